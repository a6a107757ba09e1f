"""Brute-force versions for small inputs."""

import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "\t\n", "one", "two words", "é ü 日本語 words here and more of them", "x" * 5000]


def words(text):
    return SPACE.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1, groups=6, copies=12):
    """Documents with exact copies, near copies of all degrees, shared passages, and odd texts."""
    rng, out = random.Random(seed), []
    passage = prose(rng, 40)
    for _ in range(groups):
        base = prose(rng, rng.randrange(60, 160))
        out += [base] * 2 + [edited(rng, base, rng.randrange(1, 9)) for _ in range(copies)]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(5)] + [prose(rng, 50) for _ in range(10)] + ODD
    rng.shuffle(out)
    return list(enumerate(out))
