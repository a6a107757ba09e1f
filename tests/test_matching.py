"""Splits, similarity joins, greedy merging and the BM25 index against sequential and brute-force versions."""

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, mining, retrieval, similarity, splits

# ---------------------------------------------------------------- groups that share labels


def greedy_split(groups, may, share, parts, seed):
    """One pick after the other over all groups: (group: labels)."""
    place = {g: sha256(f"{seed}{g}".encode()).hexdigest() for g in groups}
    left, out = sorted(groups, key=place.get), dict.fromkeys(groups, "train")
    counts = Counter(k for labels in groups.values() for k in labels)
    for part in parts:
        covered = set()
        for _ in range(max(1, len(groups) // share)):
            score = lambda g: (all(counts[k] > 1 for k in groups[g]), sum(splits.UNIT // counts[k] for k in groups[g] - covered))  # noqa: E731, B023
            best = max((g for g in left if may[g]), key=score)  # the first of equals
            out[best] = part
            covered |= groups[best]
            left.remove(best)
            counts.subtract(groups[best])
    return out


@pytest.mark.parametrize("case", range(4))
def test_stratified_groups(spark, case):
    rng = random.Random(case)
    n = (7, 60, 150, 90)[case]
    # Rare labels, pairs of labels, groups without any; in the last case nearly all groups have a rare one, so that safe groups run out.
    kinds = [{"a"}, {"a", "b"}, {"b"}, set(), {"c"}, {"a", "c"}, {"d", "a"}] if case < 3 else [{"a", f"r{i}"} for i in range(12)] + [{"a"}]
    weights = [40, 20, 10, 3, 3, 1, 1] if case < 3 else [1] * 13
    groups = {f"g{i}": rng.choices(kinds, weights)[0] for i in range(n)}
    may = {g: case < 2 or rng.random() < 0.8 for g in groups}
    share, parts = (10, ("test", "validation")) if case < 3 else (4, ("test", "validation", "more"))
    rows = [(g, [k] if rng.random() < 0.5 else [k, None], True) for g, labels in groups.items() for k in sorted(labels)] + [(g, [], may[g]) for g in groups] + [("g0", None, True)]
    df = spark.createDataFrame(rows, "conv string, labels array<string>, fine boolean")
    got = {r.group: r.split for r in splits.stratified_groups(df, "conv", "labels", F.col("fine"), share, parts).collect()}
    assert got == greedy_split(groups, may, share, parts, "seed")
    assert Counter(got.values())["test"] == max(1, n // share)


def test_stratified_groups_refuses(spark):
    df = lambda n, fine: spark.createDataFrame([(i, ["a"], fine) for i in range(n)], "g long, labels array<string>, fine boolean")
    with pytest.raises(ValueError, match="too few for 2 parts"):
        splits.stratified_groups(df(2, True), "g", "labels")
    with pytest.raises(ValueError, match="may be held out"):
        splits.stratified_groups(df(9, False), "g", "labels", F.col("fine"))


# ---------------------------------------------------------------- independent sets and merging


@pytest.mark.parametrize("n,edges", [(40, 30), (60, 400), (30, 29)])
def test_first_independent(spark, n, edges):
    rng = random.Random(n)
    pairs = [(i, i + 1) for i in range(n - 1)] if edges == n - 1 else [(rng.randrange(n), rng.randrange(n + 3)) for _ in range(edges)]  # a chain; loops and unknown ends
    into = {}
    for i in range(n):
        kept = [j for j in range(i) if into[j] == j and ((i, j) in pairs or (j, i) in pairs)]
        into[i] = min(kept, default=i)
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    found = graph.first_independent(nodes, spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.into for r in found.collect()} == into


def test_first_independent_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert graph.first_independent(spark.createDataFrame([("x",)], "id string"), none).collect() == [("x", "x")]
    assert graph.first_independent(none.select(F.col("a").alias("id")), none).count() == 0


def cosine(a, b):
    size = math.hypot(*a) * math.hypot(*b)
    return round(sum(x * y for x, y in zip(a, b)) / size, 9)


def clusters(rng, n, dims, centres, spread):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(middle)] for _ in range(n)]


@pytest.mark.parametrize("typ,block", [("long", None), ("string", "part")])
def test_merge_similar(spark, typ, block):
    rng = random.Random(8)
    q, a = clusters(rng, 70, 4, 6, 0.35), clusters(rng, 70, 3, 4, 0.3)
    key = (lambda i: i) if typ == "long" else (lambda i: f"k{i:03}")
    rows = [(key(i), rng.choice([None, f"q{i % 9}"]), q[i] if rng.random() < 0.9 else None, rng.choice([None, f"a{i % 5}"]), a[i] if rng.random() < 0.9 else None, i % 2) for i in range(70)]
    df = spark.createDataFrame(rows, f"key {typ}, question_key string, question_vec array<double>, answer_key string, answer_vec array<double>, part int")
    vectors = [{}, {}]
    for r in rows:
        for known, k, v in ((vectors[0], r[1], r[2]), (vectors[1], r[3], r[4])):
            if k is not None and v is not None:
                known.setdefault(k, v)
    kept, into = [], {}
    for r in sorted(rows):
        own = (r[1], vectors[0].get(r[1]) if r[1] else r[2], r[3], vectors[1].get(r[3]) if r[3] else r[4], r[5])
        alike = lambda k, v, m, w, least: (k is not None and k == m) or (v is not None and w is not None and cosine(v, w) >= least)
        to = next((k for k, o in kept if (not block or o[4] == own[4]) and alike(o[0], o[1], own[0], own[1], 0.85) and alike(o[2], o[3], own[2], own[3], 0.9)), None)
        if to is None:
            kept.append((r[0], own))
        into[r[0]] = r[0] if to is None else to
    got = {r.key: r.into for r in mining.merge_similar(df, block, 0.85, 0.9).collect()}
    assert got == into and 10 < len(kept) < 65


# ---------------------------------------------------------------- vectors in cells


@pytest.mark.parametrize("least", [0.95, 0.5, -0.2])
def test_close_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "GROUP", 16)
    rng = random.Random(5)
    vectors = clusters(rng, 150, 8, 12, 0.25)
    rows = list(enumerate(vectors)) + [(200 + i, vectors[i]) for i in range(5)] + [(300, None), (301, [0.0] * 8), (302, [math.nan] * 8), (303, [1.0]), (304, [None] * 8), (None, vectors[0]), (7, [9.0] * 8)]
    held = {i: v for i, v in rows if i is not None and i < 300}
    held[7] = min(vectors[7], [9.0] * 8)
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    cells = similarity.Cells(df, k=12)
    want = {(i, j) for i in held for j in held if i < j and cosine(held[i], held[j]) >= least}
    got = [(r.a, r.b) for r in cells.pairs(least).collect()]
    assert set(got) == want and len(got) == len(want)
    if least == 0.95:
        assert cells.compared(least) < len(held) ** 2 / 4
    asked = df.where("id % 3 = 0")
    both = [(r.a, r.b) for r in cells.close_to(asked, least).collect()]
    assert sorted(both) == sorted((i, j) for i in held for j in held if i % 3 == 0 and cosine(held[i], held[j]) >= least)


def test_nearest_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GROUP", 64)
    rng = random.Random(9)
    vectors = clusters(rng, 1500, 16, 40, 0.5)
    df = spark.createDataFrame(list(enumerate(vectors)), "chunk_id long, vector array<double>")
    cells = similarity.Cells(df, "chunk_id", "vector", k=24)
    asked = df.where("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "question_id")
    rows = lambda d: {(r.question_id, r.chunk_id, r.rank) for r in d.collect()}
    exact = rows(retrieval.dense(asked, df, 10))
    assert rows(cells.nearest(asked, 10, probes=24)) == exact
    few = {x[:2] for x in rows(cells.nearest(asked, 10, probes=8))}
    assert len(few & {x[:2] for x in exact}) / len(exact) >= 0.95


def test_cells_empty(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    cells = similarity.Cells(none)
    assert cells.pairs(0.5).count() == 0 and cells.close_to(none, 0.5).count() == 0 and cells.nearest(none.withColumnRenamed("id", "question_id")).count() == 0
    lost = similarity.equivalent(spark.createDataFrame([(1, "k", None), (2, "k", None), (3, None, [0.0])], "id long, key string, vector array<double>"), 0.5)
    assert {tuple(r)[:3] for r in lost.collect()} == {(1, 2, "text"), (1, None, "text"), (3, None, "text")}


# ---------------------------------------------------------------- BM25


def brute_bm25(asked, chunks, k):
    words = {i: retrieval_terms(t) for i, t in chunks}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    out = []
    for q, text in asked:
        scores = []
        for i, w in words.items():
            tf = Counter(w)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in sorted(set(retrieval_terms(text))) if tf[t])
            if round(s, 9) > 0:
                scores.append((-round(s, 9), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def retrieval_terms(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


@pytest.mark.parametrize("shard,first", [(4096, 4), (5, 1)])
def test_bm25_index(spark, monkeypatch, shard, first):
    monkeypatch.setattr(retrieval, "CHUNKS", shard)
    monkeypatch.setattr(retrieval, "FIRST", first)
    monkeypatch.setattr(retrieval, "QUESTIONS", 7)
    rng = random.Random(4)
    words = [f"w{min(int(rng.expovariate(0.08)), 60)}" for _ in range(4000)]
    chunks = [(i, " ".join(words[at : at + rng.randrange(3, 30)])) for i, at in enumerate(range(0, 3600, 18))] + [(900, None), (901, ""), (902, "?!")]
    asked = [(i, " ".join(rng.choice(words) for _ in range(4))) for i in range(25)] + [(98, None), (99, "unknown words only")]
    index = retrieval.Bm25Index(spark.createDataFrame(chunks, "chunk_id long, text string"))
    got = sorted((r.question_id, r.chunk_id, r.score, r.rank) for r in index.search(spark.createDataFrame(asked, "question_id long, text string"), 6).collect())
    want = sorted(brute_bm25(asked, chunks, 6))
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_bm25_reads_chunks_once_and_leaves_shards_out(spark, monkeypatch, tmp_path):
    """Questions are answered after the chunks are gone; where a term is in few shards, the others aren't scored."""
    monkeypatch.setattr(retrieval, "CHUNKS", 10)
    rows = [(i, f"common words {'rare ' * 5 if i < 3 else ''}and number{i % 50}") for i in range(300)]
    spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    index = retrieval.Bm25Index(spark.read.parquet(f"{tmp_path}/c"))
    for f in (tmp_path / "c").iterdir():
        f.unlink()
    scored = []
    own = retrieval.Bm25Index._scored
    monkeypatch.setattr(retrieval.Bm25Index, "_scored", lambda self, asked, pairs, decks, k: scored.append(pairs.count()) or own(self, asked, pairs, decks, k))
    found = index.search(spark.createDataFrame([(1, "common rare")], "question_id long, text string"), 3).collect()
    assert [r.chunk_id for r in found] == [0, 1, 2] and index.postings.select("shard").distinct().count() == 30 and sum(scored) <= retrieval.FIRST
