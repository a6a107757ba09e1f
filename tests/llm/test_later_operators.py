"""Hard negatives, syncmer fingerprints and resampling towards a target against brute-force versions, and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import decontamination, fingerprints, hard_negatives, oracle, queries, substrings, target_resampling, token_rollups
from tests.llm import helpers as H

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_target_resampling"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = queries.queries()[name](spark, SMALL)
    cur = con.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(cur.fetchall(), key=str)


# ---------------------------------------------------------------- op11

VECTORS = "vec_id long, embedding array<double>, label int"


def negatives(rows, anchors, positives, k, lowest, highest, scale=256):
    """Each anchor against every row, one by one."""
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        scaled = [math.floor(scale * x) for x in v]
        held[i] = min(held.get(i, (label, scaled)), (label, scaled))
    out = []
    for a in filter(held.__contains__, anchors):
        label, v = held[a]
        scores = [(-sum(x * y for x, y in zip(v, w)), i, kind) for i, (kind, w) in held.items() if i != a and len(w) == len(v)]
        for p, i, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            fit = [(s, j) for s, j, kind in sorted(scores) if kind != label and lowest * -p <= 100 * -s <= highest * -p]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit[:k], 1)]
    return sorted(out)


def vectors(seed, n, dims=6, labels=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, rng.gauss(0.2, 0.5)]) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]
    rows += [(n + j, rows[j][1], rows[j][2]) for j in range(9)]  # copies, so ties
    bad = [(None, [1.0] * dims, 0), (1000, None, 0), (1001, [None] + [1.0] * (dims - 1), 0), (1002, [math.nan] * dims, 0), (1003, [math.inf] * dims, 0), (1004, [1.0] * dims, None), (1005, [1.0], 0), (1006, [0.5], 0), (1007, [0.25], 1), (1008, [], 1), (3, [0.9] * dims, 0)]
    return rows + bad + [rows[4]]


@pytest.mark.parametrize("rows_in_group,anchors", [(8192, 4096), (7, 2)])
def test_hard_negatives(spark, monkeypatch, rows_in_group, anchors):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_in_group)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rows = vectors(1, 90)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit(1), "anchor": F.lit("x"), "id": F.lit(None), "v": F.lit(0)})
    asked = [r[0] for r in rows if r[0] is not None and r[0] % 5 == 0]
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, positives=3, k=4, lowest=20, highest=95)
    got = sorted(map(tuple, found.collect()))
    assert got == negatives(rows, dict.fromkeys(asked), 3, 4, 20, 95)
    assert len(got) > 50 and found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_odd(spark):
    none = hard_negatives.hard_negatives
    empty = spark.createDataFrame([], VECTORS)
    assert none(empty, F.col("vec_id") % 5 == 0).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (3, [0.6, 0.0], 1), (4, [1e300, -1e300], 1)], VECTORS)
    assert none(few, F.lit(False)).count() == 0 and none(few, F.lit(None).cast("boolean")).count() == 0
    got = none(few, F.col("vec_id") == 1, k=3, lowest=-10_000, highest=10_000).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(2, 3)]  # the fourth scores above 100 times the positive
    assert none(few, F.col("vec_id") == 4).count() == 0  # no other row of its label has a score above 0


def test_scores_exact():
    big = np.array([[2**27, 2**27 - 1, 3]])
    assert hard_negatives._scores(big, big).tolist() == [[2**54 + (2**27 - 1) ** 2 + 9]]
    small = np.array([[3, -4]])
    assert hard_negatives._scores(small, small).tolist() == [[25]]


# ---------------------------------------------------------------- op12


def _hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def syncmers(text):
    """(position, code) of each k-mer whose smallest inner hash lies at an edge, k-mer by k-mer."""
    k, s = fingerprints.K, fingerprints.S
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    out = []
    for p in range(len(text) - k + 1):
        inner = [signed(_hash(text[p + j : p + j + s].encode())) for j in range(k - s + 1)]
        if min(inner[0], inner[-1]) <= min(inner[1:-1]):
            pair = _hash(inner[-1].to_bytes(8, "little", signed=True), _hash(inner[0].to_bytes(8, "little", signed=True)))
            out.append((p, pair >> 32))
    return out


def fingerprint(text):
    found = sorted({c for _, c in syncmers(text)})[: fingerprints.SIZE]
    return found or ([_hash(text.encode()) >> 32] if text else [])


def likeness(a, b):
    union = sorted(set(a) | set(b))[: fingerprints.SIZE]
    return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)


def expected(rows):
    rows = sorted(((i is None, i or 0), t or "") for i, t in rows)
    out = []
    for at, ((null, i), text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(after)
        hexed = lambda f: "".join(f"{x:08x}" for x in f)
        out.append((None if null else i, len(text), sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [4096, 50])
def test_fingerprints(spark, monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    rng = random.Random(3)
    rows = [(i * 7 - 50, t) for i, t in H.corpus(groups=2, copies=4)]
    rows += [(10**15, "日本語のテキスト" * 30), (10**15, "é🙂" * 60), (None, "last of all " * 9), (None, None), (rows[0][0], rows[0][1]), (-(10**12), "x" * 19), (7777, "y" * 20)]
    rows += [(9000 + i, "".join(rng.choice("ab \n") for _ in range(n))) for i, n in enumerate((19, 20, 21, 26, 27, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit("x"), "_range": F.lit(3), "_n": F.lit(0)})
    got = sorted(map(tuple, fingerprints.fingerprints(df.repartition(5)).collect()), key=str)
    assert got == expected(rows)


def test_fingerprints_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a single document that follows itself, as there is no other")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 59
    long = fingerprints.fingerprints(spark.createDataFrame([(1, H.prose(random.Random(1), 400_000, 10**6)), (2, " " * 1_000_000), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert long[0].n_chars > 2_500_000 and [r.n_chars for r in long[1:]] == [1_000_000, 0] and long[2].fingerprint == "" and long[0].near_edited > 0.5


def test_anchors(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PIECE", 40)
    texts = [(1, "a passage that stands in both of the two texts, word for word"), (2, "before it: a passage that stands in both of the two texts, word for word"), (3, ""), (4, None)]
    got = fingerprints.anchors(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.position, r.code) for r in got) == sorted((i, p, c) for i, t in texts for p, c in syncmers(t or ""))
    first, second = ({(r.position - 11 * (r.doc_id - 1), r.code) for r in got if r.doc_id == i} for i in (1, 2))
    assert first <= second and first  # the same anchors at the same distance


# ---------------------------------------------------------------- op13

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled(docs, target, longest, buckets, least, percent, seed):
    def features(text):
        w = WORDS.findall(H.lower(text))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    every = [(i, *features(t)) for i, t in docs]
    s, t = sum((f for _, _, f in every), Counter()), sum((features(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, words, f in every:
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in f.items()) // f.total() if f else 0
        rows.append((i, words, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = Counter()
    out = [(i, n, w, sc, r) for r, (i, _, n, w, sc) in enumerate(fit[: percent * len(fit) // 100], 1)]
    drawn.update((i, n, w, sc) for i, n, w, sc, _ in out)
    for i, _, n, w, sc in rows:
        if drawn[(i, n, w, sc)]:
            drawn[(i, n, w, sc)] -= 1
        else:
            out.append((i, n, w, sc, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("longest,at_once", [(1, 1 << 20), (3, 100)])
def test_resampling(spark, monkeypatch, longest, at_once):
    monkeypatch.setattr(target_resampling, "AT_ONCE", at_once)
    docs = H.corpus(groups=3)
    docs += [(None, "no id but words " * 20), (None, "no id but words " * 20), (7, "ÄÖ-ü X1 \x00 z9 " * 15), docs[0], docs[0], (500, "w" * 70 + " " + "v" * 200)]
    target = ["w1 w2 w3 W4, w5", None, "", "ünï 日本 w1-w2"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(0), "_in": F.lit(1)}).repartition(3)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = target_resampling.resample(df, goal, longest, 97, 15, 30, 11)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target, longest, 97, 15, 30, 11)
    ids = {r.doc_id for r in got.where("rank IS NOT NULL AND doc_id IS NOT NULL").collect()}
    taken = target_resampling.take(df, got)
    assert taken.columns == df.columns and {r.doc_id for r in taken.collect()} == ids


def test_resampling_odd(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    assert target_resampling.resample(none, some).count() == 0
    assert target_resampling.resample(none, none).count() == 0
    got = target_resampling.resample(some, none, least_words=0, percent=100).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3] and {r.doc_id: r.n_features for r in got} == {1: 3, 2: 0, 3: 0}
    long = target_resampling.resample(spark.createDataFrame([(1, "word " * 2_000_000), (2, "x" * 10_000_000), (3, " " * 10_000_000)], "doc_id long, text string"), some)
    assert {r.doc_id: r.n_features for r in long.collect()} == {1: 2_000_000, 2: 1, 3: 0}


def test_crc32():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 7, 64, 65, 300)]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    assert target_resampling.crc32(data, ends - [len(p) for p in parts], ends).tolist() == [zlib.crc32(p) for p in parts]


# ---------------------------------------------------------------- op7


def test_long_runs(spark):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng, n = random.Random(2), token_rollups.LONG_RUN
    white = ["".join(rng.choice(" \n\t\u3000\xa0") for _ in range(m)) for m in (n - 1, n, n + 1, 3 * n)]
    texts = [f"{a}{w}{b}" for w in white for a in ("", "left.", "x ") for b in ("", "right", "\u3000\x1c?", "'s")] + ["".join(f"w{i}{w}" for i, w in enumerate(white)), " " * n + "a" + " " * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in token_rollups.count_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    huge = spark.createDataFrame([(i, c) for i, c in enumerate((" ", "a", "7", "-", "日"))], "doc_id long, c string").selectExpr("doc_id", "repeat(c, 3000000) AS text")
    got = {r.doc_id: r.tokens for r in token_rollups.count_tokens(huge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got[0] == len(other.encode(" " * 3000, add_special_tokens=False).ids) * 1000 and all(got.values())


def test_batch_of_another_content(spark, tmp_path, monkeypatch):
    r = token_rollups.TokenRollup(spark, f"file://{tmp_path}/r")
    change = lambda n: spark.createDataFrame([("insert", "s", "en", "t", n, None)], "action string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    assert r.commit("a", change(3), strict=True) and not r.commit("a", change(3), strict=True)
    for _ in range(2):
        with pytest.raises(ValueError, match="other content"):
            r.commit("a", change(4), strict=True)
        with pytest.warns(UserWarning, match="other content"):
            assert not r.commit("a", change(4))
        r.compact()  # the digest stays, in the base
    assert r.compact() and not r.commit("a", change(3), strict=True)
    # Two writers, both past the look: the second finds the name taken.
    seen = r._digest_of
    answers = iter([None])
    monkeypatch.setattr(r, "_digest_of", lambda batch: next(answers) if batch == "b" and r.__dict__.setdefault("late", []) == [] and not r.late.append(1) else seen(batch))
    token_rollups.TokenRollup(spark, r.path).commit("b", change(5))
    assert not r.commit("b", change(5), strict=True)
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 2, 8)]


# ---------------------------------------------------------------- op9


def test_many_planted_items(spark):
    """One text made of items, against thousands of them: work follows what is near, not windows times items."""
    rng = random.Random(1)
    items = [(i, H.prose(rng, 50, 20_000)) for i in range(1500)]
    planted = rng.sample(range(1500), 60)
    text = " ".join(f"{items[i][1]} {H.prose(rng, 5, 20_000)}" for i in planted)
    same = "boiler plate that stands in all of these items and in no other text at all"
    items += [(2000 + i, f"{same} {H.prose(rng, 30, 20_000)}") for i in range(200)]
    docs = spark.createDataFrame([(1, text), (2, f"{same} {H.prose(rng, 100, 20_000)}"), (3, items[1500][1])], "doc_id long, text string")
    found = decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, i) for i in planted} | {(3, 2000)}


def test_telling_shingles():
    """No pair that is similar enough lacks all telling shingles of its item."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        h = rng.choice(200, 20, replace=False)
        rows.append((i, 24, h.astype(np.int64), 1 + (rng.random(20) < 0.1), 1 + h % 7))
    index = decontamination.Items(rows, 5, 40, 0.7)
    met = 0
    for _, _, h, _, _ in rows:
        for drop in range(1, 9):
            window = np.concatenate([h[drop:], 1000 + np.arange(drop)]).astype(np.uint64)
            weight = np.where(window < 1000, np.log1p(40 / (1 + window % 7)), index.rare)
            for item in range(40):
                if index.similarity(item, window, weight) >= 0.7:
                    met += 1
                    assert item in index.find(window)[1]
    assert met > 40


# ---------------------------------------------------------------- op8


def test_suffix_array():
    """Sorted suffixes, and the words that neighbours share, against a sort of tuples."""
    rng, n = random.Random(6), 3
    contexts = [(rng.randrange(3), [rng.randrange(1, 4) for _ in range(rng.randrange(n, 12))]) for _ in range(60)]
    words = [np.array(w, np.uint64).tobytes() for _, w in contexts]
    anchor = np.array([a for a, _ in contexts], np.int64)
    of, place, common = substrings.suffix_array(anchor, words, n)
    suffixes = [(contexts[c][0], *contexts[c][1][p:]) for c, p in zip(of.tolist(), place.tolist())]
    assert sorted(zip(of.tolist(), place.tolist())) == [(c, p) for c, (_, w) in enumerate(contexts) for p in range(len(w) - n + 1)]
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0] + [max(0, shared(a, b) - 1) for a, b in zip(suffixes, suffixes[1:])]
    # What shares n words stands together, so each such run is in one stretch.
    seen = Counter(s[: n + 1] for s in suffixes)
    stretches = np.split(np.arange(len(of)), np.flatnonzero(common < n)[1:])
    assert sorted(map(len, stretches)) == sorted(seen.values())
