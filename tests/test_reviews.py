"""Review matching, dataset assembly, JSON lines and scheduled runs against brute-force and sequential versions."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import candidates, mining, splits, windows
from quarry.sources import jsonl
from quarry.streaming import events as S
from quarry.streaming.runs import ScheduledJob


def grams(text):
    compact = "".join((text or "").lower().split())
    return {compact[i : i + 2] for i in range(len(compact) - 1)}


def jaccard(a, b):
    return round(len(a & b) / len(a | b), 9) if a and b else -1.0


def questions(seed=2, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randrange(2, 8)))
    base = [[word() for _ in range(rng.randrange(2, 12))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + ["", None, " ", "x", "X ", "xy", "same text", "Same  Text", "z" * 5000]


@pytest.mark.parametrize("least", [0.95, 0.6, 0.3, 0.05])
def test_similar_sets(spark, least):
    sets = [(i, sorted(grams(t)) or None) for i, t in enumerate(questions())] + [(500, []), (501, ["only one"])]
    got = {(r.a, r.b): r.jaccard for r in candidates.similar_sets(spark.createDataFrame(sets, "id long, grams array<string>"), least).collect()}
    want = {(i, j): jaccard(set(a or ()), set(b or ())) for i, a in sets for j, b in sets if i < j}
    assert got == {k: v for k, v in want.items() if v >= least} and got
    assert candidates.similar_sets(spark.createDataFrame([], "id long, grams array<string>"), least).count() == 0


def test_best_matches(spark):
    texts = list(enumerate(questions()))
    got = {(r.id, r.other): (r.jaccard, r.score, r.rank) for r in candidates.best_matches(spark.createDataFrame(texts, "id long, text string"), 0.3, 4).collect()}
    want = {}
    for i, t in texts:
        near = sorted((-jaccard(grams(t), grams(u)), j) for j, u in texts if j < i and jaccard(grams(t), grams(u)) >= 0.3)[:4]
        scored = sorted((-round(-s + SequenceMatcher(None, t, texts[j][1]).ratio(), 9), j, -s) for s, j in near)
        want |= {(i, j): (s, -score, rank) for rank, (score, j, s) in enumerate(scored, 1)}
    assert got == want and max(Counter(i for i, _ in want).values()) == 4


def test_organise(spark):
    texts = list(enumerate(questions(5)))
    random.Random(1).shuffle(texts)
    opened, want = {}, {}
    for i, t in sorted(texts):
        text = (t or "").strip(" ")
        if not 0 < len(text) <= 4000:
            want[i] = ("failed", None)
            continue
        own, short = grams(text), "".join(text.lower().split())
        near = [(-jaccard(own, g) if own else -float(short == s), j) for j, (g, s) in opened.items()]
        best = min((x for x in near if -x[0] >= 0.4), default=None)
        if best is None:
            opened[i] = (own, short)
        want[i] = ("created", i) if best is None else ("merged", best[1])
    got = {r.id: (r.outcome, r.review) for r in mining.organise(spark.createDataFrame(texts, "id long, text string"), 0.4).collect()}
    assert got == want and Counter(o for o, _ in want.values()).keys() == {"failed", "created", "merged"}


def assembled(rows, total, shares, cap, cover):
    """Row by row, as a script would go through them."""
    place = lambda i: sha256(f"seed{i}".encode()).hexdigest()
    reason, seen, held = {}, set(), Counter()
    for i, group, key, labels, must in sorted(rows, key=lambda r: (not r[4], r[0])):
        if key is not None and key in seen:
            reason[i] = "duplicate"
            continue
        seen.add(key)
        held[group] += 1
        if held[group] > cap:
            reason[i] = "cap"
    left, covering = [r for r in rows if r[0] not in reason], set()
    for label in {r[3][0] for r in left if len(r[3]) == 1}:
        groups = set()
        for r in sorted((r for r in left if r[3] == [label]), key=lambda r: (not r[4], place(r[0]))):
            if r[1] not in groups and len(groups) < cover:
                groups.add(r[1])
                covering.add(r[0])
    limit, chosen = splits.quotas(total, shares), set()
    for n, most in limit.items():
        own = sorted((r for r in left if len(r[3]) == n), key=lambda r: (not r[4], r[0] not in covering, place(r[0])))
        chosen |= {r[0] for r in own[:most]}
    return {r[0]: (len(r[3]), r[0] in chosen, reason.get(r[0]) or (None if r[0] in chosen else "quota" if len(r[3]) in limit else "unwanted")) for r in rows}


@pytest.mark.parametrize("total,cover", [(60, 5), (25, 100), (500, 3)])
def test_assemble(spark, total, cover):
    rng = random.Random(total)
    labels = [[], ["a"], ["a"], ["a"], ["b"], ["a", "b"], ["a", "c"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    rows = [(i, f"g{rng.randrange(25)}", rng.choice([None, f"k{i}", f"k{i}", f"k{i % 20}"]), rng.choice(labels), rng.random() < 0.1) for i in range(220)]
    df = spark.createDataFrame(rows, "id long, group string, key string, labels array<string>, mandatory boolean")
    got = {r.id: (r.n_labels, r.chosen, r.reason) for r in splits.assemble(df, total, {1: 0.6, 2: 0.3, 3: 0.1}, 4, cover).collect()}
    assert got == assembled(rows, total, {1: 0.6, 2: 0.3, 3: 0.1}, 4, cover)
    chosen = [r for r in rows if got[r[0]][1]]
    assert len(chosen) <= total and max(Counter(r[1] for r in chosen).values()) <= 4
    assert all(sum(len(r[3]) == n for r in chosen) <= most for n, most in splits.quotas(total, {1: 0.6, 2: 0.3, 3: 0.1}).items())


def test_quotas():
    assert splits.quotas(10, {1: 1, 2: 1, 3: 1}) == {1: 4, 2: 3, 3: 3} and splits.quotas(0, {1: 0.5, 2: 0.5}) == {1: 0, 2: 0}
    for total in range(50):
        assert sum(splits.quotas(total, {1: 0.65, 2: 0.3, 3: 0.05}).values()) == total


# ---------------------------------------------------------------- JSON lines


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n   \nnot json\n{"id": "two"}\n{"id": 3, "more": [1]}\n')
    got = jsonl.read_lines(spark, str(tmp_path), "id long, t string").cache()
    assert sorted(((r.id, r.t, r[jsonl.BAD] is not None) for r in got.collect()), key=str) == [(1, "x", False), (3, None, False), (None, None, True), (None, None, True)]


def test_parse_lines(spark):
    texts = ['{"k": 1}', '```json\n{"k": 2}\n```', '  ```\n[1, 2]\n``` ', "", " \n", None, "plain", "```\nplain\n```", "3", '{"k": 1', "null"]
    got = jsonl.parse_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t")
    rows = {r.i: (r.status, r.k) for r in got.select("i", "status", F.try_variant_get("value", "$.k", "int").alias("k")).collect()}
    assert rows == {0: ("object", 1), 1: ("object", 2), 2: ("other", None), 6: ("bad", None), 7: ("bad", None), 8: ("other", None), 9: ("bad", None), 10: ("other", None)}


def test_checked_citations(spark):
    cases = [("a [1] b [2] [1]", [1, 2, 3]), ("a [4]", [1]), ("none", [1]), ("x [7] y［8］\t[9].", []), ("x", None), (None, [1]), (None, None), ("[99999999999]", [1]), ("[1] [99999999999]", [1])]
    df = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(cases)], "i int, a string, p array<int>").select("i", X.checked_citations(F.col("a"), F.col("p")).alias("c"))
    got = [tuple(r.c) for r in df.orderBy("i").collect()]
    refused = ("refused", [], None)
    assert got == [("cited", [1, 2], cases[0][0]), refused, refused, ("plain", [], "x y."), ("plain", [], "x"), refused, ("plain", [], ""), refused, refused]


# ---------------------------------------------------------------- scheduled runs and keyed sinks


def test_scheduled_runs(spark, tmp_path):
    """A run takes what is new; one without input adds nothing; what a run that died had begun is done once."""
    folder, rows = str(tmp_path / "in"), lambda a, b: spark.range(a, b).withColumnRenamed("id", "n").coalesce(1)
    rows(0, 10).write.mode("append").parquet(folder)
    fail = []

    def transform(batch):
        if fail:
            batch.limit(1).write.mode("append").parquet(str(tmp_path / "trace"))
            raise RuntimeError("died")
        return batch.where("n % 2 = 0")

    job = ScheduledJob(spark, str(tmp_path / "job"), transform)
    source = lambda: S.read(spark, folder, "n long")
    job.run(source(), 1)
    job.run(source(), 2)
    rows(10, 14).write.mode("append").parquet(folder)
    fail.append(1)
    with pytest.raises(Exception, match="died"):
        job.run(source(), 3)
    rows(14, 20).write.mode("append").parquet(folder)
    fail.clear()
    job.run(source(), 4)
    job.run(source(), 5)
    assert sorted((r.run, r.rows_in, r.rows_out) for r in job.runs().collect()) == [(1, 10, 5), (2, 0, 0), (4, 10, 5), (5, 0, 0)]
    assert sorted(r.n for r in job.output().collect()) == list(range(0, 20, 2))


def test_sink_reads_its_parts(spark, tmp_path):
    path = str(tmp_path / "out")
    write = S.upsert_sink(path, "k", parts=16)
    rows = lambda *k: spark.createDataFrame([(x, f"v{x}") for x in k], "k long, v string")
    write(rows(*range(40), 3, 4), 0)
    write(rows(*range(40)), 0)  # replayed
    assert spark.read.parquet(path).count() == 40
    own = rows(5).select(F.pmod(F.xxhash64("k"), F.lit(16))).first()[0]
    for part in (tmp_path / "out").glob("part=*"):  # the other folders aren't needed
        if part.name != f"part={own}":
            part.rename(tmp_path / part.name)
    write(rows(5), 1)
    assert spark.read.parquet(path).where("batch = 1").count() == 0
    new = next(k for k in range(100, 1000) if rows(k).select(F.pmod(F.xxhash64("k"), F.lit(16))).first()[0] == own)
    write(rows(new, 5), 2)
    assert [r.k for r in spark.read.parquet(path).where("batch = 2").collect()] == [new]


# ---------------------------------------------------------------- ranges


def test_ranges_with_an_outlier(spark):
    """One value far away, and few distinct ones, leave no range with more than twice its share of the others."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        values = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v")).union(spark.sql("SELECT 1e15D"))
        n = [r["count"] for r in windows.by_range(values, F.col("v")).groupBy("_range").count().collect()]
        assert len(n) == 32 and max(n) <= 2 * 20_001 / 32
        same = spark.range(1000).select((F.col("id") % 3).cast("double").alias("v")).union(spark.createDataFrame([(None,)], "v double"))
        by_value = defaultdict(set)
        for r in windows.by_range(same, F.col("v")).collect():
            by_value[r.v].add(r._range)
        assert all(len(x) == 1 for x in by_value.values())
        order = [next(iter(by_value[v])) for v in (None, 0.0, 1.0, 2.0)]
        assert order == sorted(order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
