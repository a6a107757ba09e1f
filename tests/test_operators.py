"""Inline fixtures for what the SQL comparison doesn't reach."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays as A
from quarry.functions import text as X
from quarry.operators import merge, metrics, mining, relational, traces, windows
from quarry.operators.graph import components
from quarry.sources import knowledge as K
from quarry.streaming import events as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_redaction(spark):
    text = "身份证11010519900307123X 邮箱 a.b@c.cn 订单号: AB12345678 运单号 SF1234567 电话138-0013-8000 住杭州市西湖区文三路 100 号 在北京市"
    got = one(spark, X.redact(F.lit(text)))
    for mark in ("[EMAIL]", "[ORDER]", "[TRACKING]", "[PHONE]", "[ADDRESS]"):
        assert mark in got
    assert "在北京市" in got and "文三路" not in got
    assert one(spark, X.redact(F.lit(None).cast("string"))) == ""
    assert one(spark, X.private_kinds(F.lit("x 13800138000 a@b.cc"))) == ["email", "phone"]
    assert one(spark, X.redact(F.lit("订单 138001380001234"))) == "订单 138001380001234"


def test_sentences(spark):
    cut = lambda s: one(spark, X.sentences(F.lit(s)))
    assert cut("It costs 3.5 euro. Really? “Yes!” ok") == ["It costs 3.5 euro.", "Really?", "“Yes!”", "ok"]
    assert cut("甲。乙！丙") == ["甲。", "乙！", "丙"]
    assert cut("") == [] and cut("a\n\nb…… c") == ["a", "b……", "c"]


def test_ratio_and_text(spark):
    assert one(spark, X.ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    assert one(spark, X.token_estimate(F.lit(""))) == 0 and one(spark, X.token_estimate(F.lit("a"))) == 1
    assert one(spark, X.whole_identifier(F.lit("order AB-12 sent"), "AB-12")) and not one(spark, X.whole_identifier(F.lit("AB-123"), "AB-12"))
    assert one(spark, X.citations(F.lit("a [1] b [23]"))) == [1, 23]
    assert one(spark, A.json_object(F.lit('x {"k": 3} y'), "k INT")).k == 3 and one(spark, A.json_object(F.lit("none"), "k INT")) is None


def test_markdown_chunks(spark):
    rows = "\n".join(f"| {i} | v |" for i in range(45))
    text = f"before\n# Top\nintro one. Intro two.\n## Part\n```\n# not a heading | x\n```\n| a | b |\n|---|---|\n{rows}\n## Part\nlast"
    files = spark.createDataFrame([("f.md", text)], "path string, text string")
    blocks = K.sections(files).collect()
    assert [(b.section_path, b.kind) for b in blocks] == [("Top", "text"), ("Top > Part", "code"), ("Top > Part", "table"), ("Top > Part", "text")]
    found = K.chunks(K.sections(files), K.Budget.of(512)).orderBy("section_path", "chunk_index").collect()
    tables = [c for c in found if c.kind == "table"]
    assert all(c.text.startswith("| a | b |\n|---|---|") for c in tables) and sum(c.text.count("\n") - 1 for c in tables) == 45
    assert K.Budget.of(512).text == 192 and K.Budget.of(8192).text == 6144
    assert "before" not in "".join(c.text for c in found)


def test_packing_carries_whole_sentences():
    units = [(f"s{i}", "text", 60) for i in range(5)]
    out = K._pack(units, K.Budget(512, 256, 80))
    assert [c[0] for c in out] == ["s0\ns1\ns2", "s2\ns3\ns4"]
    assert K._pack([("x", "text", 300)], K.Budget(512, 256, 80)) == [("x", "text", True)]


def test_turns(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "system", "s"), (1, 4, "assistant", " "), (1, 5, "assistant", "a"), (1, 6, "user", "tail")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r)[:3] for r in windows.build_turns(df).collect()] == [(1, 1, 5)]


def test_batches(spark):
    sizes = [10] * 9 + [7000, 10]
    rows = [(1, 2 * i, 2 * i + 1, "q" * (n // 2), "a" * (n - n // 2)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, question long, answer long, question_text string, answer_text string")
    assert [r.batch for r in windows.pack_turns(df).orderBy("question").collect()] == [0] * 8 + [1, 2, 3]


def test_upsert_and_transition(spark):
    old = spark.createDataFrame([("a", "s", "1", "t", "vectorized"), ("b", "s", "1", "t", "vectorized"), ("c", "s", "1", "t", "superseded"), ("z", "other", "1", "t", "vectorized")], "chunk_key string, source string, content_hash string, template string, status string")
    new = spark.createDataFrame([("a", "s", "1", "t", False), ("c", "s", "1", "t", False), ("d", "s", "1", "t", True)], "chunk_key string, source string, content_hash string, template string, needs_review boolean")
    got = {r.chunk_key: (r.action, r.status) for r in merge.upsert_source(old, new).collect()}
    assert got == {"a": ("unchanged", "vectorized"), "b": ("superseded", "superseded"), "c": ("updated", "pending"), "d": ("inserted", "need_manual_review"), "z": ("untouched", "vectorized")}
    rows = spark.createDataFrame([(1, "open"), (2, "done"), (3, "open")], "k int, status string")
    want = spark.createDataFrame([(1, "done"), (2, "open")], "k int, to string")
    assert {r.k: (r.status, r.outcome) for r in merge.transition(rows, want, "k", {"open": ("done",)}).collect()} == {1: ("done", "moved"), 2: ("done", "refused"), 3: ("open", None)}


def test_dedupe_and_gates(spark):
    reason = lambda q, a, c=1.0: one(spark, mining.rejection(F.lit(q), F.lit(a), F.lit(c), ("[PHONE]",), ("maybe",)))
    assert [reason("", "long enough"), reason("q" * 201, "long enough"), reason("q", "short"), reason("q", "is that so?"), reason("q", "long enough", 0.4), reason("[PHONE]", "long enough"), reason("q", "call [PHONE]"), reason("q", "maybe it is"), reason("q", "long enough")] == [
        "missing", "too long", "too short", "question", "unsure", "private question", "private answer", "vague", None]
    fresh = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "a"), ("k3", "a"), ("k4", "a")], "question_key string, answer_key string")
    known = spark.createDataFrame([("k3", "a"), ("k4", "x")], "question_key string, answer_key string")
    assert {r.question_key: r.decision for r in mining.decide(fresh, known).collect()} == {"k1": "conflict", "k2": "keep", "k3": "duplicate", "k4": "conflict"}
    items = spark.createDataFrame([("a", [1.0, 0.0], [1.0, 0.0], 0), ("b", [0.9, 0.3], [1.0, 0.0], 0), ("c", [0.6, 0.8], [1.0, 0.0], 0)], "key string, question_vec array<double>, answer_vec array<double>, part int")
    assert {r.key: r.into for r in mining.merge_similar(items, "part").collect()} == {"a": "a", "b": "a", "c": "c"}


def test_metrics_nulls(spark):
    rows = spark.createDataFrame([(["a"], ["b"]), (["a"], []), ([], ["b"])], "truth array<string>, predicted array<string>")
    got = {r.label: r for r in metrics.class_metrics(metrics.confusion(rows, ["a", "b"])).collect()}
    assert got["a"].precision is None and got["a"].recall == 0 and got["b"].recall is None and got["b"].f1 is None and got["b"].precision == 0


def test_traces(spark):
    obs = spark.createDataFrame([("t", 1, None, "graph", False), ("t", 2, 1, "graph", False), ("u", 3, None, "x", True), ("u", 4, 9, "x", False)], "trace_id string, id int, parent_id int, name string, is_root boolean")
    assert sorted(r.id for r in traces.roots(obs).collect()) == [2, 3] and [r.id for r in traces.orphans(obs).collect()] == [4]
    assert one(spark, traces.finite(F.lit(float("nan")))) is None and one(spark, traces.finite(F.lit(-1.0))) is None and one(spark, traces.finite(F.lit(2.0))) == 2


def test_graph(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 5)], "a long, b long")
    assert {r.id: r.component for r in components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}


def test_limits():
    assert relational.limit_argument(500) == 500
    for bad in (0, 501, True, "5"):
        with pytest.raises(ValueError):
            relational.limit_argument(bad)


def test_arrays(spark):
    v = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, A.cosine(v, F.array(F.lit(1.0), F.lit(0.0)))) == 0 and one(spark, A.normalised(v)) == [0, 0]
    assert one(spark, A.sigmoid(F.lit(-800.0))) == 0 and one(spark, windows.best_first_second_last(F.array(*map(F.lit, range(4))))) == [0, 2, 3, 1]


def _run(stream, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash((stream, mode)))}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(q.name).collect()


def test_streams(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2")]
    more = [(1, 3, "assistant", "b"), (1, 1, "assistant", "late"), (2, 0, "user", "x")]
    folder = str(tmp_path / "m")
    for part in (rows, more):
        spark.createDataFrame(part, S.MESSAGES).coalesce(1).write.mode("append").parquet(folder)
    got = sorted(tuple(r) for r in _run(S.turns(S.read(spark, folder, S.MESSAGES)), "append"))
    assert got in ([(1, 0, 1), (1, 2, 3)], [(1, 0, 1), (1, 2, 3)])
    events = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts, id % 3 AS user_id, 'view' AS event_type, 1D AS value, '{}' AS props FROM range(48)")
    folder = str(tmp_path / "e")
    events.union(events.limit(5)).coalesce(1).write.parquet(folder)
    stream = S.distinct_events(S.read(spark, folder, S.EVENTS))
    assert sum(r.n for r in _run(S.day_trend(stream), "complete")) == 48
    assert sum(r.n for r in _run(S.sliding_counts(stream), "complete")) == 4 * 48
    sink = str(tmp_path / "out")
    write = S.upsert_sink(sink, "event_id")
    write(events.limit(10), 0)
    write(events.limit(10), 0)
    write(events.limit(12), 1)
    assert spark.read.parquet(sink).count() == 12


def test_quantiles_over_ranges(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 1, 9, 1000)] + [("b", None), (None, 2.0), (None, 4.0), ("c", 7.0), ("c", None)]
    found = windows.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", half=0.5, most=0.95)
    got = {r.g: (r.half, None if r.most is None else round(r.most, 9)) for r in found.collect()}
    assert got == {"a": (3.0, 752.25), "b": (None, None), None: (3.0, 3.9), "c": (7.0, 7.0)}
    empty = spark.createDataFrame([], "g string, v double")
    assert windows.quantiles(empty, "g", "v", half=0.5).columns == ["g", "half"] and not windows.quantiles(empty, "g", "v", half=0.5).collect()


def test_streams_go_on_over_arrow_batches(spark):
    """Batches of three rows cut conversations and sections anywhere; the results are those of one batch."""
    turns = [(c, q, q + 1, "x" * (50 + 13 * c), "y" * (700 if q % 5 else 7000)) for c in range(4) for q in range(0, 40, 2)]
    turns = spark.createDataFrame(turns, "conv_id long, question long, answer long, question_text string, answer_text string")
    text = "# A\n" + "Some words of a sentence. " * 60 + "\n\n| a | b |\n|-|-|\n" + "| 1 | 2 |\n" * 30 + "\n## B\n" + "More words stand here. " * 70
    files = spark.createDataFrame([(f"f{i}", text * (i + 1)) for i in range(3)], "path string, text string")
    both = lambda: (sorted(windows.pack_turns(turns).collect()), sorted(K.chunks(K.sections(files), K.Budget.of(512)).select("path", "section_path", "chunk_index", "content_hash").collect()))
    whole, key = both(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert both() == whole
    finally:
        spark.conf.set(key, before)
    assert len(whole[0]) == 80 and max(r.batch for r in whole[0]) > 4 and len(whole[1]) > 12
