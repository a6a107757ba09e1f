"""What travels between tasks: queries whose shuffles once grew faster than they had to."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import candidates
from quarry.plans import datasets, evaluation
from quarry.sources.tables import Tables


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_language_audit_counts_before_the_outer_join(spark, tmp_path):
    rows = [(1, "en", "in the end"), (2, "en", "no"), (3, "fr", "les les les"), (4, "fr", "et les amis"), (5, "xx", " the ")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = datasets.language_audit(Tables(spark, str(tmp_path)))
    assert {r.lang: r.n for r in found.collect()} == {"en": 1, "fr": 2, "de": 0, "es": 0, "it": 0}
    lines = _plan(found)
    outer = next(i for i, line in enumerate(lines) if "LeftOuter" in line)
    assert any("Aggregate" in line for line in lines[outer + 1 :])


def test_similar_sets_joins_hashes_of_prefixes_only(spark):
    sets = spark.createDataFrame([(1, ["a b c d", "b c d e", "c d e f"]), (2, ["a b c d", "b c d e", "c d e f", "x"]), (3, ["y"]), (4, []), (5, None)], "id long, grams array<string>")
    found = candidates.similar_sets(sets, 0.7)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 0.75)]
    assert "string" not in {f.dataType.simpleString() for f in candidates.similar_sets(sets, 0.7).schema}
    assert not any("gram" in line and "string" in line for line in found._jdf.queryExecution().logical().toString().splitlines())
    files = [f for f in found.inputFiles() if "/ordered/" in f]
    assert files and spark.read.parquet(*files).schema["grams"].dataType.simpleString() == "array<bigint>"


def _groups(seed: int) -> list[tuple[int, list[str]]]:
    """Groups of near sets, large and small, some of which share grams with sets of other groups; the same set twice."""
    rng, out = random.Random(seed), []
    for size in (60, 9, 2, 2, 1, 1, 1):
        base = [f"{size} {len(out)} {k}" for k in range(rng.randrange(20, 40))]
        for _ in range(size):
            own = {g for g in base if rng.random() < 0.95} | {f"common {k}" for k in range(6) if rng.random() < 0.15} | {f"own {len(out)} {k}" for k in range(rng.randrange(3))}
            out.append(sorted(own))
    return list(enumerate([*out, out[0]]))


@pytest.mark.parametrize("few, grams, sets", [(32, 1 << 19, 4096), (1, 100, 5), (3, 1 << 19, 4), (10**6, 1, 1)])
def test_similar_sets_by_pairs_and_in_blocks(spark, monkeypatch, few, grams, sets):
    """By pairs, in blocks of all sizes, or both: all pairs, each once."""
    for k, v in {"FEW": few, "GRAMS": grams, "SETS": sets}.items():
        monkeypatch.setattr(candidates, k, v)
    rows, least = _groups(few), 0.7
    found = [tuple(r) for r in candidates.similar_sets(spark.createDataFrame(rows, "id long, grams array<string>"), least).collect()]
    want = {(i, j): round(len(set(a) & set(b)) / len(set(a) | set(b)), 9) for i, a in rows for j, b in rows if i < j and a and b}
    want = {k: v for k, v in want.items() if v >= least}
    assert len(found) == len(want) > 500 and {(a, b): v for a, b, v in found} == want


def test_sets_of_a_near_group_do_not_travel_with_each_pair(spark):
    """A set goes to a few tasks, whatever the number of sets that it is near to, and not at all if it shares too little."""
    base = [f"w{k}" for k in range(60)]
    group = [(i, [*base[: i % 5], *base[i % 5 + 1 :], f"own {i}"]) for i in range(200)]
    apart = [(1000 + i, [f"{i} {k}" for k in range(50)] + [f"passage {i % 10} {k}" for k in range(5)]) for i in range(100)]
    found = candidates.similar_sets(spark.createDataFrame(group + apart, "id long, grams array<string>"), 0.7)
    assert found.count() == 200 * 199 // 2
    files = [f for f in found.inputFiles() if "/tasks/" in f]
    assert files
    travels = {r.id: r["count"] for r in spark.read.parquet(*files).groupBy("id").count().collect()}
    assert set(travels) == {i for i, _ in group} and max(travels.values()) <= 8


def test_near_copies_leaves_texts_where_they_are(spark, tmp_path):
    """Copies are told apart by keys, so that neither texts nor words are dealt out; odd texts as in SQL."""
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), "\t" + "\n".join(words).upper() + " \x0b", " ".join(words[1:]), "x " + " ".join(words), "a b", "A  B ", "a b c", "", None, " \f ", "\u00a0", "a\u00a0b"]
    spark.createDataFrame(list(enumerate(texts, 5)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = datasets.near_copies(Tables(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in found.collect()) == [(5, 7, 2, 1, round(36 / 37, 9)), (5, 8, 2, 1, round(37 / 38, 9)), (7, 8, 1, 1, round(36 / 38, 9))]
    assert not any("documents.parquet" in f for f in found.inputFiles())


PRIVATE = ["", None, "nothing here", "a.b+c@d-e.org x@y", "id 11010519900307123X and 110105199003071234", "订单号: AB-123456", "订单流水号是ZX-99999 订单", "包裹号：SF-1234567", "快递编号 K1234567", "运单号:YT12345678",
           "call +86 138-1234-5678 or 13812345678", "138 1234", "住在上海市浦东新区世纪大道100号", "北京市", "广东省深圳市南山区", "内蒙古锡林郭勒盟正蓝旗", "﷐ kept ﷑", "姓名：王小明", "我叫李雷", "账号: abc_123", "x 1234567890 y", "12345678901234567",
           "地址：某处三楼，好", "收货地址: 甲乙丙", "[ADDRESS] 上海市浦东新区", "  padded  ", "微信号 wx_1"]


def test_texts_without_what_patterns_need_skip_them(spark):
    """The same as all patterns on every text, which only texts that may match are put through."""
    df = spark.createDataFrame([(t,) for t in PRIVATE] + [(f"{a} {b}",) for a in PRIVATE[2:] for b in PRIVATE[2:9]], "t string")
    t = F.col("t")
    topic = X._redacted(t)
    for pattern, token in X.LABELLED:
        topic = F.regexp_replace(topic, pattern, "$1" + token)
    topic = F.when(F.trim(F.coalesce(t, F.lit(""))) != "", F.regexp_replace(topic, r"^\s+|\s+$", ""))
    kinds = F.filter(F.array(*(F.when(t.rlike(p), k) for k, p in X.REDACTIONS.items()), F.when(F.contains(X._redacted(t), F.lit("[ADDRESS]")) & ~F.contains(t, F.lit("[ADDRESS]")), "address")), lambda k: k.isNotNull())
    got = df.select("t", X.redact(t).alias("r"), X._redacted(t).alias("r0"), X.topic_input(t).alias("i"), topic.alias("i0"), X.private_kinds(t).alias("k"), kinds.alias("k0"), X._may_match(t, X.NEEDED, X.DIGITS).alias("m")).collect()
    assert all((x.r, x.i, x.k) == (x.r0, x.i0, x.k0) for x in got) and {k for x in got for k in x.k} == {*X.REDACTIONS, "address"}
    assert [x.m for x in got if x.t in ("nothing here", "138 1234")] == [False, True]


def test_wanted_is_met_before_texts_travel(spark, tmp_path):
    spark.createDataFrame([(1, "red fox"), (2, "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "a red fox ran"), (8, "fox red"), (9, "red")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = evaluation._wanted(Tables(spark, str(tmp_path)))
    assert [tuple(r) for r in found.collect()] == [(1, 7)]
    assert not any("Aggregate" in line or "Generate" in line for line in _plan(found))
