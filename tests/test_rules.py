"""Rules that SQL can't hold against the plans: sentences, addresses, near pairs, lists, windows over ranges."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import candidates, retrieval, windows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,want", [
    ("内蒙古锡林郭勒盟多伦县", "[ADDRESS]"), ("北京市朝阳区望京街100号阳光小区3号楼", "[ADDRESS]"), ("我在杭州市", "我在杭州市"), ("香港特别行政区九龙市油尖区", "[ADDRESS]"), ("寄到杭州市西湖区文三路 100 号", "[ADDRESS]"), ("广东省天河区", "[ADDRESS]"), ("退款到账", "退款到账"),
])
def test_addresses(spark, text, want):
    assert one(spark, X.redact(F.lit(text))) == want
    assert one(spark, X.private_kinds(F.lit(text))) == (["address"] if "[ADDRESS]" in want else [])


def test_mixed_terminators_are_one_boundary(spark):
    cut = lambda s: one(spark, X.sentences(F.lit(s)))
    assert cut("真的？……好的。") == ["真的？……", "好的。"] and cut("No...!? Yes.") == ["No...!?", "Yes."] and cut("a.b 1.5 c") == ["a.b 1.5 c"]


def test_longest_sentence(spark):
    for text, want in (("", None), ("Ab. Cdefgh ij! x", "Cdefgh ij!"), ("一二三。四五六七八？", "四五六七八？"), ("one line\n\nanother longer line", "another longer line")):
        got = one(spark, F.array_max(F.transform(X.sentences(F.lit(text)), X.token_estimate)))
        assert got == (None if want is None else max(1, int(len(want) / 1.1 + 0.999))), text


def test_topic_inputs(spark):
    text = "我叫王小明, 支付宝: ab_12@x 收货地址：某处三楼，编号 12345678901 "
    assert one(spark, X.topic_input(F.lit(text))) == "我叫[姓名], 支付宝: [账号] 收货地址：[地址]，编号 [长编号]"
    assert one(spark, X.topic_input(F.lit("  "))) is None and one(spark, X.topic_input(F.lit(None).cast("string"))) is None


def test_numbered_lists(spark):
    got = lambda s: one(spark, X.numbered_list(F.lit(s), "Orders"))
    assert got("Orders\n1. A\n2. B") == ["A", "B"]
    for bad in ("Orders", "Orders\n2. A", "Orders\n1. A\n1. B", "Orders\n1. A\n2. A", "Other\n1. A", "Orders\n1. A\nfree text", "Orders\n1. " + "A" * 65, "", None):
        assert got(bad) is None, bad


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (3, 5, 8, 12, 20, 23, 40, 60, 90, 130)]
    texts = ["How do I return this?", "How do I return that?", "", "a", "a", *base]
    for t in base:
        for edits in (1, 2, 3, 5, 8):
            w = list(t)
            for k in range(edits):  # spread evenly
                at = (2 * k + 1) * len(w) // (2 * edits)
                w[at : at + 1] = rng.choice([[], ["x"], [w[at] if at < len(w) else "q", "y"]])
            texts.append("".join(w))
    for least in (0.9, 0.8):
        got = {(r.a, r.b) for r in candidates.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), least).collect()}
        want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and SequenceMatcher(None, texts[i], texts[j]).ratio() >= least}
        assert got == want and len(want) > 20


def test_windows_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), at, rng.choice([None, at * 10])) for at in rng.sample(range(100000), 400)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    groups = {g: sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) for g in ("a", "b", None)}
    want = {}
    for own in groups.values():
        last = None
        for i, (_, at, v) in enumerate(own):
            last = v if v is not None else last
            want[at] = (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None, i, last)
    near = {r.at: (r.previous_id, r.next_id) for r in windows.neighbours(df, "g", "at", "at").collect()}
    number = {r.at: r.n for r in windows.numbered(df, "g", "at", "n").collect()}
    carried = {r.at: r.last for r in windows.carried(df, "g", F.col("at"), "v", "last", F.col("at")).collect()}
    assert {at: (*near[at], number[at], carried[at]) for at in want} == want and windows.neighbours(df.limit(0), "g", "at", "at").count() == 0


def test_search_in_small_blocks(spark, monkeypatch):
    """Block sizes don't change what is found; vectors of other lengths, zero and null ones are left out."""
    rng = random.Random(6)
    chunks = spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(0, 9)))) for i in range(80)], "chunk_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta other".split()) for _ in range(3))) for i in range(30)] + [(99, "nothing known")], "question_id long, text string")
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(90, [0.0] * 4), (91, None), (92, [1.0])], "chunk_id long, vector array<double>")
    q = vectors.where("chunk_id < 20").withColumnRenamed("chunk_id", "question_id")
    found = []
    for size in (1024, 3):
        for name in ("QUESTIONS", "VECTORS", "CHUNKS"):
            monkeypatch.setattr(retrieval, name, size)
        found.append([sorted(map(tuple, df.collect())) for df in (retrieval.bm25(asked, chunks, 5), retrieval.dense(q, vectors, 5), retrieval.similar(q, vectors, 0.8))])
    assert found[0] == found[1] and len(found[0][1]) == 100 and retrieval.bm25(asked.limit(0), chunks).count() == 0 and retrieval.bm25(asked, chunks.limit(0)).count() == 0
