"""Mixing sources to target weights, by a multivariate hypergeometric splitting tree.

Every source is cut into blocks by a keyed hash of its documents, and its target becomes a quota of block draws: whole
passes over its blocks, then a prefix of a permutation of them, then one draw for what is left of the target, which
takes single documents of the next blocks. A source's draws, permuted again, are its deck.

The tree deals the decks to output shards by halving: of a node's draws, its left half gets a multivariate
hypergeometric number from each deck, which is what a shuffle of all draws together would give it. So each leaf, a
shard, has an exact quota of each source; it takes the next so many draws of the deck, which no other shard gets. The
documents of a shard are then put in random order by a sort of that shard alone.

The driver holds one number for each deck in each of the top nodes of the tree: a bounded number whatever the corpus
holds. Lower nodes are opened in tasks. Sources, blocks and draws are tables. Sums and ranks along a permutation go
over buckets of bounded size, and then over the sums of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, n_words, packed, unpacked

#: Words and documents of a block, about, and the most blocks of a corpus, about; beyond, blocks get larger.
BLOCK_WORDS, BLOCK_DOCS, MOST_BLOCKS = 1 << 13, 1 << 12, 1 << 26
#: Words in a shard, about, and the fewest shards.
SHARD_WORDS, SHARDS = 1 << 24, 64
#: Decks that the tree deals from. Up to so many sources each have their own; beyond, several share one.
DECKS = 4096
#: Nodes of the tree that the driver opens; tasks go on from there.
NODES = 256
#: Rows in a bucket of a permutation, about, and blocks from which what is left of a target is taken.
BUCKET, CUT = 256, 4


# ---------------------------------------------------------------- the tree


@dataclass
class Node:
    """Shards low : high, the draws that they get of each deck, and where in each deck these begin."""

    low: int
    high: int
    own: np.ndarray
    first: np.ndarray


def halve(node: Node, seed: int) -> tuple[Node, Node]:
    """Deal a node's draws to its two halves; leaves of one tree differ by one draw at most."""
    shards, mid, total = node.high - node.low, (node.low + node.high) // 2, int(node.own.sum())
    each, more = divmod(total, shards)
    size = each * (mid - node.low) + min(more, mid - node.low)
    rng = np.random.default_rng([seed, node.low, node.high])
    left = rng.multivariate_hypergeometric(node.own, size, method="marginals") if total else node.own
    return Node(node.low, mid, left, node.first), Node(mid, node.high, node.own - left, node.first + left)


def open_nodes(nodes: list[Node], most: int, seed: int) -> list[Node]:
    """Halve nodes, level by level, until there are `most` of them or only leaves."""
    while len(nodes) < most and any(n.high - n.low > 1 for n in nodes):
        nodes = [x for n in nodes for x in (halve(n, seed) if n.high - n.low > 1 else (n,))]
    return nodes


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each deck for each shard: (shards, decks)."""
    root = Node(0, shards, np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64))
    return np.stack([n.own for n in open_nodes([root], shards, seed)])


def _leaves(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Below each node: which draws of which deck go to which shard."""
    for batch in batches:
        for row in batch.itertuples():
            top = Node(int(row.low), int(row.high), np.asarray(row.own, np.int64), np.asarray(row.first, np.int64))
            deck = np.asarray(row.deck, np.int32)
            for leaf in open_nodes([top], top.high - top.low, seed):
                some = np.flatnonzero(leaf.own)
                yield pd.DataFrame({"deck": deck[some], "shard": np.full(len(some), leaf.low, np.int32), "first": leaf.first[some], "n": leaf.own[some]})


# ---------------------------------------------------------------- columns and tables


def _unit(key: str) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.col(key).cast("double") / F.lit(2.0**64) + 0.5


def _part(key: str, n: Column) -> Column:
    """Which of n equal parts of the range of hashes a key lies in."""
    return F.least((_unit(key) * n).cast("long"), n.cast("long") - 1)


def _hash(seed: int) -> Column:
    return F.xxhash64("doc_id", "size", F.lit(seed))


def _running(df: DataFrame, group: str, n: str, key: str, value: Column, ties: tuple[str, ...]) -> DataFrame:
    """df with upto: the sum of value over the group's rows up to and with this one, in the order of key, a hash.

    n: about how many rows the group has. Buckets of the order are summed first, so that no window holds a whole group.
    """
    df = df.withColumn("_part", _part(key, F.ceil(F.col(n) / BUCKET)))
    sums = df.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(group, "_part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_inside", inside).join(sums, [group, "_part"]).withColumn("upto", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with place: their number, from 0, in the order of code points, null last."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    ordered = scratch.table(ordered.withColumns({"_task": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    tasks = sorted((r["_task"], r["n"]) for r in ordered.groupBy("_task").agg(F.count("*").alias("n")).collect())  # a row for each task of the sort
    first = np.concatenate([[0], np.cumsum([n for _, n in tasks])]).tolist()
    offsets = sources.sparkSession.createDataFrame([(t, f) for (t, _), f in zip(tasks, first)], "_task long, _first long")
    return ordered.join(offsets, "_task").withColumn("place", F.col("_first") + F.col("_at")).drop("_task", "_first", "_id", "_at")


def _rate(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> float:
    """The words for a weight of 1, such that all sources together give share of all words, none more than most times its own."""
    rate, known = None, -1
    while True:
        full = F.lit(False) if rate is None else F.col("words") * most < F.col("weight") * rate
        rows = sources.groupBy((F.col("place") % len(weights)).alias("turn")).agg(F.sum("words").alias("all"), F.sum(F.when(full, F.col("words")).otherwise(0)).alias("full"), F.count(F.when(full, 1)).alias("n_full"), F.count(F.when(~full, 1)).alias("n")).collect()
        left = share * sum(r["all"] for r in rows) - most * sum(r["full"] for r in rows)
        over = sum(weights[r["turn"]] * r["n"] for r in sorted(rows, key=lambda r: r["turn"]))
        n_full = sum(r["n_full"] for r in rows)
        if n_full == known:
            return rate
        rate, known = (max(0.0, left) / over if over else float("inf")), n_full


@dataclass(frozen=True)
class Mix:
    """What is drawn: made by plan_mix.

    sources: source, place, n_blocks, source_size, target. blocks: place, block, draws (array of turn and shard).
    filled: place, h, fill (turn and shard), the single documents.
    """

    sources: DataFrame
    blocks: DataFrame
    filled: DataFrame
    shards: int
    seed: int

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, source, size, and any that clash with no name here) with place, h, source_size, target and draws."""
        docs = docs.withColumn("h", _hash(self.seed))
        df = docs.join(self.sources.withColumnRenamed("source", "_source"), docs["source"].eqNullSafe(F.col("_source"))).drop("_source")
        df = df.withColumn("block", _part("h", F.col("n_blocks"))).join(self.blocks, ["place", "block"], "left").join(self.filled, ["place", "h"], "left")
        single = F.when(F.col("fill").isNull(), F.array().cast("array<struct<turn:int,shard:int>>")).otherwise(F.array("fill"))
        draws = F.concat(F.coalesce("draws", F.array().cast("array<struct<turn:int,shard:int>>")), single)
        return df.withColumn("draws", draws).drop("fill", "block", "n_blocks")


def plan_mix(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS, seed: int = 7) -> Mix:
    """A plan for documents sized (doc_id, source, size), a written table.

    Sources stand in code point order, null last, and take the weights in turn, again and again. They share `share`
    times all words; no source gives more than `most` times its own, and the rest is shared again.
    """
    spark = sized.sparkSession
    totals = scratch.table(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "totals")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = scratch.table(_numbered(totals, scratch).withColumn("weight", weight), "places")
    every = totals.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    rate = _rate(sources, weights, share, most)
    block_words, block_docs = max(block_words, -(-every.words // MOST_BLOCKS)), max(block_docs, -(-every.docs // MOST_BLOCKS))
    target = F.least(F.col("words") * most, F.when(F.col("words") > 0, F.col("weight") * F.lit(rate)).otherwise(0.0))
    sources = sources.withColumn("target", target).withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block_words), F.ceil(F.col("docs") / block_docs)).cast("long")
    sources = sources.withColumns({"rest": F.col("target") - F.col("passes") * F.col("words"), "n_blocks": n_blocks, "deck": (F.col("place") % DECKS).cast("int")})
    sources = scratch.table(sources, "targets")

    own = sized.withColumn("h", _hash(seed)).join(sources.select(F.col("source").alias("_source"), "place", "n_blocks"), F.col("source").eqNullSafe(F.col("_source")))
    own = scratch.table(own.select("place", _part("h", F.col("n_blocks")).alias("block"), "h", "size"), "own")
    blocks = own.groupBy("place", "block").agg(F.sum("size").alias("words")).withColumn("key", F.xxhash64("place", "block", F.lit(seed)))
    blocks = blocks.join(sources.select("place", "deck", "passes", "rest", "n_blocks"), "place")
    blocks = scratch.table(_running(blocks, "place", "n_blocks", "key", F.col("words"), ("block",)), "blocks")
    fits = F.col("upto") <= F.col("rest") + 1e-6
    draws = scratch.table(_draws(blocks, fits), "draws")
    cut = _cut_blocks(blocks.where(~fits & (F.col("rest") > 1e-6)), blocks.where(fits).groupBy("place").agg(F.max("upto").alias("taken")), scratch)
    single = cut.select("deck", "place", F.lit(-1).cast("long").alias("block"), F.col("passes").alias("turn")).distinct()
    dealt, shards = _deal(draws.unionByName(single), F.ceil(F.lit(share * every.words) / SHARD_WORDS), shards, seed, scratch, spark)

    entry = F.struct("turn", "shard")
    held = dealt.where("block >= 0").groupBy("place", "block").agg(F.array_sort(F.collect_list(entry)).alias("draws"))  # as many as passes, and one
    chosen = own.join(cut.select("place", "block", "upto", "left"), ["place", "block"]).groupBy("place", "left", "upto", "h").agg(F.sum("size").alias("size"))
    chosen = chosen.groupBy("place").applyInPandas(_fill, "place long, h long")
    filled = chosen.join(dealt.where("block < 0").select("place", entry.alias("fill")), "place")
    return Mix(
        sources.select("source", "place", "n_blocks", F.col("words").alias("source_size"), "target"), scratch.table(held, "held"), scratch.table(filled.select("place", "h", "fill"), "filled"), shards, seed,
    )


def _draws(blocks: DataFrame, fits: Column) -> DataFrame:
    """deck, place, block, turn: every block once for each whole pass, and those of the prefix once more."""
    last = F.when(fits & (F.col("rest") > 1e-6), F.col("passes")).otherwise(F.col("passes") - 1)
    some = blocks.where(last >= 0).withColumn("turn", F.explode(F.sequence(F.lit(0), last)))
    return some.select("deck", "place", "block", "turn")


def _cut_blocks(beyond: DataFrame, taken: DataFrame, scratch: Scratch) -> DataFrame:
    """The first CUT blocks behind the prefix of each source, with left, the words that the prefix leaves."""
    at = beyond.groupBy("place").agg(F.min("_part").alias("_least"))
    near = beyond.join(at, "place").where(F.col("_part") <= F.col("_least") + 1)  # two buckets
    rank = F.row_number().over(Window.partitionBy("place").orderBy("upto", "key", "block"))
    first = near.withColumn("_rank", rank).where(F.col("_rank") <= CUT).join(taken, "place", "left")
    return scratch.table(first.select("deck", "place", "block", "passes", "upto", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("left")), "cut")


def _deal(draws: DataFrame, wanted: Column, shards: int | None, seed: int, scratch: Scratch, spark) -> tuple[DataFrame, int]:  # noqa: ANN001
    """place, block, turn and shard of every draw, and the number of shards."""
    quotas = draws.groupBy("deck").agg(F.count("*").alias("n"))
    rows = sorted((r.deck, r.n) for r in quotas.collect())  # at most DECKS
    deck, own = np.array([d for d, _ in rows], np.int32), np.array([n for _, n in rows], np.int64)
    if shards is None:
        shards = max(SHARDS, min(int(spark.range(1).select(wanted).first()[0]), int(own.sum())))
    nodes = open_nodes([Node(0, shards, own, np.zeros(len(own), np.int64))], NODES, seed) if rows else []
    table = [(n.low, n.high, deck.tolist(), n.own.tolist(), n.first.tolist()) for n in nodes]
    tops = spark.createDataFrame(table, "low int, high int, deck array<int>, own array<long>, first array<long>")
    leaves = tops.repartition(min(NODES, max(1, len(nodes)))).mapInPandas(lambda b: _leaves(b, seed), "deck int, shard int, first long, n long")
    leaves = scratch.table(leaves.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("first") + F.col("n") - 1) / BUCKET)))), "leaves")
    # The deck: a permutation of the draws. Those from first on, n of them, are the shard's.
    keyed = draws.join(quotas, "deck").withColumn("key", F.xxhash64("place", "block", "turn", F.lit(seed + 1)))
    ranked = _running(keyed, "deck", "n", "key", F.lit(1), ("place", "block", "turn")).select("deck", "place", "block", "turn", (F.col("upto") - 1).alias("rank"))
    ranked = ranked.withColumn("_bucket", F.floor(F.col("rank") / BUCKET))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return scratch.table(ranked.join(leaves, ["deck", "_bucket"]).where(inside).select("place", "block", "turn", "shard"), "dealt"), shards


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents that make up what is left of a source's target: of a few blocks in turn, by hash, each that still fits; last, the one that comes nearest."""
    rows = rows.sort_values(["upto", "h"])
    left, out, passed = float(rows["left"].iloc[0]), [], []
    for h, size in zip(rows["h"].tolist(), rows["size"].tolist()):
        if size > left:
            passed.append((size, h))
        elif size:
            out.append(h)
            left -= size
    nearest = min(((abs(size - left), h) for size, h in passed), default=(left, 0))
    if nearest[0] < left:
        out.append(nearest[1])
    return pd.DataFrame({"place": np.full(len(out), rows["place"].iloc[0]), "h": np.array(out, np.int64)})


# ---------------------------------------------------------------- use


def _sized(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source and size (words of the text, 0 for null) of every document, as a narrow table."""
    return scratch.table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")


def _position(seed: int, *ties: str) -> Column:
    """The place, from 0, in the shuffled order of a shard."""
    key = F.xxhash64("shard", "turn", "h", F.lit(seed + 2))
    return (F.row_number().over(Window.partitionBy("shard").orderBy(key, "h", "turn", *ties)) - 1).cast("long")


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, shards, shard and position of every document; options as of plan_mix.

    shards: the shard of each copy, in turn. shard and position: the first of the shards that the document is in, and
    its place there (null if it isn't taken).

    docs: doc_id long, text string, source string; other columns are ignored. A null source is a source of its own,
    the last. A null or empty text has size 0; it is taken as often as its block, but not to fill a target. Rows that
    repeat a doc_id and a size are taken alike and share their position. What is left of a target is filled from a few blocks, by hash, with
    each document that still fits, then with the one that comes nearest. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = _sized(docs, scratch)
    mix = plan_mix(sized, scratch, **options)
    drawn = scratch.table(mix.apply(sized), "drawn")
    each = drawn.select("place", "h", F.explode("draws").alias("_d")).select("place", "h", "_d.turn", "_d.shard")
    at = each.withColumn("position", _position(mix.seed)).groupBy("place", "h").agg(F.min(F.struct("shard", "position")).alias("at"))
    found = drawn.join(at, ["place", "h"], "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.size("draws").alias("copies"), F.transform("draws", lambda d: d["shard"]).alias("shards"), "at.shard", "at.position")


def draw(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: docs' columns, once for each time that the mix takes the row, with draw, shard and position.

    draw counts the copies of a row, from 0. Within a shard, position is a random order; the rows of the result stand in it. Columns
    named draw, shard or position are replaced; all others are kept. Odd inputs as of mix_documents.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("draw", "shard", "position")
    mix = plan_mix(_sized(docs, scratch), scratch, **options)
    taken = mix.apply(packed(docs, "doc_id", "source", "text").withColumn("size", n_words(F.col("text")))).where(F.size("draws") > 0)
    each = taken.select("doc_id", "source", "text", "_rest", "h", F.posexplode("draws").alias("draw", "_d")).withColumns({"turn": F.col("_d.turn"), "shard": F.col("_d.shard")})
    return each.withColumn("position", _position(mix.seed)).select(*unpacked(docs.columns, "doc_id", "source", "text"), "draw", "shard", "position")


def write_shards(drawn: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in shuffled order."""
    drawn.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)


def mix_digest(docs: DataFrame) -> DataFrame:
    found = mix_documents(docs)
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"), "shard", "position")
