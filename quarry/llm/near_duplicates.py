"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, confirmed on the full shingle sets.

A document's signature is 36 MinHash values of 16 bits each. The distance of two signatures is the number of
values that differ. The 36 values are cut into 9 chunks of 4. If two signatures differ in at most 17 values, one
chunk has at most 1 difference (9 chunks with 2 each would make 18), so writing down every chunk with each one of
its values left out (the enumerated error) makes the two meet under at least one of 36 keys. All pairs up to
distance 17 are thus found, without exception. At a similarity of 0.8 the distance is binomial (36, 0.2): a pair
lies beyond 17 with a probability of 0.00002.

Pairs that meet are confirmed on their full sets, by re-reading both texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import Scratch, constants, documents, mix, shingles, signed, texts

VALUES, CHUNKS = 36, 9
WIDTH = VALUES // CHUNKS
#: One chunk in any signatures up to this distance has one difference at most.
RADIUS = 2 * CHUNKS - 1
#: Buckets up to this many classes are compared in full by a join; larger ones by pivots, and what these leave by blocks.
SMALL = 8
#: Pivots of a large bucket, and classes in a block.
PIVOTS, BLOCK = 8, 512
#: Pairs this near are confirmed first: most are links, and then spare the rest of their group.
NEAR = 8
_LANES = [f"s{i}" for i in range(VALUES // 4)]
_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in _LANES)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Set size, two sums over the set that stand for it, and the signature of each text."""
    factors = constants(VALUES, 41)
    for batch in batches:
        for a, b, found in texts(batch.column("text"), lower=True):
            h, first = shingles(found, words)
            docs = b - a
            sizes, sums, sigs = np.zeros(docs, np.int64), np.zeros((2, docs), np.uint64), np.zeros((docs, VALUES), np.uint16)
            some = np.flatnonzero(np.diff(first))
            for d in some:
                own = np.unique(h[first[d] : first[d + 1]])
                sizes[d] = len(own)
                sums[0, d] = own.sum(dtype=np.uint64)
                sums[1, d] = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            if len(some):
                for k in range(VALUES):
                    least = np.minimum.reduceat(h * factors[k], first[some])
                    sigs[some, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
            lanes = sigs.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, docs), pa.array(sizes), pa.array(signed(mix(sums[0]))), pa.array(signed(mix(sums[1]))), *(pa.array(lanes[:, i]) for i in range(len(_LANES)))],
                names=["doc_id", "n_shingles", "h1", "h2", *_LANES],
            )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk of every signature with each of its values left out, as a 64-bit key."""
    factors = constants(WIDTH + 1, 43)
    for batch in batches:
        if not batch.num_rows:
            continue
        lanes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _LANES], axis=1)
        sig = np.ascontiguousarray(lanes).view(np.uint16).astype(np.uint64)
        out = np.empty((VALUES, len(sig)), np.uint64)
        for chunk in range(CHUNKS):
            for gone in range(WIDTH):
                kept = [j for j in range(WIDTH) if j != gone]
                out[chunk * WIDTH + gone] = mix(sum((sig[:, chunk * WIDTH + j] + np.uint64(1)) * factors[j] for j in kept) + np.uint64(chunk * WIDTH + gone) * factors[WIDTH])
        ids = np.tile(batch.column("cid").to_numpy(zero_copy_only=False), VALUES)
        slots = np.repeat(np.arange(VALUES, dtype=np.int32), len(sig))
        yield pa.RecordBatch.from_arrays([pa.array(signed(out.reshape(-1))), pa.array(ids), pa.array(slots)], names=["key", "cid", "slot"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text, as bytes."""
    for batch in batches:
        for a, b, found in texts(batch.column("text"), lower=True):
            h, first = shingles(found, words)
            own = [np.unique(h[first[d] : first[d + 1]]).tobytes() for d in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("cid").slice(a, b - a), pa.array(own, pa.binary())], names=["cid", "shingles"])


def _block_links(group: pa.Table, percent: int) -> pa.Table:
    """Links between classes of one bucket whose labels differ: of a block with itself, or of two blocks.

    A pair counts in the bucket of its first common key only. A link joins two labels, so pairs of these need no more.
    """
    one, two = group["low"][0].as_py(), group["high"][0].as_py()
    cid, label, own, n, slot = (group[c].to_numpy() for c in ("cid", "label", "block", "n_shingles", "slot"))
    values = np.ascontiguousarray(np.stack([group[c].to_numpy() for c in _LANES], axis=1)).view(np.uint16)
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in group["shingles"]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for x in range(len(cid)):
        later = np.arange(x + 1, len(cid))
        ys = later if one == two else later[own[later] != own[x]]
        differ = (values[ys] != values[x]).reshape(len(ys), CHUNKS, WIDTH)
        apart = differ.sum(axis=2)
        chunk, gone = int(slot[x]) // WIDTH, int(slot[x]) % WIDTH
        first = np.argmax(apart <= 1, axis=1) == chunk
        variant = np.where(apart[:, chunk] == 0, gone == 0, differ[:, chunk, gone]) if len(ys) else np.zeros(0, bool)
        near = (apart.sum(axis=1) <= RADIUS) & (n[ys] * 100 >= n[x] * percent) & (n[x] * 100 >= n[ys] * percent)
        for y in ys[first & variant & near]:
            if root(label[x]) == root(label[y]):
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[root(label[x])] = root(label[y])
                out.append((min(cid[x], cid[y]), max(cid[x], cid[y])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets share at least percent of their union."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        yes = np.zeros(batch.num_rows, bool)
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets: list[dict] = [{}, {}]
            for side, (ids, column) in enumerate(((a, "text_a"), (b, "text_b"))):
                wanted = {}
                for i in range(part.num_rows):
                    wanted.setdefault(ids[lo + i], i)
                rows = list(wanted.values())
                for x, y, found in texts(part.column(column).take(pa.array(rows, pa.int64())), lower=True):
                    h, first = shingles(found, words)
                    for d in range(x, y):
                        sets[side][ids[lo + rows[d]]] = np.unique(h[first[d - x] : first[d - x + 1]])
            for i in range(part.num_rows):
                s, t = sets[0][a[lo + i]], sets[1][b[lo + i]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                yes[lo + i] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[yes]), pa.array(np.array(b, np.int64)[yes])], names=["a", "b"])


def _apart(x: str, y: str) -> list[Column]:
    """How many values of each chunk differ between two signatures; a chunk's four values are one column."""

    def lane(c: str) -> Column:
        v = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        for n in (8, 4, 2, 1):  # the lowest bit of each value becomes the OR of its 16 bits
            v = v.bitwiseOR(F.shiftrightunsigned(v, n))
        return F.bit_count(v.bitwiseAND(F.lit(0x0001000100010001)))

    return [lane(c) for c in _LANES]


def _comparable(x: str, y: str, percent: int) -> Column:
    """Near enough by signature, of sizes that let the sets be similar enough, and met under their first common key."""
    n, m, slot, apart = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles"), F.col(f"{x}.slot"), _apart(x, y)
    first = F.lit(CHUNKS)
    own = F.lit(0)
    for i in reversed(range(CHUNKS)):
        first = F.when(apart[i] <= 1, i).otherwise(first)
        own = F.when(F.floor(slot / WIDTH) == i, apart[i]).otherwise(own)
    # A chunk without a difference has all its keys in common, of which the first counts; else only one key is common.
    met = (first == F.floor(slot / WIDTH)) & ((slot % WIDTH == 0) | (own == 1))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (reduce(lambda p, q: p + q, apart) <= RADIUS) & met


def _pair(x: str, y: str) -> list[Column]:
    p, q = F.col(f"{x}.cid"), F.col(f"{y}.cid")
    return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), reduce(lambda p, q: p + q, _apart(x, y)).alias("far")]


class _Links:
    """Confirmed links so far, and the label that each class has by them."""

    def __init__(self, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> None:
        self.docs, self.scratch, self.words, self.percent = docs, scratch, words, percent
        self.labels: DataFrame | None = None
        self.turn = 0

    def label(self, df: DataFrame, column: str, to: str) -> DataFrame:
        """df with the label of a column of classes; a class without a link is its own label."""
        if self.labels is None:
            return df.withColumn(to, F.col(column))
        known = self.labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        return df.join(known, df[column] == F.col("_n"), "left").withColumn(to, F.coalesce("_l", column)).drop("_n", "_l")

    def unsettled(self, pairs: DataFrame) -> DataFrame:
        return self.label(self.label(pairs, "a", "la"), "b", "lb").where("la <> lb")

    def add(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b, far), the nearest first; a pair that has become one component needs no more."""
        self.turn += 1
        pairs = self.scratch.table(pairs.groupBy("a", "b").agg(F.min("far").alias("far")), f"pairs{self.turn}")
        for step, within in enumerate((F.col("far") <= NEAR, F.col("far") > NEAR)):
            name = f"links{self.turn}-{step}"
            left = self.scratch.table(self.unsettled(pairs.where(within)).select("a", "b"), f"{name}-pairs")
            if left.isEmpty():
                continue
            one = left.join(self.docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            two = one.join(self.docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
            self.link(two.mapInArrow(partial(_confirm, words=self.words, percent=self.percent), "a long, b long"), name)
            self.scratch.drop(f"{name}-pairs")
        self.scratch.drop(f"pairs{self.turn}")

    def link(self, links: DataFrame, name: str) -> None:
        """Take confirmed links (a, b) into the labels."""
        links = self.scratch.table(links, name)
        if not links.isEmpty():
            joined = self.unsettled(links)
            found = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")), self.scratch, f"{name}-labels")
            moved = links.select(F.col("a").alias("node")).union(links.select("b"))
            if self.labels is not None:
                moved = moved.union(self.labels.select("node"))
            moved = self.label(moved.distinct(), "node", "was")
            new = moved.join(found.select(F.col("node").alias("was"), "label"), "was", "left").select("node", F.coalesce("label", "was").alias("label"))
            self.labels = self.scratch.table(new, f"{name}-now")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Every document with its component of near-duplicates.

    docs: doc_id long, text string; other columns are ignored. Words are lower-cased over A-Z; a document's set
    holds its distinct runs of `words` words, or its whole word sequence if that is shorter. Documents are linked
    when their sets share at least percent / 100 of their union.

    Returns doc_id, n_shingles (set size), component_id (smallest doc_id that links reach, itself included) and
    kept (doc_id = component_id).

    Documents with equal sets are one class from the start, represented by their smallest doc_id, so exact copies
    never meet in pairs. Buckets of up to SMALL classes are compared in full. In a larger bucket, a few pivots (classes
    outside its largest component so far) meet all the others, which joins most of a group of near copies; buckets that
    still hold several components are then cut into blocks, and each two blocks compare their pairs of different
    components inside one task, which returns links only. So no group's pairs are written out, and no link between components is lost.

    A null or empty text, or one without words, has an empty set and stays alone. Rows that repeat a doc_id are all
    returned, each judged by its own text. A row without a doc_id is returned with its n_shingles, a null
    component_id, and kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = documents(docs, "doc_id", "text")
    sketch = scratch.table(docs.mapInArrow(partial(_sketch, words=words), _SKETCH), "sketch")
    whole = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(whole.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("cid"), *(F.min(c).alias(c) for c in _LANES)), "classes")
    keys = classes.select("cid", *_LANES).mapInArrow(_keys, "key long, cid long, slot int")
    shared = scratch.table(keys.groupBy("key").count().where("count > 1"), "keys")
    members = keys.join(shared, "key").join(classes.select("cid", "n_shingles", *_LANES), "cid")
    members = scratch.table(members, "members")
    links = _Links(docs.where("doc_id is not null"), scratch, words, percent)
    small, large = members.where(F.col("count") <= SMALL), members.where(F.col("count") > SMALL)
    x, y = small.alias("x"), small.alias("y")
    links.add(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & _comparable("x", "y", percent)).select(*_pair("x", "y")))
    _large_buckets(large.drop("count"), links, scratch, percent)
    return _result(sketch, classes, links)


def _open(large: DataFrame, links: _Links, scratch: Scratch, name: str) -> DataFrame:
    """Members of the buckets that still hold several components, with label, total, and rest (classes outside the largest component)."""
    own = scratch.table(links.label(large, "cid", "label"), f"{name}-all")
    sizes = own.groupBy("key", "label").agg(F.count("*").alias("size"))
    buckets = sizes.groupBy("key").agg(F.sum("size").alias("total"), F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    buckets = scratch.table(buckets.select("key", "total", F.col("top.label").alias("most"), (F.col("total") - F.col("top.size")).alias("rest")), f"{name}-buckets")
    found = scratch.table(own.join(buckets, "key"), name)
    scratch.drop(f"{name}-all", f"{name}-buckets")
    return found


def _large_buckets(large: DataFrame, links: _Links, scratch: Scratch, percent: int) -> None:
    """Pivots join most of a bucket of near copies; the pairs of different components that are left are met in blocks."""
    own = _open(large, links, scratch, "large")
    # Some classes outside the largest component: those with the smallest hashes, so that buckets with the same classes take the same.
    chance = F.xxhash64("cid", F.lit(1)).cast("double") / F.lit(2.0**64) + 0.5
    pivots = own.where((F.col("label") != F.col("most")) & (chance <= F.lit(float(PIVOTS)) / F.col("rest")))
    x, y = pivots.alias("x"), own.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & _comparable("x", "y", percent))
    links.add(met.select(*_pair("x", "y")))
    scratch.drop("large")
    own = _open(large, links, scratch, "rest").drop("most", "rest")
    if own.isEmpty():
        return
    texts_ = links.docs.select(F.col("doc_id").alias("cid"), "text").join(own.select("cid").distinct(), "cid")
    sets = scratch.table(texts_.mapInArrow(partial(_sets, words=links.words), "cid long, shingles binary"), "sets")
    parts = F.ceil(F.col("total") / BLOCK).cast("int")
    own = own.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(2)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    own = own.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "total").join(sets, "cid")
    links.link(own.groupBy("key", "low", "high").applyInArrow(lambda group: _block_links(group, percent), "a long, b long"), "blocks")


def _result(sketch: DataFrame, classes: DataFrame, links: _Links) -> DataFrame:
    of = links.label(classes.select("n_shingles", "h1", "h2", "cid"), "cid", "component_id")
    same = reduce(lambda p, q: p & q, (F.col(f"s.{c}") == F.col(f"c.{c}") for c in ("n_shingles", "h1", "h2")))
    found = sketch.alias("s").join(of.alias("c"), same & F.col("s.doc_id").isNotNull(), "left")
    component = F.coalesce(F.col("c.component_id"), F.col("s.doc_id"))
    return found.select(F.col("s.doc_id"), F.col("s.n_shingles"), component.alias("component_id"), F.coalesce(F.col("s.doc_id") == component, F.lit(True)).alias("kept"))
