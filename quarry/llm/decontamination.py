"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle check.

Items and windows are compared as multisets of word shingles, weighted by how rare a shingle is among all items. An
item's SimHash has 64 bits. In each document, windows of as many words as the item has slide over the places that hold one of
the item's telling shingles: the rarest, up to just more weight than a similar window may lack, so that a window without any of them
isn't similar. The 64 bits are cut into 8 blocks; fingerprints within 23 bits of each other have a block with at most 2 different bits (8
blocks with 3 each make 24), and an item is listed under all 37 values that each block can so take. Blocks of 8 bits alone would leave seven
in ten pairs of any window and item; so a window looks up its blocks in the lists of those items only whose telling shingles are near, and where it shares
enough weight with them. No similar pair within the radius is lost. A pair at similarity 0.8 lies beyond 23 bits with a probability of about 0.00001. What
is left is compared exactly. Items shorter than a shingle are found as phrases: their words in a row.

The documents are read once, against a bit filter of the items' shingles whose size is bounded; what passes, distinct
texts only, is written with the number of items that hold each of its shingles, by a join. Only these candidates then meet the items,
which are broadcast in blocks of bounded size. No similarity depends on how items fall into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, Words, constants, mix, n_words, shingles, texts

BITS, BLOCKS, ERRORS = 64, 8, 2
RADIUS = BLOCKS * (ERRORS + 1) - 1
#: Words of the items in one broadcast block, about; 64-bit words of the filter, at most.
BLOCK_WORDS, FILTER = 1 << 20, 1 << 22
#: Windows of a document that are looked at together.
STARTS = 4096
_VARIANTS = np.array([0, *(sum(1 << b for b in c) for n in range(1, ERRORS + 1) for c in combinations(range(BITS // BLOCKS), n))], np.uint64)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums as 64-bit numbers."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def signs(h: np.ndarray) -> np.ndarray:
    """A row of 64 numbers 1 or -1 for each shingle."""
    bits = np.unpackbits(mix(h ^ np.uint64(0xD6E8FEB86659FD93)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def runs(found: Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of m words of each text, as shingles() has them for a text of m words, and the word at which each begins."""
    factors, h = constants(m, 23), found.hash
    n = max(0, len(h) - m + 1)
    out = np.full(n, m, np.uint64)
    for j in range(m):
        out += h[j : j + n] * factors[j]
    text = np.repeat(np.arange(len(found.first) - 1), found.counts())
    inside = np.flatnonzero(text[:n] == text[m - 1 :]) if n else np.zeros(0, np.int64)
    return mix(out[inside]), inside


class Items:
    """An index of items: by their rarest shingles, and by blocks of their fingerprints. rows: item_id, words, shingles, how often each, in how many items each."""

    def __init__(self, rows: list[tuple], words: int, n: int, least: float) -> None:
        """n: of all items, in whatever block; least: the similarity that counts."""
        self.words, self.n = words, n
        self.rare = float(np.log1p(n))  # of a shingle of one item or none
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.lengths = np.array([r[1] for r in rows], np.int64)
        self.sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, _, h, c, df in rows:
            order = np.argsort(np.array(h, np.int64).view(np.uint64))
            self.sets.append((np.array(h, np.int64).view(np.uint64)[order], np.array(c, np.int64)[order], np.log1p(n / np.array(df, np.float64)[order])))
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero(self.lengths < words):
            self.short.setdefault(int(self.lengths[i]), {}).setdefault(int(self.sets[i][0][0]), []).append(int(i))
        self.total, self.prints = np.zeros(len(rows)), np.zeros(len(rows), np.uint64)
        self.keys = np.zeros((len(rows), BLOCKS * len(_VARIANTS)), np.int64)
        marks: list[np.ndarray] = []
        for i in np.flatnonzero(self.lengths >= words):
            s, c, w = self.sets[i]
            self.total[i] = (c * w).sum()
            self.prints[i] = fingerprints((signs(s) * (c * w)[:, None]).sum(axis=0)[None, :])[0]
            self.keys[i] = np.sort((_block_keys(self.prints[i : i + 1])[0][:, None] ^ _VARIANTS.astype(np.int64)[None, :]).ravel())
            # A window without these, the rarest, lacks more of the item's weight than it may.
            order = np.lexsort((s, -w))
            telling = order[: int(np.searchsorted(np.cumsum((c * w)[order]), (1 - least) * self.total[i] + 1e-9, "right")) + 1]
            marks.append(np.stack([s[telling], np.full(len(telling), i, np.uint64)], axis=1))
        pairs = np.concatenate(marks) if marks else np.zeros((0, 2), np.uint64)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        # Items that known[k] tells of: members[upto[k] : upto[k + 1]].
        self.known, first = np.unique(pairs[:, 0], return_index=True)
        self.members, self.upto = pairs[:, 1].astype(np.int64), np.append(first, len(pairs))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold a telling shingle of an item, and the item; one for each of both."""
        if not len(self.known) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        places = np.flatnonzero(self.known[at] == h)
        first, n = self.upto[at[places]], self.upto[at[places] + 1] - self.upto[at[places]]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.repeat(places, n), self.members[each]

    def similarity(self, item: int, window: np.ndarray, weight: np.ndarray) -> float:
        """Weighted Jaccard of the two multisets; weight: of each shingle of the window."""
        s, c, own = self.sets[item]
        w, at, n = np.unique(window, return_index=True, return_counts=True)
        _, i, j = np.intersect1d(s, w, assume_unique=True, return_indices=True)
        both = float((np.minimum(c[i], n[j]) * own[i]).sum())
        total = float((c * own).sum() + (n * weight[at]).sum())
        return both / (total - both) if total > both else 1.0

    def near(self, item: int, prints: np.ndarray) -> np.ndarray:
        """Which fingerprints lie within the radius: one of their blocks is among those that the item is listed under, and all bits bear it out."""
        keys = self.keys[item]
        blocks = _block_keys(prints)
        at = np.minimum(np.searchsorted(keys, blocks), len(keys) - 1)
        return (keys[at] == blocks).any(axis=1) & (np.bitwise_count(prints ^ self.prints[item]) <= RADIUS)

    def best_window(self, item: int, h: np.ndarray, weight: np.ndarray, low: int, high: int, least: float) -> tuple[float, int] | None:
        """The similarity and the first word of the best window that begins at low to high, the first of equals."""
        size = int(self.lengths[item]) - self.words + 1  # shingles in a window
        s, found = self.sets[item][0], None
        for at in range(low, high + 1, STARTS):
            starts = np.arange(at, min(at + STARTS, high + 1))
            own, worth = h[at : starts[-1] + size], weight[at : starts[-1] + size]
            shared = np.where(s[np.minimum(np.searchsorted(s, own), len(s) - 1)] == own, worth, 0.0)
            begin, end = starts - at, np.minimum(starts - at + size, len(own))
            both, all_ = (x[end] - x[begin] for x in (np.concatenate([[0.0], np.cumsum(y)]) for y in (shared, worth)))
            fit = np.flatnonzero(both >= least * (self.total[item] + all_ - both) - 1e-9)  # at least as much as they share
            if not len(fit):
                continue
            a, b = begin[fit[0]], end[fit[-1]]
            sums = np.zeros((b - a + 1, BITS))
            np.cumsum(signs(own[a:b]) * worth[a:b, None], axis=0, out=sums[1:])
            for k in fit[self.near(item, fingerprints(sums[end[fit] - a] - sums[begin[fit] - a]))]:
                window = slice(begin[k], end[k])
                got = self.similarity(item, own[window], worth[window])
                if got >= least and (found is None or got > found[0]):
                    found = (got, int(starts[k]))
        return found

    def matches(self, h: np.ndarray, weight: np.ndarray, places: np.ndarray, items: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """Items that a document holds: similarity and first word of the best window. places and items as of find()."""
        best: dict[int, tuple[float, int]] = {}
        order = np.lexsort((places, items))
        places, items = places[order], items[order]
        for own in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1) if len(items) else []:
            item = int(items[own[0]])
            size = int(self.lengths[item]) - self.words + 1
            last, at = max(0, len(h) - size), places[own]
            for part in np.split(at, np.flatnonzero(np.diff(at) > size) + 1):
                found = self.best_window(item, h, weight, min(last, max(0, int(part[0]) - size + 1)), min(last, int(part[-1])), least)
                if found and (item not in best or found[0] > best[item][0]):
                    best[item] = found
        return best


def _block_keys(prints: np.ndarray) -> np.ndarray:
    """The blocks of each fingerprint, each with its number above it."""
    return np.stack([((prints >> np.uint64(8 * k)) & np.uint64(0xFF)).astype(np.int64) | (k << 8) for k in range(BLOCKS)], axis=1)


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item, and how often it has each."""
    for batch in batches:
        for a, b, found in texts(batch.column("text"), lower=True):
            h, first = shingles(found, words)
            own = [np.unique(h[first[d] : first[d + 1]], return_counts=True) for d in range(b - a)]
            rows = pa.array(np.repeat(np.arange(a, b), [len(u) for u, _ in own]))
            every = [np.concatenate([np.zeros(0, t), *(x[k] for x in own)]) for k, t in ((0, np.uint64), (1, np.int64))]
            size = pa.array(found.counts().astype(np.int64)[np.asarray(rows) - a])
            yield pa.RecordBatch.from_arrays([batch.column("item").take(rows), batch.column("item_id").take(rows), size, pa.array(every[0].view(np.int64)), pa.array(every[1])], names=["item", "item_id", "words", "h", "n"])


def _masks(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the filter keeps a shingle: the word, and four bits of it."""
    one, low = np.uint64(1), np.uint64(63)
    mask = one << (h >> np.uint64(58))
    for shift in (52, 46, 40):
        mask = mask | (one << ((h >> np.uint64(shift)) & low))
    return (h & np.uint64(size - 1)).astype(np.int64), mask


def _filter(h: DataFrame, most: int) -> np.ndarray:
    """A bit filter of all shingles, of at most `most` words."""
    size = 1 << min(most.bit_length() - 1, max(6, (2 * h.count()).bit_length()))
    four = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(h, {k}) & 63 as int))" for k in (58, 52, 46, 40)))
    masks = h.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("w"), four.alias("m"))
    rows = masks.groupBy("w").agg(F.bit_or("m").alias("bits")).toPandas()  # a row for each word of the filter
    out = np.zeros(size, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _candidates(batches: Iterator[pa.RecordBatch], kept: np.ndarray, words: int, short: list[int]) -> Iterator[pa.RecordBatch]:
    """The texts that share something with the filter, and the distinct hashes that they share."""
    for batch in batches:
        rows, shared = [], []
        for a, b, found in texts(batch.column("text"), lower=True):
            h, first = shingles(found, words)
            every, of = [h], [np.repeat(np.arange(b - a), np.diff(first))]
            for m in short:
                own, at = runs(found, m)
                every.append(own)
                of.append(np.searchsorted(found.first, at, "right") - 1)
            h, of = np.concatenate(every), np.concatenate(of)
            at, mask = _masks(h, len(kept))
            met = (kept[at] & mask) == mask
            h, of = h[met], of[met]
            for d in np.unique(of):
                rows.append(a + int(d))
                shared.append(np.unique(h[of == d]).view(np.int64))
        upto = np.concatenate([[0], np.cumsum([len(x) for x in shared])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([np.zeros(0, np.int64), *shared])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text", "key")), lists], names=["doc_id", "text", "key", "shared"])


def _scan(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, float]] = []
        rows: list[int] = []
        shared, counts = batch.column("h"), batch.column("df")
        for a, b, found in texts(batch.column("text"), lower=True):
            h, first = shingles(found, items.words)
            of = np.repeat(np.arange(b - a), np.diff(first))
            weight = np.full(len(h), items.rare)
            for d in range(b - a):
                own = slice(first[d], first[d + 1])
                known, df = (x[a + d].values.to_numpy() for x in (shared, counts))
                order = np.argsort(known.view(np.uint64))
                known, df = known.view(np.uint64)[order], df[order]
                at = np.minimum(np.searchsorted(known, h[own]), max(0, len(known) - 1))
                if len(known):
                    weight[own] = np.where(known[at] == h[own], np.log1p(items.n / df[at]), items.rare)
            places, members = items.find(h)
            best: dict[int, dict[int, tuple[float, int]]] = {}
            for d in np.unique(of[places]):
                own = of[places] == d
                best[int(d)] = items.matches(h[first[d] : first[d + 1]], weight[first[d] : first[d + 1]], places[own] - first[d], members[own], least)
            for m, index in items.short.items():
                own, at = runs(found, m)
                some = np.flatnonzero(np.isin(own, np.array(sorted(index), np.uint64)))
                for i in some:
                    d = int(np.searchsorted(found.first, at[i], "right") - 1)
                    for item in index[int(own[i])]:
                        best.setdefault(d, {}).setdefault(item, (1.0, int(at[i] - found.first[d])))
            for d in sorted(best):
                for item, (similarity, start) in sorted(best[d].items()):
                    rows.append(a + d)
                    out.append((int(items.ids[item]), start, similarity))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], names=["key", "item_id", "first_word", "similarity"])


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, first_word and similarity of the best window.

    docs: doc_id long, text string; benchmark: item_id long, text string; other columns are ignored. Words are
    lower-cased over A-Z. A window has as many words as the item; a shorter document is one window. An item with fewer than
    `words` words matches wherever its words stand in a row, with similarity 1. Null and empty texts, and items without an id, match nothing; a null doc_id is
    returned as such. Rows that repeat a doc_id each give their matches. If several windows are equally similar, the
    first counts. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    wanted = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    wanted = scratch.table(wanted.where(n_words(F.col("text")) > 0).withColumn("item", F.xxhash64("item_id", "text")), "items")
    n = wanted.count()
    grams = scratch.table(wanted.mapInArrow(partial(_shingles, words=words), "item long, item_id long, words long, h long, n long"), "grams")
    df = scratch.table(grams.groupBy("h").agg(F.count("*").alias("df")), "df")
    short = sorted(r.words for r in grams.where(F.col("words") < words).select("words").distinct().collect())  # fewer than `words` numbers

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("text is not null")
    near = docs.mapInArrow(partial(_candidates, kept=_filter(df.select("h"), FILTER), words=words, short=short), "doc_id long, text string, key long, shared array<long>")
    near = scratch.table(near, "near")
    once = near.groupBy("key").agg(F.first("text").alias("text"), F.first("shared").alias("shared"))
    once = scratch.table(once, "texts")
    held = once.select("key", F.explode("shared").alias("h")).join(df, "h").groupBy("key").agg(F.collect_list("h").alias("h"), F.collect_list("df").alias("df"))
    once = scratch.table(once.select("key", "text").join(held, "key"), "candidates")
    scratch.drop("texts")

    rows = grams.join(df, "h").groupBy("item", "item_id", "words").agg(F.collect_list("h").alias("h"), F.collect_list("n").alias("n"), F.collect_list("df").alias("df"))
    rows = scratch.table(rows, "index")
    found = spark.createDataFrame([], "key long, item_id long, first_word long, similarity double")
    for block in _blocks(rows):
        found = found.union(once.mapInArrow(partial(_scan, items=Items(block, words, n, least), least=least), found.schema))
    return near.select("key", "doc_id").join(scratch.table(found, "found"), "key").select("doc_id", "item_id", "first_word", "similarity")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_WORDS words, or one longer item, each small enough for the driver and a broadcast."""
    total = items.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // BLOCK_WORDS))
    for part in range(parts if total else 0):
        block, held = [], 0
        for r in items.where(F.pmod("item", F.lit(parts)) == part).orderBy("item_id", "item").toLocalIterator():
            block.append((r.item_id, r.words, r.h, r.n, r.df))
            held += r.words
            if held >= BLOCK_WORDS:
                yield block
                block, held = [], 0
        if block:
            yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, all columns, that hold no benchmark item; a row without a doc_id goes if any such row is found."""
    bad = leaks(docs, benchmark, words, least).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
