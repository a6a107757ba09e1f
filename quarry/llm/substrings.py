"""Substring deduplication by prefix-partitioned suffix trees over words.

What is sought are windows of n words that also start earlier in the corpus. Suffixes that share no n words with another
can't lie below a deep node of the suffix tree, so they are left out first, by anchors: in every window the run of k words
with the smallest hash is its anchor, the same one wherever the window stands. Windows share an anchor with all their
copies; an anchor that occurs once has none. About one word in eight is an anchor.

The windows around one occurrence of an anchor form its context. Equal contexts stand for each other: all but the first
are repeats throughout. The different contexts of one anchor are where repeats begin and end; their suffixes form the
subtree below the anchor as a prefix. Subtrees of up to GROUP contexts are built inside tasks: all suffixes of the contexts, sorted, and the
number of words that neighbours share. Stretches that share n words or more are the deep internal nodes, and the least that a stretch shares is its node's
depth; all leaves below it but the earliest repeat as many words. A larger group has its prefixes lengthened to n words: then the prefix itself is the
deep node, and an aggregate finds its earliest leaf. No task holds more than one group of bounded size.

Runs of such windows are the maximal repeats; they are removed word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch, Words, constants, mix, packed, signed, texts, unpacked

#: Words in an anchor, and contexts in a subtree that one task builds.
ANCHOR, GROUP = 6, 4096


def _anchors(found: Words, n: int) -> tuple[np.ndarray, ...]:
    """For each anchor of each text: its text, word number, hash, hash of its context, first window, number of windows."""
    h, counts = found.hash, found.counts()
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(h) < n:
        return none
    gram, wide, many = constants(ANCHOR, 61), n - ANCHOR + 1, len(h) - n + 1
    g = np.zeros(len(h) - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        g += h[j : j + len(g)] * gram[j]
    g = mix(g)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[:many] == text[n - 1 :])
    if not len(starts):
        return none
    # Position of the leftmost smallest gram in each window: a running minimum over `wide` neighbours.
    least, at = g[:many].copy(), np.arange(many)
    for j in range(1, wide):
        lower = g[j : j + many] < least
        least[lower] = g[j : j + many][lower]
        at[lower] = np.flatnonzero(lower) + j
    p = at[starts]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (text[starts[1:]] != text[starts[:-1]])])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(starts)))
    place, low = p[first], starts[first]
    # Context: words low : low + windows + n - 1, hashed as a difference of running sums, scaled to its start.
    power = np.full(len(h) + 1, 0xD1342543DE82EF95, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
    end = low + windows + n - 1
    context = (total[end] - total[low]) * power[len(h) - low]
    context = mix(context + (place - low).astype(np.uint64) * np.uint64(64) + windows.astype(np.uint64))
    return text[place], place - found.first[text[place]], g[place], context, low - found.first[text[place]], windows


def _mark(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """All anchors of all texts. at holds word number, windows before the anchor, and number of windows."""
    for batch in batches:
        for a, b, found in texts(batch.column("text")):
            text, word, h, context, low, windows = _anchors(found, n)
            ids = batch.column("doc_id").slice(a, b - a).take(pa.array(text))
            at = (word << 16) | ((word - low) << 8) | windows
            yield pa.RecordBatch.from_arrays([pa.array(signed(h.astype(np.uint64))), pa.array(signed(context.astype(np.uint64))), ids, pa.array(at)], names=["anchor", "context", "doc_id", "at"])


def _contexts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The words, as hashes, of the wanted contexts of each text; wanted: array of (anchor, at, size)."""
    for batch in batches:
        wanted = batch.column("wanted")
        for a, b, found in texts(batch.column("text")):
            out: list[list] = [[], [], [], [], []]
            for d in range(a, b):
                own = found.hash[found.first[d - a] : found.first[d - a + 1]]
                doc = batch.column("doc_id")[d].as_py()
                for w in wanted[d].as_py():
                    low = (w["at"] >> 16) - ((w["at"] >> 8) & 255)
                    windows = w["at"] & 255
                    part = own[low : low + windows + n - 1]
                    if len(part) == windows + n - 1:  # else it belongs to another row with this doc_id
                        for c, v in zip(out, (w["anchor"], w["size"], doc, low, part.tobytes())):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "size", "doc_id", "low", "words"])


def _suffixes(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of n or more words: their first n words as rows, the context each comes from, and its place in it."""
    sizes = np.array([len(w) // 8 - n + 1 for w in words])
    flat = np.frombuffer(b"".join(words), np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes + n - 1)])[:-1]
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.lib.stride_tricks.sliding_window_view(flat, n)[begin[of] + place], of, place


def suffix_array(anchor: np.ndarray, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of n or more words of some contexts, sorted below their anchors: the context of each, its place in it, and how many words it shares with
    the one before (0 for the first, and where the anchor changes)."""
    lengths = np.array([len(w) // 8 for w in words])
    sizes, longest = lengths - n + 1, int(lengths.max())
    flat = np.concatenate([np.frombuffer(b"".join(words), np.uint64), np.zeros(longest, np.uint64)])
    begin = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = lengths[of] - place  # words of each suffix
    keys = np.empty((len(of), longest + 1), np.uint64)
    keys[:, 0] = anchor[of].astype(np.int64).view(np.uint64)
    keys[:, 1:] = np.lib.stride_tricks.sliding_window_view(flat, longest)[begin[of] + place]
    keys[:, 1:][np.arange(longest)[None, :] >= rest[:, None]] = 0
    order = np.argsort(keys.view(np.dtype((np.void, keys.shape[1] * 8)))[:, 0], kind="stable")
    common = np.zeros(len(of), np.int64)
    for k in range(1, len(order), 1 << 16):  # in pieces, as this compares all words
        a, b = order[k - 1 : k - 1 + (1 << 16)], order[k : k + (1 << 16)]
        a = a[: len(b)]
        other = np.concatenate([keys[a] != keys[b], np.ones((len(b), 1), bool)], axis=1).argmax(axis=1)
        common[k : k + len(b)] = np.minimum(np.maximum(other - 1, 0), np.minimum(rest[a], rest[b]))
    return of[order], place[order], common


def _later_leaves(anchor: np.ndarray, doc: np.ndarray, low: np.ndarray, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix trees below some anchors: runs (doc_id, start, number) of windows of the leaves below deep internal nodes that aren't the earliest there.

    A stretch of the sorted suffixes whose neighbours share n words or more is what lies below one node; the least that they share is its depth d. All but its
    earliest leaf repeat d words, which are d - n + 1 windows.
    """
    of, place, common = suffix_array(anchor, words, n)
    start, doc = low[of] + place, doc[of]
    first = np.flatnonzero(common < n)  # of each node, or single leaf
    size = np.diff(np.append(first, len(of)))
    within = np.where(common < n, np.iinfo(np.int64).max, common)
    depth = np.minimum.reduceat(within, first)
    node = np.repeat(np.arange(len(first)), size)
    rank = np.lexsort((start, doc, node))
    head = rank[first][node[rank]]
    later = (doc[head] != doc[rank]) | (start[head] != start[rank])
    leaf = rank[later]
    number = depth[node[leaf]] - n + 1
    each = np.repeat(np.arange(len(leaf)), number)
    inside = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
    return _runs(doc[leaf][each], start[leaf][each] + inside)


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (doc_id, start), in any order and repeated, as runs (doc_id, first start, number)."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], start[last] - start[new] + 1


def _subtrees(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Repeats below the anchors of a partition that is sorted by anchor; an anchor's rows may span batches."""
    held: pa.Table | None = None

    def build(table: pa.Table) -> pa.RecordBatch:
        anchor, doc, low = (table[c].to_numpy() for c in ("anchor", "doc_id", "low"))
        found = _later_leaves(anchor, doc, low, table["words"].to_pylist(), n) if len(anchor) else (doc, low, low)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["doc_id", "low", "windows"])

    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = pa.Table.from_batches([batch.slice(at, 8192)])
            held = pa.concat_tables([held, part]) if held is not None else part
            anchor = held["anchor"].to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1], "left"))
            if whole:
                yield build(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None:
        yield build(held)


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Every suffix of the contexts, with a hash of its first n words as its prefix."""
    factors = constants(n, 67)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows, of, place = _suffixes(part.column("words").to_pylist(), n)
            doc, low = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "low"))
            prefix = mix((rows * factors).sum(axis=1, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(prefix)), pa.array(doc[of]), pa.array(low[of] + place)], names=["prefix", "doc_id", "low"])


def repeats(docs: DataFrame, n: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, low, windows): runs of windows, by the number of their first word, that also start earlier in the corpus.

    docs: doc_id long, text string; other columns are ignored. Earlier is a smaller doc_id, or the same one and an
    earlier word. Rows without a doc_id and texts with fewer than n words have none. n is 6 to 255.

    Every step is a written table, deleted after its last reader: at most the anchors of the texts and what is made
    of them in the same step are on disk together.
    """
    if not ANCHOR <= n <= 255:
        raise ValueError(f"windows of {n} words: {ANCHOR} to 255 are possible")
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    marks = scratch.table(docs.mapInArrow(partial(_mark, n=n), "anchor long, context long, doc_id long, at long"), "marks")
    shared = scratch.table(marks.groupBy("anchor").count().where("count > 1").select("anchor"), "shared")
    found = scratch.table(marks.join(shared, "anchor"), "found")
    scratch.drop("marks", "shared")

    # One occurrence stands for all equal contexts of an anchor: the first.
    nodes = found.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    nodes = scratch.table(nodes.select("anchor", "context", "first.doc_id", "first.at", "n"), "nodes")
    firsts = nodes.where("n > 1").select("anchor", "context", F.col("doc_id").alias("_doc"), F.col("at").alias("_at"))
    copies = found.join(firsts, ["anchor", "context"]).where((F.col("doc_id") != F.col("_doc")) | (F.col("at") != F.col("_at")))
    before, windows = F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    copies = scratch.table(copies.select("doc_id", (F.shiftright("at", 16) - before).alias("low"), windows.alias("windows")), "copies")
    scratch.drop("found")

    several = scratch.table(nodes.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1"), "several")
    wanted = nodes.join(several, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "size")).alias("wanted"))
    wanted = scratch.table(wanted, "wanted")
    scratch.drop("nodes", "several")
    contexts = docs.join(wanted, "doc_id").mapInArrow(partial(_contexts, n=n), "anchor long, size long, doc_id long, low long, words binary")
    contexts = scratch.table(contexts, "contexts")
    scratch.drop("wanted")

    small = contexts.where(F.col("size") <= GROUP).drop("size").repartition("anchor").sortWithinPartitions("anchor")
    below = scratch.table(small.mapInArrow(partial(_subtrees, n=n), "doc_id long, low long, windows long"), "below")
    large = scratch.table(contexts.where(F.col("size") > GROUP).mapInArrow(partial(_windows, n=n), "prefix long, doc_id long, low long"), "large")
    scratch.drop("contexts")
    heads = large.groupBy("prefix").agg(F.min(F.struct("doc_id", "low")).alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = scratch.table(heads.select("prefix", F.col("head.doc_id").alias("_doc"), F.col("head.low").alias("_low")), "heads")
    later = (F.col("doc_id") != F.col("_doc")) | (F.col("low") != F.col("_low"))
    deep = scratch.table(large.join(heads, "prefix").where(later).select("doc_id", "low", F.lit(1).cast("long").alias("windows")), "deep")
    scratch.drop("large", "heads")
    return copies.union(below).union(deep)


def _cut(batches: Iterator[pa.RecordBatch], n: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Word counts and what is left of each text, as text or as its SHA-256."""
    for batch in batches:
        spans = batch.column("spans")
        for a, b, found in texts(batch.column("text")):
            gone = np.zeros(len(found.hash) + 1, np.int64)
            for d in range(a, b):
                begin, end = int(found.first[d - a]), int(found.first[d - a + 1])
                for s in spans[d].as_py() or ():
                    gone[min(begin + s["low"], end)] += 1
                    gone[min(begin + s["low"] + s["windows"] + n - 1, end)] -= 1
            kept = np.cumsum(gone)[:-1] <= 0
            counts = found.counts()
            removed = np.concatenate([[0], np.cumsum(~kept)])[found.first]
            # Bytes of the kept words, each followed by a space.
            start, size = found.start[kept], (found.end - found.start)[kept] + 1
            upto = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(upto[-1]) - np.repeat(upto[:-1] - start, size)
            padded = np.append(found.data, np.uint8(32))
            out = padded[np.minimum(at, len(found.data))]
            out[upto[1:] - 1] = 32
            raw = out.tobytes()
            first = upto[np.concatenate([[0], np.cumsum(kept)])[found.first]]
            left = [raw[x : max(x, y - 1)] for x, y in zip(first[:-1], first[1:])]
            result = pa.array(left, pa.binary()).cast(pa.string()) if keep_text else pa.array([sha256(t).hexdigest() for t in left])
            rest = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in rest), pa.array(counts), pa.array(np.diff(removed)), result], names=[*rest, "n_words", "n_removed", "left"])


def _without(docs: DataFrame, n: int, keep_text: bool) -> DataFrame:
    """docs, as of packed(), with n_words, n_removed and what is left of the text."""
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = repeats(docs, n, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("low", "windows")).alias("spans"))
    spans = scratch.table(spans.withColumnRenamed("doc_id", "_id"), "spans")
    scratch.drop("copies", "below", "deep")
    joined = docs.join(spans, docs["doc_id"] == spans["_id"], "left").drop("_id")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("left", T.StringType())])
    return joined.mapInArrow(partial(_cut, n=n, keep_text=keep_text), schema)


def dedup_substrings(docs: DataFrame, n: int = 20) -> DataFrame:
    """docs with text cut to the words that no repeated window covers (joined by one space), n_words and n_removed.

    docs: doc_id long, text string, and any others; columns named n_words or n_removed are replaced. A word goes if some
    window of n words around it also starts earlier: in a smaller doc_id, or earlier in its own. All windows are judged on
    the input. A null or empty text, or one of fewer than n words, loses nothing; null becomes an empty text. Rows that
    repeat a doc_id are one document: equal texts are treated alike, and what is found in one of several texts is cut from
    each. Rows without a doc_id neither lose words nor make others lose any. An empty table gives an empty one.
    """
    docs = docs.drop("n_words", "n_removed")
    done = _without(packed(docs, "doc_id", "text"), n, keep_text=True).withColumn("text", F.col("left"))
    return done.select(*unpacked(docs.columns, "doc_id", "text"), "n_words", "n_removed")


def substring_digest(docs: DataFrame, n: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the UTF-8 text that dedup_substrings leaves)."""
    done = _without(docs.select("doc_id", "text"), n, keep_text=False)
    return done.select("doc_id", "n_words", "n_removed", F.col("left").alias("kept_sha256"))
