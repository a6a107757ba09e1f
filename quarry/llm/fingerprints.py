"""Document fingerprints from closed syncmers, with DataFrame functions only.

Each run of K code points of a text (a k-mer) holds W = K - S + 1 shorter runs of S code points. It is chosen if the smallest
hash of these lies at one of its two edges. Whether a k-mer is chosen depends on nothing but itself, so an edit
changes choices only where a k-mer covers it; in any W k-mers about two are chosen, in equal places of equal passages. As S
is at least half of K, the two edge runs cover the whole k-mer, and their hashes give the hash of the anchor.

The fingerprint holds the SIZE smallest 32-bit anchor hashes of the whole text, all of them if there are fewer. Sketches of parts merge into
the sketch of the whole, if the parts overlap by K - 1 code points: texts are cut into pieces of bounded size, and of an edited text only
the part that the edit can reach is read anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.windows import by_range

K, S = 20, 14
W = K - S + 1
#: Anchor hashes in a fingerprint, and code points that a piece of a text begins.
SIZE, PIECE = 64, 4096


def _inner_hashes(piece: Column) -> Column:
    """A 64-bit hash of each run of S code points."""
    return F.transform(F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1)), lambda run: F.xxhash64(run))


def _chosen(h: Column) -> Column:
    """Where the k-mers begin whose smallest inner hash lies at an edge, from 0; h: hashes of the inner runs."""
    inside = lambda i: F.least(*(F.get(h, i + j) for j in range(1, W - 1)))
    every = F.when(F.size(h) >= W, F.sequence(F.lit(0), F.size(h) - W)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.least(F.get(h, i), F.get(h, i + (W - 1))) <= inside(i))


def _code(h: Column, i: Column) -> Column:
    """The 32-bit hash of the k-mer that begins at i."""
    return F.shiftrightunsigned(F.xxhash64(F.get(h, i), F.get(h, i + (W - 1))), 32)


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it occurs."""
    return F.transform(F.array(value), use).getItem(0)


def _pieces(text: Column) -> Column:
    """The text in pieces; each k-mer begins in one of them and lies wholly within what that one holds."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + K - 1}}})).{{1,{PIECE}}}"), F.lit(1))


def _smallest(codes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(codes)), 1, SIZE)


def sketch(text: Column) -> Column:
    """The SIZE smallest anchor hashes of a text, in order."""
    of = lambda piece: _once(_inner_hashes(piece), lambda h: _smallest(F.transform(_chosen(h), lambda i: _code(h, i))))
    return _smallest(F.flatten(F.transform(_pieces(text), of)))


def merged(text: Column, *parts: Column) -> Column:
    """The sketch of a text from those of its parts; a text without anchors that isn't empty is one anchor as a whole."""
    found = _smallest(F.flatten(F.array(*parts)))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(text), 32))
    return _once(found, lambda x: F.when((F.size(x) == 0) & (text != ""), whole).otherwise(x))


def written(sketch: Column) -> Column:
    """The fingerprint as a string: eight hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common anchors of two texts, from 0 to 1: of the SIZE smallest of both sketches, those in both. Exact for
    texts of fewer anchors; 1 for two empty texts."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    return _once(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the anchor's first code point, from 0) and code: all anchors of whole texts, for positional matching.

    Null, empty and short texts have none; rows that repeat an id give theirs again.
    """
    pieces = docs.select("doc_id", F.posexplode(_pieces(F.coalesce(F.col("text"), F.lit("")))).alias("_n", "_piece"))
    hashed = pieces.select("doc_id", "_n", _inner_hashes(F.col("_piece")).alias("_h"))
    of = F.transform(_chosen(F.col("_h")), lambda i: F.struct((i + F.col("_n") * PIECE).cast("long").alias("position"), _code(F.col("_h"), i).alias("code")))
    return hashed.select("doc_id", F.explode(of).alias("_a")).select("doc_id", "_a.position", "_a.code")


def _with_successors(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of doc_id, and at the end of each range, flagged, the first row of the next one (of the last range: of the first)."""
    ranged = by_range(docs, F.col("doc_id")).withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(2**31 - 1)).otherwise(F.col("_range")).cast("int"))
    # As many rows as there are ranges: the smallest id, the successor, and the first text of each.
    least = ranged.groupBy("_range").agg(F.min("doc_id").alias("_least"))
    order = Window.orderBy("_range")
    least = least.withColumn("_before", F.coalesce(F.lag("_range").over(order), F.last("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    least = F.broadcast(least.withColumnRenamed("_range", "_of"))
    first = ranged.join(least, (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_least")))
    first = first.groupBy("_before").agg(F.min("text").alias("text"))
    border = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_before").alias("_range"), F.lit(True).alias("_border"))
    return ranged.select("doc_id", "text", "_range", F.lit(False).alias("_border")).unionByName(border)


def fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs (doc_id, text).

    The edited text is the text with its last floor(n_chars / share) code points replaced by the first as many (or all) of the next document, in
    the order of doc_id, null last, then of texts; after the last comes the first, so a single document follows itself. near_edited and
    near_next tell how like the fingerprint is to that of the edited text, and to that of the next document.

    A null text is an empty one; it has an empty fingerprint, which is like another empty one and unlike all others. Equal texts have
    equal fingerprints. Rows that repeat an id are documents of their own. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("_range").orderBy("_border", F.asc_nulls_last("doc_id"), "text")
    rows = _with_successors(own).withColumns({"_next": F.coalesce(F.lead("text").over(order), F.lit("")), "_n": F.length("text")})
    rows = rows.withColumn("_q", F.floor(F.col("_n") / share).cast("int"))
    # From the first k-mer on that reaches beyond the part that stays.
    kept, tail = F.substring("text", F.lit(1), F.col("_n") - F.col("_q")), F.greatest(F.col("_n") - F.col("_q") - (K - 2), F.lit(1))
    rows = rows.select("*", kept.alias("_kept"), tail.alias("_tail")).withColumn("_edited", F.concat("_kept", F.substring("_next", F.lit(1), F.col("_q"))))
    end = lambda text: F.substring(text, F.col("_tail"), F.col("_n"))
    rows = rows.select("doc_id", "_range", "_border", "text", "_edited", "_n", sketch(F.col("_kept")).alias("_start"), sketch(end("text")).alias("_own_end"), sketch(end("_edited")).alias("_edited_end"))
    rows = rows.select("*", F.sha2("_edited", 256).alias("edited_sha256"), merged(F.col("text"), F.col("_start"), F.col("_own_end")).alias("_own"), merged(F.col("_edited"), F.col("_start"), F.col("_edited_end")).alias("_other"))
    rows = rows.withColumn("_after", F.lead("_own").over(order)).where("NOT _border")
    return rows.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), "edited_sha256", written(F.col("_own")).alias("fingerprint"), written(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )
