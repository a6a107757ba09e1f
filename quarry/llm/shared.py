"""Where intermediate tables go, and the word handling that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_M = (1 << 64) - 1


#: With it, Spark removes the shuffle files of a query as soon as the query has ended, and not when the driver happens to collect garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one run, as Parquet in the folder that the cluster shares.

    A written table cuts the lineage: a lost executor costs the tasks of one step, not the whole run. Shuffle files
    aren't needed once the table stands, and are removed then.
    The folder is spark.checkpoint.dir; where that is unset, a temporary folder of a local session. On a cluster it must be set.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quarry-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEAN_UP, "false")
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others inside one struct _rest, where no name of theirs can clash; unpacked() undoes it."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))


def unpacked(columns: list[str], *without: str) -> list[Column]:
    """The columns of packed() again, in their order."""
    return [F.col(c) if c in without else F.col("_rest").getField(c).alias(c) for c in columns]


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever else the table holds."""
    return docs.select(*(F.col(c) for c in columns))


def n_words(text: Column) -> Column:
    """Words of a text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- words as 64-bit hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = constants(256, 11)
_BASE = 0x9E6C63D0876A9A47
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        grown = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            grown.append(np.cumprod(p))
        _powers[:] = grown
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: for each, a 64-bit hash and its place in the bytes.

    first[d] : first[d + 1] are the words of text d; start and end are byte positions in data.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, n = data, len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~word[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:n]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts(column: pa.Array, lower: bool = False, at_once: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """Words of a column of texts, piece by piece: (first row, row after the last, words); null counts as empty.

    A piece has about at_once bytes, or one longer text, so that the arrays stay small.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + at_once, "right")) - 1)
        last = min(last, len(column))
        piece = data[bounds[row] : bounds[last]]
        yield row, last, Words(_LOWER[piece] if lower else piece, bounds[row : last + 1] - bounds[row])
        row = last


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text, and where each text's begin; a shorter text is one run.

    Returns (hashes, first): first[d] : first[d + 1] are those of text d, repeats included.
    """
    factors = constants(n, 23)
    h, counts = words.hash, words.counts()
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(first[-1], dtype=np.uint64)
    m = max(0, len(h) - n + 1)
    rolled = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        rolled += h[j : j + m] * factors[j]
    full = counts >= n
    places = np.flatnonzero(np.repeat(full, size))
    out[places] = rolled[places + np.repeat(words.first[:-1] - first[:-1], size)[places]]
    for d in np.flatnonzero((counts > 0) & ~full):
        own = h[words.first[d] : words.first[d + 1]]
        out[first[d]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), first


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed numbers, as Spark's long holds them."""
    return x.view(np.int64)
