"""Token totals by source, language and tokenizer version, kept up to date by signed deltas in idempotent batches.

A rollup is a folder. Each batch of changes is summed to one row for each group and written as a Parquet table in a
folder of its own, which is then renamed to deltas/<batch>: the rename is the commit, and fails where that name is taken. So a
batch that is sent again does nothing, another one under its name is left out with a warning or an error, of two writers of one batch one wins, and a batch whose job died was never there.
Totals are sums over committed batches, so the order of batches doesn't matter. compact() folds the batches of one
listing into a base, which names them and is committed by a rename too; what was committed meanwhile stays a delta.
Renames must not replace a folder, as on HDFS and POSIX; an object store needs a committer that gives this.
"""

from __future__ import annotations

import base64
import re
import uuid
import warnings
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):  # noqa: ANN202
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, marker: str) -> list[str]:
        """Names in a folder that hold a marker."""
        fs, path = self._fs(), self._path(folder)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in found if fs.exists(self._path(f"{folder}/{n}/{marker}")))

    def _publish(self, work: str, name: str) -> bool:
        """Rename a finished folder; False, and the folder goes, if the name is taken."""
        jvm, fs = self.spark._jvm, self._fs()
        fs.mkdirs(self._path(name).getParent())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(work), self._path(name), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(self._path(work), True)
            return False
        return True

    def _bases(self) -> list[int]:
        """Numbers of the bases, the newest last."""
        return sorted(map(int, self._names("base", "totals/_SUCCESS")))

    def _in_base(self, number: int, names: list[str]) -> dict[str, int]:
        """Which of some names a base holds, each with the digest of its batch."""
        wanted = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return {r.batch: r.digest for r in self.spark.read.parquet(f"{self.path}/base/{number}/batches").join(F.broadcast(wanted), "batch").collect()}

    def _digest_of(self, batch: str) -> int | None:
        """The digest of a committed batch, None for any other name."""
        if self._fs().exists(self._path(f"deltas/{batch}/_SUCCESS")):
            try:
                return _digest(self.spark.read.schema(_DELTA).parquet(f"{self.path}/deltas/{batch}"))
            except AnalysisException:  # it went into a base meanwhile
                pass
        bases = self._bases()  # after the deltas: what leaves them is in a base by then
        return self._in_base(bases[-1], [batch]).get(batch) if bases else None

    def batches(self) -> set[str]:
        """Committed batches, all of them, for a look at a rollup; commits and sums ask for the names that they need only."""
        deltas, bases = self._names("deltas", "_SUCCESS"), self._bases()
        known = self.spark.read.parquet(f"{self.path}/base/{bases[-1]}/batches").select("batch").collect() if bases else []
        return set(deltas) | {r.batch for r in known}

    def commit(self, batch: str, changes: DataFrame, strict: bool = False) -> bool:
        """Add a batch of changes; False if it was committed before. Other content under a committed name changes nothing: with
        strict it is an error, else a warning.

        changes: action (insert, delete, revise), source, lang, tokenizer, tokens, and old_tokens for revise (others may
        be null). insert adds a document of so many tokens, delete takes one away, revise replaces old_tokens by tokens.
        A document that changes its group is a delete and an insert. A null count is 0; null group values are groups of
        their own; other actions fail the batch. Repeated rows each count; other columns are ignored.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        sign = F.when(F.col("action") == "insert", 1).when(F.col("action") == "delete", -1).when(F.col("action") == "revise", 0)
        sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null")))).cast("int"))
        new, old = F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
        moved = F.when(F.col("action") == "revise", new - old).otherwise(sign * new)
        rows = changes.select(*GROUP, sign.cast("long").alias("d"), moved.alias("t")).groupBy(*GROUP).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        work = f"work/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{work}")
        before = self._digest_of(batch)
        if before is None and self._publish(work, f"deltas/{batch}"):
            return True
        own = _digest(self.spark.read.schema(_DELTA).parquet(f"{self.path}/{work}")) if before is not None else None
        if before is None:  # another writer was faster
            self._fs().delete(self._path(work), True)
            return self.commit(batch, changes, strict)
        self._fs().delete(self._path(work), True)
        if own != before:
            if strict:
                raise ValueError(f"batch {batch!r} was committed with other content")
            warnings.warn(f"batch {batch!r} was committed with other content; this one is left out", stacklevel=2)
        return False

    def _sum(self, deltas: list[str], bases: list[int]) -> DataFrame:
        done = self._in_base(bases[-1], deltas) if bases else {}
        paths = [f"{self.path}/base/{n}/totals" for n in bases[-1:]] + [f"{self.path}/deltas/{b}" for b in deltas if b not in done]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        summed = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of every group with documents or tokens left."""
        deltas = self._names("deltas", "_SUCCESS")
        return self._sum(deltas, self._bases())

    def compact(self) -> bool:
        """Fold the batches committed so far into a new base; False if another compaction was faster.

        Deltas and bases that only the base before the last needed are deleted, so that a reader that began before this
        compaction still finds its files.
        """
        deltas = self._names("deltas", "_SUCCESS")
        bases = self._bases()
        before = self._in_base(bases[-1], deltas) if bases else {}
        work = f"work/{uuid.uuid4().hex}"
        fresh = [(b, _digest(self.spark.read.schema(_DELTA).parquet(f"{self.path}/deltas/{b}"))) for b in deltas if b not in before]  # since the last compaction
        names = self.spark.createDataFrame(fresh, "batch string, digest long")
        if bases:
            names = names.union(self.spark.read.schema("batch string, digest long").parquet(f"{self.path}/base/{bases[-1]}/batches"))
        names.write.parquet(f"{self.path}/{work}/batches")
        self._sum(deltas, bases).write.parquet(f"{self.path}/{work}/totals")
        if not self._publish(work, f"base/{bases[-1] + 1 if bases else 0}"):
            return False
        for old in [*(f"deltas/{b}" for b in deltas if b in before), *(f"base/{n}" for n in bases[:-1])]:
            self._fs().delete(self._path(old), True)
        return True


def _digest(rows: DataFrame) -> int:
    """A number for the sums of a batch, whatever the order of its rows."""
    found = rows.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(source, source IS NULL, lang, lang IS NULL, tokenizer, tokenizer IS NULL, n_docs, n_tokens))").alias("x")).first()
    return (found.x or 0) ^ found.n


#: The characters of the Unicode property White_Space, as a class of a regular expression; fixed values.
_WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Runs of so much white space or more are cut out of a text, as the tokenizer's regular expression goes back through them step by step.
LONG_RUN = 1000
#: The part of a pattern by which white space before other text is one piece but for its last character.
_LOOK_AHEAD = r"\s+(?!\S)"


def token_count(encoding, pattern: str, text: str) -> int:  # noqa: ANN001
    """Tokens of a whole text. A long run of white space is a piece of its own by such patterns, but for its last character where text follows;
    so nothing changes if the text is cut there."""
    if _LOOK_AHEAD not in pattern:
        return len(encoding.encode_ordinary(text))
    n, at = 0, 0
    for run in re.finditer(f"{_WHITE}{{{LONG_RUN},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


@lru_cache(1)
def _encoding(ranks: bytes, pattern: str):  # noqa: ANN202
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def _tokens(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    own = _encoding(ranks.value, pattern)
    for batch in batches:
        counts = [token_count(own, pattern, t.as_py() or "") for t in batch.column("text")]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(counts, pa.int64())], names=[*rest, "tokens"])


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (text and any others) with tokens, the length of the whole text in tokens, in place of text.

    path is a file of byte-pair ranks on the driver, which is broadcast (a vocabulary: some megabytes); pattern says how its
    tokenizer splits text. A null or empty text has 0 tokens; texts may be long runs of one character or class. A column named tokens is replaced; an empty table gives an empty one.
    """
    docs = docs.drop("tokens")
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("tokens", T.LongType())])
    return docs.mapInArrow(partial(_tokens, ranks=ranks, pattern=pattern), schema)
