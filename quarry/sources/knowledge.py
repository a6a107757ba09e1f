"""Knowledge documents: Markdown files as sections, and sections as chunks within a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import digest, sentences, token_estimate


@dataclass(frozen=True)
class Budget:
    """Tokens: of a chunk, of its longest sentence, and carried over from the chunk before."""

    chunk: int = 8192
    sentence: int = 2048
    overlap: int = 80

    @classmethod
    def of(cls, window: int) -> Budget:
        chunk = min(8192, window)
        return cls(chunk, min(2048, chunk // 2))

    @property
    def text(self) -> int:
        return max(min(self.chunk - 256 - 64, self.chunk - self.sentence), 1)


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of all .md files below a folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")


def _blocks(text: str) -> Iterator[tuple[list[str], int, str, str]]:
    """(titles from the top, block number, kind, text) of each block below a heading."""
    titles: list[tuple[int, str]] = []
    lines: list[str] = []
    kind, fence, number = "text", "", 0

    def flush() -> Iterator[tuple[list[str], int, str, str]]:
        nonlocal number
        body = "\n".join(lines).strip("\n")
        lines.clear()
        if titles and body.strip():
            yield [t for _, t in titles], number, kind, body
            number += 1

    for line in (text or "").splitlines():
        mark = re.match(r"^ {0,3}(```+|~~~+)", line)
        if fence:
            lines.append(line)
            if mark and mark[1].startswith(fence):
                yield from flush()
                fence, kind = "", "text"
            continue
        heading = _HEADING.match(line)
        wanted = "code" if mark else "table" if line.lstrip().startswith("|") else "text"
        if heading or wanted != kind or (not line.strip() and kind == "text"):
            yield from flush()
            kind = "text" if heading else wanted
        if heading:
            level = len(heading[1])
            while titles and titles[-1][0] >= level:
                titles.pop()
            titles.append((level, re.sub(r"[*_`]|\[([^\]]*)\]\([^)]*\)", r"\1", heading[2])))
            number = 0
        else:
            fence = mark[1][:3] if mark else ""
            lines.append(line)
    yield from flush()


def sections(files: DataFrame) -> DataFrame:
    """path, section_path, title, category, block_no, kind, text of files (path, text); text before any heading is dropped.

    Lines depend on what stands above, so a file is read in one piece; files are spread over tasks.
    """

    return files.select("path", "text").mapInArrow(_parse, _schema(BLOCKS))


#: Rows of an Arrow batch that are Python objects at a time, and characters of text after which what is found is handed on.
ROWS, CHARS = 256, 1 << 20
BLOCKS = {"path": pa.string(), "section_path": pa.string(), "title": pa.string(), "category": pa.string(), "block_no": pa.int32(), "kind": pa.string(), "text": pa.string()}


def _schema(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} { {pa.int32(): 'int', pa.bool_(): 'boolean'}.get(t, 'string')}" for c, t in columns.items())


def _batches(rows: Iterable[tuple], columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows, whose text is columns["text"], as batches of about CHARS characters; an empty one at least."""
    at, held, size = list(columns).index("text"), [], 0
    whole = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(columns.values())], names=list(columns))
    for row in rows:
        held.append(row)
        size += len(row[at]) + 64
        if size >= CHARS:
            yield whole()
            held, size = [], 0
    yield whole()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, of which a few at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield from zip(*(part.column(c).to_pylist() for c in names))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = ((p, " > ".join(t), t[-1], " > ".join(t[:-1]) or t[-1], n, k, b) for p, text in _rows(batches, "path", "text") for t, n, k, b in _blocks(text))
    yield from _batches(blocks, BLOCKS)


def split_table(text: str, budget: int, most: int = 20) -> list[tuple[str, bool]]:
    """A Markdown table as tables of up to `most` rows within the budget, each with the header; True for a row that is too wide."""
    tokens = lambda s: max(1, int(len(s) / 1.1 + 0.999)) if s else 0
    lines = text.split("\n")
    head = lines[:2] if len(lines) > 1 and re.fullmatch(r"[\s|:-]+", lines[1]) else []
    out, own = [], []
    for row in lines[len(head) :]:
        if own and (len(own) >= most or tokens("\n".join([*head, *own, row])) > budget):
            out.append(("\n".join([*head, *own]), False))
            own = []
        own.append(row)
        if tokens("\n".join([*head, row])) > budget:
            out.append(("\n".join([*head, row]), True))
            own = []
    return out + ([("\n".join([*head, *own]), False)] if own else [])


def _pack(units: list[tuple[str, str, int]], budget: Budget) -> list[tuple[str, str, bool]]:
    """Units (text, kind, tokens) as chunks (text, kind, flagged). Tables, code and oversize sentences stand alone; other
    chunks begin with the last whole sentences of the one before, as far as these fit."""
    out: list[tuple[str, str, bool]] = []
    held: list[tuple[str, int]] = []
    fresh = 0  # of held, those that no chunk has yet
    size = lambda us: sum(n for _, n in us)

    def flush(after: int) -> None:
        nonlocal held, fresh
        if fresh:
            out.append(("\n".join(t for t, _ in held), "text", False))
            new, carried = held[len(held) - fresh :], []
            for u in reversed(new):
                if size(carried) + u[1] > budget.overlap or size(carried) + u[1] + after > budget.text:
                    break
                carried.insert(0, u)
            held = carried
        else:
            held = []
        fresh = 0

    for text, kind, n in units:
        if kind != "text" or n > min(budget.sentence, budget.text):
            flush(budget.text)
            held = []
            out.append((text, kind, n > budget.text or kind == "text"))
            continue
        if held and size(held) + n > budget.text:
            flush(n)
        held.append((text, n))
        fresh += 1
    flush(budget.text)
    return out


CHUNKS = {"path": pa.string(), "section_path": pa.string(), "title": pa.string(), "category": pa.string(), "chunk_index": pa.int32(), "kind": pa.string(), "text": pa.string(), "flagged": pa.bool_()}


def _fold(batches: Iterator[pa.RecordBatch], budget: Budget) -> Iterator[pa.RecordBatch]:
    """Chunks of blocks in the order of sections; only the open section's units pass from one row to the next."""
    yield from _batches(_folded(batches, budget), CHUNKS)


def _folded(batches: Iterator[pa.RecordBatch], budget: Budget) -> Iterator[tuple]:
    section: tuple | None = None
    units: list[tuple[str, str, int]] = []

    def packed() -> Iterator[tuple]:
        return ((*section, i, kind, text, flagged) for i, (text, kind, flagged) in enumerate(_pack(units, budget))) if section else iter(())

    for path, section_path, title, category, kind, texts in _rows(batches, "path", "section_path", "title", "category", "kind", "units"):
        if section is None or (path, section_path) != section[:2]:
            yield from packed()
            section, units = (path, section_path, title, category), []
        for u in texts:
            parts = split_table(u, budget.text) if kind == "table" else [(u, False)]
            units += [(p, kind, max(1, int(len(p) / 1.1 + 0.999))) for p, _ in parts]
    yield from packed()


def chunks(blocks: DataFrame, budget: Budget) -> DataFrame:
    """path, section_path, title, category, chunk_index, kind, text, flagged, content_hash, chunk_key of the sections' blocks."""
    cut = blocks.withColumn("units", F.when(F.col("kind") == "text", sentences("text")).otherwise(F.array("text"))).drop("text")
    ordered = cut.repartition("path", "section_path").sortWithinPartitions("path", "section_path", "block_no")
    found = ordered.mapInArrow(partial(_fold, budget=budget), _schema(CHUNKS))
    hashed = found.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withColumns({"tokens": token_estimate(F.col("text")), "chunk_key": digest(F.col("path"), F.concat_ws("#", "section_path", F.col("chunk_index").cast("string")), F.col("content_hash"))})


def faq_chunks(faq: DataFrame) -> DataFrame:
    """A chunk for each active row of faq (faq_id, question, answer, category, is_active) with an answer."""
    own = faq.where("is_active AND trim(coalesce(answer, '')) <> ''")
    return own.select(F.concat(F.lit("faq:"), F.col("faq_id").cast("string")).alias("source"), F.array("question").alias("questions"), F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorised")).alias("category"), "answer", F.sha2("answer", 256).alias("content_hash"))
