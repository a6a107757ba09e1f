"""What a Python worker and the driver hold, whatever the size of the input."""

from __future__ import annotations

import pyarrow as pa

from quarry.operators import graph
from quarry.operators.scratch import Scratch
from quarry.sources import knowledge as K


def test_sections_and_chunks_are_handed_on_in_small_batches():
    text = "# Top\n" + "\n\n".join(f"Part {i} of it. " + "word " * 100 for i in range(40))
    read = []

    def files():
        for at in range(0, 2000, 1000):
            read.append(at)
            yield pa.RecordBatch.from_pydict({"path": [f"f{at + i}" for i in range(1000)], "text": [text] * 1000})

    sizes, rows = [], 0
    for batch in K._parse(files()):
        assert len(read) == 1 or rows > 39000  # what one batch of files gives is handed on before the next one is read
        sizes.append(batch.nbytes)
        rows += batch.num_rows
    assert rows == 80000 and len(sizes) > 20 and max(sizes) < 3 * K.CHARS
    blocks = pa.RecordBatch.from_pydict({"path": [f"f{i // 40}" for i in range(20000)], "section_path": ["Top"] * 20000, "title": ["Top"] * 20000, "category": ["Top"] * 20000, "kind": ["text"] * 20000, "units": [["word " * 30] * 3] * 20000})
    out = list(K._fold(iter([blocks]), K.Budget.of(512)))
    assert len(out) > 3 and max(b.nbytes for b in out) < 3 * K.CHARS and len({(p, i) for b in out for p, i in zip(b["path"].to_pylist(), b["chunk_index"].to_pylist())}) == sum(b.num_rows for b in out)
    assert [b.num_rows for b in K._parse(iter([]))] == [0] and [b.num_rows for b in K._fold(iter([]), K.Budget.of(512))] == [0]


def test_components_send_no_labels_through_the_driver(spark, monkeypatch):
    plans, rows, own = [], {}, Scratch.table

    def table(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        found = own(self, df, name)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(Scratch, "table", table)
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (7, 8), (9, 99), (5, 5)], "a long, b long")
    found = {r.id: r.component for r in graph.components(spark.range(20), edges).collect()}
    assert found == {i: 1 if i in (2, 3, 4) else 7 if i == 8 else i for i in range(20)}
    assert not any("Broadcast" in p for p in plans) and rows["0"] == 7  # those with edges
