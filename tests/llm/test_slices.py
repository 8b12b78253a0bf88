"""Batches in runs of rows of bounded bytes."""

import pyarrow as pa

from textloom.llm.runtime import slices


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000)), "t": ["word " * 50] * 1000})
    parts = list(slices([batch, batch.slice(0, 0)], 20_000))
    assert len(parts) > 10 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000)) and max(p.nbytes for p in parts) < 30_000
