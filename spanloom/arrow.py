"""Bounds for functions over Arrow batches: a batch has a fixed number of rows, but rows hold texts of any length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: bytes of text that are Python objects at a time, and rows of a batch that goes back
SLICE_BYTES, OUT_ROWS = 1 << 19, 20_000
#: bytes of a batch that a worker gets (Spark's own bound is 64 MB, and a worker holds about twice that)
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: what an item of an array counts for
ITEM_BYTES = 64


def slices(batches: Iterable, limit: int = SLICE_BYTES) -> Iterator:
    """Parts of Arrow batches with at most ``limit`` bytes each (a longer row stands alone)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        size = np.ones(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(c.type):
                size += ITEM_BYTES * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
            yield b.slice(i, j - i)
            i = j


def map_batches(rows, run, schema: str):
    """``mapInArrow`` with batches bounded by bytes, unless the session has a bound of its own."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES[0], None) is None:
        conf.set(*BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def record_batches(rows: Iterable[tuple], types: list, names: list[str], size: int = OUT_ROWS) -> Iterator:
    """Rows as Arrow batches of at most ``size`` rows, so no more of them are Python objects at a time."""
    import pyarrow as pa

    part: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate(types)], names=names)
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield make()
            part = []
    if part:
        yield make()


def groups(batches: Iterable) -> Iterator[tuple]:
    """(key, rows of the other columns) of batches sorted by their first column; one group is held at a time."""
    key, rows = None, []
    for b in slices(batches):
        for k, *row in zip(*[c.to_pylist() for c in b.columns]):
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def in_order(rows, key: str, *order):
    """``rows`` with those of a key in one task, next to each other and in order: input of ``groups``, without a fixed cost a group."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def key_type(rows, key: str = "doc_id"):
    """Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[key].dataType)
