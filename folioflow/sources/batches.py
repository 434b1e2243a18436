"""Python over Arrow batches, a few rows at a time: what a worker holds grows neither with the batch nor with the partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes that are Python objects at once, on the way in and on the way out; a row that is larger goes alone.
ROWS, BYTES = 256, 4 << 20


def pieces(batch, rows: int = ROWS, size: int = BYTES) -> Iterator:
    """Slices of a batch, halved until they are small."""
    n = batch.num_rows
    if n > rows or (n > 1 and batch.nbytes > size):
        yield from pieces(batch.slice(0, n // 2), rows, size)
        yield from pieces(batch.slice(n // 2), rows, size)
    elif n:
        yield batch


def weight(x) -> int:
    """Bytes that a value takes in a batch, nearly."""
    if isinstance(x, (str, bytes)):
        return len(x) + 4
    if isinstance(x, dict):
        return sum(map(weight, x.values()))
    if isinstance(x, (list, tuple)):
        return sum(map(weight, x)) + 4
    return 8


def filled(rows: Iterable[tuple], kind, most: int = ROWS, size: int = BYTES) -> Iterator:
    """Record batches of rows, each let go as soon as it is full."""
    import pyarrow as pa

    def made():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) for x, f in zip(zip(*held), kind)], schema=kind)

    held, total = [], 0
    for r in rows:
        held.append(r)
        total += weight(r)
        if len(held) >= most or total >= size:
            yield made()
            held, total = [], 0
    if held:
        yield made()


def mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Rows that ``f(frame)`` yields, as tuples in the order of ``schema``, for small pandas frames of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from filled((r for b in batches for p in pieces(b) for r in f(p.to_pandas(integer_object_nulls=True, maps_as_pydicts="strict"))), kind)

    return df.mapInArrow(run, schema)
