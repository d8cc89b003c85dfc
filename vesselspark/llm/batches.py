"""Python work on Arrow batches of a table: columns in, further columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of the input columns that are turned into Python objects at once.
CHUNK_BYTES = 4 << 20


def parsed(ddl: str) -> DataType:
    return DataType.fromDDL(ddl)


def chunks(batch: pa.RecordBatch, columns: list[int], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes in ``columns``; a longer row stands alone."""
    if batch.num_rows == 0:
        return
    total = None
    for i in columns:
        col = batch.column(i)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type):
            size = pc.cast(pc.fill_null(pc.binary_length(col), 0), pa.int64())
            total = size if total is None else pc.add(total, size)
    if total is None:
        yield batch
        return
    start, held = 0, 0
    for i, n in enumerate(total.to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 64
    yield batch.slice(start)


def with_columns(docs: DataFrame, inputs: list[str], fields: list[tuple[str, str]], factory: Callable, keep: bool = True, chunk: int = CHUNK_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the columns that a Python function makes of ``inputs``.

    ``factory()`` runs once in each task and returns a function from lists (one
    per input, in row order) to lists (one per field). Rows stay where they are.
    A field takes the place of a column of the same name; columns in ``drop`` are read but not sent back.
    """
    names = {n.lower() for n in (*drop, *(n for n, _ in fields))}
    kept = [f for f in docs.schema.fields if keep and f.name.lower() not in names]
    at = {f.name.lower(): i for i, f in enumerate(kept)}
    extra, where = [], []
    for c in inputs:
        if c.lower() in at:
            where.append(at[c.lower()])
        else:
            where.append(len(kept) + len(extra))
            extra.append(F.col(f"`{c}`").alias(f"__in{len(extra)}"))
    new = [StructField(n, parsed(t)) for n, t in fields]
    schema = StructType([*kept, *new])
    types = [to_arrow_type(f.dataType) for f in new]
    out_names = [f.name for f in schema]
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for whole in batches:
            for batch in chunks(whole, where, chunk):
                made = work(*(batch.column(i).to_pylist() for i in where))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], *(pa.array(m, t) for m, t in zip(made, types, strict=True))], names=out_names
                )
                del made
        # A worker serves further tasks: what Arrow keeps of this one goes back to the system.
        whole = batch = work = None
        pa.default_memory_pool().release_unused()

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], *extra).mapInArrow(run, schema)
