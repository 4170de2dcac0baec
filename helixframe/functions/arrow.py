"""Arrow UDFs from whole columns to structs, for scans over sequences and vectors that have no built-in form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def row_struct(one: Callable[..., tuple], schema: str):
    """An Arrow UDF that calls one() with the row's values and packs what it returns; a null argument gives a null struct."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(schema))

    def run(batches):
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            rows = [None if any(v is None for v in r) else dict(zip([f.name for f in kind], one(*r), strict=True)) for r in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.array(rows, kind)

    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run(batches)

    n = one.__code__.co_argcount - len(one.__defaults__ or ())
    chosen = single if n == 1 else several
    chosen.__annotations__ = {"batches": Iterator[pa.Array] if n == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return arrow_udf(chosen, StructType.fromDDL(schema)).asNondeterministic()
