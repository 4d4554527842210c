"""Arrow UDFs over one text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


#: Characters of texts whose rows are made at a time: Spark's batches have up to 10,000 rows of any length, and what Python
#: makes of a text takes many times its size until it is in Arrow's columns.
SLICE = 1 << 20


def slices(arrays: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """Arrays cut at the same rows into slices of about ``SLICE`` bytes, of one row at least."""
    n, row = len(arrays[0]), max(1, sum(a.nbytes for a in arrays) // max(1, len(arrays[0])))
    step = max(1, SLICE // row)
    for k in range(0, n, step):
        yield [a.slice(k, step) for a in arrays]


def udf_of(function: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """A column function that applies ``function`` to each row in Arrow batches; a null first argument gives null.
    What is made of a slice of a batch goes on before the next is looked at, so memory is that of a slice."""
    cached: list = []

    def column(*columns: Column | str) -> Column:
        if not cached:
            kind: DataType = _parse_datatype_string(returns)
            arrow = to_arrow_type(kind)

            def run(*arrays: pa.Array) -> Iterator[pa.Array]:
                for part in slices(arrays):
                    yield pa.array([None if r[0] is None else function(*r) for r in zip(*(a.to_pylist() for a in part))], arrow)

            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for a in batches:
                    yield from run(a)

            def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                for a, b in batches:
                    yield from run(a, b)

            cached.extend([F.arrow_udf(one, kind), F.arrow_udf(two, kind)])
        return cached[len(columns) - 1](*columns)

    return column
