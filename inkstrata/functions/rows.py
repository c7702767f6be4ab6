"""Python functions over rows, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: About the size of the results that are gathered before they go back to Spark, in bytes.
HELD = 2 << 20


def _weight(value: object) -> int:
    if isinstance(value, str):
        return len(value)
    if isinstance(value, dict):
        return 50 + sum(map(_weight, value.values()))
    if isinstance(value, list | tuple):
        return 50 + sum(map(_weight, value))
    return 8


def results(f: Callable, made: pa.DataType, batches: Iterator) -> Iterator[pa.Array]:
    """f of each row of the batches, in arrays that are given out once they reach HELD."""
    for batch in batches:
        done, size = [], 0
        for row in zip(*(batch if isinstance(batch, tuple) else (batch,))):
            done.append(f(*(x.as_py() for x in row)))
            size += _weight(done[-1])
            if size >= HELD:
                yield pa.array(done, made)
                done, size = [], 0
        if done:
            yield pa.array(done, made)


def by_row(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A column function that calls f with the values of each row, None for a null; f returns what Arrow takes for kind.

    Spark sends batches of 10,000 rows. They stay Arrow data, a row at a time is made into
    Python values, and results go back as soon as they reach HELD, so memory follows neither
    the rows of a batch as Python values nor the size of their results.
    """
    made = to_arrow_type(kind)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return results(f, made, batches)

    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return results(f, made, batches)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else more, kind)(*columns)
