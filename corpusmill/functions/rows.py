"""Python functions of one row as column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())
#: Bytes of a batch that are Python objects at a time.
SLICE = 1 << 20


def _slices(columns: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    n = len(columns[0])
    step = max(1, n * SLICE // max(1, sum(c.nbytes for c in columns)))
    for at in range(0, n, step):
        yield [c.slice(at, step) for c in columns]


def _objects(c: pa.Array) -> list:
    """The values of a column as Python objects; strings are made all at once, which is faster than ``to_pylist``."""
    if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
        ends = c.offsets.to_pylist()
        values = _objects(c.values.slice(ends[0], ends[-1] - ends[0]))
        return [values[a - ends[0] : b - ends[0]] if ok else None for a, b, ok in zip(ends, ends[1:], c.is_valid().to_pylist(), strict=False)]
    if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
        return c.to_numpy(zero_copy_only=False).tolist()
    return c.to_pylist()


def by_row(kind: T.DataType) -> Callable:
    """A decorator: f(values of a row) -> value, a tuple of fields for a struct, becomes a function of columns.

    A batch is Arrow's; a list of words as Python objects takes many times the
    memory, so only a slice of a batch is that at a time, and its results are sent
    before the next one is looked at.
    """
    arrow_type = to_arrow_type(kind)
    names = kind.names if isinstance(kind, T.StructType) else None

    def wrap(f: Callable) -> Callable:
        value = f if names is None else lambda *row: dict(zip(names, f(*row), strict=True))

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for b in batches:
                for s in _slices(b):
                    yield pa.array([value(*row) for row in zip(*map(_objects, s), strict=True)], arrow_type)

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return several((b,) for b in batches)

        return lambda *columns: F.arrow_udf(one if len(columns) == 1 else several, kind)(*columns)

    return wrap
