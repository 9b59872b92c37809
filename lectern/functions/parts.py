"""Python over columns of Arrow data, with a bounded part of a batch as Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrow bytes that become objects at once; a longer value is alone.
PART_BYTES = 2 << 20


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The values in order, in arrays of at most PART_BYTES."""
    if len(column) > 1 and column.nbytes > PART_BYTES:
        half = len(column) // 2
        yield from slices(column.slice(0, half))
        yield from slices(column.slice(half))
    elif len(column):
        yield column


def parts(column: pa.Array) -> Iterator[list]:
    """slices() as lists."""
    for part in slices(column):
        yield part.to_pylist()


def by_slices(column: Column, rule: Callable[[pa.Array], pa.Array], kind: str, arrow: pa.DataType) -> Column:
    """A column of type `kind` (`arrow` in Arrow): `rule` takes a part's values as an array, and gives one of as many."""

    @F.arrow_udf(kind)
    def run(batch: pa.Array) -> pa.Array:
        made = [rule(part) for part in slices(batch)]
        return pa.concat_arrays(made) if made else pa.array([], arrow)

    return run(column)


def by_parts(column: Column, rule: Callable[[list], list], kind: str, arrow: pa.DataType) -> Column:
    """by_slices() of a rule for lists of Python objects."""
    return by_slices(column, lambda part: pa.array(rule(part.to_pylist()), arrow), kind, arrow)


def by_values(column: Column, rule: Callable, kind: str, arrow: pa.DataType) -> Column:
    """by_parts() of a rule for one value; null stays null."""
    return by_parts(column, lambda values: [None if v is None else rule(v) for v in values], kind, arrow)
