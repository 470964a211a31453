"""Small helpers on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_ARRAY = "array<int>"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def int_array(values: Sequence[int]) -> Column:
    """A literal ``array<int>``."""
    return F.array(*[F.lit(int(v)) for v in values]).cast(INT_ARRAY)


def empty_ints() -> Column:
    return F.array().cast(INT_ARRAY)


def int_range(start: Column, count: Column) -> Column:
    """``start, start+1, …`` (``count`` ints), empty when ``count`` is 0 or less.

    ``sequence`` would run downwards there.
    """
    return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(empty_ints())


def occurrences(values: Column | str, item: int) -> Column:
    """How often ``item`` occurs, without an interpreted lambda."""
    values = as_column(values)
    return F.array_size(values) - F.array_size(F.array_remove(values, item))


def truncate_to_shorter(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Both vectors cut to the length of the shorter one."""
    a, b = as_column(a), as_column(b)
    n = F.least(F.array_size(a), F.array_size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def digest(values: Column | str) -> Column:
    """md5 over the comma-joined values: a whole array as one comparable value."""
    return F.md5(F.array_join(as_column(values).cast("array<string>"), ","))


def int_sum(values: Column | str) -> Column:
    """Sum of an int array as bigint, 0 for an empty one."""
    return F.aggregate(as_column(values), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
