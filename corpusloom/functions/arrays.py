"""Array expressions that Spark lacks, as compositions of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(xs: Column, block: int = 256) -> Column:
    """Sums of an int array up to and with each element: by blocks, so that no array grows to the length of xs."""

    def sums(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: sums(F.slice(xs, i * block + 1, F.lit(block))))

    def shifted(inner: Column) -> Column:
        starts = F.slice(sums(F.transform(inner, lambda s: F.element_at(s, -1))), 1, F.size(inner))
        return F.flatten(F.zip_with(inner, starts, lambda s, at: F.transform(F.slice(s, 2, F.size(s) - 1), lambda x: x + at)))

    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(bound(blocks, shifted))
