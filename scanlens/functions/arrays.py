"""Column builders over arrays whose cost stays near the length of the array.

The optimizer may move a column's expression into a lambda that reads it, where it would be computed
once per element; ``bound`` hands a value over as a lambda argument instead, which is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: elements of a block in ``running_sums``
_BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(values: Column) -> Column:
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def running_sums(values: Column) -> Column:
    """``[0, v0, v0 + v1, ...]`` of an array of ints, one element longer than it.

    Appending copies an array, so sums are built inside blocks of fixed size and then shifted by the
    sums of the blocks before.
    """
    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
                             lambda b: _sums(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        return F.when(F.size(v) == 0, F.array(F.lit(0))).otherwise(bound(blocks, shifted))

    def shifted(blocks: Column) -> Column:
        before = _sums(F.transform(blocks, lambda s: F.element_at(s, -1)))
        moved = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)),
                           lambda s, at: F.transform(F.slice(s, 2, F.size(s) - 1), lambda x: x + at))
        return F.concat(F.array(F.lit(0)), F.flatten(moved))

    return bound(values, whole)


def floor_index(sorted_values: Column, x: Column) -> Column:
    """Index of the last element of a sorted array that is not above ``x``, by binary search; 0 if all are.
    ``sorted_values`` should be bound."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(sorted_values).cast("long"))))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        return F.when(F.get(sorted_values, mid) <= x, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), F.greatest(mid, s["low"]).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))
    return F.aggregate(steps, start, halve)["low"]
