"""Column builders that keep work on long arrays linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements that a running total goes over at once; an appended array is copied, so long ones are built in parts.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _totals(sizes: Column, base: Column) -> Column:
    """The total before each element, counted from ``base``, and after the last one."""
    return F.aggregate(sizes, F.array(base), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def totals_before(sizes: Column) -> Column:
    """For each element of an array of ints, the total of those before it."""

    def parted(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / PART).cast("int"), F.lit(0))), lambda p: F.slice(x, p * PART + 1, F.lit(PART)))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x))
        return let(_totals(sums, F.lit(0)), lambda bases: F.flatten(F.transform(parts, lambda part, p: F.slice(_totals(part, F.get(bases, p)), F.lit(1), F.size(part)))))

    return let(sizes, lambda x: let(parted(x), joined))
