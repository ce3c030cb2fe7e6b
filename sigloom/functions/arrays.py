"""Array helpers that the signal and sequence functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def indices(n: Column) -> Column:
    """0..n-1; empty for n <= 0, where sequence() would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def let(*values_and_body) -> Column:
    """let(a, b, body): body(a, b) with a and b computed once a row. A column that a lambda refers to may otherwise be
    computed again for each element, as the optimiser writes its expression into the lambda."""
    *values, body = values_and_body
    if not values:
        return body()
    return F.get(F.transform(F.array(values[0]), lambda x: let(*values[1:], lambda *rest: body(x, *rest))), F.lit(0))


def at(values: Column, i: Column) -> Column:
    """values[i] from 0; null outside."""
    return F.get(values, i.cast("int"))


def clamped(values: Column, i: Column) -> Column:
    """values[i], the first or last element for an i outside."""
    return at(values, F.greatest(F.lit(0), F.least(F.size(values) - 1, i)))


def total(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x).cast("double"))


def mean(values: Column) -> Column:
    """0 for an empty array."""
    n = F.size(values)
    return F.when(n > 0, total(values) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def std(values: Column) -> Column:
    """Population standard deviation; 0 for an empty array."""
    return let(values, lambda v: let(mean(v), lambda m: F.sqrt(total(v, lambda x: (x - m) * (x - m)) / F.greatest(F.size(v), F.lit(1)))))


def median(values: Column) -> Column:
    """Midpoint of the two middle elements for an even count; 0 for an empty array."""

    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2).otherwise(F.lit(0.0))

    return let(F.array_sort(values), of)


def padded(values: Column, start: Column, stop: Column, fill: float = 0.0) -> Column:
    """values[start:stop] with `fill` where that reaches outside."""
    return let(values, start, stop, lambda v, a, b: F.transform(indices(b - a), lambda i: F.coalesce(F.when(a + i >= 0, at(v, a + i)), F.lit(fill))))


RUN = 512  # elements that are summed up in one array; a longer one is copied for every element


def running(values: Column) -> Column:
    """The sum of the elements before each, of integers."""

    def sums(x: Column) -> Column:
        empty = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("all"))
        return F.aggregate(x, empty, lambda s, v: F.struct(F.array_append(s["before"], s["all"]).alias("before"), (s["all"] + v).alias("all")))

    def of(v: Column) -> Column:
        blocks = F.transform(indices(F.ceil(F.size(v) / RUN)), lambda b: sums(F.slice(v, b * RUN + 1, F.lit(RUN))))
        return let(blocks, lambda bs: joined(bs, sums(F.transform(bs, lambda x: x["all"]))["before"]))

    def joined(blocks: Column, starts: Column) -> Column:
        return let(blocks, starts, lambda bs, first: F.flatten(F.transform(bs, lambda x, i: F.transform(x["before"], lambda p: p + at(first, i)))))

    return let(values, of)


def first_where(values: Column, test: Callable[[Column], Column]) -> Column:
    """Index from 0 of the first element that passes; null if none does."""
    return F.array_position(F.transform(values, test), F.lit(True)) - 1
