"""Expressions over one side of a book: arrays of [price, size], best first, kept inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price(level: Column) -> Column:
    return F.get(level, F.lit(0))


def size(level: Column) -> Column:
    return F.get(level, F.lit(1))


def best_first(levels: Column) -> Column:
    """Levels with a price, highest price first; of one price the larger size first."""
    known = F.filter(levels, lambda x: price(x).isNotNull())
    return F.reverse(F.array_sort(known))


def total_size(levels: Column) -> Column:
    """Sum of sizes; 0 for an empty side, null for a null one."""
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + F.coalesce(size(x), F.lit(0.0)))


def size_within(levels: Column, best: Column, band: float, tick: float = 0.01) -> Column:
    """Sum of the sizes no more than ``band`` (and half a tick) under ``best``."""
    return total_size(F.filter(levels, lambda x: price(x) >= best - band - tick / 2))


def size_at_or_above(levels: Column, at: Column, tick: float = 0.01) -> Column:
    """Sum of the sizes at ``at`` (less half a tick) or better."""
    return total_size(F.filter(levels, lambda x: price(x) >= at - tick / 2))


def imbalance(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null when both are empty."""
    return F.try_divide(a - b, a + b)


def faults(levels: Column) -> Column:
    """(out_of_range, no_size, not_descending): how many levels break the rules of a side."""
    pairs = F.zip_with(levels, F.slice(levels, F.lit(2), F.greatest(F.size(levels), F.lit(1))), lambda a, b: price(a) <= price(b))
    return F.struct(
        F.size(F.filter(levels, lambda x: (price(x) <= 0) | (price(x) >= 1))).alias("out_of_range"),
        F.size(F.filter(levels, lambda x: size(x) <= 0)).alias("no_size"),
        F.size(F.filter(pairs, lambda x: x)).alias("not_descending"),
    )


def departures(before: Column, now: Column, at: Column, tick: float = 0.01) -> Column:
    """Size that left the levels at ``at`` or better since the book before; new levels do not count, sizes of one price are added."""
    at_price = lambda levels, p: total_size(F.filter(levels, lambda x: price(x) == p))
    prices = F.array_distinct(F.transform(F.filter(before, lambda x: price(x) >= at - tick / 2), price))
    return F.aggregate(prices, F.lit(0.0), lambda a, p: a + F.greatest(at_price(before, p) - at_price(now, p), F.lit(0.0)))


def spacing(values: Column) -> Column:
    """Median gap between the distinct sorted values; null for fewer than two."""
    s = F.array_sort(F.array_distinct(F.array_compact(values)))
    gaps = F.array_sort(F.array_compact(F.zip_with(F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), s, lambda b, a: b - a)))
    n = F.size(gaps)
    return F.when(n > 0, (F.get(gaps, ((n - 1) / 2).cast("int")) + F.get(gaps, (n / 2).cast("int"))) / 2)


def walk(levels: Column, limit: Column, wanted: Column) -> Column:
    """(filled, cost) of taking whole units level by level while the price is at most ``limit``; ``levels`` cheapest first."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def take(a: Column, x: Column) -> Column:
        n = F.when(price(x) <= limit, F.least(F.floor(size(x)).cast("double"), wanted - a["filled"])).otherwise(F.lit(0.0))
        return F.struct((a["filled"] + n).alias("filled"), (a["cost"] + n * price(x)).alias("cost"))

    return F.aggregate(levels, start, take)


def complement(levels: Column) -> Column:
    """The other side's asks: one less each price, sizes and order kept."""
    return F.transform(levels, lambda x: F.array(F.round(1 - price(x), 4), size(x)))


def coordinate(kind: Column, low: Column, high: Column) -> Column:
    """Where a rung lies: the middle of a bracket, else the bound it has."""
    return F.when(kind == "between", (low + high) / 2).otherwise(F.coalesce(low, high))


def normalized(yes: Column, no: Column) -> Column:
    """(yes_bid, yes_ask, no_bid, no_ask, depth): best bids of both sides in any order of levels, each ask one less the other's bid, and the number of levels."""
    best = lambda side: F.array_max(F.transform(side, price))
    levels = lambda side: F.coalesce(F.array_size(side), F.lit(0))
    y, n = best(yes), best(no)
    return F.struct(y.alias("yes_bid"), F.round(1 - n, 4).alias("yes_ask"), n.alias("no_bid"), F.round(1 - y, 4).alias("no_ask"), (levels(yes) + levels(no)).alias("depth"))
