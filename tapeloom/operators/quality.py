"""Checks on records and tables, reconciliation of sources, and the health of families of captures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(checks: Mapping[str, Column]) -> Column:
    """The names of the checks that a record fails, in order; a check that cannot be told fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def violations(df: DataFrame, table: str, invariants: Mapping[str, Column]) -> DataFrame:
    """(tbl, invariant, n_violations, n_rows), one row per invariant from a single pass; what cannot be told is no violation."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~ok).alias(name) for name, ok in invariants.items()])
    return counted.unpivot(["n_rows"], list(invariants), "invariant", "n_violations").select(F.lit(table).alias("tbl"), "invariant", "n_violations", "n_rows")


def reconcile(sources: Mapping[str, DataFrame], keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, a column per source, spread, verdict): clean when at least two sources agree within ``tolerance``, else dirty, or unverifiable with fewer than two."""
    out = None
    for name, df in sources.items():
        one = df.select(*keys, F.col(value).alias(name))
        out = one if out is None else out.join(one, keys, "full_outer")
    values = [F.col(n) for n in sources]
    known = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    spread = F.greatest(*values) - F.least(*values)
    verdict = F.when(known < 2, "unverifiable").when(spread <= tolerance, "clean").otherwise("dirty")
    return out.select(*keys, *sources, F.when(known >= 2, spread).alias("spread"), verdict.alias("verdict"))


def family_health(captures: DataFrame, family: str, at: str, capture: str, now_us: Column, window_us: int, interval_us: int) -> DataFrame:
    """(family, n_captures, expected, ratio, age_us, stale, thin) over the window up to now; rows later than now are ignored.

    A capture seen several times counts once, at its earliest. A family is stale when its newest
    capture is older than twice the interval, and thin when less than 80 % of the expected came.
    """
    seen = captures.where(F.col(at) <= now_us)
    first = seen.groupBy(family, capture).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    expected = window_us // interval_us
    out = first.groupBy(family).agg(F.count_if(F.col("first") > now_us - window_us).alias("n_captures"), F.max("last").alias("newest"))
    ratio = F.col("n_captures") / expected
    return out.select(family, "n_captures", F.lit(expected).cast("bigint").alias("expected"), ratio.alias("ratio"), (now_us - F.col("newest")).alias("age_us"), (now_us - F.col("newest") > 2 * interval_us).alias("stale"), (ratio < 0.8).alias("thin"))


def streak_ledger(days: DataFrame, key: str, day: str, hit: str, candidate: int = 3, expired: int = 5) -> DataFrame:
    """State of each pattern after its last day: (key, hit_days, misses, last_seen, status).

    ``misses`` counts the days since the last hit. Expired after ``expired`` of them, candidate
    from ``candidate`` hit days on, else observed. Patterns without a hit have no state.
    """
    per = days.groupBy(key, day).agg(F.max(hit).alias("hit"))
    seen = per.where("hit").groupBy(key).agg(F.max(day).alias("last_seen"))
    last = per.join(seen, key)
    out = last.where("last_seen is not null").groupBy(key).agg(F.count_if("hit").alias("hit_days"), F.count_if(~F.col("hit") & (F.col(day) > F.col("last_seen"))).alias("misses"), F.max("last_seen").alias("last_seen"))
    status = F.when(F.col("misses") >= expired, "expired").when(F.col("hit_days") >= candidate, "candidate").otherwise("observed")
    return out.withColumn("status", status)


def rounds(polls: DataFrame, keys: list[str], at: str, cadence_us: int) -> DataFrame:
    """Fixed-rate rounds on start + k cadence: (keys, n_rounds, n_missed, n_dropped) by what came.

    The start is the key's first poll. A boundary without a poll was missed, a second poll of one
    round is dropped.
    """
    first = polls.groupBy(*keys).agg(F.min(at).alias("__first"))
    number = F.call_function("div", F.col(at) - F.col("__first"), F.lit(cadence_us))
    per = polls.join(first, keys).groupBy(*keys, number.alias("round")).agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy(*keys).agg((F.max("round") + 1).alias("n_rounds"), (F.max("round") + 1 - F.count(F.lit(1))).alias("n_missed"), F.sum(F.col("m") - 1).alias("n_dropped"))


def ticks(legs: DataFrame, tick: str, leg: str, ok: str) -> DataFrame:
    """Each tick over all legs that occur at all: (tick, n_legs, n_failed, n_absent, complete); a leg is fine if any of its rows is."""
    per = legs.groupBy(tick, leg).agg(F.bool_or(ok).alias("ok"))
    total = per.agg(F.count_distinct(leg)).scalar()
    return per.groupBy(tick).agg(F.count(F.lit(1)).alias("n_legs"), F.count_if(~F.col("ok")).alias("n_failed"), F.bool_and("ok").alias("__all")).select(tick, "n_legs", "n_failed", (total - F.col("n_legs")).alias("n_absent"), (F.col("__all") & (F.col("n_legs") == total)).alias("complete"))


def reconciled(now: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """What today's (key, flag) says to each pattern's (key, hits, days, expired): (key, event, hits).

    A flag without hits before is ``observed``, one with them a ``recheck_hit``; no flag after hits
    is a ``recheck_miss`` unless the pattern has expired. A pattern that was not looked at today
    has no row, one of which nothing is said a null event.
    """
    both = now.join(state, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    event = F.when(F.col("hits") == 0, F.when(F.col("flag"), "observed")).when(F.col("flag"), "recheck_hit").when(~F.coalesce("expired", F.lit(False)), "recheck_miss")
    return both.select(key, event.alias("event"), "hits")
