"""Latest, earliest, top and unique rows; incremental appends; matches that refuse to guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], latest: bool = True) -> DataFrame:
    """One row per key: the one greatest (or least) in ``order``, which must be total for a defined result. No sort, partial aggregation."""
    best = (F.max if latest else F.min)(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*columns).alias("v")))
    return df.groupBy(*keys).agg(best.alias("x")).select(*keys, *[F.col(f"x.v.{c}").alias(c) for c in columns])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; Spark limits every partition's groups ahead of the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def append_new(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored, the first of each key; rows with a null key never pass."""
    whole = batch.where(F.expr(" and ".join(f"{k} is not null" for k in keys)))
    return pick(whole, keys, order, columns, latest=False).join(stored.select(*keys).distinct(), keys, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: (keys, n)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, status): matched where exactly one right row has the key, else unmatched or ambiguous, never a guess."""
    found = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(right_id).alias("only"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return left.select(left_id, key).join(found, key, "left").select(left_id, F.when(F.col("n") == 1, F.col("only")).alias(right_id), status.alias("status"))


def complete_periods(df: DataFrame, period: str, leg: str) -> DataFrame:
    """Periods in which every leg that occurs at all is present: (period)."""
    legs = df.select(leg).where(F.col(leg).isNotNull()).agg(F.count_distinct(leg).alias("all"))
    have = df.groupBy(period).agg(F.count_distinct(leg).alias("n"))
    return have.join(F.broadcast(legs), F.col("n") == F.col("all")).select(period)  # one row is sent


def interval_sums(prints: DataFrame, hourly: DataFrame, key: str, hour: str, width: int, value: str) -> DataFrame:
    """Each print with the sum of the ``width`` hours up to its own: (key, hour, n, total, status), status full only with every hour there."""
    spread = prints.select(key, F.col(hour).alias("at"), F.explode(F.sequence(F.col(hour) - (width - 1), F.col(hour))).alias(hour))
    joined = spread.join(hourly.select(key, hour, value), [key, hour], "left").groupBy(key, "at").agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return joined.select(key, F.col("at").alias(hour), "n", F.when(F.col("n") == width, F.col("total")).alias("total"), F.when(F.col("n") == width, "full").when(F.col("n") > 0, "partial").otherwise("none").alias("status"))


def fold(caches: list[DataFrame], keys: list[str], stored: DataFrame) -> DataFrame:
    """Several caches as one, by key: the first cache that has a key keeps it (``source``, from 1); keys that are stored, and null ones, are left out.

    Caches may lack columns of others; of a key's rows in one cache any of the least stays.
    """
    every = None
    for n, cache in enumerate(caches, 1):
        one = cache.withColumn("source", F.lit(n))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    whole = every.where(F.expr(" and ".join(f"{k} is not null" for k in keys)))
    rest = [c for c in every.columns if c not in keys and c != "source"]
    first = whole.groupBy(*keys).agg(F.min(F.struct("source", *rest)).alias("x"))
    return first.select(*keys, "x.*").join(stored.select(*keys).distinct(), keys, "left_anti")
