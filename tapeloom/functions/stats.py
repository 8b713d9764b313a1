"""Named statistics, kept apart where their definitions differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 6) -> Column:
    """Half up by floor, alike in every engine."""
    return F.floor(x * 10**places + 0.5) / F.lit(float(10**places))


def pct_linear(x: Column | str, p: float) -> Column:
    """Percentile with linear interpolation between order statistics."""
    return F.percentile(x, F.lit(p))


def order_statistic(df: DataFrame, keys: list[str], x: str, index: Column, out: str) -> DataFrame:
    """The ``index``-th (from 0, may use n) smallest x of each key: (keys, n, out). Equal values are counted before anything is sorted."""
    counted = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("n", F.sum("m").over(w)).withColumn("upto", F.sum("m").over(w.orderBy(x)))
    return placed.where((index < F.col("upto")) & (index >= F.col("upto") - F.col("m"))).select(*keys, "n", F.col(x).alias(out))


def parts(df: DataFrame, keys: list[str], x: str, low: Column, high: Column) -> DataFrame:
    """Each distinct x of a key with how many of its rows are among the first ``low`` and how many from place ``high`` on, counted from 0: (keys, x, below, above).

    ``low`` and ``high`` may use n, the key's number of rows; a null x comes last.
    """
    counted = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("n", F.sum("m").over(w)).withColumn("upto", F.sum("m").over(w.orderBy(F.col(x).asc_nulls_last())))
    below = F.least("m", F.greatest(low - (F.col("upto") - F.col("m")), F.lit(0)))
    above = F.least("m", F.greatest(F.col("upto") - high, F.lit(0)))
    return placed.select(*keys, x, below.cast("bigint").alias("below"), above.cast("bigint").alias("above"))


def exact_quantile(df: DataFrame, x: str, p: float) -> Column:
    """Quantile of all rows' x, interpolated between order statistics, as a scalar: equal values are counted and parts sorted, no task holds all."""
    counted = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("m"))
    placed = running_total(counted, x, F.col("m"), "upto")
    place = (df.agg(F.count(x)).scalar() - 1) * F.lit(float(p))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(x)))
    low, high = F.floor(place), F.ceil(place)
    return placed.agg((at(low) + (at(high) - at(low)) * (place - low)).alias("q")).scalar()


def floor_index(p: float) -> Column:
    """Index of the percentile that takes the order statistic at the floor of p n."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * p))


def upper_median() -> Column:
    """Index of the upper of the two middle values."""
    return F.floor(F.col("n") / 2)


def robust_z(df: DataFrame, keys: list[str], x: str, floor: float = 1e-3) -> DataFrame:
    """Adds z: distance from the median in scaled median absolute deviations, which count as ``floor`` at least."""
    middle = df.groupBy(*keys).agg(F.median(x).alias("middle"))
    placed = df.join(middle, keys)
    spread = placed.groupBy(*keys).agg(F.median(F.abs(F.col(x) - F.col("middle"))).alias("mad"))
    return placed.join(spread, keys).withColumn("z", (F.col(x) - F.col("middle")) / F.greatest(F.col("mad") * 1.4826, F.lit(floor))).drop("middle", "mad")


def running_total(df: DataFrame, by: str, value: Column, out: str, parts: int = 256) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all rows with at most this row's ``by``, which must be a distinct number in each.

    Rows are cut into ``parts`` by estimated quantiles (a bounded number of them goes to the
    driver), summed per part, and sorted within parts only; the sums are exact wherever the cuts lie.
    """
    cuts = df.stat.approxQuantile(by, [k / parts for k in range(1, parts)], 1 / (2 * parts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    rows = df.withColumn("__part", part).withColumn("__value", value)
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    base = sums.select("__part", F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__base"))  # a row per part
    here = F.sum("__value").over(Window.partitionBy("__part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(base), "__part").withColumn(out, here + F.coalesce("__base", F.lit(0))).drop("__part", "__value", "__base")


def benjamini_hochberg(tests: DataFrame, p: str, q: float) -> DataFrame:
    """Adds kept: the step-up rule at level q; ranks come from one row per distinct p."""
    per = tests.groupBy(p).agg(F.count(F.lit(1)).alias("m"))
    sized = running_total(per.where(F.col(p).isNotNull()), p, F.col("m"), "upto")
    total = tests.agg(F.count(F.lit(1))).scalar()
    limit = sized.where(F.col(p) <= F.col("upto") * q / total).agg(F.max(p)).scalar()
    return tests.withColumn("kept", F.coalesce(F.col(p) <= limit, F.lit(False)))
