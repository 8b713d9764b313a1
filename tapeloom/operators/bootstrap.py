"""Cluster bootstrap with a portable index, and the gates on its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import running_total

#: Seed and defaults of the resampling.
SEED, SAMPLES = 42, 10_000
#: Modulus and factors of the draws.
PRIME, MULTIPLIERS = 2**31 - 1, (48_271, 69_621, 40_692, 16_807)
#: Units that are sent to all tasks at most; more are joined by their number.
SENT = 1_000_000


def drawn(b: Column, s: Column, n: Column) -> Column:
    """Index of the unit drawn at place s of sample b: linear steps and squares modulo a prime, in turn, reduced at every step."""
    m, (p, q, r, t) = F.lit(PRIME), MULTIPLIERS
    x = F.pmod(F.pmod((b + SEED) * p, m) * q + (s + 1) * r, m)
    x = F.pmod(x * x + b * t, m)
    x = F.pmod(x * x + s, m)
    return F.pmod(F.pmod(x * p + SEED, m), n)


def sql_drawn(b: str, s: str, n: str) -> str:
    """DuckDB twin of :func:`drawn`."""
    p, q, r, t = MULTIPLIERS
    x = f"(((({b} + {SEED}) * {p}) % {PRIME}) * {q} + ({s} + 1) * {r}) % {PRIME}"
    for more in (f"{b} * {t}", s):
        x = f"list_transform([{x}], lambda x: (x * x + {more}) % {PRIME})[1]"
    return f"((({x}) * {p} + {SEED}) % {PRIME}) % {n}"


def _means(values: DataFrame, keys: list[str], unit: str, value: str, samples: int) -> tuple[DataFrame, DataFrame]:
    """The units' totals by key, and the pooled mean of every sample of each key: (keys, b, mean).

    Units are reduced to sum and count and numbered in their order; every sample draws as many
    units of a key as there are, so work is samples times units.
    """
    known = values.where(F.expr(" and ".join(f"`{c}` is not null" for c in (unit, value, *keys))))
    per = known.groupBy(*keys, unit).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    total = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.sum("s").alias("total"), F.sum("c").alias("n"))
    if keys:
        numbered = per.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(unit)).cast("bigint") - 1)  # one row per unit
        each = total.select(*keys, "n_units", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))).alias("b"))
        chosen = each.repartition(values.sparkSession.sparkContext.defaultParallelism * 4)
    else:
        numbered = running_total(per, unit, F.lit(1), "i").withColumn("i", (F.col("i") - 1).cast("bigint"))
        chosen = values.sparkSession.range(samples).select(F.col("id").alias("b"), per.agg(F.count(F.lit(1))).scalar().alias("n_units")).where("n_units > 0")
    draws = chosen.withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_units") - 1)))
    draws = draws.select(*keys, "b", drawn(F.col("b"), F.col("place"), F.col("n_units")).alias("i"))
    units = numbered.select(*keys, "i", "s", "c")
    few = per.count() <= SENT
    means = draws.join(F.broadcast(units) if few else units, [*keys, "i"]).groupBy(*keys, "b").agg((F.sum("s") / F.sum("c")).alias("mean"))
    return total, means


def cluster_bootstrap(values: DataFrame, unit: str, value: str, samples: int = SAMPLES) -> DataFrame:
    """(n_units, total, n, low, high): the pooled mean's 95 % interval over resampled units, as order statistics.

    ``value`` must hold whole numbers and ``unit`` numbers. No units give no interval.
    """
    total, means = _means(values, [], unit, value, samples)
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("mean")) - 1)  # a row per sample
    ends = ranked.agg(F.max(F.when(F.col("r") == int(0.025 * samples), F.col("mean"))).alias("low"), F.max(F.when(F.col("r") == int(0.975 * samples), F.col("mean"))).alias("high"))
    return total.withColumns({c: ends.select(c).scalar() for c in ("low", "high")})


def grouped_bootstrap(values: DataFrame, keys: list[str], unit: str, value: str, samples: int = SAMPLES) -> DataFrame:
    """Per key (keys, n_units, total, n, low, high, p): the interval with interpolated ends, and the share of samples whose mean is not above 0.

    ``p`` counts the data itself as one more such sample, so that it is never 0. The keys are
    scenarios, a bounded number of them; there is one row per sample and key.
    """
    total, means = _means(values, keys, unit, value, samples)
    ends = means.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), ((F.count_if(F.col("mean") <= 0) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return total.join(ends, keys)


def admissible(values: DataFrame, unit: str, value: str, least: int = 10) -> DataFrame:
    """(n_units, n_opposite, reasons): whether enough units speak, and at least one of them against the pooled sign."""
    per = values.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("c")).where("c > 0")
    signs = per.withColumn("p", per.agg(F.sum("s")).scalar()).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.signum("s") == -F.signum("p")).alias("against"), F.count_if(F.col("s") > 0).alias("up"), F.count_if(F.col("s") < 0).alias("down"), F.max("p").alias("p"))
    opposite = F.when(F.col("p") != 0, F.col("against")).otherwise(F.least("up", "down"))
    reasons = F.array_compact(F.array(F.when(F.col("n_units") < least, "too few units"), F.when(opposite < 1, "no unit against the pooled sign")))
    return signs.select("n_units", opposite.alias("n_opposite"), F.array_join(reasons, "; ").alias("reasons"))
