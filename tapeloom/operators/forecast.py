"""Forecasts turned into calibrated normal distributions, fitted by distributed grid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import normal
from tapeloom.session import written

#: Candidates to either side of the best in both directions, the first centre and step, how a step shrinks, and where it ends; in mean variances.
REACH, CENTRE, STEP, SHRINK, FINE = 4, 4.0, 1.0, 4.0, 1e-3
#: Rounds after which a search that still moves outward is an error.
ROUNDS = 40


def bracket_probability(mean: Column, sd: Column, low: Column, high: Column) -> Column:
    """P(low <= X < high) of a normal forecast; a null bound is open."""
    upper = F.when(high.isNull(), 1.0).otherwise(normal.cdf(high.cast("double"), mean, sd))
    lower = F.when(low.isNull(), 0.0).otherwise(normal.cdf(low.cast("double"), mean, sd))
    return F.when(sd > 0, upper - lower)


def _candidates(a: np.ndarray, b: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and factors around the best, a row for each."""
    side = np.arange(-REACH, REACH + 1)
    i, j = (x.ravel() for x in np.meshgrid(side, side, indexing="ij"))
    return np.maximum(a[:, None] + step[:, None] * i, 0), np.maximum(b[:, None] + step[:, None] * j, 0)


def _summed(keys: list[str]):
    """Sums of the scores of every candidate by key, from the samples of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                y, m, v, scale, a, b, step = (part[f"__{c}"].to_numpy(float) for c in ("y", "m", "v", "scale", "a", "b", "step"))
                offset, factor = _candidates(a, b, step)
                sd = np.sqrt(np.maximum(offset * scale[:, None] + factor * v[:, None], scale[:, None] * 1e-6))
                score = normal.crps_of(y[:, None], m[:, None], sd)
                code, names = pd.factorize(pd.MultiIndex.from_frame(part[keys]) if len(keys) > 1 else part[keys[0]], use_na_sentinel=False)
                sums = np.zeros((len(names), score.shape[1]))
                np.add.at(sums, code, score)
                out = names.to_frame(index=False) if len(keys) > 1 else pd.DataFrame({keys[0]: names})
                out.columns = keys
                yield out.assign(__sums=list(sums))

    return run


def fit_spread(samples: DataFrame, keys: list[str], y: str, mean: str, variance: str, least: int = 4) -> DataFrame:
    """(keys, n, bias, a, b, score): forecasts with the bias taken off and variance a + b v that score best by mean CRPS.

    The bias is the mean error. Each round scores every sample under a square of candidates
    around its key's best, sums them within each batch and then by key; the square moves on while
    the best lies on its edge, else it closes in, until steps are within FINE of the mean
    variance. What a round leaves is one row per key. Keys with fewer than ``least`` samples, and
    samples with a null, are left out; an equal score takes the smaller a, then b.
    """
    known = samples.where(F.col(y).isNotNull() & F.col(mean).isNotNull() & F.col(variance).isNotNull()).select(*keys, F.col(y).cast("double").alias("__y"), F.col(mean).cast("double").alias("__m"), F.col(variance).cast("double").alias("__v"))
    known = written(known, "samples")
    heads = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("__y") - F.col("__m")).alias("bias"), F.greatest(F.avg("__v"), F.lit(1e-9)).alias("__scale")).where(F.col("n") >= least)
    best = written(heads.withColumns({"__a": F.lit(CENTRE), "__b": F.lit(CENTRE), "__step": F.lit(STEP), "__score": F.lit(None).cast("double")}), "fit")
    schema = ", ".join(f"`{k}` {known.schema[k].dataType.simpleString()}" for k in keys) + ", __sums array<double>"
    side = F.array(*[F.lit(float(k)) for k in range(-REACH, REACH + 1)])
    for _ in range(ROUNDS):
        going = best.where(F.col("__step") > FINE)
        if going.isEmpty():
            out = best.select(*keys, "n", "bias", (F.col("__a") * F.col("__scale")).alias("a"), F.col("__b").alias("b"), F.col("__score").alias("score"))
            return out
        tried = known.join(going, keys).withColumn("__m", F.col("__m") + F.col("bias")).select(*keys, *[f"__{c}" for c in ("y", "m", "v", "scale", "a", "b", "step")])
        total = tried.mapInPandas(_summed(keys), schema).select(*keys, F.posexplode("__sums").alias("__k", "__s")).groupBy(*keys, "__k").agg(F.sum("__s").alias("__s"))
        width = 2 * REACH + 1
        placed = total.join(going, keys).withColumns({"__i": F.get(side, F.floor(F.col("__k") / width).cast("int")), "__j": F.get(side, F.pmod("__k", F.lit(width)))})
        at = F.struct(F.round(F.col("__s") / F.col("n"), 12).alias("s"), F.greatest(F.col("__a") + F.col("__i") * F.col("__step"), F.lit(0.0)).alias("a"), F.greatest(F.col("__b") + F.col("__j") * F.col("__step"), F.lit(0.0)).alias("b"))
        won = placed.groupBy(*keys).agg(F.min(at).alias("w"))
        moved = going.join(won, keys)
        edge = (F.col("w.a") >= F.col("__a") + REACH * F.col("__step")) | (F.col("w.b") >= F.col("__b") + REACH * F.col("__step")) | ((F.col("w.a") <= F.col("__a") - REACH * F.col("__step")) & (F.col("w.a") > 0)) | ((F.col("w.b") <= F.col("__b") - REACH * F.col("__step")) & (F.col("w.b") > 0))
        after = moved.select(*keys, "n", "bias", "__scale", F.col("w.a").alias("__a"), F.col("w.b").alias("__b"), F.when(edge, F.col("__step")).otherwise(F.col("__step") / SHRINK).alias("__step"), F.col("w.s").alias("__score"))
        best = written(after.unionByName(best.where(F.col("__step") <= FINE)), "fit")
    raise RuntimeError(f"the search still moves after {ROUNDS} rounds")
