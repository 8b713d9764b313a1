"""Censuses, persistence and monitoring: equal to SQL; forecasts against synthetic samples."""

from __future__ import annotations

import math

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import normal, tickers
from tapeloom.operators import forecast, matching
from tapeloom.plans import census


@pytest.mark.parametrize("name", sorted(census.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


def test_spread_is_recovered(spark):
    rng = np.random.default_rng(4)
    v = rng.uniform(0.5, 2, 800)
    mean = rng.normal(20, 5, 800)
    y = mean + 1.5 + rng.normal(0, np.sqrt(3 * v))
    df = spark.createDataFrame([("k", *map(float, r)) for r in zip(y, mean, v)] + [("few", 1.0, 1.0, 1.0), ("k", None, 1.0, 1.0)], "k string, y double, m double, v double")
    got = forecast.fit_spread(df, ["k"], "y", "m", "v").collect()
    assert [r.k for r in got] == ["k"] and got[0].n == 800
    fitted = np.sqrt(got[0].a + got[0].b * v)
    assert abs(got[0].bias - 1.5) < 0.3 and np.abs(fitted / np.sqrt(3 * v) - 1).mean() < 0.15


def test_the_fit_is_the_best_and_moves_outward(spark):
    rng = np.random.default_rng(8)
    data, want = [], {}
    for k, (a, b) in {"wide": (0.5, 30.0), "flat": (9.0, 0.0), "steep": (0.0, 0.3)}.items():
        v = rng.uniform(0.2, 3, 300)
        m = rng.normal(0, 2, 300)
        y = m + rng.normal(0, np.sqrt(a + b * v))
        data += [(k, *map(float, r)) for r in zip(y, m, v)]
        bias = np.mean(y - m)

        def score(x, z, y=y, m=m, v=v, bias=bias):
            return normal.crps_of(y, m + bias, np.sqrt(np.maximum(x * v.mean() + z * v, v.mean() * 1e-6))).mean()

        at, step = (4.0, 4.0), 4.0
        while step > 1e-4:  # a plain descent
            near = [(max(at[0] + i * step, 0), max(at[1] + j * step, 0)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            best = min(near, key=lambda c, score=score: score(*c))
            step, at = (step, best) if score(*best) < score(*at) - 1e-13 else (step / 2, at)
        want[k] = (score(*at), score, v.mean())
    got = forecast.fit_spread(spark.createDataFrame(data, "k string, y double, m double, v double"), ["k"], "y", "m", "v").collect()
    assert len(got) == 3
    for r in got:
        least, score, scale = want[r.k]
        assert math.isclose(r.score, score(r.a / scale, r.b), rel_tol=1e-6) and r.score <= least * (1 + 1e-5)
    assert next(r.b for r in got if r.k == "wide") > 15


def test_bracket_probability(spark):
    df = spark.createDataFrame([(0.0, 1.0, -1.0, 1.0), (0.0, 1.0, None, 0.0), (0.0, 1.0, 0.0, None), (0.0, 0.0, 0.0, 1.0)], "m double, s double, a double, b double")
    got = [r.p for r in df.select(forecast.bracket_probability(F.col("m"), F.col("s"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert np.allclose(got[:3], [math.erf(1 / math.sqrt(2)), 0.5, 0.5]) and got[3] is None


def test_cells_rules_and_initials(spark):
    df = spark.createDataFrame([(r"| a | b\|c | |", "A maker fades", "nyg", "New York Giants")], "l string, t string, s string, n string")
    r = df.select(tickers.cells(F.col("l")).alias("c"), tickers.first_rule(F.col("t"), {"fade": "x", "maker": "y"}, "z").alias("r"), matching.initials_of(F.col("s"), matching.tokens(F.col("n"))).alias("i")).first()
    assert r.c == ["a", "b|c", ""] and r.r == "x" and r.i
