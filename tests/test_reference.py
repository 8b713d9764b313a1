"""The library's own operators: equal to their SQL twins, and to brute force on small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import ladder, stats, tickers
from tapeloom.operators import asof, bootstrap, fold, sequence, sets
from tapeloom.plans import reference


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_brute_force(spark, direction, strict):
    rng = random.Random(7)
    make = lambda n, first: [(rng.choice(["a", "b", None]), rng.choice([None, *range(12), 100, 101]), first + i) for i in range(n)]
    left, right = make(50, 0), make(40, 100)
    want = []
    for k, t, i in left:
        fit = [(u, j) for q, u, j in right if None not in (k, t, u) and q == k and not (strict and u == t)]
        fit = [x for x in fit if {"backward": x[0] <= t, "forward": x[0] >= t, "nearest": True}[direction]] if t is not None else []
        if fit:
            u, j = min(fit, key=lambda x: (abs(x[0] - t), x[0], x[1]))
            want.append((i, j, abs(u - t)))
    df = lambda d: spark.createDataFrame(d, "k string, t bigint, id bigint")
    assert rows(asof.asof(df(left), df(right), direction, strict=strict, block_us=5)) == sorted(want, key=repr)
    assert rows(asof.asof(df(left), df(right), direction, 1, strict, 5)) == sorted([w for w in want if w[2] <= 1], key=repr)
    assert rows(asof.asof(df([]), df(right), direction)) == rows(asof.asof(df(left), df([]), direction)) == []


def test_positions_against_a_loop(spark, small):
    data = [("A", 1, 1, True, 10, 0.5), ("A", 2, 2, True, 10, 0.7), ("A", 3, 3, False, 15, 0.9), ("A", 4, 4, False, 15, 0.8), ("B", 1, 5, False, 3, 0.1), (None, 1, 6, True, 1, 1.0), ("B", None, 7, True, None, 0.2)]
    df = spark.createDataFrame(data, "ticker string, loaded_at int, fill_row int, is_buy boolean, qty int, price double")
    got = {r.ticker: r for r in fold.positions(df, "ticker", ["loaded_at", "fill_row"], "is_buy", "qty", "price").collect()}
    assert set(got) == {"A", "B"} and got["B"].n_clamped == 1 and got["B"].open_qty == 0
    assert got["A"].open_qty == 0 and got["A"].n_clamped == 1 and np.isclose(got["A"].realised, 15 * 0.3 + 5 * 0.2)


def test_gated_runs_burst_and_sustained(spark):
    df = spark.createDataFrame([("k", 1, True, 30.0, 500.0), ("k", 2, True, 30.0, 500.0), ("k", 3, None, 30.0, 1.0), ("k", 4, True, 5.0, 50.0)], "k string, t int, hit boolean, s double, d double")
    got = rows(sequence.gated_runs(df, ["k"], ["t"], F.col("hit"), F.col("s"), F.col("d"), 60, 100).select("n", "seconds", "depth", "passes"))
    assert got == [(1, 5.0, 50.0, False), (2, 60.0, 500.0, True)]


def test_membership_and_missing(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 3, "b"), ("g", 3, None), ("g", 7, "a"), ("g", 7, "b")], "g string, d bigint, m string")
    assert rows(sequence.membership_changes(df, ["g"], "d", "m")) == [("g", 3, "a", "removed"), ("g", 7, "a", "added")]
    assert rows(sequence.missing_periods(df, ["g"], "d")) == [("g", 2, 2, 1), ("g", 4, 6, 3)]


def test_ladder_expressions(spark):
    df = spark.sql("select array(array(0.45D, 100D), array(0.44D, 50D), array(0.30D, 10D)) as a, array(array(0.45D, 60D), array(0.30D, 99D)) as b, array(1.0D, 4.0D, 2.0D, 2.0D) as s, array() as e")
    r = df.select(
        ladder.departures(F.col("a"), F.col("b"), F.lit(0.44)).alias("gone"), ladder.size_within(F.col("a"), F.lit(0.45), 0.05).alias("near"), ladder.spacing(F.col("s")).alias("gap"),
        ladder.faults(F.col("a")).alias("f"), ladder.walk(F.reverse(F.col("a")), F.lit(0.44), F.lit(20.0)).alias("w"), ladder.size_at_or_above(F.col("a"), F.lit(0.44)).alias("at"), F.to_json(ladder.best_first(F.reverse("a"))).alias("o"),
    ).first()
    assert (r.gone, r.near, r.gap, tuple(r.f), r.at) == (90.0, 150.0, 1.5, (0, 0, 0), 150.0)
    assert r.w.filled == 20.0 and np.isclose(r.w.cost, 10 * 0.3 + 10 * 0.44) and r.o.startswith("[[0.45")


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([("26JUL0621", " 1.5 "), ("26jan1512", "NaN"), ("26JUL0700", "1d"), ("KX-26JUL0700", "")], "t string, n string")
    got = {r.t: (r.u, r.v) for r in df.select("t", tickers.hour_token_micros(F.col("t")).alias("u"), tickers.number(F.col("n")).alias("v")).collect()}
    assert got["26JUL0621"] == (1783386000000000, 1.5) and got["26jan1512"][0] == 1768496400000000 and got["26JUL0700"][0] == 1783396800000000
    assert got["KX-26JUL0700"] == (None, None) and got["26jan1512"][1] is None and got["26JUL0700"][1] is None


def test_unique_match_never_guesses(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "l bigint, k string")
    right = spark.createDataFrame([(7, "a"), (8, "b"), (9, "b"), (10, None)], "r bigint, k string")
    assert rows(sets.unique_match(left, right, "k", "l", "r")) == [(1, 7, "matched"), (2, None, "ambiguous"), (3, None, "unmatched"), (4, None, "unmatched")]


def test_false_discovery_against_a_loop(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.205, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "i bigint, p double")
    kept = [r.i for r in stats.benjamini_hochberg(df, "p", 0.05).where("kept").collect()]
    limit = max((x for k, x in enumerate(sorted(p), 1) if x <= 0.05 * k / len(p)), default=-1)
    assert sorted(kept) == [i for i, x in enumerate(p) if x <= limit]


def test_long_silences_count_as_missing_order_days(spark, tmp_path):
    days = {1: [0, 1, 40, 41, 500], 2: [3, 3, 10], 3: [5], 4: [7, 8], 5: [-50, 0]}
    first = dt.datetime(1995, 1, 1)
    data = [(c, first + dt.timedelta(days=d)) for c, ds in days.items() for d in ds] + [(1, None)]
    spark.createDataFrame(data, "o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    want = []
    for c, ds in days.items():
        gone = [b - a - 1 for a, b in zip(sorted(set(ds)), sorted(set(ds))[1:]) if b > a + 1]
        want += [(c, sum(gone), max(gone))] if gone else []
    assert rows(reference.missing_order_days(spark, str(tmp_path))) == sorted(want) == [(1, 496, 458), (2, 6, 6), (5, 49, 49)]


def draw(b, s, n):
    """The index of a unit, as the operator's docstring has it."""
    m, (p, q, r, t) = bootstrap.PRIME, bootstrap.MULTIPLIERS
    x = ((b + bootstrap.SEED) * p % m * q + (s + 1) * r) % m
    x = (x * x + b * t) % m
    x = (x * x + s) % m
    return (x * p + bootstrap.SEED) % m % n


def test_bootstrap_takes_ten_thousand_samples_of_units(spark):
    data = [(u, (u * u * 7 + k * 3) % 41 - 20) for u in range(9) for k in range(u % 4 + 1)] + [(None, 99), (3, None)]
    per = [[y for v, y in data if v == u and y is not None] for u in range(9)]
    means = []
    for b in range(10_000):
        drawn = [per[draw(b, s, 9)] for s in range(9)]
        means.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
    means.sort()
    got = bootstrap.cluster_bootstrap(spark.createDataFrame(data, "u bigint, y bigint"), "u", "y").first()
    assert (got.n_units, got.total, got.n) == (9, sum(map(sum, per)), sum(map(len, per)))
    assert np.allclose([got.low, got.high], [means[250], means[9_750]]) and not np.allclose([got.low, got.high], [sorted(means[:200])[5], sorted(means[:200])[195]])
    none = bootstrap.cluster_bootstrap(spark.createDataFrame([], "u bigint, y bigint"), "u", "y").first()
    assert (none.n_units, none.low, none.high) == (0, None, None)
