"""Ordering checks, scored matches, rounds and further statistics: equal to SQL, and to brute force on small fixtures."""

from __future__ import annotations

import math
import random
import threading

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import normal, stats, tickers
from tapeloom.operators import bootstrap, matching, quality, sequence
from tapeloom.plans import further


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(further.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


def test_best_before_against_all_pairs(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randrange(40), rng.randrange(1000), i) for i in range(150)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint, i bigint")
    want = []
    for k, o, v, i in data:
        less = [(w, j) for q, p, w, j in data if q == k and p < o]
        want.append((i, min(less)[0] if less else None))
    got = sequence.best_before(df, ["k"], ["o"], F.struct("v", "i"), "low", width=7)
    assert sorted((r.i, r.low and r.low.v) for r in got.collect()) == sorted(want)
    assert rows(sequence.best_before(df.where("false"), ["k"], ["o"], F.col("v"), "low")) == []


def test_a_crossing_of_rungs_that_are_no_neighbours_is_found(spark):
    df = spark.createDataFrame([("e", 1, 40, 61, "a"), ("e", 2, 55, 50, "b"), ("e", 3, 50, 55, "c")], "event string, lo bigint, ask bigint, no_ask bigint, ticker string")
    got = sequence.best_before(df, ["event"], ["lo"], F.struct("ask", "ticker"), "low")
    edges = {r.ticker: (r.low.ticker, 100 - r.low.ask - r.no_ask) for r in got.where("low is not null").collect()}
    assert edges == {"b": ("a", 10), "c": ("a", 5)}


def test_episodes_by_direction(spark):
    data = [("k", 1, "up", 3), ("k", 2, "up", 5), ("k", 3, None, 9), ("k", 4, "up", 2), ("k", 5, "down", 1), ("k", 9, "down", 4)]
    df = spark.createDataFrame(data, "k string, t bigint, s string, v int")
    got = rows(sequence.episodes(df, ["k"], ["t"], F.col("s"), F.col("v")).drop("run"))
    assert got == [("k", "down", 5, 9, 2, 1, 4), ("k", "up", 1, 2, 2, 3, 5), ("k", "up", 4, 4, 1, 2, 2)]


def test_missing_periods_over_blocks(spark):
    df = spark.createDataFrame([("g", d) for d in (1, 1, 3, 5000, 5001)] + [("g", None), ("h", -3000), ("h", 2)], "g string, d bigint")
    assert rows(sequence.missing_periods(df, ["g"], "d")) == [("g", 2, 2, 1), ("g", 4, 4999, 4996), ("h", -2999, 1, 3001)]


def score(a: str, b: str) -> float:
    """A plain loop over the rules of team scores."""
    words = lambda n: [w for w in n.lower().split() if w not in matching.NOISE] or n.lower().split()
    a, b = words(a), words(b)
    if set(a) == set(b):
        return 1.0
    if set(a) <= set(b) or set(b) <= set(a):
        return 0.85
    n = len(set(a) & set(b))
    for own, other in ((a, b), (b, a)):
        for t in set(own) - set(other):
            runs = {"".join(w[0] for w in other[i : i + len(t)]) for i in range(len(other) - len(t) + 1)}
            n += len(t) <= 4 and (t in runs or any(w.startswith(t) for w in other))
    return min(0.8, 0.8 * n / min(len(set(a)), len(set(b))))


def test_team_scores_against_a_loop(spark):
    names = ["Chicago White Sox", "Chicago WS", "CWS", "Los Angeles Lakers", "LA Lakers", "Lakers", "Real Madrid FC", "Madrid Real", "FC", "Atl Braves", "Atlanta Braves", "The Club"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    split = df.select("a", "b", matching.team_words(F.col("a")).alias("x"), matching.team_words(F.col("b")).alias("y"))
    got = split.select("a", "b", matching.team_score(F.col("x"), F.col("y")).alias("s")).collect()
    for r in got:
        assert math.isclose(r.s, score(r.a, r.b)), (r.a, r.b, r.s)
    empty = spark.createDataFrame([(None,), ("",), ("Ñandú Á.C.",)], "n string").select(matching.team_words(F.col("n")).alias("w")).collect()
    assert [r.w for r in empty] == [None, [], ["nandu", "a", "c"]]


def test_events_are_matched_by_time_teams_and_margin(spark):
    hour = 3_600_000_000
    make = lambda d: spark.createDataFrame(d, "id bigint, a string, b string, t bigint").select("id", matching.team_words(F.col("a")).alias("one"), matching.team_words(F.col("b")).alias("two"), "t")
    left = make([(1, "Chicago White Sox", "Boston Red Sox", 10 * hour), (2, "Leeds United", "Hull City", 10 * hour), (3, "Real Madrid", "Getafe", 50 * hour), (4, "Real Madrid", "Getafe", None), (5, "Nobody", "Else", 10 * hour)])
    right = make([(11, "Boston RS", "Chicago WS", 12 * hour), (12, "Leeds", "Hull", 11 * hour), (13, "Leeds", "Hull City", 9 * hour), (14, "Real Madrid", "Getafe", 54 * hour), (15, "Chicago White Sox", "Detroit", 10 * hour)])
    got = {r.left_id: (r.right_id, r.status) for r in matching.match_events(left, right).collect()}
    assert got == {1: (11, "matched"), 2: (None, "ambiguous"), 3: (None, "no_match"), 4: (None, "no_match"), 5: (None, "no_match")}
    assert rows(matching.match_events(left.where("false"), right)) == []


def _events(spark, d):
    df = spark.createDataFrame(d, "id string, a string, b string, t bigint")
    return df.select("id", matching.team_words(F.col("a")).alias("one"), matching.team_words(F.col("b")).alias("two"), "t")


def test_events_against_a_loop(spark):
    names = ["Chicago White Sox", "Chicago WS", "Boston Red Sox", "Boston RS", "Hull City", "Hull", "Leeds", "Leeds United", "Leeds City", "", None]
    r, half = random.Random(4), 1_800_000_000
    draw = lambda p, n: [(f"{p}{i:03d}", r.choice(names), r.choice(names), r.choice([None, *range(20)])) for i in range(n)]
    left, right = draw("l", 150), draw("r", 60) + [("same", "Hull", "Hull", 99), ("sole", "Leeds", "Hull", 99)]
    left += [("both", "Hull", "Hull", 99), ("turned", "Hull", "Leeds", 99)]
    want = {}
    for i, a, b, t in left:
        found = []
        for j, c, d, u in right:
            if all((a, b, c, d)) and t is not None and u is not None and abs(t - u) <= 6:
                sides = [(score(a, c), score(b, d)), (score(a, d), score(b, c))]
                found.append((max(sum(x) if min(x) >= 0.3 else 0.0 for x in sides), j))
        found = sorted((x for x in found if x[0] >= 1.2), reverse=True)
        clear = len(found) == 1 or len(found) > 1 and found[0][0] - found[1][0] >= 0.25
        want[i] = (found[0][1] if clear else None, round(found[0][0], 9) if found else None, "matched" if clear else "ambiguous" if found else "no_match")
    timed = lambda d: [(i, a, b, None if t is None else t * half) for i, a, b, t in d]
    got = {x.left_id: (x.right_id, x.score and round(x.score, 9), x.status) for x in matching.match_events(_events(spark, timed(left)), _events(spark, timed(right))).collect()}
    assert got == want
    assert {x[2] for x in want.values()} == {"matched", "ambiguous", "no_match"} and got["both"][0] == "same"


def test_many_events_of_the_same_teams_and_day(spark):
    """20,000 events of the same teams are not 400 million pairs: two minutes are far more than the match takes."""
    many = _events(spark, [("", "Barvel", "Dovvel", 0), ("sole", "Leeds", "Hull", 0)]).withColumn("k", F.explode(F.when(F.col("id") == "", F.sequence(F.lit(1), F.lit(20_000))).otherwise(F.array(F.lit(0)))))
    left = many.select(F.col("k").alias("id"), "one", "two", "t")
    right = left.withColumns({"one": F.transform("one", lambda x: F.substring(x, 1, 3)), "two": F.transform("two", lambda x: F.substring(x, 1, 3))})
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = matching.match_events(left, right).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("right_id").alias("right_id")).collect()
    finally:
        late.cancel()
    assert {(x.status, x.n, x.right_id) for x in got} == {("ambiguous", 20_000, None), ("matched", 1, 0)}


def test_names_of_outcomes(spark):
    df = spark.createDataFrame([("Leeds United", ["Hull", "Leeds", "Draw"]), ("Tie", ["Hull", "Leeds", " Draw"]), ("United", ["Leeds United", "Hull United"]), (None, ["a"]), ("Tie", ["a", "b"])], "n string, o array<string>")
    df = df.withColumn("w", matching.team_words(F.col("n"))).withColumn("ow", F.transform("o", lambda x: F.split(F.lower(x), " ")))
    assert [r.p for r in df.select(matching.best_name(F.col("n"), F.col("w"), F.col("o"), F.col("ow")).alias("p")).collect()] == [2, 3, None, None, None]


def test_holders_of_all_words(spark):
    make = lambda d: spark.createDataFrame(d, "id bigint, words array<string>")
    left, right = make([(1, ["a", "b"]), (2, ["a"]), (3, ["z"]), (4, []), (5, None)]), make([(7, ["a", "b", "c"]), (8, ["a"])])
    assert rows(matching.holders(left, right)) == [(1, 7, "matched"), (2, None, "ambiguous"), (3, None, "unmatched"), (4, None, "unmatched"), (5, None, "unmatched")]


def test_classes_of_long_chains(spark):
    ids = spark.createDataFrame([(i,) for i in range(60)], "id bigint")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 52), (52, 50), (51, 51)], "left_id bigint, right_id bigint")
    got = {r.id: (r.class_id, r.n_links) for r in matching.classes(pairs, ids).collect()}
    assert len(got) == 60 and all(got[i][0] == 0 for i in range(41)) and got[50] == (50, 1) and got[52] == (50, 1) and got[51] == (51, 0) and got[20][1] == 2


def test_many_units_draw_without_overflow(spark):
    df = spark.range(100_000).select(F.col("id").alias("u"), (F.col("id") % 7 - 3).alias("y"))
    out = bootstrap.cluster_bootstrap(df, "u", "y", samples=3).first()
    assert out.n_units == 100_000 and abs(out.low) < 0.1


def test_draws_are_even_and_not_in_step():
    n, samples = 40, 4000
    draws = np.array([[draw(b, s, n) for s in range(n)] for b in range(samples)])
    counts = np.bincount(draws.ravel(), minlength=n)
    assert abs(counts - samples).max() < 4 * math.sqrt(samples)
    centred = draws - draws.mean()
    assert abs(np.mean(centred[:, 1:] * centred[:, :-1]) / centred.var()) < 0.01 and abs(np.mean(centred[1:] * centred[:-1]) / centred.var()) < 0.01
    spread = draws.mean(axis=1).std() / (np.arange(n).std() / math.sqrt(n))
    assert 0.95 < spread < 1.05  # as independent draws would have it


def draw(b, s, n):
    m, (p, q, r, t) = bootstrap.PRIME, bootstrap.MULTIPLIERS
    x = ((b + bootstrap.SEED) * p % m * q + (s + 1) * r) % m
    x = (x * x + b * t) % m
    x = (x * x + s) % m
    return (x * p + bootstrap.SEED) % m % n


def test_grouped_bootstrap_against_a_loop(spark):
    rng = random.Random(1)
    data = [(k, rng.randrange(6), rng.randrange(-5, 9)) for k in "ab" for _ in range(30)] + [(None, 1, 1), ("a", None, 1), ("c", 1, 2)]
    got = {r.k: r for r in bootstrap.grouped_bootstrap(spark.createDataFrame(data, "k string, u bigint, y bigint"), ["k"], "u", "y", 200).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, r in got.items():
        units = sorted({u for q, u, _ in data if q == k and u is not None})
        per = [[y for q, v, y in data if q == k and v == u] for u in units]
        means = []
        for b in range(200):
            chosen = [per[draw(b, s, len(per))] for s in range(len(per))]
            means.append(sum(map(sum, chosen)) / sum(map(len, chosen)))
        assert np.allclose([r.low, r.high], np.quantile(means, [0.025, 0.975])) and math.isclose(r.p, (1 + sum(m <= 0 for m in means)) / 201)


def test_error_function_and_quantile(spark):
    x = np.linspace(-9, 9, 20_001)
    assert np.abs(normal._erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-13
    values = [3, 9, 9, 1, 4, None, 20, 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = spark.range(1).select(stats.exact_quantile(df, "v", p).alias("q")).first().q
        assert math.isclose(got, np.quantile([v for v in values if v is not None], p))


def test_rounds_and_ticks(spark):
    polls = spark.createDataFrame([("a", t) for t in (100, 101, 112, 149)] + [("b", 5)], "k string, t bigint")
    assert rows(quality.rounds(polls, ["k"], "t", 10)) == [("a", 5, 2, 1), ("b", 1, 0, 0)]
    legs = spark.createDataFrame([(1, "x", True), (1, "x", False), (1, "y", True), (2, "x", False)], "tick int, leg string, ok boolean")
    assert rows(quality.ticks(legs, "tick", "leg", "ok")) == [(1, 2, 0, 0, True), (2, 1, 1, 1, False)]


def test_tokens_of_days_clocks_and_months(spark):
    df = spark.createDataFrame([("26JUN02", "1930"), ("26FEB30", "1930"), ("26JUN02", "2460"), ("x", "0000")], "d string, h string")
    got = df.select(tickers.token_day(F.col("d")).alias("d"), tickers.clock_micros(F.col("d"), F.col("h")).alias("t")).collect()
    assert [r.d for r in got] == [20606, None, 20606, None] and [r.t for r in got] == [20606 * 86_400_000_000 + 70_200_000_000, None, None, None]
    year = spark.sql("select date'2026-01-14' as e").select(tickers.rolled_year(F.lit(12), F.col("e")).alias("a"), tickers.rolled_year(F.lit(1), F.col("e")).alias("b")).first()
    assert tuple(year) == (2025, 2026)
    half = spark.createDataFrame([(5,), (15,), (14,), (-5,), (-15,), (25,)], "t bigint").select(tickers.half_even(F.col("t"), 10).alias("h")).collect()
    assert [r.h for r in half] == [0, 2, 1, 0, -2, 2]
