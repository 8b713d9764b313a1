"""Further statistics and matches: equal to SQL, and to brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import normal, provenance, stats
from tapeloom.operators import matching
from tapeloom.plans import statistics


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(statistics.SQL))
def test_equals_sql(spark, duck, small, name):
    assert oracle.compare(spark, duck, name, small) == ""


def test_scored_pairs_are_complete(spark):
    rng = random.Random(2)
    names = [" ".join(rng.sample(["the", "the", "old", "new", "post", "echo", "argus", "north"], rng.randrange(1, 5))) for _ in range(40)] + ["", "x"]
    left = spark.createDataFrame(list(enumerate(names)), "id bigint, name string").select("id", matching.tokens(F.col("name")).alias("words"))
    got = {(a, b) for a, b, _ in rows(matching.scored_pairs(left, left, 0.6))}
    sets = [set(n.split()) for n in names]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_best_match_refuses_near_equals(spark):
    make = lambda d: spark.createDataFrame(d, "id bigint, name string").select("id", matching.tokens(F.col("name"), ("fc",)).alias("words"))
    left = make([(1, "Real Madrid FC"), (2, "United"), (3, "Nobody"), (4, "fc")])
    right = make([(7, "Real Madrid"), (8, "Leeds United"), (9, "Hull United"), (10, "FC")])
    got = {r.left_id: (r.right_id, r.status) for r in matching.best_match(left, right, 0.5, 0.25).collect()}
    assert got == {1: (7, "matched"), 2: (None, "ambiguous"), 3: (None, "no_match"), 4: (10, "matched")}


def test_folding(spark):
    df = spark.createDataFrame([("Þé Ñandú",), (None,)], "t string").select(matching.folded("t").alias("f"))
    assert [r.f for r in df.collect()] == ["þe nandu", None]


def test_normal_scores_against_quadrature(spark):
    df = spark.createDataFrame([(1.3, 0.5, 2.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (None, 0.0, 1.0)], "x double, m double, s double")
    got = df.select(normal.crps("x", "m", "s").alias("c"), normal.cdf("x", "m", "s").alias("p")).collect()
    for r, (x, m, s) in zip(got, [(1.3, 0.5, 2.0), (0.0, 0.0, 1.0)]):
        y = np.linspace(m - 12 * s, m + 12 * s, 400_001)
        density = np.exp(-(((y - m) / s) ** 2) / 2) / s / np.sqrt(2 * np.pi)
        cumulative = np.cumsum(density) * (y[1] - y[0])
        assert np.isclose(r.c, np.sum((cumulative - (y >= x)) ** 2) * (y[1] - y[0]), atol=1e-3)
        assert np.isclose(r.p, np.interp(x, y, cumulative), atol=1e-3)
    assert got[2].c is None and got[3].c is None


def test_signatures_and_files(spark, tmp_path):
    df = provenance.signed(spark.sql("select 1 as b, 'x' as a, cast(null as int) as n"))
    assert df.select(provenance.verified(df)).first()[0] is True
    broken = df.withColumn("b", F.lit(2))
    assert broken.select(provenance.verified(broken)).first()[0] is False
    (tmp_path / "one").write_bytes(b"1")
    (tmp_path / "two").write_bytes(b"2")
    (tmp_path / "more").write_bytes(b"3")
    listed = spark.createDataFrame([("one", "sha256:" + hashlib.sha256(b"1").hexdigest()), ("two", "0" * 64), ("gone", "0" * 64)], "p string, h string")
    assert rows(provenance.files_against(spark, f"file://{tmp_path}", listed, "p", "h")) == [("gone", "absent"), ("more", "unlisted"), ("one", "same"), ("two", "changed")]


def test_arrays_in_a_page(spark):
    df = spark.createDataFrame([("<script>var xs = [1, 2.5]; ys=[3,x];</script>",), ("xs = [1]; ys = [1, 2]",), ("none",)], "h string")
    got = [r.a for r in df.select(provenance.arrays_in_page(F.col("h"), ["xs", "ys"]).alias("a")).collect()]
    assert [tuple(x) for x in got[0]] == [(1.0, 3.0), (2.5, None)] and got[1] is None and got[2] is None


def test_running_total_is_exact(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v bigint, w bigint")
    got = {r.v: r.upto for r in stats.running_total(df, "v", F.col("w"), "upto", 16).collect()}
    total = 0
    for v in sorted(values):
        total += v % 7
        assert got[v] == total
