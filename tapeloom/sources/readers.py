"""Readers of the tape's families: what of a table is usable, as filters that reach the scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.times import floor_div, micros

DAY_US = 86_400_000_000


def two_sided(books: DataFrame, bid: str = "bid", ask: str = "ask", whole: int = 10_000) -> DataFrame:
    """Readings with both quotes inside of 0 and ``whole`` that do not cross, with twice their middle."""
    return books.where((F.col(bid) > 0) & (F.col(ask) < whole) & (F.col(bid) < F.col(ask))).withColumn("twice_mid", F.col(bid) + F.col(ask))


def decided(members: DataFrame, group: str, member: str, won: str, least: int) -> DataFrame:
    """Groups of ``least`` members or more of which exactly one won: (group, n, winner). A member won if any of its rows says so."""
    known = members.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    per = known.groupBy(group, member).agg(F.bool_or(won).alias("__won"))
    out = per.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("__won").alias("__n"), F.max(F.when(F.col("__won"), F.col(member))).alias("winner"))
    return out.where((F.col("n") >= least) & (F.col("__n") == 1)).select(group, "n", "winner")


def in_season(families: Mapping[str, tuple[DataFrame, str]], first: int, last: int) -> DataFrame:
    """Rows of several families as (family, d), the UTC day of their time, from day ``first`` to ``last``; rows without a time are left out."""
    out = None
    for name, (df, at) in families.items():
        one = df.select(F.lit(name).alias("family"), floor_div(micros(at), DAY_US).alias("d")).where(F.col("d").between(first, last))
        out = one if out is None else out.unionByName(one)
    return out


def watch_list(df: DataFrame, name: str, place: str, most: int) -> DataFrame:
    """The first ``most`` distinct names in order of their first ``place``, and whether there are more: (name, truncated)."""
    first = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(place).alias("__place"))
    top = first.orderBy("__place", name).limit(most + 1)  # a bounded number of rows
    numbered = top.withColumn("__r", F.row_number().over(Window.orderBy("__place", name)))
    more = first.agg(F.count(F.lit(1)) > most).scalar()
    return numbered.where(F.col("__r") <= most).select(name, more.alias("truncated"))
