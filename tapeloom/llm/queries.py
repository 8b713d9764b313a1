"""Queries p7 to p10, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.keys import key, sql_key
from tapeloom.functions.times import iso_micros, sql_iso_micros
from tapeloom.llm import encode, garble, leak, nearest
from tapeloom.sources.tables import table

TOLERANCE_US = 600_000_000


def _pairs(spark: SparkSession, at: str) -> DataFrame:
    entity = key("event_ticker").alias("entity")
    settles = table(spark, at, "hour_settles").select(entity, iso_micros("settle_close_iso").alias("t"), F.col("settle_id").alias("id"))
    captures = table(spark, at, "hour_captures").select(entity, iso_micros("captured_at").alias("t"), F.col("capture_row").alias("id"))
    return nearest.replay(settles, captures, TOLERANCE_US)


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return _pairs(spark, at).select(F.col("left_id").alias("settle_id"), F.col("right_id").alias("capture_row"))


def p7_hour_pairs(spark: SparkSession, at: str) -> DataFrame:
    """HourPair rows: each settled hour with its nearest spot capture."""
    pairs = p7_found(spark, at)
    settles = table(spark, at, "hour_settles").select("settle_id", "symbol", key("event_ticker").alias("event_ticker"), "settle_close_iso", "settle_value")
    captures = table(spark, at, "hour_captures").select("capture_row", "capture_id", "captured_at", "spot_price")
    return pairs.join(settles, "settle_id").join(captures, "capture_row").select("settle_id", "symbol", "event_ticker", "settle_close_iso", "settle_value", "capture_row", "capture_id", "captured_at", "spot_price")


_P7 = f"""
with s as (select settle_id, {sql_key("event_ticker")} as k, {sql_iso_micros("settle_close_iso")} as t from hour_settles),
c as (select capture_row, {sql_key("event_ticker")} as k, {sql_iso_micros("captured_at")} as t from hour_captures),
pairs as (
  select settle_id, capture_row from s join c on s.k = c.k and abs(s.t - c.t) <= {TOLERANCE_US}
  qualify row_number() over (partition by settle_id order by abs(s.t - c.t), c.t, capture_row) = 1)
"""
P7_SQL = f"{_P7} select settle_id, capture_row from pairs"
P7_WIDE_SQL = f"""{_P7}
select settle_id, x.symbol, {sql_key("x.event_ticker")} as event_ticker, settle_close_iso, settle_value, capture_row, capture_id, captured_at, spot_price
from pairs join hour_settles x using (settle_id) join hour_captures y using (capture_row)"""


def p8_ids(spark: SparkSession, at: str) -> DataFrame:
    return encode.token_ids(table(spark, at, "documents"))


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    return leak.leaked(table(spark, at, "documents"), table(spark, at, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, at: str) -> DataFrame:
    """Which items leaked, into how many pages, and the longest stretch of words."""
    cases = leak.leaked(table(spark, at, "documents"), table(spark, at, "eval_items"))
    return cases.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("n_words").alias("most_words"))


def p10_found(spark: SparkSession, at: str) -> DataFrame:
    return garble.garbled(table(spark, at, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, at: str) -> DataFrame:
    """The garbled pages with what was wrong with them and their restored text."""
    return garble.garbled(table(spark, at, "documents"))


QUERIES = {"p7_found": p7_found, "p7_hour_pairs": p7_hour_pairs, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_restored": p10_restored}
SQL = {"p7_found": P7_SQL, "p7_hour_pairs": P7_WIDE_SQL}
