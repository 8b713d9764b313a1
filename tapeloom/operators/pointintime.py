"""Attributes as they were known at an event's time, by version number instead of by range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.times import floor_div
from tapeloom.session import written

#: Width of the time blocks that an entity's rows are split into.
BLOCK_MICROS = 3_600_000_000


def versions(facts: DataFrame, events: DataFrame, block_micros: int = BLOCK_MICROS) -> tuple[DataFrame, DataFrame]:
    """Number the versions of each entity and give every event instant its number.

    ``facts``: (entity, event_us, as_of_us, row_id), known from ``max(event_us, as_of_us)`` on;
    the version in force is the fact with the latest event_us, then as_of_us, then the smallest
    row_id among those known. ``events``: (entity, t), one row per instant. Returns
    (entity, version, row_id) and (entity, t, version); an event before any fact gets none.

    The number is the cumulative count of changes over narrow (entity, instant) rows. Rows of one
    entity are split into blocks of time; the best fact and the number of changes before a block
    are carried into it from one row per block, so that no task holds a whole entity. Facts that
    become known in the same instant are reduced to the best before anything is sorted.
    """
    best = F.max(F.struct(F.col("event_us").alias("e"), F.col("as_of_us").alias("a"), (-F.col("row_id")).alias("r")))
    known = facts.where("entity is not null and event_us is not null and as_of_us is not null and row_id is not null")
    changes = known.groupBy("entity", F.greatest("event_us", "as_of_us").alias("t")).agg(best.alias("best"))
    points = events.where("entity is not null and t is not null").select("entity", "t").distinct()
    rows = changes.withColumn("kind", F.lit(0)).unionByName(points.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = written(rows.withColumn("block", floor_div(F.col("t"), block_micros)), "instants")  # narrow, and read twice

    before = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Blocks that hold only events have a row, too, to be given what came before them.
    per_block = rows.groupBy("entity", "block").agg(F.max("best").alias("best"))
    carried = per_block.select("entity", "block", F.max("best").over(before).alias("carry"))

    inside = Window.partitionBy("entity", "block").orderBy("t", "kind")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(carried, ["entity", "block"]).withColumn("run", F.greatest(F.max("best").over(so_far), F.col("carry")))
    earlier = F.coalesce(F.lag("run").over(inside), F.col("carry"))
    run = run.withColumn("changed", (F.col("kind") == 0) & (earlier.isNull() | (F.col("run") > earlier)))
    run = written(run.select("entity", "block", "t", "kind", "changed", (-F.col("run.r")).alias("row_id"), F.sum(F.col("changed").cast("bigint")).over(so_far).alias("nth")), "versions")

    counts = run.groupBy("entity", "block").agg(F.max("nth").alias("n"))
    base = counts.select("entity", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = run.join(base, ["entity", "block"]).withColumn("version", F.col("base") + F.col("nth"))
    return (
        numbered.where("kind = 0 and changed").select("entity", "version", "row_id"),
        numbered.where("kind = 1 and version > 0").select("entity", "t", "version"),
    )


def known_at(events: DataFrame, entity: Column, at: Column, attributes: DataFrame, attribute_entity: Column, event_us: Column, as_of_us: Column, row_id: str, wide: list[str]) -> DataFrame:
    """Rows of ``events`` with the ``wide`` attributes that described their entity and were known at their time.

    Events whose entity or time is null, or that come before anything was known, are left out;
    repeated events each get their row. Facts without entity, event time or time of knowledge
    describe nothing. ``wide`` columns that ``events`` has as well are prefixed with ``known_``.
    """
    facts = attributes.select(attribute_entity.alias("entity"), event_us.alias("event_us"), as_of_us.alias("as_of_us"), F.col(row_id).alias("row_id"))
    signals = events.withColumns({"__entity": entity, "__t": at})
    numbers, instants = versions(facts, signals.select(F.col("__entity").alias("entity"), F.col("__t").alias("t")))
    named = [F.col(c).alias(c if c not in events.columns else f"known_{c}") for c in wide]
    rows = attributes.select(F.col(row_id).alias("__row_id"), *named)
    described = numbers.join(rows, F.col("row_id") == F.col("__row_id")).drop("row_id", "__row_id").withColumnsRenamed({"entity": "__e", "version": "__v"})
    instants = instants.withColumnsRenamed({"entity": "__ie", "t": "__it", "version": "__iv"})
    joined = signals.join(instants, (F.col("__entity") == F.col("__ie")) & (F.col("__t") == F.col("__it")))
    joined = joined.join(described, (F.col("__ie") == F.col("__e")) & (F.col("__iv") == F.col("__v")))
    return joined.drop("__entity", "__t", "__ie", "__it", "__iv", "__e", "__v")
