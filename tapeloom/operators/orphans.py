"""References to records that do not exist (yet, or any more), for any child and parent table.

References are counted per key and period ahead of the shuffle. The keys that hold ``HEAVY_SHARE``
of all of them meet their parents by broadcast, the others by shuffled joins of the counts: an
anti-join finds the missing ones, and both halves are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import written

#: A key with at least this share of all references is heavy; there are at most 1 / share of them.
HEAVY_SHARE = 0.002
#: Kind of a key's period in which some rows are orphans and others are not, or of another kind.
MIXED = "mixed"


def parent_states(parents: DataFrame, key: Column, arrived: str, ceased: str) -> DataFrame:
    """One row per parent key: (key, first_at, gone_at); rows with a null key are left out."""
    keyed = parents.select(key.alias("key"), F.col(arrived).alias("arrived"), F.col(ceased).alias("ceased")).where("key is not null")
    return keyed.groupBy("key").agg(F.min("arrived").alias("first_at"), F.min("ceased").alias("gone_at"))


@dataclass
class _Split:
    """References by row and by (key, period), with the heavy keys' parents."""

    rows: DataFrame  # key, row_id, loaded, period
    counts: DataFrame  # key, period, n, first_loaded, last_loaded
    states: DataFrame
    heavy: DataFrame  # key, heavy, there, first_at, gone_at; 1 / heavy_share rows at most

    def light(self) -> DataFrame:
        """Orphan (key, period) of the keys that are not heavy: (key, period, n, kind, first_at, gone_at)."""
        rest = self.counts.join(F.broadcast(self.heavy.select("key")), "key", "left_anti")
        missing = rest.join(self.states, "key", "left_anti").select("key", "period", "n", F.lit("missing").alias("kind"), *[F.lit(None).cast(self.states.schema[c].dataType).alias(c) for c in ("first_at", "gone_at")])
        present = rest.join(self.states, "key").withColumn("kind", _kind_of_period()).where("kind is not null")
        return missing.unionByName(present.select(missing.columns))

    def hot(self) -> DataFrame:
        """The heavy keys' rows with their parents."""
        return self.rows.join(F.broadcast(self.heavy), "key")


def _kind_of_row() -> Column:
    return F.when(F.col("first_at") > F.col("loaded"), "late").when(F.col("gone_at") <= F.col("loaded"), "deleted")


def _kind_of_period() -> Column:
    """The kind of all rows between first_loaded and last_loaded of a present key; null if none is an orphan."""
    never = lambda c: F.coalesce(c, F.lit(True))
    all_late, none_late = F.col("last_loaded") < F.col("first_at"), never(F.col("first_at") <= F.col("first_loaded"))
    all_gone, none_gone = F.col("gone_at") <= F.col("first_loaded"), never(F.col("gone_at") > F.col("last_loaded"))
    return F.when(all_late, "late").when(~none_late, MIXED).when(all_gone, "deleted").when(~none_gone, MIXED)


def _split(children: DataFrame, key: Column, row_id: str, loaded_at: str, parents: DataFrame, parent_key: Column, arrived: str, ceased: str, heavy_share: float) -> _Split:
    period = F.date_format(F.col(loaded_at).cast("timestamp"), "yyyy-MM-dd")
    rows = children.select(key.alias("key"), F.col(row_id).cast("bigint").alias("row_id"), F.col(loaded_at).alias("loaded"), period.alias("period")).where("key is not null")
    counts = written(rows.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("loaded").alias("first_loaded"), F.max("loaded").alias("last_loaded")), "references")
    least = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(heavy_share), F.lit(2.0))).scalar()
    states = parent_states(parents, parent_key, arrived, ceased)
    heavy = counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    heavy = written(heavy.join(states.withColumn("there", F.lit(True)), "key", "left"), "heavy")
    return _Split(rows, counts, states, heavy)


def orphan_references(children: DataFrame, key: Column, row_id: str, loaded_at: str, parents: DataFrame, parent_key: Column, arrived: str, ceased: str, src: str, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Every row whose reference does not hold when it is loaded: (src, row_id, period, kind).

    ``missing``: no parent row has the key; ``late``: the first parent row arrived after the
    child; ``deleted``: the parent had ceased to exist by then. Null or blank references are no
    case. A child without ``loaded_at`` can only be ``missing``, with a null period. A parent
    key whose arrivals are all null is present and never late. Repeated child rows are judged one
    by one; empty tables give no rows (without parents every reference is ``missing``).

    Rows are touched again only where their key and period have orphans: those of heavy keys by
    broadcast, the others by a join with the orphan keys and periods.
    """
    s = _split(children, key, row_id, loaded_at, parents, parent_key, arrived, ceased, heavy_share)
    hot = s.hot().withColumn("kind", F.when(F.col("there").isNull(), "missing").otherwise(_kind_of_row()))
    found = s.light().select(F.col("key").alias("k"), F.col("period").alias("p"), "kind", "first_at", "gone_at")
    rest = s.rows.join(found, (F.col("key") == F.col("k")) & F.col("period").eqNullSafe(F.col("p")))
    rest = rest.withColumn("kind", F.when(F.col("kind") == MIXED, _kind_of_row()).otherwise(F.col("kind")))
    columns = [F.lit(src).alias("src"), "row_id", "period", "kind"]
    return hot.select(columns).unionByName(rest.select(columns)).where("kind is not null")


def orphan_counts(children: DataFrame, key: Column, row_id: str, loaded_at: str, parents: DataFrame, parent_key: Column, arrived: str, ceased: str, src: str, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Orphan references per period and kind: (src, period, kind, n), as :func:`orphan_references` would list them.

    Both halves' counts are united; rows are read again only for the keys' periods in which a
    parent arrived or ceased.
    """
    s = _split(children, key, row_id, loaded_at, parents, parent_key, arrived, ceased, heavy_share)
    hot = s.counts.join(F.broadcast(s.heavy), "key").withColumn("kind", F.when(F.col("there").isNull(), "missing").otherwise(_kind_of_period())).where("kind is not null")
    units = written(hot.select("key", "period", "n", "kind", "first_at", "gone_at").unionByName(s.light()), "orphan-keys")
    border = units.where(F.col("kind") == MIXED).select(F.col("key").alias("k"), F.col("period").alias("p"), "first_at", "gone_at")
    mixed = s.rows.join(border, (F.col("key") == F.col("k")) & (F.col("period") == F.col("p"))).withColumn("kind", _kind_of_row()).where("kind is not null")
    counted = units.where(F.col("kind") != MIXED).select("period", "kind", "n").unionByName(mixed.groupBy("period", "kind").agg(F.count(F.lit(1)).alias("n")))
    return counted.groupBy("period", "kind").agg(F.sum("n").alias("n")).select(F.lit(src).alias("src"), "period", "kind", "n")
