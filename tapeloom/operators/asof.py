"""As-of joins: each left row with the nearest right row in time of its key, backward, forward or either way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.times import floor_div

#: Width of the time blocks that a key's rows are split into.
BLOCK_US = 6 * 3_600_000_000


def _last_before(rows: DataFrame, forward: bool) -> Column:
    """The nearest right row at or before (after) each row within its block, else that carried into the block."""
    order = [F.col("t").desc() if forward else F.col("t").asc(), F.col("is_left").asc()]
    inside = Window.partitionBy("k", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = (F.min if forward else F.max)(F.when(~F.col("is_left"), F.struct("t", F.col("right_id"))))
    return F.coalesce(near.over(inside), F.col("carry_f" if forward else "carry_b"))


def asof(left: DataFrame, right: DataFrame, direction: str = "backward", tolerance_us: int | None = None, strict: bool = False, block_us: int = BLOCK_US) -> DataFrame:
    """Pairs (left_id, right_id, gap_us) of ``left`` (k, t, id) and ``right`` (k, t, id).

    ``backward`` takes the last right row at or before the left one, ``forward`` the first at or
    after it, ``nearest`` the closer of both, the earlier on a tie. ``strict`` leaves out right
    rows of the same instant. Of right rows of one instant the smallest id stands for all. Left
    rows without key or time, or without a right row within ``tolerance_us``, are left out.

    Right rows are first reduced to one per key and instant. A key's rows are sorted block by
    block, with the nearest row before (after) each block carried in from one row per block; no
    task sorts a whole key.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such direction: {direction}")
    usable = "k is not null and t is not null"
    block = floor_div(F.col("t"), block_us).alias("block")
    near = right.where(usable).groupBy("k", "t").agg(F.min("id").alias("right_id"))
    none = F.lit(None).cast("bigint")
    # With strict, a left row takes its place just before or after its instant, in microseconds.
    lefts = left.where(usable).select("k", "t", F.col("id").alias("left_id"), F.lit(True).alias("is_left"), none.alias("right_id"), block)
    rights = near.select("k", "t", none.alias("left_id"), F.lit(False).alias("is_left"), "right_id", block)
    edges = rights.groupBy("k", "block").agg(F.max(F.struct("t", "right_id")).alias("last"), F.min(F.struct("t", "right_id")).alias("first"))
    blocks = lefts.select("k", "block").distinct().join(edges, ["k", "block"], "full_outer")
    order = Window.partitionBy("k").orderBy("block")
    carried = blocks.select("k", "block", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_b"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("carry_f"))

    def side(forward: bool) -> DataFrame:
        shift = F.lit((1 if forward else -1) * int(strict))
        moved = lefts.withColumn("t", F.col("t") + shift).withColumn("block", floor_div(F.col("t"), block_us))
        here = carried if not strict else None
        if here is None:  # the shift may reach into a block that holds no row
            more = blocks.select("k", "block").union(moved.select("k", "block")).distinct().join(edges, ["k", "block"], "left")
            here = more.select("k", "block", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_b"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("carry_f"))
        rows = moved.unionByName(rights).join(here, ["k", "block"])
        found = rows.withColumn("near", _last_before(rows, forward)).where("is_left and near is not null")
        return found.select("left_id", (F.col("t") - shift).alias("t"), F.col("near.right_id").alias("right_id"), F.abs(F.col("t") - shift - F.col("near.t")).alias("gap_us"), F.lit(forward).alias("later"))

    sides = {"backward": [False], "forward": [True], "nearest": [False, True]}[direction]
    out = side(sides[0])
    if len(sides) > 1:
        out = out.unionByName(side(True)).groupBy("left_id").agg(F.min(F.struct("gap_us", "later", "right_id")).alias("x")).select("left_id", F.col("x.right_id").alias("right_id"), F.col("x.gap_us").alias("gap_us"))
    out = out.select("left_id", "right_id", "gap_us")
    return out if tolerance_us is None else out.where(F.col("gap_us") <= tolerance_us)
