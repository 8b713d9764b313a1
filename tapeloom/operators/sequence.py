"""Operators over ordered rows of a key: changes, runs, gaps, membership, lead and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.times import floor_div


#: Width of the blocks of the first order column that a key's rows are split into: six hours in microseconds.
BLOCK = 6 * 3_600_000_000


def ordered(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _split(df: DataFrame, order: list[str], width: int) -> DataFrame:
    return df.withColumn("__block", floor_div(F.col(order[0]), width))


def beside(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, ahead: bool = False, width: int = BLOCK) -> DataFrame:
    """Adds ``out``, a struct of the ``columns`` of the key's row before (or ahead of) each row; null where there is none.

    A key's rows are sorted in blocks of ``order[0]``, and what lies beyond a block's edge is
    carried into it from one row per block; so no task sorts a whole key, however hot it is.
    Rows with a null key see their own block only.
    """
    rows, cell = _split(df, order, width), F.struct(*columns)
    step = F.lead if ahead else F.lag
    edge = (F.min_by if ahead else F.max_by)(cell, F.struct(*order))
    edges = rows.groupBy(*keys, "__block").agg(edge.alias("__edge"))
    carried = edges.select(*keys, "__block", step("__edge").over(ordered(keys, ["__block"])).alias("__carry"))
    near = step(cell).over(ordered([*keys, "__block"], order))
    return rows.join(carried, [*keys, "__block"], "left").withColumn(out, F.coalesce(near, F.col("__carry"))).drop("__block", "__carry")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """Adds ``out``, the key's sum of ``value`` up to and with each row, from sums within and before its block."""
    rows = _split(df, order, width).withColumn("__value", value)
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    earlier = ordered(keys, ["__block"]).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "__block", F.sum("__sum").over(earlier).alias("__base"))
    here = F.sum("__value").over(ordered([*keys, "__block"], order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(base, [*keys, "__block"], "left").withColumn(out, here + F.coalesce("__base", F.lit(0))).drop("__block", "__value", "__base")


def best_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """Adds ``out``, the least ``value`` (a number or a struct) of the key's rows with a smaller ``order``; null where there is none.

    A running extreme in place of a join of all pairs, from one row per block; rows equal in ``order`` do not see each other.
    """
    rows = _split(df, order, width).withColumn("__value", value)
    least = rows.groupBy(*keys, "__block").agg(F.min("__value").alias("__least"))
    earlier = ordered(keys, ["__block"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = least.select(*keys, "__block", F.min("__least").over(earlier).alias("__carry"))
    # One row per place in the order, so that equal rows are left out together.
    at = rows.groupBy(*keys, "__block", *order).agg(F.min("__value").alias("__least"))
    here = F.min("__least").over(ordered([*keys, "__block"], order).rowsBetween(Window.unboundedPreceding, -1))
    places = at.withColumn("__here", here).drop("__least").join(carried, [*keys, "__block"])
    both = F.when(F.col("__here").isNull(), F.col("__carry")).when(F.col("__carry").isNull(), F.col("__here")).otherwise(F.least("__here", "__carry"))
    return rows.join(places.select(*keys, "__block", *order, both.alias(out)), [*keys, "__block", *order], "left").drop("__block", "__value")


def episodes(df: DataFrame, keys: list[str], order: list[str], state: Column, value: Column) -> DataFrame:
    """Stretches of neighbouring rows in one state, null states left out: (keys, run, state, first, last, n, entry, peak).

    ``first`` and ``last`` are the first order column's, ``entry`` is the value of the first row.
    A null state ends a stretch.
    """
    marked = df.withColumn("__state", state).withColumn("__v", value)
    near = beside(marked, keys, order, ["__state"], "__before")
    new = F.col("__before").isNull() | ~F.col("__state").eqNullSafe(F.col("__before.__state"))
    numbered = running(near.withColumn("__new", new), keys, order, F.col("__new").cast("bigint"), "run").where("__state is not null")
    out = numbered.groupBy(*keys, "run").agg(F.max("__state").alias("state"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("__v", F.struct(*order)).alias("entry"), F.max("__v").alias("peak"))
    return out


def without_largest_product(steps: DataFrame, keys: list[str], x: str, y: str, order: list[str], least: int) -> DataFrame:
    """Correlation of x and y without the row of the largest centred cross-product: (keys, n, r), null without variance.

    The product is (n x - sum x)(n y - sum y), whole numbers throughout; of equals the last row in
    ``order`` goes. Keys with fewer than ``least`` rows are left out.
    """
    known = steps.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy")).where(F.col("n") >= least)
    product = F.abs((F.col("n") * F.col(x) - F.col("sx")) * (F.col("n") * F.col(y) - F.col("sy")))
    largest = F.max(F.struct(product.alias("p"), *order, F.col(x).alias("x"), F.col(y).alias("y"))).alias("l")
    gone = known.join(sums, keys).groupBy(*keys).agg(largest).select(*keys, "l.x", "l.y")
    left = sums.join(gone, keys)
    n = (F.col("n") - 1).cast("double")
    sx, sy, sxx, syy, sxy = (c.cast("double") for c in (F.col("sx") - F.col("x"), F.col("sy") - F.col("y"), F.col("sxx") - F.col("x") * F.col("x"), F.col("syy") - F.col("y") * F.col("y"), F.col("sxy") - F.col("x") * F.col("y")))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return left.select(*keys, (F.col("n") - 1).alias("n"), F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy)).alias("r"))


def deltas(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds d_<column>, the change against the key's row before; null on its first row or where either is null."""
    near = beside(df, keys, order, columns, "__before")
    return near.withColumns({f"d_{c}": F.col(c) - F.col(f"__before.{c}") for c in columns}).drop("__before")


def runs(df: DataFrame, keys: list[str], order: list[str], state: Column, end: str) -> DataFrame:
    """Maximal stretches of rows with an equal state (null equals null): (keys, run, state, first, last, n).

    ``first`` and ``last`` are the smallest and largest ``end`` of the run; ``run`` counts from 1.
    """
    near = beside(df.withColumn("state", state), keys, order, ["state"], "__before")
    new = F.col("__before").isNull() | ~F.col("state").eqNullSafe(F.col("__before.state"))
    numbered = running(near.withColumn("__new", new), keys, order, F.col("__new").cast("bigint"), "run")
    return numbered.groupBy(*keys, "run").agg(F.max("state").alias("state"), F.min(end).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("n"))


def gated_runs(df: DataFrame, keys: list[str], order: list[str], hit: Column, seconds: Column, depth: Column, least_s: float, least_depth: float) -> DataFrame:
    """Runs of hits with their length and thinnest depth: (keys, run, n, seconds, depth, passes).

    A run passes if it lasts ``least_s`` and its depth never falls below ``least_depth``. A null
    hit is none; a run of unknown depth does not pass.
    """
    marked = df.select(*keys, *order, F.coalesce(hit, F.lit(False)).alias("hit"), seconds.alias("seconds"), depth.alias("depth"))
    hits = running(marked, keys, order, (~F.col("hit")).cast("bigint"), "run").where("hit")
    out = hits.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), F.min("depth").alias("depth"))
    return out.withColumn("passes", F.coalesce((F.col("seconds") >= least_s) & (F.col("depth") >= least_depth), F.lit(False)))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], columns: list[str], width: int = BLOCK) -> DataFrame:
    """Each column with the key's last value that is not null, its own row included."""
    rows = _split(df, order, width)
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "__block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in columns])
    earlier = ordered(keys, ["__block"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__block", *[F.last(f"__{c}", ignorenulls=True).over(earlier).alias(f"__{c}") for c in columns])
    here = ordered([*keys, "__block"], order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(carried, [*keys, "__block"], "left").withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"__{c}")) for c in columns})
    return filled.drop("__block", *[f"__{c}" for c in columns])


def joint_state(df: DataFrame, keys: list[str], order: list[str], member: str, value: str, members: list[str]) -> DataFrame:
    """The last seen value of every member at each row, once all have been seen: (keys, order, a column per member)."""
    spread = df.select(*keys, *order, *[F.when(F.col(member) == m, F.col(value)).alias(m) for m in members])
    filled = forward_fill(spread, keys, order, members)
    return filled.where(F.expr(" and ".join(f"`{m}` is not null" for m in members)))


def membership_changes(df: DataFrame, group: list[str], step: str, member: str) -> DataFrame:
    """Members that came or went between consecutive steps of a group: (group, step, member, change).

    Compared by presence at the neighbouring steps, one row per member and step, so that no set
    is gathered; steps and members are sorted in blocks. The first step adds nothing and the last
    removes nothing.
    """
    there = df.where(F.col(member).isNotNull()).select(*group, step, member).distinct()
    steps = there.select(*group, step).distinct()
    for name, ahead in (("__earlier", False), ("__later", True)):
        steps = beside(steps, group, [step], [step], name, ahead=ahead, width=1024)
    steps = steps.select(*group, step, F.col(f"__earlier.{step}").alias("before"), F.col(f"__later.{step}").alias("after"))
    shown = there.join(steps, [*group, step])
    for name, ahead in (("__seen", False), ("__next", True)):
        shown = beside(shown, [*group, member], [step], [step], name, ahead=ahead, width=1024)
    came = shown.where(F.col("before").isNotNull() & ~F.col(f"__seen.{step}").eqNullSafe(F.col("before"))).select(*group, step, member, F.lit("added").alias("change"))
    went = shown.where(F.col("after").isNotNull() & ~F.col(f"__next.{step}").eqNullSafe(F.col("after"))).select(*group, F.col("after").alias(step), member, F.lit("removed").alias("change"))
    return came.unionByName(went)


def lead_lag(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, least: int) -> DataFrame:
    """Per key the sums for the correlations of the changes of x and y at lag 0, x ahead by one and y ahead by one: (keys, n, r0, r_x_leads, r_y_leads).

    Keys with fewer than ``least`` steps are left out; a correlation without variance is null.
    """
    steps = lagged_steps(df, keys, order, x, y)
    return steps.groupBy(*keys).agg(F.count(F.col(f"d_{x}") + F.col(f"d_{y}")).alias("n"), rho(f"d_{x}", f"d_{y}").alias("r0"), rho("px", f"d_{y}").alias("r_x_leads"), rho(f"d_{x}", "py").alias("r_y_leads")).where(F.col("n") >= least)


def lagged_steps(df: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Adds d_x and d_y, the changes of both, and px and py, the changes one step before."""
    near = beside(deltas(df, keys, order, [x, y]), keys, order, [f"d_{x}", f"d_{y}"], "__before")
    return near.withColumn("px", F.col(f"__before.d_{x}")).withColumn("py", F.col(f"__before.d_{y}")).drop("__before")


def rho(x: str, y: str) -> Column:
    """Pearson correlation of the rows where both are known, from exact sums of whole numbers; null without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    total = lambda c: F.sum(F.when(both, c)).cast("double")
    n = F.count(F.when(both, 1))
    sx, sy = total(F.col(x)), total(F.col(y))
    sxx, syy, sxy = total(F.col(x) * F.col(x)), total(F.col(y) * F.col(y)), total(F.col(x) * F.col(y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))


def leave_one_out(df: DataFrame, keys: list[str], row: str, x: str, y: str, least: int = 4) -> DataFrame:
    """Per key the row without which the correlation of x and y is weakest: (keys, row, r), the smallest row on a tie.

    From the sums of the key less the row; nothing is paired.
    """
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    total = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("double").alias(a) for a, c in (("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("syy", F.col(y) * F.col(y)), ("sxy", F.col(x) * F.col(y)))]).where(F.col("n") >= least)
    less = sums.join(total, keys)
    n, sx, sy = F.col("n") - 1, F.col("sx") - F.col(x), F.col("sy") - F.col(y)
    vx = n * (F.col("sxx") - F.col(x) * F.col(x)) - sx * sx
    vy = n * (F.col("syy") - F.col(y) * F.col(y)) - sy * sy
    r = F.when((vx > 0) & (vy > 0), (n * (F.col("sxy") - F.col(x) * F.col(y)) - sx * sy) / F.sqrt(vx) / F.sqrt(vy))
    weakest = F.min(F.struct(F.round(F.abs(F.col("r")), 9).alias("a"), F.col(row).alias("row"), F.col("r").alias("r")))
    return less.withColumn("r", r).where("r is not null").groupBy(*keys).agg(weakest.alias("w")).select(*keys, F.col("w.row").alias(row), F.col("w.r").alias("r"))


def missing_periods(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Gaps in the whole numbers between a key's smallest and largest: (keys, first, last, n), one row per gap, however long."""
    there = df.where(F.col(period).isNotNull()).select(*keys, period).distinct()
    near = beside(there, keys, [period], [period], "__next", ahead=True, width=1024)
    gaps = near.where(F.col(f"__next.{period}") > F.col(period) + 1)
    return gaps.select(*keys, (F.col(period) + 1).alias("first"), (F.col(f"__next.{period}") - 1).alias("last"), (F.col(f"__next.{period}") - F.col(period) - 1).alias("n"))


def sequence_gaps(df: DataFrame, keys: list[str], order: list[str], seq: str, is_snapshot: Column) -> DataFrame:
    """Breaks in a numbered stream: (keys, order, expected, got, missed). A snapshot starts anew and is never a break."""
    near = beside(df, keys, order, [seq], "__before").withColumn("expected", F.col(f"__before.{seq}") + 1)
    rows = near.where(~is_snapshot & F.col("expected").isNotNull() & (F.col(seq) != F.col("expected")))
    return rows.select(*keys, *order, "expected", F.col(seq).alias("got"), (F.col(seq) - F.col("expected")).alias("missed"))
