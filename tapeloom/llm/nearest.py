"""Records of two tables paired by nearest time within a tolerance, as a stateful streaming join."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import scratch

#: What both sides look like: t and id are the record's microseconds and row id.
SIDE = "entity string, t bigint, id bigint"
#: A record on its way to a state: the entity as 128 bits.
ROWS = "shard int, k1 bigint, k2 bigint, t bigint, id bigint, is_left boolean"
PAIRS = "left_id bigint, left_t bigint, right_id bigint, right_t bigint, gap bigint"
STATE = "lefts binary, rights binary"
#: Entities with at least this share of the right side are split over several shards, in proportion to it.
HEAVY_SHARE = 0.01
#: Staged rows to a file, files to a micro-batch for each core, and rows to a shard at least.
FILE_ROWS, CORE_FILES, SHARD_ROWS = 1_000_000, 2, 20_000
#: The closing row's time, in 2261; instants beyond it either way take no part.
LAST_US = 9_190_000_000_000_000
#: A watermark starts at 1970, before which all is late, and batches of times reach to 2262; so event times are moved on by SHIFT_US and run at one PACE-th.
SHIFT_US, PACE = 9_200_000_000_000_000, 2
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.shuffle.partitions": None,
}


def _load(raw: bytes | None) -> np.ndarray:
    """Rows (k1, k2, t, id)."""
    return np.frombuffer(raw, np.int64).reshape(-1, 4) if raw else np.zeros((0, 4), np.int64)


def _earliest(rows: np.ndarray) -> np.ndarray:
    """One row per entity and instant, the smallest id, in order."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])]


def nearest(lefts: np.ndarray, rights: np.ndarray, tolerance: int) -> pd.DataFrame:
    """For each row of ``lefts`` the nearest of ``rights`` of its entity, the earlier one on equal gaps, if within ``tolerance``.

    Both are put into one order by entity and time; the right rows before and behind a left row
    are then running extremes of their places.
    """
    rights = _earliest(rights)
    both = np.concatenate([rights, lefts])
    is_left = np.arange(len(both)) >= len(rights)
    order = np.lexsort((is_left, both[:, 2], both[:, 1], both[:, 0]))
    both, is_left = both[order], is_left[order]
    n = len(both)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(is_left, -1, place)) if n else place
    after = np.minimum.accumulate(np.where(is_left, n, place)[::-1])[::-1] if n else place
    at = np.flatnonzero(is_left)
    t, far = both[at, 2], np.iinfo(np.int64).max

    def gap(to: np.ndarray, there: np.ndarray) -> np.ndarray:
        there = there & (both[np.clip(to, 0, n - 1), :2] == both[at, :2]).all(axis=1) if n else there
        return np.where(there, np.abs(both[np.clip(to, 0, n - 1), 2] - t), far) if n else t

    low, high = gap(before[at], before[at] >= 0), gap(after[at], after[at] < n)
    found = np.where(low <= high, before[at], after[at])
    near = np.minimum(low, high)
    good = near <= tolerance
    found, at = found[good], at[good]
    return pd.DataFrame({"left_id": both[at, 3], "left_t": both[at, 2], "right_id": both[found, 3], "right_t": both[found, 2], "gap": near[good]})


def _pair(tolerance: int, shift: int = 0, pace: int = 1):
    """The state machine of one shard: buffer both sides of its entities, emit behind the watermark (of times moved on by ``shift`` at one ``pace``-th), evict."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lefts, rights = map(_load, state.get) if state.exists else (_load(None), _load(None))
        more = [(pdf[["k1", "k2", "t", "id"]].to_numpy(np.int64), pdf["is_left"].to_numpy(bool)) for pdf in batches]
        lefts = np.concatenate([lefts, *[rows[left] for rows, left in more]])
        rights = _earliest(np.concatenate([rights, *[rows[~left] for rows, left in more]]))  # of one instant only one can be nearest
        passed = state.getCurrentWatermarkMs() * 1000 * pace - shift
        due = lefts[:, 2] + tolerance < passed  # nothing that could still come is near enough
        out = nearest(lefts[due], rights, tolerance) if due.any() else None
        lefts = lefts[~due]
        rights = rights[rights[:, 2] + 2 * tolerance >= passed]  # what a left row still to come could use, or one that waits
        if len(lefts) or len(rights):
            state.update((lefts.tobytes(), rights.tobytes()))
            last = lefts[:, 2].min() + tolerance if len(lefts) else rights[:, 2].max() + 2 * tolerance
            state.setTimeoutTimestamp(int((max(last, passed) + shift) // (1000 * pace) + 1))
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out

    return run


def keyed(left: DataFrame, right: DataFrame, shards: int, heavy: Mapping[str, int] | None = None) -> DataFrame:
    """Both sides as rows of shards (ROWS); those without entity, time or id are left out.

    ``heavy`` says over how many shards an entity is spread: its right rows by their ids, while
    every left row goes to all of them.
    """
    usable = f"entity is not null and abs(t) <= {LAST_US} and id is not null"
    spread = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair]), F.col("entity")), F.lit(1)) if heavy else F.lit(1)
    shard = lambda salt: F.pmod(F.xxhash64("entity") + salt, F.lit(shards)).cast("int").alias("shard")
    own = [F.xxhash64("entity").alias("k1"), F.xxhash64("entity", F.lit("second")).alias("k2"), "t", "id"]
    lefts = left.where(usable).withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1)))
    rights = right.where(usable).withColumn("salt", F.pmod(F.xxhash64("id"), spread))
    return lefts.select(shard(F.col("salt")), *own, F.lit(True).alias("is_left")).unionByName(rights.select(shard(F.col("salt")), *own, F.lit(False).alias("is_left")))


def paired(rows: DataFrame, tolerance_us: int, delay: str) -> DataFrame:
    """Candidate pairs of a stream of shards' rows: (left_id, left_t, right_id, right_t, gap)."""
    timed = rows.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("t") + SHIFT_US, F.lit(PACE)))).withWatermark("ts", delay)
    return timed.groupBy("shard").applyInPandasWithState(_pair(tolerance_us, SHIFT_US, PACE), PAIRS, STATE, "append", "EventTimeTimeout")


def nearest_stream(left: DataFrame, right: DataFrame, tolerance_us: int, delay: str = "10 minutes", shards: int = 64, heavy: Mapping[str, int] | None = None) -> DataFrame:
    """The streaming join of two streams (entity, t, id): candidate pairs as (left_id, left_t, right_id, right_t, gap).

    Both sides are buffered per entity; a left row is emitted once the watermark has passed its
    tolerance horizon, and right rows that no left row can use any more are evicted. Entities lie
    together in ``shards`` states, as sorted arrays; a left row of a ``heavy`` entity has a
    candidate from each of its shards, of which :func:`best` keeps the nearest.
    """
    return paired(keyed(left, right, shards, heavy), tolerance_us, delay)


def best(candidates: DataFrame) -> DataFrame:
    """The nearest candidate of each left row: the earlier one on equal gaps, then the smaller id."""
    near = F.min(F.struct("gap", "right_t", "right_id")).alias("near")
    return candidates.groupBy("left_id").agg(near).select("left_id", F.col("near.right_id").alias("right_id"), F.col("near.gap").alias("gap"))


def heavy_entities(right: DataFrame, shards: int, share: float = HEAVY_SHARE) -> dict[str, int]:
    """Entities with at least ``share`` of the rows, ``1 / share`` at most, with the shards they are spread over."""
    counts = right.where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    found = counts.where((F.col("n") >= total * share) & (F.col("n") > SHARD_ROWS)).select("entity", (F.col("n") / total).alias("part")).collect()
    return {r.entity: max(2, min(shards, round(2 * r.part * shards))) for r in found}


def _in_order(spark: SparkSession, folder: str) -> bool:
    """Date the files of a folder by their names, so that a stream reads them in that order; False where the file system keeps its own times."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    want = [1_000_000_000_000 + 1000 * k for k in range(len(files))]
    for p, at in zip(files, want):
        fs.setTimes(p, at, -1)
    return [fs.getFileStatus(p).getModificationTime() for p in files] == want


def replay(left: DataFrame, right: DataFrame, tolerance_us: int, file_rows: int = FILE_ROWS, files: int | None = None) -> DataFrame:
    """Run the streaming join over whole tables (entity, t, id): (left_id, right_id, gap), one row per matched left row.

    Rows are staged in order of time, ``file_rows`` to a file, and the stream takes ``files`` of
    them at once; the watermark follows, so a state holds what lies within the tolerance of a
    micro-batch and no more. One closing row, later than all others, moves the watermark past
    every horizon. Rows without entity or time (or outside of 1679 to 2261) take no part; of
    repeated rows each left one gets its pair; an empty table gives no rows. State and output lie
    in the shared folder.
    """
    spark = left.sparkSession
    work = scratch(spark, "nearest")
    n = left.count() + right.count()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(most, max(spark.sparkContext.defaultParallelism, n // SHARD_ROWS + 1))
    rows = keyed(left, right, shards, heavy_entities(right, shards))
    closing = spark.createDataFrame([(0, 0, 0, LAST_US, -1, True)], ROWS)
    rows.unionByName(closing).repartitionByRange(n // file_rows + 1, "t").write.parquet(f"{work}/rows")
    ordered = _in_order(spark, f"{work}/rows")
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value or str(shards))
    try:
        reader = spark.readStream.schema(ROWS)
        if ordered:  # else all files make one micro-batch, for no row may come behind the watermark
            reader = reader.option("maxFilesPerTrigger", files or CORE_FILES * spark.sparkContext.defaultParallelism)
        staged = reader.parquet(f"{work}/rows")
        run = paired(staged, tolerance_us, "1 second").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work}/state").option("path", f"{work}/pairs").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return best(spark.read.schema(PAIRS).parquet(f"{work}/pairs"))
