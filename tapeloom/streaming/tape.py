"""Streams over tape: gaps in numbered streams, exactly-once appends, duplicates within a watermark, cadence by window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.sources import tape

GAPS = "market string, t bigint, expected bigint, got bigint, missed bigint"


def _track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Last number of one market: a snapshot starts anew, another number than the next is a gap."""
    rows = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")  # one market's share of a micro-batch
    seq = rows["seq"].to_numpy(np.int64)
    known = np.append([state.exists], np.ones(len(seq) - 1, bool))
    before = np.append([state.get[0] if state.exists else 0], seq[:-1])
    gap = known & ~rows["is_snapshot"].to_numpy(bool) & (seq != before + 1)
    state.update((int(seq[-1]),))
    if gap.any():
        yield pd.DataFrame({"market": key[0], "t": rows["t"].to_numpy()[gap], "expected": before[gap] + 1, "got": seq[gap], "missed": (seq - before - 1)[gap]})


def sequence_gaps(frames: DataFrame) -> DataFrame:
    """Gaps in a stream of (market, t, seq, is_snapshot), in order within and across micro-batches: (market, t, expected, got, missed)."""
    usable = frames.where("market is not null and t is not null and seq is not null").select("market", "t", "seq", F.coalesce("is_snapshot", F.lit(False)).alias("is_snapshot"))
    return usable.groupBy("market").applyInPandasWithState(_track, GAPS, "last bigint", "append", "NoTimeout")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key's first row within the watermark's delay; state is dropped behind it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def cadence(stream: DataFrame, family: str, at: str, capture: str, width: str, delay: str) -> DataFrame:
    """Captures per family and window: (family, starts, n_rows, n_captures), emitted once the watermark passes the window.

    Rows are counted per capture first and captures after that, so the number is exact; what a
    window keeps is one row per capture until it is emitted.
    """
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, width), family, capture).agg(F.count(F.lit(1)).alias("m"))
    by_window = counted.groupBy("window", family).agg(F.sum("m").alias("n_rows"), F.count(capture).alias("n_captures"))
    return by_window.select(family, F.col("window.start").alias("starts"), "n_rows", "n_captures")


def append_lines(stream: DataFrame, root: str, family: str, at: str, checkpoint: str, compression: str = "gzip") -> StreamingQuery:
    """Append a stream's records to the family's days as canonical lines, exactly once; :func:`tapeloom.sources.tape.lines` reads them.

    A record's own time decides its day, so the tape turns over at midnight UTC. Within a day each
    micro-batch has a folder of its own, replaced when the batch runs again.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = tape.dated(batch, at).withColumn("batch", F.lit(number))
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("dt", "batch").text(f"{root}/{family}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key is not in the target yet, exactly once: each micro-batch owns a folder by its number, rewritten whole when it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        had = committed(spark, target, number)
        if had is not None:
            fresh = fresh.join(had.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """What the target holds of the batches ahead of ``before``; None when there are none."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/_SUCCESS")) or []
    numbers = [int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found]
    paths = [f"{target}/batch={n}" for n in numbers if before is None or n < before]
    return spark.read.parquet(*paths) if paths else None


def replayed(query_input: DataFrame, work: str, schema: str | None = None) -> DataFrame:
    """Run an append stream over everything there is and read what it wrote."""
    run = query_input.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work}/state").option("path", f"{work}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return query_input.sparkSession.read.schema(schema or query_input.schema).parquet(f"{work}/out")
