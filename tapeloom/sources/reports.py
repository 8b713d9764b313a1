"""Small outputs: reports, alerts, snapshots of state, and one order over several kinds of records."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.tape import canonical


def _plain(value):
    """Dates as ISO strings, sets as sorted lists, rows as objects."""
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(_plain, value))
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def _write(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def table_text(columns: list[str], rows: list) -> str:
    """Rows as a table with bars; bars inside of cells are escaped."""
    cell = lambda v: "" if v is None else str(_plain(v)).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["-"] * len(columns), *[[cell(r[c]) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def write_report(df: DataFrame, stem: str, title: str, most: int = 10_000) -> int:
    """Write a summary as ``stem``.json and ``stem``.md and return its number of rows; more than ``most`` rows are no summary but an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    said = {"title": title, "rows": [_plain(r) for r in rows]}
    _write(df.sparkSession, f"{stem}.json", json.dumps(said, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    _write(df.sparkSession, f"{stem}.md", f"# {title}\n\n{table_text(df.columns, rows)}")
    return len(rows)


def alert(df: DataFrame, when, post: Callable[[str], None], most: int = 100) -> int:
    """Hand the rows for which ``when`` holds to ``post`` as one table, the first ``most`` of them with their whole number; nothing is posted for none."""
    hits = df.where(when)
    n = hits.count()
    if n:
        post(f"{n} alerts\n\n{table_text(df.columns, hits.limit(most).collect())}")
    return n


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a snapshot of state: the new one is written beside it and takes its place when it is whole."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    df.write.parquet(draft.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(draft, target)


def in_order(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Records of several kinds in the order of their parts, each by its own column: (seq, kind, line).

    ``seq`` grows along the order, with gaps: it is the place within a range of the order, so no
    task numbers all rows. Equal places are in the order of their lines.
    """
    out = None
    for n, (kind, df, by) in enumerate(parts):
        one = df.select(F.lit(n).alias("part"), F.lit(kind).alias("kind"), F.col(by).cast("string").alias("at"), canonical(df.columns).alias("line"))
        out = one if out is None else out.unionByName(one)
    placed = out.repartitionByRange("part", "at", "line").sortWithinPartitions("part", F.col("at").asc_nulls_first(), "line")
    return placed.select(F.monotonically_increasing_id().alias("seq"), "kind", "line")
