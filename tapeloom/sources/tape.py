"""Append-only tape: one JSON object per line in ``family/dt=DATE.jsonl`` files, read and written as tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tapeloom.functions.times import floor_div, micros

DAY_US = 86_400_000_000
#: A day of a family: one file, or a folder of parts (of batches).
FILE = r"^(.*/)?([^/]+)/dt=(\d{4}-\d{2}-\d{2})(\.jsonl(\.gz)?|(/batch=\d+)?/part-[^/]*)$"
NAMES = "{dt=*.jsonl,dt=*.jsonl.gz,part-*}"


def lines(spark: SparkSession, root: str) -> DataFrame:
    """Every line of a tape that is not blank: (family, dt, file_name, line).

    Only days count, at any depth: files ``dt=DATE.jsonl`` and the folders ``dt=DATE`` that
    :func:`append` writes; other files beside them are passed over. Files may be gzipped.
    ``file_name`` is ``family/dt=DATE.jsonl`` in either case.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).text(root).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    g = lambda n: F.regexp_extract("path", FILE, n)
    return raw.where(F.trim("line") != "").where(F.col("path").rlike(FILE)).select(g(2).alias("family"), g(3).alias("dt"), F.concat(g(2), F.lit("/dt="), g(3), F.lit(".jsonl")).alias("file_name"), "line")


def records(tape: DataFrame, schema: T.StructType | str, schema_version: str | None = None) -> DataFrame:
    """Lines as typed records: the columns of ``schema``, family, dt, file_name and bad.

    ``bad`` marks lines that are no JSON object or do not fit the schema, so that they can be
    counted; with ``schema_version`` only records of it are kept.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = tape.withColumn("r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | ~F.col("line").rlike(r"^\s*\{")
    out = read.select("family", "dt", "file_name", bad.alias("bad"), *[F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields])
    return out.where(F.col("schema_version") == schema_version) if schema_version else out


def days(tape: DataFrame) -> DataFrame:
    """The days there are of each family: (family, dt)."""
    return tape.select("family", "dt").distinct()


@F.pandas_udf(T.StringType())
def _ordered(text: pd.Series) -> pd.Series:
    """JSON with the keys of all objects in order, no blanks, ASCII only, and the shortest form of each float."""
    write = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode
    known = text.dropna()
    return pd.Series([write(v) for v in json.loads(f"[{','.join(known)}]")], known.index, object).reindex(text.index)


def canonical(columns: list[str]) -> Column:
    """A record as canonical JSON: keys in order at every level, no blanks, nulls written, other than ASCII escaped, floats in their shortest form.

    Spark writes neither these floats nor these escapes, so its JSON is read and written once more
    in Arrow batches; signatures depend on every byte.
    """
    return _ordered(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def dated(df: DataFrame, at: str) -> DataFrame:
    """Records as lines with the UTC day of ``at``: (value, dt); those without a time are left out."""
    day = F.date_from_unix_date(floor_div(micros(at), DAY_US).cast("int")).cast("string")
    return df.select(canonical(df.columns).alias("value"), day.alias("dt")).where("dt is not null")


def append(df: DataFrame, root: str, family: str, at: str, compression: str = "none") -> None:
    """Append records to the family's days; nothing is written for no rows. ``at`` decides the day; ``compression`` may be gzip."""
    dated(df, at).write.mode("append").option("compression", compression).partitionBy("dt").text(f"{root}/{family}")


def tagged(records: Mapping[str, DataFrame], tag: str = "record_kind") -> DataFrame:
    """Records of several kinds as lines of one ledger: (line), each with its kind under ``tag``."""
    out = None
    for kind, df in records.items():
        one = df.withColumn(tag, F.lit(kind)).select(canonical([*df.columns, tag]).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def untagged(ledger: DataFrame, schemas: Mapping[str, T.StructType | str], tag: str = "record_kind") -> dict[str, DataFrame]:
    """The records of a ledger's lines by kind; a line of another kind, or none, is an error when it is met."""
    kind = F.get_json_object("line", f"$.{tag}")
    known = F.when(kind.isin(*schemas), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of record: "), F.coalesce(kind, F.lit("none")))))
    marked = ledger.select("line", known.alias("kind"))
    return {k: marked.where(F.col("kind") == k).select(F.from_json("line", s if isinstance(s, str) else s.simpleString()).alias("r")).select("r.*") for k, s in schemas.items()}


def roll_up(spark: SparkSession, df: DataFrame, out: str, day: str, force: bool = False) -> None:
    """Write each day's rows once: days already there are left alone, or with ``force`` replaced; others stay."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if there and not force:
        df = df.join(spark.read.parquet(out).select(F.col(day).cast(df.schema[day].dataType).alias(day)).distinct(), day, "left_anti")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(out)


class Pages(DataSource):
    """A paginated pull replayed from stored pages: ``spark.read.format("pages").load(folder)``.

    The folder holds ``<series>/page-*.json``, each ``{"cursor": next or "", "records": [...]}``.
    A series is a partition; its pages follow their cursors, ``maxPages`` at most, and the last
    row of a pull that was cut there says so in ``truncated``.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "series string, page int, record string, truncated boolean"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(self.options["path"], int(self.options.get("maxPages", 1_000_000)))


class PageReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path if "://" in path else f"file://{path}", most

    def _open(self):
        """The file system of the folder, a local or a shared one, and the folder's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path.rstrip("/"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root))
        return [InputPartition(n) for n in sorted(f.base_name for f in found if f.type == fs.FileType.Directory)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        files, root = self._open()
        name = "page-0.json"
        for n in range(self.most):
            path = f"{root}/{partition.value}/{name}"
            if files.get_file_info(path).type != fs.FileType.File:
                return
            with files.open_input_stream(path) as stream:
                page = json.loads(stream.read())
            cursor = page.get("cursor") or ""
            cut = bool(cursor) and n + 1 == self.most
            for k, r in enumerate(page["records"]):
                yield partition.value, n, json.dumps(r, sort_keys=True), cut and k + 1 == len(page["records"])
            if not cursor:
                return
            name = f"page-{cursor}.json"
