"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers are dictionary-encoded exactly (shard, code), the codes already seen are kept as
compressed bitmaps of 4 KB per bucket and shard, one arrival is selected per unseen bit, and the
new bits are united with the old ones by publishing one log entry.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import scratch, written

DICTIONARY = "k1 string, k2 string, shard int, code bigint"
BITMAPS = "shard int, bucket bigint, bits binary"
#: So many folders of new bits are united into one when the next are written.
FOLD_AT = 16
SHARDS = 64
#: Consecutive slices of arrivals that :func:`repeated` hands to its store one after another.
SLICES = 2


def _bit(bits: Column, position: Column) -> Column:
    """Whether the bit at ``position`` (from 0) is set in a 4 KB bitmap."""
    byte = F.conv(F.hex(F.substring(bits, F.call_function("div", position, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))


@dataclass(frozen=True)
class Snapshot:
    """What the log says at one version: the live folders of the dictionary and of the bitmaps."""

    version: int
    shards: int | None
    dictionaries: tuple[str, ...]
    bitmaps: tuple[str, ...]


class SeenStore:
    """Dictionary of identifiers and bitmaps of those accepted so far, in one folder.

    A log of numbered entries says what holds. A writer puts its data into a folder of its own and
    then publishes the entry that follows the version it started from; the entry appears whole or
    not at all, and of two writers one fails without having touched anything of the other's. An
    identifier may be in the dictionary without being accepted (encoded ahead, or by a run that
    died before its bits were published): its bit alone says whether it was seen.

    The dictionary and the bitmaps grow by what is new; after ``FOLD_AT`` folders the bitmaps are
    written whole once. Files are in order of the shard, so that readers of few shards skip the
    rest. The number of shards is part of the log; opening a store with another is an error.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        stored = self.snapshot().shards
        if stored and shards and stored != shards:
            raise ValueError(f"{self.path} has {stored} shards, not {shards}")
        self.shards = stored or shards or SHARDS

    def _java(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, conf, root.getFileSystem(conf)

    def _entries(self) -> dict[int, dict]:
        jvm, _, fs = self._java()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/*.json")) or []
        out = {}
        for status in found:
            stream = fs.open(status.getPath())
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            out[int(status.getPath().getName().split(".")[0])] = json.loads(text)
        return out

    def versions(self) -> list[int]:
        """Numbers of the published entries, oldest first."""
        return sorted(self._entries())

    def snapshot(self) -> Snapshot:
        dictionaries, bitmaps, version, shards = [], [], 0, None
        for version, entry in sorted(self._entries().items()):
            shards = entry["shards"]
            dictionaries += [entry["dictionary"]] if entry.get("dictionary") else []
            bitmaps = bitmaps if not entry.get("whole") else []
            bitmaps += [entry["bitmaps"]] if entry.get("bitmaps") else []
        return Snapshot(version, shards, tuple(dictionaries), tuple(bitmaps))

    def _publish(self, version: int, **entry) -> None:
        """Make an entry version ``version``, whole or not at all; fails if there is one."""
        jvm, conf, fs = self._java()
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"shards": self.shards, **entry}).encode()))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{version:012d}.json")
        fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:  # renaming without overwriting is atomic
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was published by another writer") from e

    def _read(self, folders: tuple[str, ...], schema: str) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return folder

    def dictionary(self, at: Snapshot | None = None) -> DataFrame:
        """Every encoded identifier: (k1, k2, shard, code)."""
        return self._read((at or self.snapshot()).dictionaries, DICTIONARY)

    def bitmaps(self, at: Snapshot | None = None) -> DataFrame:
        """The codes accepted so far: (shard, bucket, bits)."""
        parts = self._read((at or self.snapshot()).bitmaps, BITMAPS)
        return parts.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _coded(self, ids: DataFrame, at: Snapshot) -> tuple[DataFrame, str | None]:
        """``ids`` with shard and code, and the folder with those that are new to the dictionary."""
        sharded = ids.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), F.lit(self.shards)).cast("int"))
        if not at.dictionaries:
            fresh, known, top = sharded, None, None
        else:
            sharded = written(sharded, "dedup-ids")
            touched = [r.shard for r in sharded.select("shard").distinct().collect()]  # numbers of shards
            entries = self.dictionary(at).where(F.col("shard").isin(touched))
            # The dictionary is only scanned where the batch is small: an inner join may send the batch to it.
            found = entries.join(sharded.select("k1", "k2", "shard"), ["k1", "k2", "shard"]).select("k1", "k2", "shard", "code")
            known = written(sharded.join(found, ["k1", "k2", "shard"], "left"), "dedup-known")
            fresh = known.where("code is null").drop("code")
            top = entries.groupBy("shard").agg(F.max("code").alias("top"))  # a row per shard
        code = F.row_number().over(Window.partitionBy("shard").orderBy("k1", "k2")).cast("bigint")
        if top is not None:
            fresh = fresh.join(F.broadcast(top), "shard", "left").withColumn("top", F.coalesce("top", F.lit(0)))
            code = code + F.col("top")
        fresh = written(fresh.withColumn("code", code).select(*sharded.columns, "code"), "dedup-fresh")
        folder = self._write(fresh.select("k1", "k2", "shard", "code"), "dictionary")
        return (fresh if known is None else known.where("code is not null").select(fresh.columns).unionByName(fresh)), folder

    def _unseen(self, coded: DataFrame, at: Snapshot) -> tuple[DataFrame, str, bool]:
        """The rows of ``coded`` whose bit is not set, the folder with their bits, and whether that holds all others, too."""
        placed = coded.withColumn("bucket", F.bitmap_bucket_number("code")).withColumn("bit", F.bitmap_bit_position("code"))
        if at.bitmaps:
            placed = placed.join(self.bitmaps(at), ["shard", "bucket"], "left").where(~_bit(F.col("bits"), F.col("bit"))).drop("bits")
        unseen = written(placed, "dedup-unseen")
        bits = unseen.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        whole = len(at.bitmaps) >= FOLD_AT
        if whole:
            bits = self.bitmaps(at).unionByName(bits).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return unseen.drop("bucket", "bit"), self._write(bits.sortWithinPartitions("shard", "bucket"), "bitmaps"), whole

    def encode(self, ids: DataFrame) -> DataFrame:
        """``ids``, rows with distinct (k1, k2) and any other columns, with shard and code; new identifiers are added to the dictionary, not accepted."""
        at = self.snapshot()
        coded, folder = self._coded(ids, at)
        self._publish(at.version + 1, dictionary=folder)
        return coded

    def accept(self, coded: DataFrame) -> DataFrame:
        """The rows of ``coded``, at most one per (shard, code), whose bit was not set; from now on it is."""
        at = self.snapshot()
        unseen, folder, whole = self._unseen(coded, at)
        self._publish(at.version + 1, bitmaps=folder, whole=whole)
        return unseen

    def ingest(self, arrivals: DataFrame, k1: Column, k2: Column, order: Column, row_id: str) -> DataFrame:
        """The one arrival of each message not seen before: (k1, k2, shard, code, row_id, copies).

        ``order`` decides which arrival of this batch is kept, then the smaller ``row_id``; of a
        message seen in an earlier batch none is. Rows where either key is null are no messages
        and do not appear. The partial aggregation ahead of the shuffle leaves one row of a hot
        message per task, so its share of the input does not matter.
        """
        at = self.snapshot()
        keyed = arrivals.select(k1.alias("k1"), k2.alias("k2"), order.alias("at"), F.col(row_id).alias("row_id")).where("k1 is not null and k2 is not null")
        first = keyed.groupBy("k1", "k2").agg(F.min(F.struct("at", "row_id")).alias("first"), F.count(F.lit(1)).alias("copies"))
        coded, dictionary = self._coded(first.select("k1", "k2", F.col("first.row_id").alias("row_id"), "copies"), at)
        unseen, bitmaps, whole = self._unseen(coded, at)
        self._publish(at.version + 1, dictionary=dictionary, bitmaps=bitmaps, whole=whole)
        return unseen.select("k1", "k2", "shard", "code", "row_id", "copies")


def repeated(arrivals: DataFrame, k1: Column, k2: Column, delivered_at: str, row_id: str, store: SeenStore | None = None, slices: int = SLICES) -> DataFrame:
    """The ``row_id`` of every arrival that is a further copy of a message (one column).

    A message is all rows with both keys equal; its first row by ``delivered_at`` (null last),
    then ``row_id``, is the copy that stays. Rows where a key is null are never copies, and
    ``row_id`` must be unique. An empty table gives no rows. Without a ``store`` the table is
    judged by itself, against an empty store in the shared folder; with one, messages it has
    accepted before are copies, too.

    All identifiers are encoded at once. Arrivals are then cut by their time into ``slices``
    (estimated quantiles; where they lie changes no result) that the store is given one after
    another, and the bits left by the earlier ones decide what of the later ones is new.
    """
    spark = arrivals.sparkSession
    store = store or SeenStore(spark, scratch(spark, "seen"), max(SHARDS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    messages = arrivals.where(k1.isNotNull() & k2.isNotNull())
    keyed = messages.select(k1.alias("k1"), k2.alias("k2"), F.col(delivered_at).alias("t"), F.col(row_id).alias("row_id"))
    cuts = keyed.agg(F.percentile_approx(F.unix_micros(F.col("t").cast("timestamp")), [k / slices for k in range(1, slices)], 100)).first()[0] if slices > 1 else None
    us = F.unix_micros(F.col("t").cast("timestamp"))
    number = F.when(us.isNull(), slices - 1).otherwise(sum((F.when(us > c, 1).otherwise(0) for c in sorted(cuts)), F.lit(0)) if cuts else F.lit(0))
    order = F.struct(F.col("t").isNull().alias("n"), "t", "row_id")
    per = keyed.withColumn("slice", number).groupBy("k1", "k2").agg(*[F.min(F.when(F.col("slice") == i, order)).alias(f"s{i}") for i in range(slices)])
    coded = store.encode(per)
    kept = None
    for i in range(slices):
        part = store.accept(coded.where(f"s{i} is not null").select("shard", "code", F.col(f"s{i}.row_id").alias("row_id"))).select("row_id")
        kept = part if kept is None else kept.unionByName(part)
    return messages.select(F.col(row_id).alias("row_id")).join(kept, "row_id", "left_anti").select(F.col("row_id").alias(row_id))


def deduplicated(arrivals: DataFrame, k1: Column, k2: Column, delivered_at: str, row_id: str, store: SeenStore | None = None) -> DataFrame:
    """The rows of ``arrivals`` without the further copies; rows without a full key all stay."""
    return arrivals.join(repeated(arrivals, k1, k2, delivered_at, row_id, store), row_id, "left_anti")
