"""Hashes of records and files, and what they were derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.keys import hash_key
from tapeloom.sources.tape import canonical


def signature(columns: list[str], label: str = "sha256:") -> Column:
    """Hash of a record's canonical JSON over ``columns``."""
    return F.concat(F.lit(label), F.sha2(canonical(columns), 256))


def signed(df: DataFrame, into: str = "signature") -> DataFrame:
    """Each record with its own signature over all other columns."""
    return df.withColumn(into, signature([c for c in df.columns if c != into]))


def verified(df: DataFrame, name: str = "signature") -> Column:
    """Whether a record's signature is that of its other columns; null without one."""
    return hash_key(name) == hash_key(signature([c for c in df.columns if c != name]))


def files_against(spark: SparkSession, folder: str, manifest: DataFrame, path: str, sha: str) -> DataFrame:
    """(path, status): each file a manifest names is same, changed or absent, and files it does not name are unlisted."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("found"))
    both = manifest.select(F.col(path).alias("path"), hash_key(sha).alias("said"), F.lit(True).alias("listed")).join(there, "path", "full_outer")
    status = F.when(F.col("listed").isNull(), "unlisted").when(F.col("found").isNull(), "absent").when(F.col("found") == F.col("said"), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def completeness(flags: list[Column]) -> Column:
    """True if every known flag is true; null if none is known."""
    known = F.array_compact(F.array(*flags))
    return F.when(F.size(known) > 0, F.forall(known, lambda f: f))


def arrays_in_page(html: Column, names: list[str]) -> Column:
    """Parallel number arrays written in a page's script as ``name = [..]``: zipped if all are there and equally long, else null."""
    body = [F.regexp_extract(html, rf"\b{n}\s*=\s*\[([^\]]*)\]", 1) for n in names]
    lists = [F.transform(F.split(b, r"\s*,\s*"), lambda v: F.trim(v).try_cast("double")) for b in body]
    fine = [b != "" for b in body] + [F.size(a) == F.size(lists[0]) for a in lists[1:]]
    both = fine[0]
    for f in fine[1:]:
        both = both & f
    return F.when(both, F.arrays_zip(*[a.alias(n) for a, n in zip(lists, names)]))
