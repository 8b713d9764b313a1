"""Schemas that drift between files: one consistent table, and a report of every change."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The records' own fields with the types they are read as; others stay in the rest column.
TARGET = {
    "order_id": "string", "ts": "string", "ticker": "string", "side": "string", "action": "string", "limit_price": "double", "qty": "bigint",
    "tif": "string", "strategy": "string", "event_ticker": "string", "schema_version": "string", "record_kind": "string", "capture_id": "string",
    "venue": "string", "city": "string", "target_date": "string", "event_time": "string", "as_of": "string", "captured_at": "string",
    "n_markets": "bigint", "expected_markets": "bigint", "n_with_book": "bigint", "total_levels": "bigint", "series": "array<string>",
    "completeness_ok": "boolean", "warmup": "boolean",
}


def path_values(lines: DataFrame, levels: int = 1) -> DataFrame:
    """Each readable line once, as a map from path to raw value: (file_name, line_no, line_id, fields).

    Readable is a payload that is a JSON object (with a key twice it is none). Of the readable
    copies of a file's line the one received first stays, then the smaller line_id; lines without
    a number are each a line of their own. Null or blank payloads and file names are left out.
    A path is a top-level field; with ``levels`` above 1 objects are opened so many levels deep,
    paths are written with dots (a dot in a field's own name as ``\\.``) and an object that is
    opened has no path of its own, unless it is empty.
    """
    objects = lines.where(F.col("payload").rlike(r"^\s*\{") & (F.trim("file_name") != "")).withColumn("v", F.try_parse_json("payload"))
    own = F.when(F.col("line_no").isNull(), F.col("line_id")).alias("own")
    order = F.when(F.col("v").isNotNull(), F.struct(F.col("received_at").isNull(), "received_at", "line_id"))
    once = objects.groupBy("file_name", "line_no", own).agg(F.min_by(F.struct("line_id", "v"), order).alias("x"))
    fields = F.col("x.v").cast("map<string,variant>")
    if levels > 1:
        escaped = lambda k: F.regexp_replace(k, r"([\\.])", r"\\$1")
        entries = F.transform(F.map_entries(fields), lambda e: F.struct(escaped(e["key"]).alias("key"), e["value"].alias("value")))
        for _ in range(levels - 1):
            entries = F.flatten(F.transform(entries, lambda e: _opened(e, escaped)))
        fields = F.map_from_entries(entries)
    return once.where("x.v is not null").select("file_name", "line_no", F.col("x.line_id").alias("line_id"), fields.alias("fields"))


def _opened(entry: Column, escaped: Callable[[Column], Column]) -> Column:
    """The entries of an object under their paths, or the entry itself."""
    inside = F.map_entries(F.when(raw_type(entry["value"]) == "object", entry["value"]).try_cast("map<string,variant>"))
    parts = F.transform(inside, lambda c: F.struct(F.concat(entry["key"], F.lit("."), escaped(c["key"])).alias("key"), c["value"].alias("value")))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.struct(entry["key"].alias("key"), entry["value"].alias("value"))))


def raw_type(value: Column) -> Column:
    """string, number, boolean, array or object; null for a null."""
    said = F.schema_of_variant(value)
    return F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said != "VOID", "number")


def file_schemas(values: DataFrame) -> DataFrame:
    """The fields of every file: (stream, file_name, dt, file_no, next_file, field, type).

    A field belongs to a file if more than half of its lines have the key; its type is the
    commonest among non-null values (the first by name when tied, null if there is none). Lines
    are counted in the same pass, as the cells of no field. A file without fields has one row
    with a null field; ``next_file`` is the name of the file after it in its stream.
    """
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    cells = values.select("file_name", F.inline(F.concat(whole, F.map_entries("fields"))).alias("field", "value"))
    by_type = cells.groupBy("file_name", "field", raw_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    by_field = by_type.groupBy("file_name", "field").agg(
        F.sum("n").alias("n"), F.max_by("type", F.when(F.col("type").isNotNull(), F.struct(F.col("n"), -F.ascii("type"), -F.ascii(F.substring("type", 2, 1))))).alias("type")
    )
    held = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "type", "n")))  # the fields of one file
    files = by_field.groupBy("file_name").agg(F.max(F.when(F.col("field").isNull(), F.col("n"))).alias("n_lines"), held.alias("held"))
    files = files.withColumn("stream", F.regexp_extract("file_name", r"^(.*)/[^/]*$", 1)).withColumn("dt", F.regexp_extract("file_name", r"(\d{4}-?\d{2}-?\d{2})[^/]*$", 1))
    by_day = Window.partitionBy("stream").orderBy(F.regexp_replace("dt", "-", ""), "file_name")
    numbered = files.withColumn("file_no", F.row_number().over(by_day)).withColumn("next_file", F.lead("file_name").over(by_day))
    kept = F.filter("held", lambda h: 2 * h["n"] > F.col("n_lines"))
    return numbered.select("stream", "file_name", "dt", "file_no", "next_file", F.explode_outer(kept).alias("h")).select("stream", "file_name", "dt", "file_no", "next_file", "h.field", "h.type")


def schema_changes(schemas: DataFrame) -> DataFrame:
    """What each file changes against the one before it in its stream: (stream, file_no, file_name, field, change, new_field).

    ``renamed`` pairs a field that went with one of the same type that came, in the order of
    their names when there are several; both then are neither removed nor added. A field whose
    type is unknown on one side is not retyped. A stream's first file has no changes.
    """
    of_field = Window.partitionBy("stream", "field").orderBy("file_no")
    held = schemas.where("field is not null").withColumns({"prev_no": F.lag("file_no").over(of_field), "prev_type": F.lag("type").over(of_field), "next_no": F.lead("file_no").over(of_field)})
    there, stays = F.col("prev_no").eqNullSafe(F.col("file_no") - 1), F.col("next_no").eqNullSafe(F.col("file_no") + 1)
    event = lambda cond, no, name, what: F.when(cond, F.struct(no.alias("file_no"), name.alias("file_name"), F.lit(what).alias("what")))
    here, after = (F.col("file_no"), F.col("file_name")), (F.col("file_no") + 1, F.col("next_file"))
    seen = F.array_compact(F.array(
        event(~there & (F.col("file_no") > 1), *here, "came"), event(there & (F.col("type") != F.col("prev_type")), *here, "retyped"), event(~stays & F.col("next_file").isNotNull(), *after, "gone"),
    ))
    events = held.select("stream", "field", "type", F.explode(seen).alias("e")).select("stream", "e.file_no", "e.file_name", "field", "type", "e.what")
    # The n-th field that went and the n-th that came of one type make a pair; a retyped field stands alone.
    nth = F.row_number().over(Window.partitionBy("stream", "file_no", "type", "what").orderBy("field"))
    alone = F.when(F.col("what") == "retyped", F.col("field"))
    pairs = events.withColumn("nth", nth).groupBy("stream", "file_no", "file_name", "type", "nth", alone.alias("alone"))
    pairs = pairs.agg(F.max(F.when(F.col("what") == "gone", F.col("field"))).alias("gone"), F.max(F.when(F.col("what") == "came", F.col("field"))).alias("came"))
    change = F.when(F.col("alone").isNotNull(), "retyped").when(F.col("gone").isNull(), "added").when(F.col("came").isNull(), "removed").otherwise("renamed")
    return pairs.select("stream", "file_no", "file_name", F.coalesce("alone", "gone", "came").alias("field"), change.alias("change"), F.when(change == "renamed", F.col("came")).otherwise("").alias("new_field"))


def _aliases(target: frozenset[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From a stream's changes, the files where a target field goes by another name: (stream, name, root, since, until).

    A field renamed to a target's own name has a column of that name from there on. A span ends
    where its name is removed or renamed again, and where the root's own name comes back; so a
    file has one name at most for each root.
    """

    def spans(changes: pd.DataFrame) -> pd.DataFrame:
        rows, by_name = [], {}  # open spans by their present name
        for no, file in changes.sort_values("file_no").groupby("file_no", sort=True):
            renamed = {r.field: r.new_field for r in file.itertuples() if r.change == "renamed"}
            back = {r.field for r in file.itertuples() if r.change == "added"} | set(renamed.values())
            for name, span in list(by_name.items()):
                if name in renamed or span["root"] in back or ((file["field"] == name) & (file["change"] == "removed")).any():
                    by_name.pop(name)["until"] = no
                    if name in renamed and span["root"] not in back:
                        renamed[span["root"]] = renamed.pop(name)
            for root, name in renamed.items():
                if root in target and name not in target:
                    by_name[name] = {"stream": changes["stream"].iloc[0], "name": name, "root": root, "since": no, "until": 2**31 - 1}
                    rows.append(by_name[name])
        return pd.DataFrame(rows, columns=["stream", "name", "root", "since", "until"])

    return spans


def consistent_rows(values: DataFrame, schemas: DataFrame, changes: DataFrame, target: Mapping[str, str] = TARGET) -> DataFrame:
    """One table over all files: (file_name, line_no, line_id), a column per target field, rest, failed.

    A renamed target field is read under its new name from the file on in which it was renamed,
    until that name goes or the field's own name comes back; where a line has both, its own name
    counts unless it is null. A value that cannot be cast to the target's type is null there and
    its field's name is in ``failed``. Whatever is in no column, values that failed among it, is
    in ``rest`` (JSON by path). The changes that are gathered per stream are schema changes, not
    records.
    """
    moves = changes.where("change != 'retyped'").select("stream", "file_no", "field", "change", "new_field")
    spans = moves.groupBy("stream").applyInPandas(_aliases(frozenset(target)), "stream string, name string, root string, since int, until int")
    files = schemas.select("stream", "file_no", "file_name").distinct()
    names = files.join(spans, "stream").where("file_no >= since and file_no < until").groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("root", "name"))).alias("names"))
    rows = values.join(names, "file_name", "left")
    # In steps, each of which is computed once: the values under both names, the one that counts, its cast.
    known = lambda v: v.isNotNull() & ~F.is_variant_null(v)
    line = ["file_name", "line_no", "line_id", "fields"]
    rows = rows.select(*line, "names", *[F.try_element_at("fields", F.lit(f)).alias(f"own_{f}") for f in target], *[F.when(F.col("names").isNotNull(), F.try_element_at("names", F.lit(f))).alias(f"name_{f}") for f in target])
    rows = rows.select(*line, *[f"own_{f}" for f in target], *[f"name_{f}" for f in target], *[F.when(F.col(f"name_{f}").isNotNull(), F.try_element_at("fields", f"name_{f}")).alias(f"other_{f}") for f in target])
    taken = {f: F.col(f"other_{f}").isNotNull() & ~F.coalesce(known(F.col(f"own_{f}")), F.lit(False)) for f in target}
    rows = rows.select(*line, *[F.when(c, F.col(f"other_{f}")).otherwise(F.col(f"own_{f}")).alias(f"cell_{f}") for f, c in taken.items()], *[F.when(c, F.col(f"name_{f}")).otherwise(F.lit(f)).alias(f"from_{f}") for f, c in taken.items()])
    rows = rows.select(*line, *[f"cell_{f}" for f in target], *[f"from_{f}" for f in target], *[F.try_variant_get(f"cell_{f}", "$", kind).alias(f"__{f}") for f, kind in target.items()])
    bad = {f: F.coalesce(F.col(f"__{f}").isNull() & known(F.col(f"cell_{f}")), F.lit(False)) for f in target}
    failed = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in bad.items()]))
    read = F.array_compact(F.array(*[F.when(~c, F.col(f"from_{f}")) for f, c in bad.items()]))
    rows = rows.select(*line, *[f"__{f}" for f in target], read.alias("__read"), failed.alias("failed"))
    rest = F.transform_values(F.map_filter("fields", lambda k, v: ~F.array_contains("__read", k)), lambda k, v: F.to_json(v))
    return rows.select("file_name", "line_no", "line_id", *[F.col(f"__{f}").alias(f) for f in target], rest.alias("rest"), "failed")


def failed_casts(table: DataFrame) -> DataFrame:
    """Values that did not fit their target type: (file_name, field, n)."""
    return table.select("file_name", F.explode("failed").alias("field")).groupBy("file_name", "field").agg(F.count(F.lit(1)).alias("n"))
