"""Queries p1 to p6 over the tape's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.keys import hash_key, key, sql_hash_key, sql_key
from tapeloom.functions.times import date_key, iso_micros, micros, sql_date_key, sql_iso_micros
from tapeloom.operators import dedup, drift, grid, nested, orphans, pointintime
from tapeloom.session import written
from tapeloom.sources.tables import table


def _mid() -> F.Column:
    return (F.col("best_yes_bid") + F.col("best_yes_ask")) / 2


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    series = grid.regular_series(table(spark, at, "book_snapshots"), key("ticker"), "ts_utc", _mid(), only_missing=True)
    return series.where("is_missing").select(F.col("source").alias("ticker"), "slot_epoch")


def p1_series(spark: SparkSession, at: str) -> DataFrame:
    """The whole five-minute series of the mid price, measured and imputed."""
    return grid.regular_series(table(spark, at, "book_snapshots"), key("ticker"), "ts_utc", _mid()).withColumnRenamed("source", "ticker")


P1_SQL = f"""
with slots as (
  select {sql_key("ticker")} as ticker, cast(floor(epoch_us(ts_utc) / 300000000.0) as bigint) as slot
  from book_snapshots where ts_utc is not null group by all),
spans as (
  select ticker, cast(floor(slot / 288.0) as bigint) as day, min(slot) as a, max(slot) as b from slots where ticker is not null group by all)
select s.ticker, t.slot * 300 as slot_epoch
from spans s, unnest(generate_series(s.a, s.b)) as t(slot)
where not exists (select 1 from slots x where x.ticker = s.ticker and x.slot = t.slot)
"""


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    schemas = drift.file_schemas(drift.path_values(table(spark, at, "ledger_lines")))
    return drift.schema_changes(schemas).select("file_name", "field", "change", "new_field")


def _consistent(spark: SparkSession, at: str) -> DataFrame:
    values = written(drift.path_values(table(spark, at, "ledger_lines")), "lines")
    schemas = written(drift.file_schemas(values), "schemas")
    return drift.consistent_rows(values, schemas, drift.schema_changes(schemas))


def p2_table(spark: SparkSession, at: str) -> DataFrame:
    """Every readable line once, under the fields' first names and the target's types; ``rest`` is a JSON object, ``failed`` a list of names."""
    rest = F.transform(F.map_entries("rest"), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return _consistent(spark, at).withColumns({"rest": F.concat(F.lit("{"), F.array_join(F.array_sort(rest), ","), F.lit("}")), "failed": F.array_join("failed", ",")})


def p2_failed_casts(spark: SparkSession, at: str) -> DataFrame:
    return drift.failed_casts(_consistent(spark, at))


_P2 = """
with recursive good as (
  select distinct on (file_name, line_no) file_name, line_no, line_id, payload::json as j
  from ledger_lines where payload is not null and case when json_valid(payload) then json_type(payload) = 'OBJECT' else false end
  order by file_name, line_no, received_at, line_id),
sizes as (select file_name, count(*) as n_lines from good group by all),
cells as (select file_name, k as field, json_type(j, '$."' || k || '"') as t from (select file_name, j, unnest(json_keys(j)) as k from good)),
typed as (
  select file_name, field, case when t in ('OBJECT') then 'object' when t = 'ARRAY' then 'array' when t = 'VARCHAR' then 'string'
    when t = 'BOOLEAN' then 'boolean' when t = 'NULL' then null else 'number' end as type, count(*) as n from cells group by all),
fields as (
  select file_name, field, sum(n) as n, first(type order by (type is null), n desc, type) as type from typed group by all),
files as (
  select file_name, n_lines, regexp_replace(file_name, '/[^/]*$', '') as stream,
    row_number() over (partition by regexp_replace(file_name, '/[^/]*$', '') order by regexp_extract(file_name, '(\\d{4}-?\\d{2}-?\\d{2})[^/]*$', 1), file_name) as no from sizes),
here as (select stream, no, f.file_name, field, type from files f join fields d using (file_name) where 2 * n > n_lines),
pairs as (
  select f.stream, f.no, f.file_name, coalesce(h.field, b.field) as field, h.type as now, b.type as was, h.field is not null as has, b.field is not null as had
  from files f join (select stream, no, field from here union select stream, no + 1, field from here) x on x.stream = f.stream and x.no = f.no
  left join here h on h.stream = f.stream and h.no = f.no and h.field = x.field
  left join here b on b.stream = f.stream and b.no = f.no - 1 and b.field = x.field
  where f.no > 1),
moved as (
  select *, coalesce(now, was) as type, row_number() over (partition by stream, no, coalesce(now, was), has order by field) as nth from pairs where has != had),
swaps as (
  select stream, no, file_name, type, nth, max(case when had then field end) as gone, max(case when has then field end) as come from moved group by all),
changes as (
  select stream, no, file_name, field, 'retyped' as change, '' as new_field from pairs where has and had and now != was
  union all
  select stream, no, file_name, coalesce(gone, come), case when gone is null then 'added' when come is null then 'removed' else 'renamed' end,
    case when gone is not null and come is not null then come else '' end from swaps)"""
P2_SQL = f"{_P2} select file_name, field, change, new_field from changes"


def _p2_cell(field: str, kind: str) -> str:
    """The raw value of a target field, and what its cast gives."""
    text = f"json_extract_string(v_{field}, '$')"
    return {
        "string": f"case when json_type(v_{field}) in ('OBJECT', 'ARRAY') then json(v_{field})::varchar else {text} end",
        "double": f"case when json_type(v_{field}) not in ('OBJECT', 'ARRAY') then try_cast({text} as double) end",
        "bigint": f"case when json_type(v_{field}) not in ('OBJECT', 'ARRAY') then try_cast({text} as bigint) end",
        "boolean": f"case when json_type(v_{field}) not in ('OBJECT', 'ARRAY') then try_cast({text} as boolean) end",
        "array<string>": f"case when json_type(v_{field}) = 'ARRAY' then cast(v_{field} as varchar[]) end",
    }[kind]


_TARGETS = ", ".join(f"('{f}')" for f in drift.TARGET)
_P2_TABLE = f"""{_P2},
target(field) as (values {_TARGETS}),
back as (select stream, no, field from changes where change = 'added' union select stream, no, new_field from changes where change = 'renamed'),
ends as (
  select s.stream, s.root, s.name, f.no from (select distinct r.stream, t.field as root, r.new_field as name from changes r, target t where r.change = 'renamed') s join files f on f.stream = s.stream
  where exists (select 1 from changes c where c.stream = f.stream and c.no = f.no and c.field = s.name and c.change in ('removed', 'renamed')) or exists (select 1 from back c where c.stream = f.stream and c.no = f.no and c.field = s.root)),
spans(stream, root, name, since, until) as (
  select c.stream, c.field, c.new_field, c.no, (select min(e.no) from ends e where e.stream = c.stream and e.root = c.field and e.name = c.new_field and e.no > c.no)
  from changes c where c.change = 'renamed' and c.field in (select field from target) and c.new_field not in (select field from target)
  union all
  select s.stream, s.root, c.new_field, c.no, (select min(e.no) from ends e where e.stream = c.stream and e.root = s.root and e.name = c.new_field and e.no > c.no)
  from spans s join changes c on c.stream = s.stream and c.no = s.until and c.field = s.name and c.change = 'renamed' and c.new_field not in (select field from target)
  where not exists (select 1 from back b where b.stream = s.stream and b.no = c.no and b.field = s.root)),
names as (select f.file_name, map_from_entries(list((root, name))) as names from spans s join files f on f.stream = s.stream and f.no >= s.since and f.no < coalesce(s.until, 2147483647) group by f.file_name),
rows as (select g.*, n.names from good g left join names n using (file_name)),
picked as (select file_name, line_no, line_id, j, {", ".join(f"case when coalesce(json_type(j, '$.{f}'), 'NULL') = 'NULL' and list_contains(json_keys(j), names['{f}']) then names['{f}'] else '{f}' end as k_{f}" for f in drift.TARGET)} from rows),
valued as (select *, {", ".join(f"json_extract(j, '$.' || k_{f}) as v_{f}" for f in drift.TARGET)} from picked),
cast_rows as (select *, {", ".join(f"{_p2_cell(f, kind)} as {f}" for f, kind in drift.TARGET.items())} from valued),
failing as (select *, list_filter([{", ".join(f"case when {f} is null and coalesce(json_type(v_{f}), 'NULL') != 'NULL' then '{f}' end" for f in drift.TARGET)}], lambda x: x is not null) as bad from cast_rows)"""
P2_TABLE_SQL = f"""{_P2_TABLE}
select file_name, line_no, line_id, {", ".join(drift.TARGET)}, array_to_string(bad, ',') as failed,
  '{{' || coalesce(array_to_string(list_sort(list_transform(list_filter(json_keys(j), lambda k: not list_contains(list_filter([{", ".join(f"case when not list_contains(bad, '{f}') then k_{f} end" for f in drift.TARGET)}], lambda y: y is not null), k)),
    lambda k: '"' || k || '":' || json(json_extract(j, '$."' || k || '"'))::varchar)), ','), '') || '}}' as rest
from failing"""
P2_FAILED_SQL = f"{_P2_TABLE} select file_name, field, count(*) as n from (select file_name, unnest(bad) as field from failing) group by all"


def _known(spark: SparkSession, at: str, wide: list[str]) -> DataFrame:
    entity = F.when(key("city").isNotNull() & date_key("target_date").isNotNull(), F.struct(key("city").alias("city"), date_key("target_date").alias("day")))
    return pointintime.known_at(
        table(spark, at, "city_signals"), entity, micros("signal_ts"), table(spark, at, "capture_manifests"), entity,
        iso_micros("event_time"), F.when(F.col("as_of").isNull(), iso_micros("captured_at")).otherwise(iso_micros("as_of")), "delivery_id", wide,
    )


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return _known(spark, at, ["delivery_id"]).select("signal_id", "delivery_id")


def p3_attributes(spark: SparkSession, at: str) -> DataFrame:
    """Signals with the whole manifest that was known to them."""
    return _known(spark, at, ["delivery_id", "event_time", "as_of", "captured_at", "n_markets", "expected_markets", "n_with_book", "total_levels", "completeness_ok", "warmup"])


_P3_FACTS = f"""
with facts as (
  select *, {sql_key("city")} as c, {sql_date_key("target_date")} as d, {sql_iso_micros("event_time")} as e,
    case when as_of is null then {sql_iso_micros("captured_at")} else {sql_iso_micros("as_of")} end as a from capture_manifests),
signals as (select *, {sql_key("city")} as c, {sql_date_key("target_date")} as d, epoch_us(signal_ts) as t from city_signals)
"""
P3_SQL = f"""{_P3_FACTS}
select signal_id, delivery_id from signals s join facts f on f.c = s.c and f.d = s.d and f.e <= s.t and f.a <= s.t
qualify row_number() over (partition by signal_id order by f.e desc, f.a desc, delivery_id) = 1
"""
P3_WIDE_SQL = f"""{_P3_FACTS}
select signal_id, s.city, s.target_date, signal_ts, strategy, delivery_id, event_time, as_of, captured_at, n_markets, expected_markets, n_with_book, total_levels, completeness_ok, warmup
from signals s join facts f on f.c = s.c and f.d = s.d and f.e <= s.t and f.a <= s.t
qualify row_number() over (partition by signal_id order by f.e desc, f.a desc, delivery_id) = 1
"""


def _p4_both(spark: SparkSession, at: str, find) -> DataFrame:
    """What ``find`` says of fills without their orders and of trades without their brackets."""
    fills = find(table(spark, at, "paper_fills"), key("order_id"), "fill_row", "loaded_at", table(spark, at, "paper_orders"), key("order_id"), "loaded_at", "deleted_at", "paper_fills")
    trades = find(table(spark, at, "bracket_trades"), key("bracket_ticker"), "trade_row", "loaded_at", table(spark, at, "bracket_markets"), key("ticker"), "listed_at", "delisted_at", "bracket_trades")
    return fills.unionByName(trades)


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return _p4_both(spark, at, orphans.orphan_references)


def p4_report(spark: SparkSession, at: str) -> DataFrame:
    """Orphan references per table, day and kind, from counts per key and day."""
    return _p4_both(spark, at, orphans.orphan_counts)


def _p4_half(src: str, row: str, ref: str, parent: str, parent_key: str, arrived: str, ceased: str) -> str:
    return f"""
  select '{src}' as src, {row} as row_id, strftime(loaded_at, '%Y-%m-%d') as period,
    case when p.k is null then 'missing' when p.first_at > c.loaded_at then 'late' when p.gone_at <= c.loaded_at then 'deleted' end as kind
  from (select *, {sql_key(ref)} as k from {src}) c
  left join (select {sql_key(parent_key)} as k, min({arrived}) as first_at, min({ceased}) as gone_at from {parent} where {sql_key(parent_key)} is not null group by 1) p on p.k = c.k
  where c.k is not null"""


_P4 = f"""select * from ({_p4_half("paper_fills", "fill_row", "order_id", "paper_orders", "order_id", "loaded_at", "deleted_at")}
  union all {_p4_half("bracket_trades", "trade_row", "bracket_ticker", "bracket_markets", "ticker", "listed_at", "delisted_at")}) where kind is not null"""
P4_SQL = _P4
P4_REPORT_SQL = f"select src, period, kind, count(*) as n from ({_P4}) group by all"


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    return dedup.repeated(table(spark, at, "capture_manifests"), key("capture_id"), hash_key("raw_sha256"), "delivered_at", "delivery_id")


P5_SQL = f"""
select delivery_id from (
  select delivery_id, delivered_at, {sql_key("capture_id")} as a, {sql_hash_key("raw_sha256")} as b from capture_manifests)
where a is not null and b is not null
qualify row_number() over (partition by a, b order by delivered_at, delivery_id) > 1
"""


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    levels = nested.game_tables(table(spark, at, "game_pair_lines")).where("kind = 'level'")
    return levels.select("line_id", "event_ticker", "ticker", "book_no", "side", "level_no", "price_tt")


def p6_tables(spark: SparkSession, at: str) -> DataFrame:
    """Manifests, outcomes, books and levels, each linked to its parent."""
    return nested.game_tables(table(spark, at, "game_pair_lines"))


P6_SQL = """
with good as (
  select line_id, payload::json as j from game_pair_lines
  where payload is not null and json_valid(payload) and trim(payload) != ''),
listed as (
  select line_id, unnest(case when json_type(j) = 'ARRAY' then cast(j as json[]) when json_type(j, '$.manifests') = 'ARRAY' then cast(json_extract(j, '$.manifests') as json[]) else [j] end) as r from good),
events as (
  select line_id, coalesce(json_extract_string(r, '$.game.event_ticker'), json_extract_string(r, '$.event_ticker')) as event_ticker,
    case when json_type(r, '$.game.outcomes') = 'ARRAY' then json_extract(r, '$.game.outcomes') when json_type(r, '$.outcomes') = 'ARRAY' then json_extract(r, '$.outcomes') end as os from listed),
outcomes as (select line_id, event_ticker, unnest(cast(os as json[])) as o from events where os is not null),
held as (
  select line_id, event_ticker, json_extract_string(o, '$.ticker') as ticker,
    case when json_type(o, '$.book') = 'OBJECT' then [json_extract(o, '$.book')]
      when json_type(o, '$.books') = 'ARRAY' then cast(json_extract(o, '$.books') as json[])
      when json_type(o, '$.depth.books') = 'ARRAY' then cast(json_extract(o, '$.depth.books') as json[]) else [] end as bs from outcomes),
books as (select line_id, event_ticker, ticker, unnest(bs) as b, generate_subscripts(bs, 1) as book_no from held),
sides as (
  select line_id, event_ticker, ticker, book_no, side, cast(case side when 'yes' then json_extract(b, '$.yes_bids') else json_extract(b, '$.no_bids') end as json[]) as ls
  from books, (values ('yes'), ('no')) v(side)
  where json_type(b) = 'OBJECT' and json_type(b, '$.' || side || '_bids') = 'ARRAY'),
levels as (select line_id, event_ticker, ticker, book_no, side, unnest(ls) as l, generate_subscripts(ls, 1) as level_no from sides),
priced as (
  select *, try_cast(case when json_type(l) = 'ARRAY' then json_extract_string(l, '$[0]') when json_type(l) = 'OBJECT' then json_extract_string(l, '$.price') end as double) as p from levels)
select line_id, event_ticker, ticker, cast(book_no as integer) as book_no, side, cast(level_no as integer) as level_no, cast(round(p * 10000) as bigint) as price_tt
from priced where p is not null
"""

QUERIES = {
    "p1_found": p1_found, "p1_series": p1_series, "p2_found": p2_found, "p2_table": p2_table, "p2_failed_casts": p2_failed_casts,
    "p3_found": p3_found, "p3_attributes": p3_attributes, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found,
    "p6_found": p6_found, "p6_tables": p6_tables,
}
SQL = {
    "p1_found": P1_SQL, "p2_found": P2_SQL, "p2_table": P2_TABLE_SQL, "p2_failed_casts": P2_FAILED_SQL, "p3_found": P3_SQL, "p3_attributes": P3_WIDE_SQL, "p4_found": P4_SQL, "p4_report": P4_REPORT_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL,
}
