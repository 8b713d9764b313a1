"""Queries of further statistics and matches, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import normal, stats
from tapeloom.functions.keys import key, sql_key
from tapeloom.functions.times import floor_div
from tapeloom.operators import matching, nested, sequence
from tapeloom.plans.reference import BOOKS, CAPTURES, DAY, EVENTS, HOUR, SETTLES, books, captures, events, r6, settles
from tapeloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {CAPTURES}, x as (select symbol, t, capture_row, spot - lag(spot) over (partition by symbol order by t, capture_row) as v from captures where symbol is not null and t is not null and spot is not null)
select symbol, count(v) as n, count(*) filter (where v = 0) as n_zero, count(*) filter (where v > 0) as n_up, count(*) filter (where v < 0) as n_down, min(v) as least, max(v) as most, {r6("median(v)")} as middle,
case when count(v) >= 4 then {r6("floor(sqrt(greatest(count(v) * cast(sum(cast(v as double) * v) as double) - cast(sum(v) as double) * cast(sum(v) as double), 0)) / count(v) * 100) / 100")} end as spread from x group by symbol""")
def change_statistics(spark, at):
    c = captures(spark, at).where("symbol is not null and t is not null and spot is not null")
    x = sequence.deltas(c, ["symbol"], ["t", "capture_row"], ["spot"]).withColumn("v", F.col("d_spot"))
    n, s, ss = F.count("v"), F.sum("v").cast("double"), F.sum(F.col("v").cast("double") * F.col("v"))
    spread = F.floor(F.sqrt(F.greatest(n * ss - s * s, F.lit(0.0))) / n * 100) / 100
    return x.groupBy("symbol").agg(
        n.alias("n"), F.count_if(F.col("v") == 0).alias("n_zero"), F.count_if(F.col("v") > 0).alias("n_up"), F.count_if(F.col("v") < 0).alias("n_down"),
        F.min("v").alias("least"), F.max("v").alias("most"), stats.rounded(F.median("v")).alias("middle"), F.when(n >= 4, stats.rounded(spread)).alias("spread"),
    )


@query(f"""with {CAPTURES} select (cast(floor(t / {HOUR}.0) as bigint) % 24 + 24) % 24 as hour, count(*) as n, {r6("cast(count(*) filter (where spot is null) as double) / count(*)")} as null_share from captures where t is not null group by 1""")
def null_share_by_hour(spark, at):
    c = captures(spark, at).where("t is not null")
    n = F.count(F.lit(1))
    return c.groupBy(F.pmod(floor_div(F.col("t"), HOUR), F.lit(24)).alias("hour")).agg(n.alias("n"), stats.rounded(F.count_if(F.col("spot").isNull()).cast("double") / n).alias("null_share"))


@query(f"""with {BOOKS}, x as (select ticker, d, ask - bid as s, coalesce(lead(t) over (partition by ticker order by t, snap_id) - t, 0) as us from books)
select ticker, cast(sum(us) as bigint) as us, cast(coalesce(sum(us) filter (where s <= 200), 0) as bigint) as us_tight from x group by ticker""")
def time_weighted_tightness(spark, at):
    b = sequence.beside(books(spark, at), ["ticker"], ["t", "snap_id"], ["t"], "next", ahead=True)
    x = b.withColumn("us", F.coalesce(F.col("next.t") - F.col("t"), F.lit(0)))
    tight = F.col("ask") - F.col("bid") <= 200
    return x.groupBy("ticker").agg(F.sum("us").alias("us"), F.coalesce(F.sum(F.when(tight, F.col("us"))), F.lit(0)).alias("us_tight"))


@query(f"""with {BOOKS} select series, count(*) as n, {r6("coalesce(avg(case when abs(bid - 100) <= 1 then 1.0 else 0.0 end) filter (where bid is not null), 0)")} as floor_share, cast(sum(case when depth < 8 then depth else 0 end) as bigint) as thin_levels, cast(sum(depth) as bigint) as levels from books group by series""")
def floor_and_thin_shares(spark, at):
    pinned = F.when(F.col("bid").isNotNull(), F.when(F.abs(F.col("bid") - 100) <= 1, 1.0).otherwise(0.0))
    return books(spark, at).groupBy("series").agg(F.count(F.lit(1)).alias("n"), stats.rounded(F.coalesce(F.avg(pinned), F.lit(0.0))).alias("floor_share"), F.sum(F.when(F.col("depth") < 8, F.col("depth")).otherwise(0)).alias("thin_levels"), F.sum("depth").alias("levels"))


@query(f"""with {BOOKS} select ticker, arg_min(snap_id, (ask, t, snap_id)) filter (where ask is not null) as cheapest, arg_max(snap_id, (bid, -t, -snap_id)) filter (where bid is not null) as dearest, min(ask) as low, max(bid) as high from books group by ticker having count(ask) > 0 and count(bid) > 0""")
def extremes_per_ticker(spark, at):
    low = F.when(F.col("ask").isNotNull(), F.struct("ask", "t", "snap_id"))
    high = F.when(F.col("bid").isNotNull(), F.struct(F.col("bid"), -F.col("t"), -F.col("snap_id")))
    out = books(spark, at).groupBy("ticker").agg(F.min_by("snap_id", low).alias("cheapest"), F.max_by("snap_id", high).alias("dearest"), F.min("ask").alias("low"), F.max("bid").alias("high"))
    return out.where("low is not null and high is not null")


@query("""with x as (select cast(round(early_yes_ask * 10000) as bigint) as p, case when settled_result = 'yes' then 10000 when settled_result = 'no' then 0 end as y, has_room from bracket_trades)
select has_room, count(*) as n, floor(cast(sum((p - y) * (p - y)) as double) / count(*) / 100.0 + 0.5) / 1000000.0 as brier from x where p is not null and y is not null and has_room is not null group by has_room""")
def brier_scores(spark, at):
    y = F.when(F.col("settled_result") == "yes", 10_000).when(F.col("settled_result") == "no", 0)
    x = table(spark, at, "bracket_trades").select("has_room", (F.round(F.col("early_yes_ask") * 10_000).cast("bigint") - y).alias("e")).where("e is not null and has_room is not null")
    n = F.count(F.lit(1))
    return x.groupBy("has_room").agg(n.alias("n"), (F.floor(F.sum(F.col("e") * F.col("e")).cast("double") / n / 100.0 + 0.5) / 1000000.0).alias("brier"))


@query(f"""with {EVENTS}, h as (select user_id, avg(x) as a from ev where x is not null and t < (select median(t) from ev) group by user_id), g as (select user_id, avg(x) as a from ev where x is not null and t >= (select median(t) from ev) group by user_id)
select user_id, {r6("h.a - g.a")} as fall from h join g using (user_id)""")
def early_against_late(spark, at):
    e = events(spark, at).where("x is not null")
    cut = stats.exact_quantile(events(spark, at), "t", 0.5)
    early, late = F.avg(F.when(F.col("t") < cut, F.col("x"))), F.avg(F.when(F.col("t") >= cut, F.col("x")))
    return e.groupBy("user_id").agg(stats.rounded(early - late).alias("fall")).where("fall is not null")


@query(f"""with m as (select {sql_key("event_ticker")} as event, {sql_key("ticker")} as ticker, cast(round(floor_strike * 100) as bigint) as lo from bracket_markets where {sql_key("event_ticker")} is not null and floor_strike is not null),
s as (select {sql_key("event_ticker")} as event, max(cast(round(settle_value * 100) as bigint)) as v from hour_settles where settle_value is not null and {sql_key("event_ticker")} is not null group by 1)
select event, min(struct_pack(d := lo - v, k := ticker)).k as above, max(v) as v from m join s using (event) where lo > v group by event""")
def nearest_rung_above(spark, at):
    m = table(spark, at, "bracket_markets").select(key("event_ticker").alias("event"), key("ticker").alias("ticker"), F.round(F.col("floor_strike") * 100).cast("bigint").alias("lo")).where("event is not null and lo is not null")
    s = table(spark, at, "hour_settles").select(key("event_ticker").alias("event"), F.round(F.col("settle_value") * 100).cast("bigint").alias("v")).where("event is not null and v is not null").groupBy("event").agg(F.max("v").alias("v"))
    near = F.min(F.struct((F.col("lo") - F.col("v")).alias("d"), F.col("ticker").alias("k")))
    return m.join(s, "event").where("lo > v").groupBy("event").agg(near["k"].alias("above"), F.max("v").alias("v"))


@query("""select ticker_key as ticker, price_source_tag, n from (select upper(trim(ticker)) as ticker_key, price_source_tag, count(*) as n from paper_fills where trim(ticker) != '' and ticker is not null group by all)
qualify row_number() over (partition by ticker_key order by case price_source_tag when 'real_bid' then 1 when 'real_ask' then 2 else 3 end, price_source_tag is null, price_source_tag) = 1""")
def preferred_source(spark, at):
    f = table(spark, at, "paper_fills").select(key("ticker").alias("ticker"), "price_source_tag").where("ticker is not null").groupBy("ticker", "price_source_tag").agg(F.count(F.lit(1)).alias("n"))
    return matching.by_preference(f, ["ticker"], "price_source_tag", ["real_bid", "real_ask"], ["n"])


@query("""with t as (select line_id, unnest(case when json_type(j) = 'ARRAY' then cast(j as json[]) when json_type(j, '$.manifests') = 'ARRAY' then cast(json_extract(j, '$.manifests') as json[]) else [j] end) as r from (select line_id, payload::json as j from game_pair_lines where payload is not null and json_valid(payload) and trim(payload) != '')),
x as (select line_id, coalesce(json_extract_string(r, '$.game.event_title'), json_extract_string(r, '$.event_title')) as title, coalesce(json_extract_string(r, '$.game.event_ticker'), json_extract_string(r, '$.event_ticker')) as ticker from t)
select line_id, regexp_extract(title, '^(.+) at (.+)$', 1) as away, regexp_extract(title, '^(.+) at (.+)$', 2) as home, upper(left(regexp_extract(title, '^(.+) at (.+)$', 1), 3)) || upper(left(regexp_extract(title, '^(.+) at (.+)$', 2), 3)) = regexp_extract(ticker, '-[0-9]{2}[A-Z]{3}[0-9]{2}([A-Z]{6})', 1) as agrees from x where regexp_matches(title, '^(.+) at (.+)$') and ticker is not null""")
def titles_and_codes(spark, at):
    """Teams named in titles against the codes in tickers, from the nodes of the nested records."""
    nodes = nested.json_nodes(table(spark, at, "game_pair_lines"), "line_id", "payload")
    said = nodes.where("field in ('event_title', 'event_ticker') and type = 'string'")
    x = said.groupBy("row_id", "parent").agg(F.max(F.when(F.col("field") == "event_title", F.col("text"))).alias("title"), F.max(F.when(F.col("field") == "event_ticker", F.col("text"))).alias("ticker"))
    g = lambda n: F.regexp_extract("title", r"^(.+) at (.+)$", n)
    code = F.regexp_extract("ticker", r"-[0-9]{2}[A-Z]{3}[0-9]{2}([A-Z]{6})", 1)
    x = x.where(F.col("title").rlike(r"^(.+) at (.+)$") & F.col("ticker").isNotNull())
    return x.select(F.col("row_id").alias("line_id"), g(1).alias("away"), g(2).alias("home"), (F.concat(F.upper(F.substring(g(1), 1, 3)), F.upper(F.substring(g(2), 1, 3))) == code).alias("agrees"))


@query(f"""with {SETTLES}, {CAPTURES}, h as (select event, max(t) as a from captures where event is not null group by event)
select settle_id, case when date_part('hour', make_timestamp(t)) = 23 and date_part('minute', make_timestamp(t)) = 59 or t % {DAY} = 0 then null else h.a - t > {HOUR} end as long_after from settles s left join h on s.event = h.event where t is not null""")
def captured_long_after(spark, at):
    """Whether an hour was still captured an hour past its close; unknown for closes that are only dates."""
    h = captures(spark, at).where("event is not null").groupBy("event").agg(F.max("t").alias("a"))
    s = settles(spark, at).where("t is not null").join(h, "event", "left")
    minute = F.pmod(floor_div(F.col("t"), 60_000_000), F.lit(1440))
    coarse = (minute == 1439) | (F.pmod("t", F.lit(DAY)) == 0)
    return s.select("settle_id", F.when(~coarse, F.col("a") - F.col("t") > HOUR).alias("long_after"))


@query(f"""with c as (select delivery_id, completeness_ok as a, warmup as b, n_with_book >= expected_markets as c from capture_manifests)
select delivery_id, case when a is null and b is null and c is null then null else coalesce(a, true) and coalesce(b, true) and coalesce(c, true) end as complete from c""")
def completeness(spark, at):
    from tapeloom.functions.provenance import completeness as whole

    return table(spark, at, "capture_manifests").select("delivery_id", whole([F.col("completeness_ok"), F.col("warmup"), F.col("n_with_book") >= F.col("expected_markets")]).alias("complete"))


@query()
def forecast_scores(spark, at):
    """Mean ranked probability score per symbol of a normal forecast from the mean and spread of the hour before; tested against quadrature."""
    c = captures(spark, at).where("symbol is not null and t is not null and spot is not null").withColumn("hour", floor_div(F.col("t"), HOUR))
    h = c.groupBy("symbol", "hour").agg(F.avg("spot").alias("mean"), F.coalesce(F.stddev_samp("spot"), F.lit(0.0)).alias("sd"), F.max_by("spot", F.struct("t", "capture_row")).alias("last"))
    before = h.select("symbol", (F.col("hour") + 1).alias("hour"), "mean", "sd")
    joined = h.select("symbol", "hour", F.col("last").cast("double").alias("y")).join(before, ["symbol", "hour"])
    return joined.withColumn("score", normal.crps("y", "mean", "sd")).groupBy("symbol").agg(F.count("score").alias("n"), F.avg("score").alias("score"))
