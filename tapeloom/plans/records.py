"""Queries of readers, projections, predicates and small joins, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import ladder, stats, tickers
from tapeloom.functions.keys import key, sql_key
from tapeloom.functions.provenance import arrays_in_page
from tapeloom.functions.times import date_key, floor_div, iso_micros, sql_date_key, sql_iso_micros
from tapeloom.operators import nested, quality, sequence, sets
from tapeloom.plans.further import _TITLES, _games
from tapeloom.plans.reference import BOOKS, CAPTURES, DAY, HOUR, SETTLES, books, captures, r6, settles, tt
from tapeloom.sources import readers
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


# --- readers


@query(f"""with {BOOKS} select series, count(*) as n, cast(sum(bid + ask) as bigint) as twice_mids from books where bid > 0 and ask < 10000 and bid < ask group by series""")
def two_sided_mids(spark, at):
    """Readings with both quotes, and their middles."""
    return readers.two_sided(books(spark, at)).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum("twice_mid").alias("twice_mids"))


@query(f"""with x as (select {sql_key("event_ticker")} as event, {sql_key("bracket_ticker")} as ticker, bool_or(settled_result = 'yes') as won from bracket_trades where {sql_key("event_ticker")} is not null and {sql_key("bracket_ticker")} is not null group by all),
y as (select event, count(*) as n, count(*) filter (where won) as n_won, max(case when won then ticker end) as winner from x group by event) select event, n, winner from y where n >= 2 and n_won = 1""")
def decided_ladders(spark, at):
    """Ladders of two rungs or more of which exactly one won."""
    t = table(spark, at, "bracket_trades").select(key("event_ticker").alias("event"), key("bracket_ticker").alias("ticker"), (F.col("settled_result") == "yes").alias("won"))
    return readers.decided(t, "event", "ticker", "won", least=2)


@query(f"""with {BOOKS}, f as (select 'books' as family, d from books union all select 'manifests', cast(floor(epoch_us(delivered_at) / {DAY}.0) as bigint) from capture_manifests union all select 'signals', cast(floor(epoch_us(signal_ts) / {DAY}.0) as bigint) from city_signals)
select family, d, count(*) as n from f where d between 20605 and 20700 group by all""")
def families_in_season(spark, at):
    """Rows of three families by day, within a season."""
    times = {"books": ("book_snapshots", "ts_utc", key("ticker").isNotNull()), "manifests": ("capture_manifests", "delivered_at", F.lit(True)), "signals": ("city_signals", "signal_ts", F.lit(True))}
    season = readers.in_season({f: (table(spark, at, t).where(cond), c) for f, (t, c, cond) in times.items()}, 20605, 20700)
    return season.groupBy("family", "d").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with g as (select unnest(case when json_type(j) = 'ARRAY' then cast(j as json[]) when json_type(j, '$.manifests') = 'ARRAY' then cast(json_extract(j, '$.manifests') as json[]) else [j] end) as r from (select payload::json as j from game_pair_lines where payload is not null and json_valid(payload) and trim(payload) != '')),
e as (select upper(json_extract_string(r, '$.event_ticker')) as event, json_extract_string(r, '$.odds_leg.status') as leg from g where json_type(r) = 'OBJECT') select event, count(*) as n, count(leg) as n_legs from e where event is not null group by event""")
def captures_of_games(spark, at):
    """Captures of each game that stand at the top of their record, and how many have the newer layout's leg."""
    nodes = nested.json_nodes(table(spark, at, "game_pair_lines"), "line_id", "payload")
    event = nodes.where("field = 'event_ticker' and type = 'string'").select("row_id", "parent", F.upper("text").alias("event"))
    legs = nodes.where("field = 'odds_leg' and type = 'object'").select("row_id", F.col("parent").alias("p"), F.col("node").alias("leg"))
    status = nodes.where("field = 'status' and type = 'string'").select("row_id", F.col("parent").alias("leg"), F.lit(1).alias("has"))
    manifest = nodes.where("type = 'object' and (field is null or field != 'game')").select("row_id", F.col("node").alias("parent"))
    e = event.join(manifest, ["row_id", "parent"]).join(legs.join(status, ["row_id", "leg"]).withColumnRenamed("p", "parent"), ["row_id", "parent"], "left")
    return e.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("n_legs"))


@query(f"""with {SETTLES}, {CAPTURES}, s as (select event, min(value) as value from settles where event is not null and value is not null group by event having count(distinct value) = 1), c as (select event, arg_min(spot, (t, capture_row)) as spot, max(symbol) as symbol from captures where event is not null and t is not null and spot is not null group by event)
select symbol, event, spot, value from c join s using (event)""")
def settled_hours(spark, at):
    """Events with a spot at their first priced capture and one undisputed settlement."""
    s = settles(spark, at).where("event is not null and value is not null").groupBy("event").agg(F.min("value").alias("value"), F.count_distinct("value").alias("k")).where("k = 1")
    c = captures(spark, at).where("event is not null and t is not null and spot is not null").groupBy("event").agg(F.min_by("spot", F.struct("t", "capture_row")).alias("spot"), F.max("symbol").alias("symbol"))
    return c.join(s, "event").select("symbol", "event", "spot", "value")


@query(f"""select symbol, left(hour, 7) as day, count(*) as n, min(lo) as low, max(lo) as high from (select {sql_key("symbol")} as symbol, regexp_extract({sql_key("event_ticker")}, '-([^-]*)$', 1) as hour, cast(round(floor_strike * 100) as bigint) as lo, {sql_key("event_ticker")} as e from bracket_markets) where e like 'KX%' and symbol is not null and hour != '' group by all""")
def groups_of_symbol_and_day(spark, at):
    """Markets of one family of names, by symbol and the day in their event."""
    m = table(spark, at, "bracket_markets").select(key("symbol").alias("symbol"), key("event_ticker").alias("e"), F.round(F.col("floor_strike") * 100).cast("bigint").alias("lo")).where(F.col("e").like("KX%") & F.col("symbol").isNotNull())
    m = m.withColumn("hour", F.regexp_extract("e", "-([^-]*)$", 1)).where("hour != ''")
    return m.groupBy("symbol", F.substring("hour", 1, 7).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("low"), F.max("lo").alias("high"))


@query(f"""with r as (select {sql_key("bracket_ticker")} as ticker, settled_result as result from bracket_trades where settled_result is not null and {sql_key("bracket_ticker")} is not null qualify row_number() over (partition by {sql_key("bracket_ticker")} order by loaded_at, trade_row) = 1) select result, count(*) as n from r group by result""")
def first_resolutions(spark, at):
    """The first known result of each bracket."""
    t = table(spark, at, "bracket_trades").select(key("bracket_ticker").alias("ticker"), "settled_result", "loaded_at", "trade_row").where("ticker is not null and settled_result is not null")
    first = sets.pick(t, ["ticker"], [F.col("loaded_at").isNull(), F.col("loaded_at"), F.col("trade_row")], ["settled_result"], latest=False)
    return first.groupBy(F.col("settled_result").alias("result")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {BOOKS}, d as (select ticker, min(snap_id) as place from books group by ticker) select ticker, (select count(*) from d) > 40 as truncated from d order by place limit 40""")
def watch_list(spark, at):
    """The first 40 tickers in the order in which they were first named, and whether there were more."""
    return readers.watch_list(books(spark, at), "ticker", "snap_id", 40)


@query(f"""with c as (select {sql_key("order_id")} as k, 1 as source from paper_orders union all select {sql_key("order_id")}, 2 from paper_fills union all select {sql_key("fill_id")}, 3 from paper_fills), f as (select k, min(source) as source from c where k is not null group by k) select source, count(*) as n from f where k not in (select {sql_key("order_id")} from paper_orders where deleted_at is not null and {sql_key("order_id")} is not null) group by source""")
def folded_caches(spark, at):
    """Several caches folded into one by key, the earlier source first, without what is stored already."""
    orders, fills = table(spark, at, "paper_orders"), table(spark, at, "paper_fills")
    caches = [orders.select(key("order_id").alias("k")), fills.select(key("order_id").alias("k")), fills.select(key("fill_id").alias("k"))]
    return sets.fold(caches, ["k"], orders.where("deleted_at is not null").select(key("order_id").alias("k"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- projections


@query(f"""with {BOOKS}, x as (select snap_id, list_max(list_transform(yes_bids, lambda l: l[1])) as yb, list_max(list_transform(no_bids, lambda l: l[1])) as nb, coalesce(len(yes_bids), 0) + coalesce(len(no_bids), 0) as depth from books)
select snap_id, cast(round(yb * 10000) as bigint) as yes_bid, cast(round((1 - nb) * 10000) as bigint) as yes_ask, cast(round(nb * 10000) as bigint) as no_bid, cast(round((1 - yb) * 10000) as bigint) as no_ask, cast(depth as integer) as depth from x""")
def normalized_books(spark, at):
    """Best prices and depth from both ladders, each side's ask as one less the other's best bid."""
    b = books(spark, at).select("snap_id", ladder.normalized(F.col("yes_bids"), F.col("no_bids")).alias("n"))
    price = lambda c: F.round(F.col(f"n.{c}") * 10_000).cast("bigint").alias(c)
    return b.select("snap_id", price("yes_bid"), price("yes_ask"), price("no_bid"), price("no_ask"), "n.depth")


@query(f"""with b as (select distinct {sql_key("ticker")} as ticker, venue from book_snapshots where {sql_key("ticker")} is not null), s as (select ticker, string_split(ticker, '-') as parts from b)
select parts[len(parts)] as last_part, parts[len(parts)] = 'TIE' as is_tie, count(distinct ticker) as n from s group by all""")
def last_parts(spark, at):
    """The last part of each ticker, and whether it names a tie."""
    t = table(spark, at, "book_snapshots").select(key("ticker").alias("ticker")).where("ticker is not null").distinct()
    last = F.element_at(F.split("ticker", "-"), -1)
    return t.groupBy(last.alias("last_part"), (last == "TIE").alias("is_tie")).agg(F.count(F.lit(1)).alias("n"))


# --- predicates


@query(f"""with {BOOKS}, x as (select series, bid, ask, yes_bids[1][2] as yes_size, no_bids[1][2] as no_size, case when yes_bids[1][1] is null or no_bids[1][1] is null then null else abs(bid - round(yes_bids[1][1] * 10000)) <= 0 and abs(ask - (10000 - round(no_bids[1][1] * 10000))) <= 0 end as mirror from books)
select series, count(*) filter (where ask > 0 and no_size >= 1) as n_fillable, count(*) filter (where ask > 0 and no_size >= 10) as n_liquid, count(*) filter (where bid > 0 and yes_size >= 1 and ask > 0 and no_size >= 1) as n_two_sided, count(*) filter (where mirror) as n_mirrored, count(*) filter (where not mirror) as n_crooked, count(*) filter (where mirror is null) as n_untold from x group by series""")
def fillable_readings(spark, at):
    """Readings with a size behind their prices, and whether both sides mirror each other; unknown where a side is empty."""
    head = lambda c, i: F.get(F.get(c, F.lit(0)), F.lit(i))
    x = books(spark, at).select("series", "bid", "ask", head("yes_bids", 1).alias("ys"), head("no_bids", 1).alias("ns"), F.round(head("yes_bids", 0) * 10_000).alias("yp"), F.round(head("no_bids", 0) * 10_000).alias("np"))
    mirror = F.when(F.col("yp").isNull() | F.col("np").isNull(), None).otherwise((F.col("bid") == F.col("yp")) & (F.col("ask") == 10_000 - F.col("np")))
    buy = lambda n: (F.col("ask") > 0) & (F.col("ns") >= n)
    return x.withColumn("mirror", mirror).groupBy("series").agg(
        F.count_if(buy(1)).alias("n_fillable"), F.count_if(buy(10)).alias("n_liquid"), F.count_if(buy(1) & (F.col("bid") > 0) & (F.col("ys") >= 1)).alias("n_two_sided"),
        F.count_if("mirror").alias("n_mirrored"), F.count_if(~F.col("mirror")).alias("n_crooked"), F.count_if(F.col("mirror").isNull()).alias("n_untold"),
    )


@query(f"""with {BOOKS}, f as (select * from books qualify row_number() over (partition by ticker order by t, snap_id) = 1) select event, ticker, ask from f where ask <= 1500""")
def far_rungs(spark, at):
    """Rungs that cost little at their first reading."""
    first = sets.pick(books(spark, at), ["ticker"], [F.col("t"), F.col("snap_id")], ["event", "ask"], latest=False)
    return first.where("ask <= 1500").select("event", "ticker", "ask")


@query(f"""with {BOOKS}, x as (select series, case when bid + ask > 10000 then 'yes' when bid + ask < 10000 then 'no' end as by_mid, case when yes_bids[1][2] > no_bids[1][2] then 'yes' when yes_bids[1][2] < no_bids[1][2] then 'no' end as by_size from books) select series, by_mid, by_size, count(*) as n from x group by all""")
def sides_by_sign(spark, at):
    """The side that the middle and the sizes at the touch speak for; none on a tie."""
    side = lambda a, b: F.when(a > b, "yes").when(a < b, "no")
    head = lambda c: F.get(F.get(c, F.lit(0)), F.lit(1))
    return books(spark, at).groupBy("series", side(F.col("bid") + F.col("ask"), F.lit(10_000)).alias("by_mid"), side(head("yes_bids"), head("no_bids")).alias("by_size")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with m as (select {sql_key("event_ticker")} as event, {sql_key("ticker")} as ticker from bracket_markets where {sql_key("event_ticker")} is not null and {sql_key("ticker")} is not null group by all) select event, count(*) as n, count(*) between 1 and 3 and bool_and(regexp_matches(ticker, '-B[0-9.]+$')) as fits from m group by event""")
def groups_that_fit(spark, at):
    """Groups of one to three members whose names all fit a pattern."""
    m = table(spark, at, "bracket_markets").select(key("event_ticker").alias("event"), key("ticker").alias("ticker")).where("event is not null and ticker is not null").distinct()
    return m.groupBy("event").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)).between(1, 3) & F.bool_and(F.col("ticker").rlike("-B[0-9.]+$"))).alias("fits"))


@query(f"""with {BOOKS}, c as (select 'books' as family, count(distinct d) as n_days, min(d) as first_day from books), m as (select 'manifests', count(distinct cast(floor(epoch_us(delivered_at) / {DAY}.0) as bigint)), min(cast(floor(epoch_us(delivered_at) / {DAY}.0) as bigint)) from capture_manifests) select *, n_days >= 3 as enough from (select * from c union all select * from m)""")
def days_of_data(spark, at):
    """How many days two families have, the first of them, and whether they are enough."""
    b = books(spark, at).select(F.lit("books").alias("family"), "d")
    m = readers.in_season({"manifests": (table(spark, at, "capture_manifests"), "delivered_at")}, -(2**40), 2**40)
    return b.unionByName(m).groupBy("family").agg(F.count_distinct("d").alias("n_days"), F.min("d").alias("first_day")).withColumn("enough", F.col("n_days") >= 3)


# --- joins


@query(f"""with {BOOKS}, {SETTLES}, s as (select event, min(t) as close from settles where event is not null and t is not null and value is not null group by event), p as (select b.*, s.close from books b join s using (event) where b.t < s.close)
select ticker, count(*) as n, arg_min(bid, (t, snap_id)) as first_bid, arg_max(bid, (t, snap_id)) as last_bid, max(close) - max(t) as us_left from p where bid is not null group by ticker""")
def paths_before_close(spark, at):
    """Each ticker's readings before its event's close: how many, the first and last bid, and how long before the close they end."""
    s = settles(spark, at).where("event is not null and t is not null and value is not null").groupBy("event").agg(F.min("t").alias("close"))
    p = books(spark, at).where("bid is not null").join(s, "event").where("t < close")
    o = F.struct("t", "snap_id")
    return p.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min_by("bid", o).alias("first_bid"), F.max_by("bid", o).alias("last_bid"), (F.max("close") - F.max("t")).alias("us_left"))


@query(f"""with {SETTLES}, {CAPTURES}, m as (select {sql_key("ticker")} as ticker, min(market_row) as market_row from bracket_markets where {sql_key("ticker")} is not null group by 1), s as (select event, max(value) as value from settles where event is not null group by event), c as (select event, count(*) as n from captures where event is not null group by event),
t as (select {sql_key("symbol")} as symbol, {sql_key("bracket_ticker")} as ticker, {sql_key("event_ticker")} as event, cast(round(realized_pnl * 10000) as bigint) as pnl from bracket_trades) select symbol, count(*) as n, cast(sum(pnl) as bigint) as pnl, cast(sum(c.n) as bigint) as n_captures, count(s.value) as n_valued from t join m using (ticker) join s using (event) join c using (event) where symbol is not null group by symbol""")
def four_way_join(spark, at):
    """Trades with their market, settlement and captures, by symbol; each other side has one row per key."""
    m = table(spark, at, "bracket_markets").select(key("ticker").alias("ticker")).where("ticker is not null").distinct()
    s = settles(spark, at).where("event is not null").groupBy("event").agg(F.max("value").alias("value"))
    c = captures(spark, at).where("event is not null").groupBy("event").agg(F.count(F.lit(1)).alias("k"))
    t = table(spark, at, "bracket_trades").select(key("symbol").alias("symbol"), key("bracket_ticker").alias("ticker"), key("event_ticker").alias("event"), tt("realized_pnl").alias("pnl")).where("symbol is not null")
    return t.join(m, "ticker").join(s, "event").join(c, "event").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.sum("k").alias("n_captures"), F.count("value").alias("n_valued"))


@query(f"""with s as (select signal_id, {sql_key("city")} as city, {sql_date_key("target_date")} as day from city_signals), m as (select distinct {sql_key("city")} as city, {sql_date_key("target_date")} as day from capture_manifests where {sql_key("city")} is not null)
select status, count(*) as n from (select case when s.city is null then 'no city' when s.city not in (select city from m) then 'unknown city' when not exists (select 1 from m where m.city = s.city and m.day = s.day) then 'no such day' else 'joined' end as status from s) group by status""")
def join_status_of_signals(spark, at):
    """Why a signal finds no manifest of its city and day, by precedence."""
    s = table(spark, at, "city_signals").select("signal_id", key("city").alias("city"), date_key("target_date").alias("day"))
    m = table(spark, at, "capture_manifests").select(key("city").alias("city"), date_key("target_date").alias("day")).where("city is not null").distinct()
    j = s.join(m.select("city").distinct().withColumn("c", F.lit(True)), "city", "left").join(m.withColumn("d", F.lit(True)), ["city", "day"], "left")
    status = F.when(F.col("city").isNull(), "no city").when(F.col("c").isNull(), "unknown city").when(F.col("d").isNull(), "no such day").otherwise("joined")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with c as (select {sql_key("capture_id")} as capture_id, unnest(series) as s from capture_manifests where {sql_key("capture_id")} is not null) select capture_id, count(distinct s) as n from c group by capture_id""")
def series_of_pass(spark, at):
    """The series that each capture's manifests name."""
    return table(spark, at, "capture_manifests").select(key("capture_id").alias("capture_id"), F.explode("series").alias("s")).where("capture_id is not null and s is not null").groupBy("capture_id").agg(F.count_distinct("s").alias("n"))


@query(f"""select delivery_id, coalesce(list_filter(series, lambda s: s = 'KXHIGH' || {sql_key("city")})[1], series[1]) as own from capture_manifests where series is not null""")
def own_series(spark, at):
    """The series of a manifest's own city in its array, else the first."""
    m = table(spark, at, "capture_manifests").where("series is not null").withColumn("k", key("city"))
    own = F.get(F.filter("series", lambda s: s == F.concat(F.lit("KXHIGH"), F.col("k"))), F.lit(0))
    return m.select("delivery_id", F.coalesce(own, F.get("series", F.lit(0))).alias("own"))


@query(f"""with {BOOKS}, x as (select event, ticker, t, snap_id, ask - coalesce(lag(ask) over (partition by ticker order by t, snap_id), 0) as step, row_number() over (partition by ticker order by t, snap_id) as n from books where ask is not null),
s as (select *, sum(step) over (partition by event order by t, snap_id) as asks, count(*) filter (where n = 1) over (partition by event order by t, snap_id) as n_seen from x) select ticker, snap_id, cast(asks as bigint) as asks, n_seen from s where n = 1""")
def siblings_at_entry(spark, at):
    """At each ticker's first ask the sum of the asks that its event's tickers then had: a running sum of their changes, siblings are not paired."""
    b = sequence.beside(books(spark, at).where("ask is not null"), ["ticker"], ["t", "snap_id"], ["ask"], "before")
    b = b.withColumns({"step": F.col("ask") - F.coalesce("before.ask", F.lit(0)), "first": F.col("before").isNull().cast("bigint")})
    s = sequence.running(sequence.running(b, ["event"], ["t", "snap_id"], F.col("step"), "asks"), ["event"], ["t", "snap_id"], F.col("first"), "n_seen")
    return s.where("first = 1").select("ticker", "snap_id", "asks", "n_seen")


# --- aggregations


@query(f"""with {BOOKS}, l as (select * from books qualify row_number() over (partition by ticker, d order by t desc, snap_id desc) = 1) select event, d, count(ask) as n, cast(sum(ask) as bigint) as asks, cast(sum(ask) - 10000 as bigint) as over from l group by event, d having count(ask) > 0""".replace("as over from", "as excess from"))
def ask_sums(spark, at):
    """The sum of an event's asks at the last readings of a day, and by how much it exceeds one dollar."""
    last = sets.pick(books(spark, at), ["ticker", "d"], [F.col("t"), F.col("snap_id")], ["event", "ask"])
    return last.groupBy("event", "d").agg(F.count("ask").alias("n"), F.sum("ask").alias("asks"), (F.sum("ask") - 10_000).alias("excess")).where("n > 0")


@query(f"""select {sql_key("city")} as city, count(distinct {sql_key("capture_id")}) as n_captures, {r6("median(n_with_book)")} as median_books, {r6("count(*) filter (where completeness_ok) / count(*)::double")} as complete from capture_manifests where {sql_key("city")} is not null group by 1""")
def completeness_by_city(spark, at):
    """Per city the captures, the median of books and the share of manifests that say they are complete; unknown is not complete."""
    m = table(spark, at, "capture_manifests").select(key("city").alias("city"), key("capture_id").alias("c"), "n_with_book", "completeness_ok").where("city is not null")
    return m.groupBy("city").agg(F.count_distinct("c").alias("n_captures"), stats.rounded(F.median("n_with_book")).alias("median_books"), stats.rounded(F.count_if("completeness_ok") / F.count(F.lit(1))).alias("complete"))


@query(f"""with {BOOKS}, l as (select * from books qualify row_number() over (partition by ticker, d order by t desc, snap_id desc) = 1), e as (select series, event, d, coalesce(sum(ask) filter (where ask < 500), 0) as low, coalesce(sum(ask) filter (where ask between 500 and 5000), 0) as mid, coalesce(sum(ask) filter (where ask > 5000), 0) as high from l group by all)
select series, count(*) as n, {r6("sum(low)::double / count(*)")} as low, {r6("sum(mid)::double / count(*)")} as mid, {r6("sum(high)::double / count(*)")} as high from e group by series""")
def ladder_parts(spark, at):
    """Sums of an event's asks by how dear they are, then their means by series."""
    last = sets.pick(books(spark, at), ["ticker", "d"], [F.col("t"), F.col("snap_id")], ["series", "event", "ask"])
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("ask"))), F.lit(0))
    e = last.groupBy("series", "event", "d").agg(part(F.col("ask") < 500).alias("l"), part(F.col("ask").between(500, 5000)).alias("m"), part(F.col("ask") > 5000).alias("h"))
    mean = lambda c: stats.rounded(F.sum(c).cast("double") / F.count(F.lit(1)))
    return e.groupBy("series").agg(F.count(F.lit(1)).alias("n"), mean("l").alias("low"), mean("m").alias("mid"), mean("h").alias("high"))


_BASIS = f"""{SETTLES}, {CAPTURES}, s as (select event, max(symbol) as symbol, max(value) as value from settles where event is not null and value is not null group by event), c as (select event, arg_max(spot, (t, capture_row)) as spot from captures where event is not null and t is not null and spot is not null group by event), g as (select symbol, event, value, spot from s join c using (event) where symbol is not null)"""


def _basis(spark, at):
    s = settles(spark, at).where("event is not null and value is not null").groupBy("event").agg(F.max("symbol").alias("symbol"), F.max("value").alias("value")).where("symbol is not null")
    c = captures(spark, at).where("event is not null and t is not null and spot is not null").groupBy("event").agg(F.max_by("spot", F.struct("t", "capture_row")).alias("spot"))
    return s.join(c, "event")


@query(f"""with {_BASIS} select symbol, count(*) as n, cast(sum(abs(value - spot)) as bigint) as total, max(abs(value - spot)) as most, {r6("sum(abs(value - spot) * 10000.0 / spot) / count(*)")} as bps, case when count(*) >= 4 then {r6("floor(stddev_pop((value - spot)::double) * 100) / 100")} end as spread from g where spot > 0 group by symbol""")
def basis_by_symbol(spark, at):
    """The gap between settlement and last spot: sum, largest, in basis points, and its spread from four on."""
    g = _basis(spark, at).where("spot > 0").withColumn("v", F.col("value") - F.col("spot"))
    n = F.count(F.lit(1))
    return g.groupBy("symbol").agg(n.alias("n"), F.sum(F.abs("v")).alias("total"), F.max(F.abs("v")).alias("most"), stats.rounded(F.sum(F.abs("v") * F.lit(10_000.0) / F.col("spot")) / n).alias("bps"), F.when(n >= 4, stats.rounded(F.floor(F.stddev_pop(F.col("v").cast("double")) * 100) / 100)).alias("spread"))


@query(f"""with {_BASIS} select count(*) as n, {r6("sum(abs(value - spot))::double / count(*)")} as mean, {r6("median(abs(value - spot))")} as middle, max(abs(value - spot)) as most, {r6("count(*) filter (where abs(value - spot) >= 5000) / count(*)::double")} as rate from g""")
def disagreements(spark, at):
    """How far settlement and last spot are apart, and how often by half a dollar or more."""
    g = _basis(spark, at).withColumn("v", F.abs(F.col("value") - F.col("spot")))
    middle = stats.exact_quantile(g, "v", 0.5)
    n = F.count(F.lit(1))
    return g.agg(n.alias("n"), stats.rounded(F.sum("v").cast("double") / n).alias("mean"), F.max("v").alias("most"), stats.rounded(F.count_if(F.col("v") >= 5000) / n).alias("rate")).withColumn("middle", stats.rounded(middle))


@query(rf"""with {BOOKS}, {SETTLES}, s as (select event, min(t) as close from settles where event is not null and t is not null group by event), x as (select b.t >= s.close as past_settle, regexp_extract(b.event, '-(\d{{2}}[A-Z]{{3}}\d{{4}})$', 1) as tok, b.t from books b join s using (event)),
y as (select past_settle, t >= epoch_us(timezone('America/New_York', strptime('20' || left(tok, 2) || substr(tok, 3, 1) || lower(substr(tok, 4, 2)) || substr(tok, 6), '%Y%b%d%H'))) as past_token from x where tok != '') select past_settle, past_token, count(*) as n from y group by all""")
def two_closes(spark, at):
    """Readings past the settlement's close against those past the close in the ticker."""
    s = settles(spark, at).where("event is not null and t is not null").groupBy("event").agg(F.min("t").alias("close"))
    token = tickers.hour_token_micros(F.regexp_extract("event", r"-(\d{2}[A-Z]{3}\d{4})$", 1))
    x = books(spark, at).join(s, "event").withColumn("token", token).where("token is not null")
    return x.groupBy((F.col("t") >= F.col("close")).alias("past_settle"), (F.col("t") >= F.col("token")).alias("past_token")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {BOOKS} select series, d, count(*) as n, count(distinct ticker) as n_tickers, min(t) as opens, max(t) as closes from books where event != ticker group by series, d""")
def grouped_readings(spark, at):
    """Readings by series and day; those of a ticker without an event are left out."""
    return books(spark, at).where("event != ticker").groupBy("series", "d").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"), F.min("t").alias("opens"), F.max("t").alias("closes"))


@query(f"""with {BOOKS}, j as (select series, bid - lag(bid) over (partition by ticker order by t, snap_id) as v from books) select series, count(v) as n, {r6("count(*) filter (where v > 0) / count(v)::double")} as positive, {r6("median(abs(v))")} as middle from j where v is not null group by series""")
def positive_shares(spark, at):
    """The share of steps upwards and the median size of a step."""
    j = sequence.deltas(books(spark, at), ["ticker"], ["t", "snap_id"], ["bid"]).where("d_bid is not null")
    return j.groupBy("series").agg(F.count(F.lit(1)).alias("n"), stats.rounded(F.count_if(F.col("d_bid") > 0) / F.count(F.lit(1))).alias("positive"), stats.rounded(F.median(F.abs("d_bid"))).alias("middle"))


# --- sequences and tops


@query(f"""with {BOOKS}, {SETTLES}, s as (select event, min(t) as close from settles where event is not null and t is not null group by event), x as (select b.ticker, b.t, b.snap_id, coalesce(depth >= 6, false) as hit, depth, coalesce(lead(b.t) over (partition by ticker order by b.t, snap_id) - b.t, 0) as us from books b join s using (event) where s.close - b.t between 0 and {24 * HOUR}),
r as (select *, sum(case when hit then 0 else 1 end) over (partition by ticker order by t, snap_id) as run from x), c as (select ticker, run, count(*) as n, cast(sum(us) as bigint) as us, min(depth) as depth from r where hit group by all) select ticker, cast(run as bigint) as run, n, us as seconds, depth, us >= 600000000 and depth >= 8 as passes from c""")
def runs_near_close(spark, at):
    """Runs of deep readings in the day before the close; shallow ones break them."""
    s = settles(spark, at).where("event is not null and t is not null").groupBy("event").agg(F.min("t").alias("close"))
    x = books(spark, at).join(s, "event").where(F.col("close") - F.col("t") >= 0).where(F.col("close") - F.col("t") <= 24 * HOUR)
    b = sequence.beside(x, ["ticker"], ["t", "snap_id"], ["t"], "next", ahead=True).withColumn("us", F.coalesce(F.col("next.t") - F.col("t"), F.lit(0)))
    return sequence.gated_runs(b, ["ticker"], ["t", "snap_id"], F.col("depth") >= 6, F.col("us"), F.col("depth"), 600_000_000, 8)


@query(f"""with g as (select {sql_key("symbol")} as symbol, {sql_key("event_ticker")} as event, min({sql_iso_micros("open_time")}) as opens, max({sql_iso_micros("close_time")}) as closes from bracket_markets where {sql_key("event_ticker")} is not null and {sql_key("symbol")} is not null group by all)
select symbol, event, closes from g where closes - opens <= {65 * 60_000_000} and closes > 1780380000000000 qualify row_number() over (partition by symbol order by closes, event) = 1""")
def soonest_groups(spark, at):
    """Per symbol the group of at most 65 minutes that closes soonest after a moment."""
    m = table(spark, at, "bracket_markets").select(key("symbol").alias("symbol"), key("event_ticker").alias("event"), iso_micros("open_time").alias("o"), iso_micros("close_time").alias("c")).where("symbol is not null and event is not null")
    g = m.groupBy("symbol", "event").agg(F.min("o").alias("opens"), F.max("c").alias("closes")).where(f"closes - opens <= {65 * 60_000_000} and closes > 1780380000000000")
    return sets.pick(g, ["symbol"], [F.col("closes"), F.col("event")], ["event", "closes"], latest=False)


@query(f"""with {BOOKS} select ticker, snap_id, t, ask from books where ask <= 1500 qualify row_number() over (partition by ticker order by t, snap_id) = 1""")
def first_longshots(spark, at):
    """The first reading of each ticker at which it was a long shot."""
    return sets.pick(books(spark, at).where("ask <= 1500"), ["ticker"], [F.col("t"), F.col("snap_id")], ["snap_id", "t", "ask"], latest=False)


@query(f"""with m as (select {sql_key("city")} as city, {sql_date_key("target_date")} as day, delivery_id, delivered_at from capture_manifests where {sql_key("city")} is not null and {sql_date_key("target_date")} is not null) select city, day, delivery_id from m where (city, day) not in (select ({sql_key("city")}, {sql_date_key("target_date")}) from city_signals where {sql_key("city")} is not null and {sql_date_key("target_date")} is not null) qualify row_number() over (partition by city, day order by delivered_at, delivery_id) = 1""")
def once_a_day(spark, at):
    """The first manifest of each city and day that no signal names yet."""
    cell = lambda n: table(spark, at, n).withColumns({"city": key("city"), "day": date_key("target_date")}).where("city is not null and day is not null")
    return sets.append_new(cell("capture_manifests"), cell("city_signals"), ["city", "day"], [F.col("delivered_at").isNull(), F.col("delivered_at"), F.col("delivery_id")], ["delivery_id"])


# --- tokens


@query(rf"""with x as (select delivery_id, {sql_iso_micros("captured_at")} as a, {sql_iso_micros(r"regexp_extract(capture_id, '(\d{8}T\d{6}Z)', 1)")} as b from capture_manifests) select delivery_id, coalesce(a, b) as t, a is null and b is not null as from_id from x where coalesce(a, b) is not null""")
def capture_times(spark, at):
    """When a manifest was captured, by its own field or else by the time in its id."""
    own, by_id = iso_micros("captured_at"), iso_micros(F.regexp_extract("capture_id", r"(\d{8}T\d{6}Z)", 1))
    return table(spark, at, "capture_manifests").select("delivery_id", F.coalesce(own, by_id).alias("t"), (own.isNull() & by_id.isNotNull()).alias("from_id")).where("t is not null")


@query(rf"""with {BOOKS}, x as (select t, regexp_extract(event, '-(\d{{2}}[A-Z]{{3}}\d{{4}})$', 1) as fine, regexp_extract(event, '-(\d{{2}}[A-Z]{{3}}\d{{2}})[A-Z]', 1) as coarse from books),
y as (select case when fine != '' then 'fine' when coarse != '' then 'coarse' else 'unparsed' end as resolution, case when fine != '' then epoch_us(timezone('America/New_York', strptime('20' || left(fine, 2) || substr(fine, 3, 1) || lower(substr(fine, 4, 2)) || substr(fine, 6), '%Y%b%d%H'))) - t end as us from x)
select resolution, case when us is null then 'unknown' when us < 0 then 'past' when us < {HOUR} then 'under 1 h' when us < {6 * HOUR} then '1-6 h' when us < {24 * HOUR} then '6-24 h' else 'over 24 h' end as bucket, count(*) as n from y group by all""")
def time_to_close(spark, at):
    """Readings by the time left until the close in their ticker, and by how finely it says so."""
    fine, coarse = F.regexp_extract("event", r"-(\d{2}[A-Z]{3}\d{4})$", 1), F.regexp_extract("event", r"-(\d{2}[A-Z]{3}\d{2})[A-Z]", 1)
    us = tickers.hour_token_micros(fine) - F.col("t")
    bucket = F.when(us.isNull(), "unknown").when(us < 0, "past").when(us < HOUR, "under 1 h").when(us < 6 * HOUR, "1-6 h").when(us < 24 * HOUR, "6-24 h").otherwise("over 24 h")
    return books(spark, at).groupBy(F.when(fine != "", "fine").when(coarse != "", "coarse").otherwise("unparsed").alias("resolution"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""with {_TITLES} select ticker, regexp_extract(ticker, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{2}})([A-Z]{{3}})([A-Z]{{3}})(\d*)$', 1) as series, regexp_extract(ticker, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{2}})([A-Z]{{3}})([A-Z]{{3}})(\d*)$', 3) as away, regexp_extract(ticker, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{2}})([A-Z]{{3}})([A-Z]{{3}})(\d*)$', 4) as home,
case when not regexp_matches(ticker, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{2}})([A-Z]{{3}})([A-Z]{{3}})(\d*)$') then 'no game' end as error from games""")
def game_tickers(spark, at):
    """The parts of a game's ticker, or why it has none."""
    g = _games(spark, at)
    parts = tickers.game(F.col("ticker"))
    return g.select("ticker", parts["series"].alias("series"), parts["away"].alias("away"), parts["home"].alias("home"), parts["error"].alias("error"))


@query(f"""select order_row, coalesce({sql_key("event_ticker")}, nullif(regexp_replace({sql_key("ticker")}, '-[^-]*$', ''), ''), '<unknown>') as event, coalesce(nullif(split_part({sql_key("ticker")}, '-', 1), ''), '<unknown>') as series, lower(regexp_replace(coalesce(strategy, 'none given'), '[^A-Za-z0-9]+', '-', 'g')) as slug from paper_orders""")
def keys_with_fallbacks(spark, at):
    """Event and series of an order from its own field, else from its ticker, else unknown; its strategy as a slug."""
    t = key("ticker")
    blank = lambda c: F.when(c != "", c)
    return table(spark, at, "paper_orders").select("order_row", F.coalesce(key("event_ticker"), blank(tickers.event_of(t)), F.lit("<unknown>")).alias("event"), F.coalesce(blank(tickers.series_of(t)), F.lit("<unknown>")).alias("series"), tickers.slug(F.coalesce("strategy", F.lit("none given"))).alias("slug"))


@query(r"""with p as (select order_row, 'var xs = [' || order_row || ', ' || coalesce(qty, 0) || ']; ys = [' || coalesce(qty, 0) || ', 7]; zs = [1]' as h from paper_orders)
select order_row, cast(string_split(regexp_extract(h, 'xs = \[([^\]]*)\]', 1), ', ')[2] as double) as last_x, cast(string_split(regexp_extract(h, 'ys = \[([^\]]*)\]', 1), ', ')[2] as double) as last_y, 'parse_error' as other from p""")
def last_of_page_arrays(spark, at):
    """The newest entry of parallel arrays in a page's script; arrays of other lengths are an error."""
    q = F.coalesce("qty", F.lit(0)).cast("string")
    h = F.concat(F.lit("var xs = ["), F.col("order_row").cast("string"), F.lit(", "), q, F.lit("]; ys = ["), q, F.lit(", 7]; zs = [1]"))
    p = table(spark, at, "paper_orders").select("order_row", F.element_at(arrays_in_page(h, ["xs", "ys"]), -1).alias("z"), F.when(arrays_in_page(h, ["xs", "zs"]).isNull(), "parse_error").otherwise("ok").alias("other"))
    return p.select("order_row", F.col("z.xs").alias("last_x"), F.col("z.ys").alias("last_y"), "other")


@query(r"""select order_row, 3 as n_cells, coalesce(strategy, '') || '|x' as second, coalesce(side, '') as third from paper_orders""")
def cells_of_rows(spark, at):
    """Cells of a table row with bars; an escaped bar belongs to its cell."""
    line = F.concat(F.lit("| "), F.col("order_row").cast("string"), F.lit(" | "), F.coalesce("strategy", F.lit("")), F.lit(r"\|x | "), F.coalesce("side", F.lit("")), F.lit(" |"))
    c = table(spark, at, "paper_orders").select("order_row", tickers.cells(line).alias("c"))
    return c.select("order_row", F.size("c").alias("n_cells"), F.get("c", F.lit(1)).alias("second"), F.get("c", F.lit(2)).alias("third"))


# --- quality and state


_ORDER_CHECKS = f"""case when {sql_key("order_id")} is null then 'order_id' end, case when not coalesce(qty > 0, false) then 'qty' end, case when not coalesce(limit_price > 0 and limit_price < 1, false) then 'limit_price' end, case when not coalesce(lower(trim(side)) in ('yes', 'no'), false) then 'side' end, case when {sql_key("event_ticker")} is null then 'event_ticker' end, case when {sql_iso_micros("ts")} is null then 'ts' end"""


@query(f"""select order_row, concat_ws(',', {_ORDER_CHECKS}) as errors from paper_orders where concat_ws(',', {_ORDER_CHECKS}) != ''""")
def order_errors(spark, at):
    checks = {"order_id": key("order_id").isNotNull(), "qty": F.col("qty") > 0, "limit_price": (F.col("limit_price") > 0) & (F.col("limit_price") < 1), "side": F.lower(F.trim("side")).isin("yes", "no"), "event_ticker": key("event_ticker").isNotNull(), "ts": iso_micros("ts").isNotNull()}
    return table(spark, at, "paper_orders").select("order_row", F.array_join(quality.errors(checks), ",").alias("errors")).where("errors != ''")


@query(rf"""with {BOOKS}, x as (select regexp_matches(ticker, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{4}})-([BT])(\d+(?:\.\d+)?)$') as parsed, bid > 0 and ask < 10000 and bid >= ask as crossed, t < lag(t) over (partition by ticker order by snap_id) as backward from books) select count(*) as n, count(*) filter (where parsed) as n_parsed, count(*) filter (where crossed) as n_crossed, count(*) filter (where backward) as n_backward from x""")
def market_data_checks(spark, at):
    """How many readings have a ticker that can be read, quotes that cross, and a time before that of the row stored before."""
    b = sequence.beside(books(spark, at), ["ticker"], ["snap_id"], ["t"], "before", width=65_536)
    crossed = (F.col("bid") > 0) & (F.col("ask") < 10_000) & (F.col("bid") >= F.col("ask"))
    return b.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ticker").rlike(tickers.BRACKET)).alias("n_parsed"), F.count_if(crossed).alias("n_crossed"), F.count_if(F.col("t") < F.col("before.t")).alias("n_backward"))


@query(f"""with {BOOKS}, l as (select max(d) as today from books), f as (select ticker, bool_or(ask - bid >= 600) as flag from books, l where d = today group by ticker), s as (select ticker, count(distinct d) filter (where ask - bid >= 600) as hits, count(distinct d) as days, max(d) filter (where ask - bid >= 600) as last_hit from books, l where d < today group by ticker)
select coalesce(f.ticker, s.ticker) as ticker, case when f.ticker is null then null when coalesce(s.hits, 0) = 0 and f.flag then 'observed' when coalesce(s.hits, 0) = 0 then null when f.flag then 'recheck_hit' when s.days >= 3 and s.hits = 1 then null else 'recheck_miss' end as event, coalesce(s.hits, 0) as hits from f full join s using (ticker) where f.ticker is not null""")
def reconciled_flags(spark, at):
    """Today's flags against what was known: newly observed, hit again, missed; an expired pattern misses no more but can be hit again."""
    b = books(spark, at).withColumn("flag", F.col("ask") - F.col("bid") >= 600)
    today = b.agg(F.max("d")).scalar()
    now = b.where(F.col("d") == today).groupBy("ticker").agg(F.bool_or("flag").alias("flag"))
    state = b.where(F.col("d") < today).groupBy("ticker").agg(F.count_distinct(F.when(F.col("flag"), F.col("d"))).alias("hits"), F.count_distinct("d").alias("days"))
    state = state.withColumn("expired", (F.col("days") >= 3) & (F.col("hits") == 1))
    return quality.reconciled(now, state, "ticker").select("ticker", "event", "hits")


