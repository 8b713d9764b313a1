"""Queries over the library's own operators, with their DuckDB twins.

Prices are whole ten-thousandths of a dollar and sizes whole hundredths, so that sums are exact
in any order; other doubles are rounded to six places by floor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import ladder, stats, tickers
from tapeloom.functions.keys import hash_key, key, sql_hash_key, sql_key
from tapeloom.functions.times import floor_div, iso_micros, micros, sql_iso_micros
from tapeloom.operators import asof, bootstrap, fold, quality, sequence, sets
from tapeloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000.0"


def tt(c: str) -> F.Column:
    return F.round(F.col(c) * 10_000).cast("bigint")


# --- views

BOOKS = f"""books as (
  select snap_id, {sql_key("ticker")} as ticker, epoch_us(ts_utc) as t, cast(floor(epoch_us(ts_utc) / {DAY}.0) as bigint) as d, lower(trim(venue)) as venue,
    regexp_replace({sql_key("ticker")}, '-[^-]*$', '') as event, split_part({sql_key("ticker")}, '-', 1) as series,
    cast(round(best_yes_bid * 10000) as bigint) as bid, cast(round(best_yes_ask * 10000) as bigint) as ask, depth, yes_bids, no_bids
  from book_snapshots where ts_utc is not null and {sql_key("ticker")} is not null)"""


def books(spark: SparkSession, at: str) -> DataFrame:
    """Readings with a ticker and a time."""
    ticker = key("ticker")
    t = micros("ts_utc")
    df = table(spark, at, "book_snapshots").where(ticker.isNotNull() & F.col("ts_utc").isNotNull())
    return df.select(
        "snap_id", ticker.alias("ticker"), t.alias("t"), floor_div(t, DAY).alias("d"), F.lower(F.trim("venue")).alias("venue"), tickers.event_of(ticker).alias("event"),
        tickers.series_of(ticker).alias("series"), tt("best_yes_bid").alias("bid"), tt("best_yes_ask").alias("ask"), "depth", "yes_bids", "no_bids",
    )


CAPTURES = f"""captures as (
  select capture_row, capture_id, {sql_key("symbol")} as symbol, {sql_key("event_ticker")} as event, {sql_iso_micros("captured_at")} as t, cast(round(spot_price * 10000) as bigint) as spot from hour_captures)"""


def captures(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "hour_captures").select("capture_row", "capture_id", key("symbol").alias("symbol"), key("event_ticker").alias("event"), iso_micros("captured_at").alias("t"), tt("spot_price").alias("spot"))


SETTLES = f"""settles as (
  select settle_id, {sql_key("symbol")} as symbol, {sql_key("event_ticker")} as event, {sql_iso_micros("settle_close_iso")} as t, cast(round(settle_value * 10000) as bigint) as value, epoch_us(booked_at) as booked from hour_settles)"""


def settles(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "hour_settles").select("settle_id", key("symbol").alias("symbol"), key("event_ticker").alias("event"), iso_micros("settle_close_iso").alias("t"), tt("settle_value").alias("value"), micros("booked_at").alias("booked"))


def events(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").select("event_id", "user_id", "event_type", micros("ts").alias("t"), F.get_json_object("props", "$.k").cast("bigint").alias("x"))


EVENTS = "ev as (select event_id, user_id, event_type, epoch_us(ts) as t, cast(json_extract_string(props, '$.k') as bigint) as x from events)"


# --- latest, earliest, sets


@query(f"""with {BOOKS} select ticker, d, snap_id, bid, ask from books qualify row_number() over (partition by ticker, d order by t desc, snap_id desc) = 1""")
def last_reading_per_day(spark, at):
    return sets.pick(books(spark, at), ["ticker", "d"], [F.col("t"), F.col("snap_id")], ["snap_id", "bid", "ask"])


@query(f"""with {BOOKS}, l as (select * from books qualify row_number() over (partition by ticker, d order by t desc, snap_id desc) = 1)
select series, d, count(*) as n, count(*) filter (where bid > 0 and bid < ask and ask < 10000) as n_two_sided,
  {r6("median(case when bid > 0 and bid < ask and ask < 10000 then ask - bid end)")} as median_spread, {r6("median(depth)")} as median_depth from l group by series, d""")
def daily_rollup(spark, at):
    last = sets.pick(books(spark, at), ["ticker", "d"], [F.col("t"), F.col("snap_id")], ["series", "bid", "ask", "depth"])
    two = (F.col("bid") > 0) & (F.col("bid") < F.col("ask")) & (F.col("ask") < 10_000)
    return last.groupBy("series", "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(two).alias("n_two_sided"), stats.rounded(F.median(F.when(two, F.col("ask") - F.col("bid")))).alias("median_spread"), stats.rounded(F.median("depth")).alias("median_depth"))


@query(f"""with {CAPTURES}, f as (select * from captures where event is not null and t is not null qualify row_number() over (partition by event order by t, capture_row) = 1)
select event, capture_row, t, spot from f""")
def earliest_capture_per_event(spark, at):
    return sets.pick(captures(spark, at).where("event is not null and t is not null"), ["event"], [F.col("t"), F.col("capture_row")], ["capture_row", "t", "spot"], latest=False)


@query(f"""select {sql_key("fill_id")} as fill_id, fill_row, order_id, qty from paper_fills where {sql_key("fill_id")} is not null
qualify row_number() over (partition by {sql_key("fill_id")} order by loaded_at, fill_row) = 1""")
def first_fill_of_an_id(spark, at):
    df = table(spark, at, "paper_fills").withColumn("fill_id", key("fill_id")).where("fill_id is not null")
    return sets.pick(df, ["fill_id"], [F.col("loaded_at").isNull(), F.col("loaded_at"), F.col("fill_row")], ["fill_row", "order_id", "qty"], latest=False)


_HALF = f"""with k as (select delivery_id, {sql_key("capture_id")} as a, delivered_at, cast(floor(epoch_us(delivered_at) / {DAY}.0) as bigint) as d from capture_manifests),
cut as (select median(d) as m from k)"""


@query(f"""{_HALF} select a as capture_id, delivery_id from k where a is not null and d > (select m from cut) and a not in (select a from k where a is not null and d <= (select m from cut))
qualify row_number() over (partition by a order by delivered_at, delivery_id) = 1""")
def incremental_append(spark, at):
    k = table(spark, at, "capture_manifests").select("delivery_id", key("capture_id").alias("capture_id"), "delivered_at", floor_div(micros("delivered_at"), DAY).alias("d"))
    cut = k.agg(F.median("d")).scalar()
    return sets.append_new(k.where(F.col("d") > cut), k.where((F.col("d") <= cut) & F.col("capture_id").isNotNull()), ["capture_id"], [F.col("delivered_at"), F.col("delivery_id")], ["delivery_id"])


@query(f"""select {sql_key("order_id")} as order_id, count(*) as n from paper_orders where {sql_key("order_id")} is not null group by 1 having count(*) > 1""")
def repeated_order_ids(spark, at):
    return sets.repeated_keys(table(spark, at, "paper_orders").select(key("order_id").alias("order_id")).where("order_id is not null"), ["order_id"])


@query(f"""with {BOOKS} select series, count(distinct event) as n_events, count(distinct ticker) as n_tickers from books group by series""")
def keys_per_series(spark, at):
    return books(spark, at).groupBy("series").agg(F.count_distinct("event").alias("n_events"), F.count_distinct("ticker").alias("n_tickers"))


@query(f"""with {BOOKS}, m as (select min(d) as a from books where d > 0) select ticker, count(*) as n from books, m where t between a * {DAY} + 6 * {HOUR} and a * {DAY} + 12 * {HOUR} group by ticker""")
def window_slice(spark, at):
    b = books(spark, at)
    first = b.where("d > 0").agg(F.min("d") * DAY).scalar()
    return b.where((F.col("t") >= first + 6 * HOUR) & (F.col("t") <= first + 12 * HOUR)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select {sql_key("source")} as source, count(distinct source) as n_spellings, count(*) as n from documents where {sql_key("source")} is not null group by 1""")
def source_spellings(spark, at):
    return table(spark, at, "documents").select(key("source").alias("k"), "source").where("k is not null").groupBy("k").agg(F.count_distinct("source").alias("n_spellings"), F.count(F.lit(1)).alias("n")).withColumnRenamed("k", "source")


# --- joins


@query(f"""with {BOOKS}, {SETTLES}, s as (select event, min(t) as close from settles where event is not null and t is not null group by event)
select b.ticker, s.close, b.snap_id, b.bid, b.ask from books b join s on b.event = s.event where b.t < s.close qualify row_number() over (partition by b.ticker order by b.t desc, b.snap_id) = 1""")
def last_reading_before_close(spark, at):
    close = settles(spark, at).where("event is not null and t is not null").groupBy("event").agg(F.min("t").alias("close"))
    joined = books(spark, at).join(close, "event").where("t < close")
    return sets.pick(joined, ["ticker", "close"], [F.col("t"), -F.col("snap_id")], ["snap_id", "bid", "ask"])


_ASOF_L = "l as (select user_id as k, t, event_id as id from ev where event_type = 'purchase')"
_ASOF_R = "r as (select user_id as k, t, min(event_id) as id from ev where event_type in ('signup', 'view') group by 1, 2)"


def _asof_sides(spark, at):
    e = events(spark, at)
    return e.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "t", F.col("event_id").alias("id")), e.where("event_type in ('signup', 'view')").select(F.col("user_id").alias("k"), "t", F.col("event_id").alias("id"))


@query(f"""with {EVENTS}, {_ASOF_L}, {_ASOF_R} select l.id as left_id, r.id as right_id, l.t - r.t as gap_us from l join r on l.k = r.k and r.t <= l.t qualify row_number() over (partition by l.id order by r.t desc) = 1""")
def asof_backward(spark, at):
    return asof.asof(*_asof_sides(spark, at))


@query(f"""with {EVENTS}, {_ASOF_L}, {_ASOF_R} select l.id as left_id, r.id as right_id, r.t - l.t as gap_us from l join r on l.k = r.k and r.t > l.t qualify row_number() over (partition by l.id order by r.t) = 1""")
def asof_forward_strict(spark, at):
    return asof.asof(*_asof_sides(spark, at), direction="forward", strict=True)


@query(f"""with {EVENTS}, {_ASOF_L}, {_ASOF_R} select l.id as left_id, r.id as right_id, abs(r.t - l.t) as gap_us from l join r on l.k = r.k and abs(r.t - l.t) <= {6 * HOUR} qualify row_number() over (partition by l.id order by abs(r.t - l.t), r.t) = 1""")
def asof_nearest_within(spark, at):
    return asof.asof(*_asof_sides(spark, at), direction="nearest", tolerance_us=6 * HOUR)


@query(f"""with {CAPTURES}, h as (select symbol, cast(floor(t / {HOUR}.0) as bigint) as hour, count(*) as n from captures where symbol is not null and t is not null group by all),
p as (select distinct symbol, hour from h), j as (select p.symbol, p.hour, count(h.n) as n, sum(h.n) as total from p left join h on p.symbol = h.symbol and h.hour between p.hour - 7 and p.hour group by all)
select symbol, hour, n, case when n = 8 then cast(total as bigint) end as total, case when n = 8 then 'full' when n > 0 then 'partial' else 'none' end as status from j""")
def interval_of_eight_hours(spark, at):
    h = captures(spark, at).where("symbol is not null and t is not null").groupBy("symbol", floor_div(F.col("t"), HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n_captures"))
    return sets.interval_sums(h, h, "symbol", "hour", 8, "n_captures")


@query(f"""with r as (select {sql_key("ticker")} as k, count(*) as n, min(market_row) as sole from bracket_markets where {sql_key("ticker")} is not null group by 1)
select trade_row, case when n = 1 then sole end as market_row, case when n = 1 then 'matched' when n > 1 then 'ambiguous' else 'unmatched' end as status from bracket_trades t left join r on {sql_key("t.bracket_ticker")} = r.k""")
def unique_match_of_trades(spark, at):
    trades = table(spark, at, "bracket_trades").select("trade_row", key("bracket_ticker").alias("k"))
    return sets.unique_match(trades, table(spark, at, "bracket_markets").select("market_row", key("ticker").alias("k")), "k", "trade_row", "market_row")


@query(f"""with o as (select {sql_key("order_id")} as k, min(loaded_at) as first_at, max(strategy) as strategy from paper_orders where {sql_key("order_id")} is not null group by 1)
select reason, count(*) as n from (select case when {sql_key("f.order_id")} is null then '1 no reference' when o.k is null then '2 no order' when o.first_at > f.loaded_at then '3 order came later' when o.strategy is null then '4 no strategy' else '5 joined' end as reason
from paper_fills f left join o on {sql_key("f.order_id")} = o.k) group by reason""")
def join_funnel(spark, at):
    o = table(spark, at, "paper_orders").select(key("order_id").alias("k"), "loaded_at", "strategy").where("k is not null").groupBy("k").agg(F.min("loaded_at").alias("first_at"), F.max("strategy").alias("strategy"), F.lit(True).alias("there"))
    f = table(spark, at, "paper_fills").select(key("order_id").alias("k"), "loaded_at").join(o, "k", "left")
    reason = F.when(F.col("k").isNull(), "1 no reference").when(F.col("there").isNull(), "2 no order").when(F.col("first_at") > F.col("loaded_at"), "3 order came later").when(F.col("strategy").isNull(), "4 no strategy").otherwise("5 joined")
    return f.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SETTLES}, s as (select * from settles where event is not null qualify row_number() over (partition by event order by booked desc, settle_id desc) = 1), {CAPTURES},
c as (select event, arg_min(spot, (t, capture_row)) filter (where spot is not null) as first_spot, arg_max(spot, (t, capture_row)) filter (where spot is not null) as last_spot, count(*) as n from captures where event is not null and t is not null group by event)
select s.event, s.settle_id, s.value, c.first_spot, c.last_spot, c.n from s join c on s.event = c.event""")
def first_last_and_settlement(spark, at):
    s = sets.pick(settles(spark, at).where("event is not null"), ["event"], [F.col("booked"), F.col("settle_id")], ["settle_id", "value"])
    order = F.when(F.col("spot").isNotNull(), F.struct("t", "capture_row"))
    c = captures(spark, at).where("event is not null and t is not null").groupBy("event").agg(F.min_by("spot", order).alias("first_spot"), F.max_by("spot", order).alias("last_spot"), F.count(F.lit(1)).alias("n"))
    return s.join(c, "event")


@query(f"""with {EVENTS}, x as (select cast(floor(t / {HOUR}.0) as bigint) as hour, event_type from ev where t is not null and event_type is not null)
select hour from x group by hour having count(distinct event_type) = (select count(distinct event_type) from x)""")
def hours_with_every_event_type(spark, at):
    x = events(spark, at).where("t is not null and event_type is not null").select(floor_div(F.col("t"), HOUR).alias("hour"), "event_type")
    return sets.complete_periods(x, "hour", "event_type")


@query(f"""with f as (select {sql_key("order_id")} as o, {sql_key("ticker")} as k from paper_fills)
select count(*) as n, count(*) filter (where o in (select {sql_key("order_id")} from paper_orders where {sql_key("order_id")} is not null)) as n_order,
  count(*) filter (where k in (select {sql_key("ticker")} from bracket_markets where {sql_key("ticker")} is not null)) as n_market,
  count(*) filter (where k in (select {sql_key("ticker")} from book_snapshots where {sql_key("ticker")} is not null)) as n_book from f""")
def rows_surviving_each_join(spark, at):
    f = table(spark, at, "paper_fills").select("fill_row", key("order_id").alias("o"), key("ticker").alias("k"))

    def there(name: str, column: str, on: str, flag: str) -> DataFrame:
        return table(spark, at, name).select(key(column).alias(on)).where(f"{on} is not null").distinct().withColumn(flag, F.lit(1))

    j = f.join(there("paper_orders", "order_id", "o", "a"), "o", "left").join(there("bracket_markets", "ticker", "k", "b"), "k", "left").join(there("book_snapshots", "ticker", "k", "c"), "k", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_order"), F.count("b").alias("n_market"), F.count("c").alias("n_book"))


_RUNGS = f"""m as (select {sql_key("event_ticker")} as event, cast(round(floor_strike * 100) as bigint) as lo, cast(round(cap_strike * 100) as bigint) as hi, {sql_key("ticker")} as ticker from bracket_markets
  where {sql_key("event_ticker")} is not null and floor_strike is not null qualify row_number() over (partition by {sql_key("ticker")} order by market_row) = 1)"""


def _rungs(spark, at):
    m = table(spark, at, "bracket_markets").select("market_row", key("ticker").alias("ticker"), key("event_ticker").alias("event"), F.round(F.col("floor_strike") * 100).cast("bigint").alias("lo"), F.round(F.col("cap_strike") * 100).cast("bigint").alias("hi"))
    return sets.pick(m.where("event is not null and lo is not null"), ["ticker"], [F.col("market_row")], ["event", "lo", "hi"], latest=False)


@query(f"""with {_RUNGS}, g as (select event, lo, hi, lead(lo) over (partition by event order by lo, hi, ticker) as next from m)
select event, count(*) as n, count(*) filter (where next is not null and next - hi > 2) as n_gaps, count(*) filter (where next is not null and next <= hi) as n_overlaps from g group by event""")
def ladder_contiguity(spark, at):
    w = Window.partitionBy("event").orderBy("lo", "hi", "ticker")
    g = _rungs(spark, at).withColumn("next", F.lead("lo").over(w))
    return g.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("next") - F.col("hi")) > 2).alias("n_gaps"), F.count_if(F.col("next") <= F.col("hi")).alias("n_overlaps"))


@query(f"""with {_RUNGS}, d as (select distinct event, lo from m), g as (select event, lo - lag(lo) over (partition by event order by lo) as gap from d) select event, {r6("median(gap) / 100.0")} as spacing from g group by event having count(gap) > 0""")
def strike_spacing(spark, at):
    per = _rungs(spark, at).groupBy("event").agg(F.collect_set("lo").alias("s"))  # a ladder has a bounded number of rungs
    return per.select("event", stats.rounded(ladder.spacing(F.col("s")) / 100.0).alias("spacing")).where("spacing is not null")


# --- aggregations


@query(f"""with {BOOKS} select d, venue, count(*) as n, count(*) filter (where bid is null) as n_no_bid, count(*) filter (where ask is null) as n_no_ask, cast(sum(depth) as bigint) as levels, cast(grouping(d) * 2 + grouping(venue) as bigint) as grain
from books group by grouping sets ((), (d), (d, venue))""")
def liquidity_census(spark, at):
    out = books(spark, at).groupingSets([[], ["d"], ["d", "venue"]], "d", "venue")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bid").isNull()).alias("n_no_bid"), F.count_if(F.col("ask").isNull()).alias("n_no_ask"), F.sum("depth").alias("levels"), F.grouping_id().alias("grain"))


@query(f"""with {BOOKS}, x as (select series, (cast(floor(t / {HOUR}.0) as bigint) % 24 + 24) % 24 as hour, bid, ask from books)
select series, hour, count(*) as n, case when count(*) >= 20 then {r6("avg(ask - bid)")} end as mean_spread, case when count(*) < 20 then 'insufficient' else 'ok' end as verdict, cast(grouping(series) * 2 + grouping(hour) as bigint) as grain from x group by cube (series, hour)""")
def anatomy_cube(spark, at):
    x = books(spark, at).select("series", F.pmod(floor_div(F.col("t"), HOUR), F.lit(24)).alias("hour"), (F.col("ask") - F.col("bid")).alias("spread"))
    n = F.count(F.lit(1))
    return x.cube("series", "hour").agg(n.alias("n"), F.when(n >= 20, stats.rounded(F.sum("spread") / F.count("spread"))).alias("mean_spread"), F.when(n < 20, "insufficient").otherwise("ok").alias("verdict"), F.grouping_id().alias("grain"))


@query("""with w as (select limit_price, cast(qty as double) as qty from paper_orders), u as (unpivot w on limit_price, qty into name field value v)
select field, (select count(*) from paper_orders) as n, count(v) as n_known, count(*) filter (where v != 0) as n_nonzero, max(v) as most from u group by field""")
def field_population(spark, at):
    w = table(spark, at, "paper_orders").select("limit_price", F.col("qty").cast("double").alias("qty"))
    u = w.unpivot([], ["limit_price", "qty"], "field", "v")
    return u.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_known"), F.count_if(F.col("v") != 0).alias("n_nonzero"), F.max("v").alias("most"))


@query(f"""with {BOOKS} select series, {r6("quantile_cont(ask - bid, 0.5)")} as p50, {r6("quantile_cont(ask - bid, 0.9)")} as p90 from books where ask - bid is not null group by series""")
def percentiles_linear(spark, at):
    b = books(spark, at).withColumn("spread", F.col("ask") - F.col("bid")).where("spread is not null")
    return b.groupBy("series").agg(stats.rounded(stats.pct_linear("spread", 0.5)).alias("p50"), stats.rounded(stats.pct_linear("spread", 0.9)).alias("p90"))


@query(f"""with {BOOKS}, x as (select series, ask - bid as v, row_number() over (partition by series order by ask - bid) - 1 as r, count(*) over (partition by series) as n from books where ask - bid is not null)
select series, n, v as p90 from x where r = least(n - 1, cast(floor(n * 0.9) as bigint))""")
def percentile_floor_index(spark, at):
    b = books(spark, at).withColumn("spread", F.col("ask") - F.col("bid"))
    return stats.order_statistic(b, ["series"], "spread", stats.floor_index(0.9), "p90")


@query(f"""with {CAPTURES}, x as (select distinct symbol, t from captures where t is not null and symbol is not null), g as (select symbol, t - lag(t) over (partition by symbol order by t) as gap from x),
k as (select symbol, gap, row_number() over (partition by symbol order by gap) - 1 as r, count(*) over (partition by symbol) as n from g where gap is not null)
select symbol, n, gap as upper_median_gap from k where r = cast(floor(n / 2.0) as bigint)""")
def cadence_upper_median(spark, at):
    x = captures(spark, at).where("t is not null and symbol is not null").select("symbol", "t").distinct()
    gaps = sequence.deltas(x, ["symbol"], ["t"], ["t"])
    return stats.order_statistic(gaps, ["symbol"], "d_t", stats.upper_median(), "upper_median_gap")


_BINS = """with x as (select least(cast(floor(cast(round(early_yes_ask * 10000) as bigint) / 500.0) as bigint), 19) as bin, cast(round(early_yes_ask * 10000) as bigint) as p, case when settled_result = 'yes' then 1 when settled_result = 'no' then 0 end as y from bracket_trades where early_yes_ask is not null)"""


@query(f"""{_BINS} select bin, count(*) as n, {r6("sum(p) / 10000.0 / count(*)")} as mean_p, {r6("cast(sum(y) as double) / count(*)")} as rate from x where y is not null group by bin""")
def calibration_bins(spark, at):
    p = tt("early_yes_ask")
    y = F.when(F.col("settled_result") == "yes", 1).when(F.col("settled_result") == "no", 0)
    x = table(spark, at, "bracket_trades").select(p.alias("p"), y.alias("y")).where("p is not null and y is not null")
    n = F.count(F.lit(1))
    return x.groupBy(F.least(floor_div(F.col("p"), 500), F.lit(19)).alias("bin")).agg(n.alias("n"), stats.rounded(F.sum("p") / 10000.0 / n).alias("mean_p"), stats.rounded(F.sum("y").cast("double") / n).alias("rate"))


@query(f"""with {BOOKS}, f as (select *, min(t) over (partition by ticker) as t0 from books), e as (select * from f where t0 >= (select min(d) + 1 from books where d > 0) * {DAY}),
x as (select ticker, case when t - t0 < {HOUR} then '0-1h' when t - t0 < 6 * {HOUR} then '1-6h' when t - t0 < 24 * {HOUR} then '6-24h' else '24h+' end as age, ask - bid as s from e where ask - bid is not null)
select age, count(*) as n, count(distinct ticker) as n_tickers, cast(sum(s) as bigint) as total from x group by age""")
def spread_by_age(spark, at):
    b = books(spark, at)
    first_day = b.where("d > 0").agg((F.min("d") + 1) * DAY).scalar()
    first = b.groupBy("ticker").agg(F.min("t").alias("t0"))
    e = b.join(first, "ticker").where(F.col("t0") >= first_day).withColumn("s", F.col("ask") - F.col("bid")).where("s is not null")
    age = F.col("t") - F.col("t0")
    name = F.when(age < HOUR, "0-1h").when(age < 6 * HOUR, "1-6h").when(age < 24 * HOUR, "6-24h").otherwise("24h+")
    return e.groupBy(name.alias("age")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"), F.sum("s").alias("total"))


@query("""with x as (select user_id, x, row_number() over (partition by user_id order by x, event_id) - 1 as r, count(*) over (partition by user_id) as n from (select user_id, event_id, cast(json_extract_string(props, '$.k') as bigint) as x from events))
select user_id, count(*) filter (where r < n // 3) as n_low, cast(sum(x) filter (where r < n // 3) as bigint) as low, cast(sum(x) filter (where r >= 2 * n // 3) as bigint) as high from x group by user_id""")
def tercile_split(spark, at):
    """Sums of the lowest and highest third of each user's values; equal values are counted before anything is sorted."""
    split = stats.parts(events(spark, at), ["user_id"], "x", F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3))
    low, high = F.col("below") > 0, F.col("above") > 0
    return split.groupBy("user_id").agg(F.sum("below").alias("n_low"), F.sum(F.when(low, F.col("x") * F.col("below"))).alias("low"), F.sum(F.when(high, F.col("x") * F.col("above"))).alias("high"))


@query(f"""with c as (select user_id, event_type, count(*) as n from events group by all), t as (select user_id, sum(n) as n from c group by user_id)
select c.user_id, {r6("sum(cast(c.n as double) * c.n) / (cast(t.n as double) * t.n)")} as hhi from c join t using (user_id) group by c.user_id, t.n""")
def concentration(spark, at):
    c = events(spark, at).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").cast("double")
    return c.groupBy("user_id").agg(stats.rounded(F.sum(F.col("n").cast("double") * F.col("n")) / (n * n)).alias("hhi"))


# --- sequences


@query(f"""with {BOOKS} select snap_id, bid - lag(bid) over w as d_bid, ask - lag(ask) over w as d_ask from books window w as (partition by ticker order by t, snap_id)""")
def deltas(spark, at):
    return sequence.deltas(books(spark, at), ["ticker"], ["t", "snap_id"], ["bid", "ask"]).select("snap_id", "d_bid", "d_ask")


def _corr(x: str, y: str) -> str:
    n, c = f"count({x} + {y})", lambda e: f"cast(sum({e}) filter (where {x} + {y} is not null) as double)"
    vx, vy = f"({n} * {c(f'{x} * {x}')} - {c(x)} * {c(x)})", f"({n} * {c(f'{y} * {y}')} - {c(y)} * {c(y)})"
    return f"case when {vx} > 0 and {vy} > 0 then {r6(f'({n} * {c(f"{x} * {y}")} - {c(x)} * {c(y)}) / sqrt({vx}) / sqrt({vy})')} end"


_STEPS = f"""with {BOOKS}, a as (select ticker, t, snap_id, bid - lag(bid) over w as dx, depth - lag(depth) over w as dy from books window w as (partition by ticker order by t, snap_id)),
s as (select *, lag(dx) over w as px, lag(dy) over w as py from a window w as (partition by ticker order by t, snap_id))"""


@query(f"""{_STEPS} select ticker, count(dx + dy) as n, {_corr("dx", "dy")} as r0, {_corr("px", "dy")} as r_x_leads, {_corr("dx", "py")} as r_y_leads from s group by ticker having count(dx + dy) >= 10""")
def lead_lag_per_ticker(spark, at):
    out = sequence.lead_lag(books(spark, at), ["ticker"], ["t", "snap_id"], "bid", "depth", 10)
    return out.select("ticker", "n", *[stats.rounded(F.col(c)).alias(c) for c in ("r0", "r_x_leads", "r_y_leads")])


@query(f"""{_STEPS}, k as (select ticker from s group by ticker having count(dx + dy) >= 10) select {_corr("dx", "dy")} as r0, {_corr("px", "dy")} as r_x_leads, {_corr("dx", "py")} as r_y_leads, count(dx + dy) as n from s where ticker in (select ticker from k)""")
def lead_lag_pooled(spark, at):
    steps = sequence.lagged_steps(books(spark, at), ["ticker"], ["t", "snap_id"], "bid", "depth")
    enough = steps.groupBy("ticker").agg(F.count(F.col("d_bid") + F.col("d_depth")).alias("m")).where("m >= 10").select("ticker")
    pooled = steps.join(enough, "ticker", "left_semi")
    pairs = (("r0", "d_bid", "d_depth"), ("r_x_leads", "px", "d_depth"), ("r_y_leads", "d_bid", "py"))
    return pooled.agg(*[stats.rounded(sequence.rho(x, y)).alias(n) for n, x, y in pairs], F.count(F.col("d_bid") + F.col("d_depth")).alias("n"))


@query(f"""with {BOOKS}, x as (select series, d, ticker from books group by all), s as (select series, d, lag(d) over (partition by series order by d) as before, lead(d) over (partition by series order by d) as after from (select distinct series, d from x))
select series, d, ticker, 'added' as change from x join s using (series, d) where before is not null and not exists (select 1 from x y where y.series = x.series and y.d = s.before and y.ticker = x.ticker)
union all select series, after as d, ticker, 'removed' from x join s using (series, d) where after is not null and not exists (select 1 from x y where y.series = x.series and y.d = s.after and y.ticker = x.ticker)""")
def membership_changes(spark, at):
    return sequence.membership_changes(books(spark, at), ["series"], "d", "ticker")


@query(f"""with {BOOKS}, a as (select *, coalesce(depth >= 10, false) as hit, coalesce(lead(t) over (partition by ticker order by t, snap_id) - t, 0) as us from books),
b as (select *, sum(case when hit then 0 else 1 end) over (partition by ticker order by t, snap_id) as run from a), c as (select ticker, run, count(*) as n, cast(sum(us) as bigint) as us, min(depth) as depth from b where hit group by ticker, run)
select ticker, cast(run as bigint) as run, n, us as seconds, depth, us >= {HOUR} and depth >= 12 as passes from c""")
def gated_runs(spark, at):
    b = sequence.beside(books(spark, at), ["ticker"], ["t", "snap_id"], ["t"], "next", ahead=True)
    b = b.withColumn("us", F.coalesce(F.col("next.t") - F.col("t"), F.lit(0)))
    return sequence.gated_runs(b, ["ticker"], ["t", "snap_id"], F.col("depth") >= 10, F.col("us"), F.col("depth"), HOUR, 12)


@query(f"""with {BOOKS}, a as (select *, case when lag(1) over w is null or bid is distinct from lag(bid) over w then 1 else 0 end as new from books window w as (partition by ticker order by t, snap_id)),
b as (select *, sum(new) over (partition by ticker order by t, snap_id) as run from a), c as (select ticker, run, count(*) as n from b group by all)
select ticker, count(*) as n_runs, max(n) as longest, {r6("median(n)")} as median_n from c group by ticker""")
def unchanged_streaks(spark, at):
    r = sequence.runs(books(spark, at), ["ticker"], ["t", "snap_id"], F.col("bid"), "t")
    return r.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("longest"), stats.rounded(F.median("n")).alias("median_n"))


@query(f"""with {EVENTS}, p as (select user_id, t, event_id, case when event_type = 'click' then x end as a, case when event_type = 'view' then x end as b from ev),
f as (select user_id, t, event_id, last_value(a ignore nulls) over w as click, last_value(b ignore nulls) over w as view from p window w as (partition by user_id order by t, event_id rows between unbounded preceding and current row))
select event_id, click, view from f where click is not null and view is not null""")
def joint_state(spark, at):
    return sequence.joint_state(events(spark, at), ["user_id"], ["t", "event_id"], "event_type", "x", ["click", "view"]).select("event_id", "click", "view")


@query(f"""with {BOOKS}, s as (select *, lead(t) over w - t as gap, lead(bid) over w - bid as jump, lead(bid, 2) over w - lead(bid) over w as next from books window w as (partition by ticker order by t, snap_id))
select series, count(*) as n, count(*) filter (where sign(next) = -sign(jump)) as n_reversed, cast(sum(next * sign(jump)) as bigint) as signed_next from s where abs(jump) >= 200 and gap <= {int(1.5 * HOUR)} and next is not null and next != 0 group by series""")
def jump_reversals(spark, at):
    s = sequence.beside(books(spark, at), ["ticker"], ["t", "snap_id"], ["t", "bid"], "one", ahead=True)
    s = sequence.beside(s, ["ticker"], ["t", "snap_id"], ["one"], "two", ahead=True)
    s = s.withColumn("gap", F.col("one.t") - F.col("t")).withColumn("jump", F.col("one.bid") - F.col("bid")).withColumn("next", F.col("two.one.bid") - F.col("one.bid"))
    s = s.where((F.abs("jump") >= 200) & (F.col("gap") <= int(1.5 * HOUR)) & (F.col("next") != 0))
    sign = F.signum("jump").cast("bigint")
    return s.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("next").cast("bigint") == -sign).alias("n_reversed"), F.sum(F.col("next") * sign).alias("signed_next"))


@query("""with x as (select distinct cast(floor(epoch_us(o_orderdate) / 86400000000.0) as bigint) as d, o_custkey as c from orders), g as (select c, d, lead(d) over (partition by c order by d) as n from x)
select c, cast(sum(n - d - 1) as bigint) as n_missing, max(n - d - 1) as longest from g where n > d + 1 group by c""")
def missing_order_days(spark, at):
    x = table(spark, at, "orders").select(F.col("o_custkey").alias("c"), floor_div(micros("o_orderdate"), DAY).alias("d"))
    return sequence.missing_periods(x, ["c"], "d").groupBy("c").agg(F.sum("n").alias("n_missing"), F.max("n").alias("longest"))


@query(f"""with {BOOKS}, g as (select ticker, d, lead(d) over (partition by ticker order by d) as next from (select distinct ticker, d from books))
select ticker, d + 1 as first, next - 1 as last, next - d - 1 as n from g where next > d + 1""")
def missing_days(spark, at):
    """Each ticker's gaps in days, however long, as first and last missing day."""
    return sequence.missing_periods(books(spark, at), ["ticker"], "d")


@query(f"""with {EVENTS}, n as (select user_id, t, event_id, event_id // 7 as seq, event_type = 'signup' as snap from ev), g as (select *, lag(seq) over (partition by user_id order by t, event_id) + 1 as expected from n)
select user_id, t, event_id, expected, seq as got, seq - expected as missed from g where not snap and expected is not null and seq != expected""")
def sequence_breaks(spark, at):
    e = events(spark, at).withColumn("seq", F.floor(F.col("event_id") / 7).cast("bigint"))
    return sequence.sequence_gaps(e.select("user_id", "t", "event_id", "seq", "event_type"), ["user_id"], ["t", "event_id"], "seq", F.col("event_type") == "signup")


@query(f"""with {EVENTS}, s as (select user_id, count(*) as n, cast(sum(event_id % 50) as double) as sx, cast(sum(x) as double) as sy, cast(sum((event_id % 50) * (event_id % 50)) as double) as sxx, cast(sum(x * x) as double) as syy, cast(sum(x * (event_id % 50)) as double) as sxy from ev group by user_id having count(*) >= 4),
l as (select e.user_id, event_id, n - 1 as n, sx - event_id % 50 as sx, sy - x as sy, sxx - (event_id % 50) * (event_id % 50) as sxx, syy - x * x as syy, sxy - x * (event_id % 50) as sxy from ev e join s using (user_id)),
r as (select user_id, event_id, (n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy) as r from l where n * sxx - sx * sx > 0 and n * syy - sy * sy > 0)
select user_id, event_id, {r6("r")} as r from r qualify row_number() over (partition by user_id order by round(abs(r), 9), event_id) = 1""")
def weakest_without_one(spark, at):
    e = events(spark, at).withColumn("z", F.pmod("event_id", F.lit(50))).where("x is not null")
    return sequence.leave_one_out(e, ["user_id"], "event_id", "z", "x").withColumn("r", stats.rounded(F.col("r")))


# --- ladders


@query(f"""with {BOOKS}, y as (select snap_id, unnest(yes_bids) as l, generate_subscripts(yes_bids, 1) as i from books), z as (select snap_id, l[1] as p, l[2] as s, lag(l[1]) over (partition by snap_id order by i) as prev from y)
select snap_id, count(*) filter (where p <= 0 or p >= 1) as out_of_range, count(*) filter (where s <= 0) as no_size, count(*) filter (where prev <= p) as not_descending from z group by snap_id""")
def book_faults(spark, at):
    f = books(spark, at).where("size(yes_bids) > 0").select("snap_id", ladder.faults(F.col("yes_bids")).alias("f"))
    return f.select("snap_id", *[F.col(f"f.{c}").cast("bigint").alias(c) for c in ("out_of_range", "no_size", "not_descending")])


@query(f"""with {BOOKS}, y as (select snap_id, bid / 10000.0 as best, unnest(yes_bids) as l from books where bid is not null)
select snap_id, {r6("sum(coalesce(l[2], 0.0)) filter (where l[1] >= best - 0.05 - 0.005)")} as near, {r6("sum(coalesce(l[2], 0.0))")} as everything from y group by snap_id""")
def depth_near_best(spark, at):
    b = books(spark, at).where("bid is not null and size(yes_bids) > 0")
    return b.select("snap_id", stats.rounded(ladder.size_within(F.col("yes_bids"), F.col("bid") / 10000.0, 0.05)).alias("near"), stats.rounded(ladder.total_size(F.col("yes_bids"))).alias("everything"))


@query(f"""with {BOOKS}, y as (select snap_id, list_sum(list_transform(yes_bids, lambda x: x[2])) as a, list_sum(list_transform(no_bids, lambda x: x[2])) as b from books where yes_bids is not null and no_bids is not null)
select snap_id, case when coalesce(a, 0) + coalesce(b, 0) != 0 then {r6("(coalesce(a, 0) - coalesce(b, 0)) / (coalesce(a, 0) + coalesce(b, 0))")} end as imbalance from y""")
def size_imbalance(spark, at):
    b = books(spark, at).where("yes_bids is not null and no_bids is not null")
    return b.select("snap_id", stats.rounded(ladder.imbalance(ladder.total_size(F.col("yes_bids")), ladder.total_size(F.col("no_bids")))).alias("imbalance"))


@query(f"""with {BOOKS}, p as (select snap_id, ticker, yes_bids, lag(yes_bids) over w as prev, bid / 10000.0 as best from books window w as (partition by ticker order by t, snap_id)),
q as (select snap_id, yes_bids, best, u.l[1] as price, sum(u.l[2]) as had from p, unnest(prev) as u(l) where prev is not null and yes_bids is not null and best is not null and u.l[1] >= best - 0.005 group by all)
select snap_id, {r6("sum(greatest(had - coalesce(list_sum(list_transform(list_filter(yes_bids, lambda x: x[1] = price), lambda x: x[2])), 0), 0))")} as departed from q group by snap_id""")
def queue_departures(spark, at):
    b = sequence.beside(books(spark, at), ["ticker"], ["t", "snap_id"], ["yes_bids"], "before").withColumn("prev", F.col("before.yes_bids"))
    b = b.where("prev is not null and yes_bids is not null and bid is not null")
    b = b.where(F.exists("prev", lambda x: ladder.price(x) >= F.col("bid") / 10000.0 - 0.005))
    return b.select("snap_id", stats.rounded(ladder.departures(F.col("prev"), F.col("yes_bids"), F.col("bid") / 10000.0)).alias("departed"))


@query(f"""with {BOOKS}, y as (select snap_id, unnest(no_bids) as l, generate_subscripts(no_bids, 1) as i from books where size_ok), z as (select snap_id, i, l[1] as p, floor(l[2]) as s from y where l[1] >= 0.3),
c as (select snap_id, p, s, sum(s) over (partition by snap_id order by i) - s as before from z) select snap_id, sum(greatest(least(s, 100 - before), 0)) as filled, {r6("sum(greatest(least(s, 100 - before), 0) * p)")} as cost from c group by snap_id""".replace("where size_ok", "where len(no_bids) > 0 and len(list_filter(no_bids, lambda x: x[1] is null or x[2] is null)) = 0"))
def walk_of_a_side(spark, at):
    whole = "size(no_bids) > 0 and not exists(no_bids, x -> x[0] is null or x[1] is null) and exists(no_bids, x -> x[0] >= 0.3)"
    up = F.transform(F.col("no_bids"), lambda x: F.array(-ladder.price(x), ladder.size(x)))  # dearest first: the limit is a floor
    w = ladder.walk(up, F.lit(-0.3), F.lit(100.0))
    return books(spark, at).where(whole).select("snap_id", w["filled"].alias("filled"), stats.rounded(-w["cost"]).alias("cost"))


# --- scalars


@query(rf"""select trade_row, regexp_extract(k, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{4}})-([BT])(\d+(?:\.\d+)?)$', 1) as series, regexp_extract(k, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{4}})-([BT])(\d+(?:\.\d+)?)$', 3) as side,
cast(regexp_extract(k, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{4}})-([BT])(\d+(?:\.\d+)?)$', 4) as double) as strike from (select trade_row, {sql_key("bracket_ticker")} as k from bracket_trades) where regexp_matches(k, '^([A-Z0-9]+)-(\d{{2}}[A-Z]{{3}}\d{{4}})-([BT])(\d+(?:\.\d+)?)$')""")
def ticker_grammar(spark, at):
    t = table(spark, at, "bracket_trades").select("trade_row", tickers.bracket(key("bracket_ticker")).alias("b")).where("b is not null")
    return t.select("trade_row", "b.series", "b.side", "b.strike")


@query(rf"""with k as (select settle_id, regexp_extract({sql_key("event_ticker")}, '-(\d{{2}}[A-Z]{{3}}\d{{4}})$', 1) as tok from hour_settles)
select settle_id, epoch_us(timezone('America/New_York', strptime('20' || left(tok, 2) || substr(tok, 3, 1) || lower(substr(tok, 4, 2)) || substr(tok, 6), '%Y%b%d%H'))) as hour_us from k where tok != ''""")
def hour_tokens(spark, at):
    token = F.regexp_extract(key("event_ticker"), r"-(\d{2}[A-Z]{3}\d{4})$", 1)
    return table(spark, at, "hour_settles").select("settle_id", tickers.hour_token_micros(token).alias("hour_us")).where("hour_us is not null")


@query(f"""select capture_row, {sql_iso_micros("captured_at")} as t from hour_captures where captured_at is not null""")
def instants(spark, at):
    return table(spark, at, "hour_captures").where("captured_at is not null").select("capture_row", iso_micros("captured_at").alias("t"))


@query("""select order_row, case when regexp_matches(j, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') then cast(trim(j) as double) end as v from (select order_row, case order_row % 5 when 0 then ' ' || limit_price || ' ' when 1 then 'n/a' when 2 then '' when 3 then 'NaN' else cast(qty as varchar) end as j from paper_orders)""")
def numbers_as_text(spark, at):
    m = F.pmod("order_row", F.lit(5))
    text = F.when(m == 0, F.concat(F.lit(" "), F.col("limit_price").cast("string"), F.lit(" "))).when(m == 1, "n/a").when(m == 2, "").when(m == 3, "NaN").otherwise(F.col("qty").cast("string"))
    return table(spark, at, "paper_orders").select("order_row", tickers.number(text).alias("v"))


@query(f"""with {EVENTS} select event_id, case when v >= 1000000000000 then v * 1000 when v >= 1000000000 then v * 1000000 end as us from (select event_id, case event_id % 3 when 0 then t // 1000 when 1 then t // 1000000 else event_id end as v from ev)""")
def epoch_units(spark, at):
    m = F.pmod("event_id", F.lit(3))
    v = F.when(m == 0, floor_div(F.col("t"), 1000)).when(m == 1, floor_div(F.col("t"), 1_000_000)).otherwise(F.col("event_id"))
    return events(spark, at).select("event_id", tickers.epoch_micros(v).alias("us"))


@query("""select doc_id, left(sha256(coalesce(lower(trim(source)), '') || '|' || coalesce(lower(lang), '')), 12) as pattern_id from documents""")
def pattern_ids(spark, at):
    text = F.concat(F.coalesce(F.lower(F.trim("source")), F.lit("")), F.lit("|"), F.coalesce(F.lower("lang"), F.lit("")))
    return table(spark, at, "documents").select("doc_id", F.substring(F.sha2(text, 256), 1, 12).alias("pattern_id"))


# --- statistics


@query(f"""with {BOOKS}, x as (select d, ticker, median(ask - bid) as v from books where ask - bid is not null group by all), m as (select d, median(v) as m from x group by d), a as (select d, median(abs(v - m)) as mad from x join m using (d) group by d),
z as (select d, ticker, {r6("(v - m) / greatest(mad * 1.4826, 1.0)")} as z from x join m using (d) join a using (d))
select d, ticker, z, row_number() over (partition by d order by abs(z) desc, ticker) as rank from z qualify rank <= 10""")
def outliers_per_day(spark, at):
    x = books(spark, at).withColumn("s", F.col("ask") - F.col("bid")).where("s is not null").groupBy("d", "ticker").agg(F.median("s").alias("v"))
    z = stats.robust_z(x, ["d"], "v", 1.0).select("d", "ticker", stats.rounded(F.col("z")).alias("z"))
    return sets.top_k(z, ["d"], [F.abs("z").desc(), F.col("ticker")], 10).withColumn("rank", F.col("rank").cast("bigint"))


_P = f"""with {EVENTS}, p as (select user_id, cast((user_id * 7919 % 1000) * (user_id * 7919 % 1000) as double) / 1000000.0 as p from ev group by user_id)"""


@query(f"""{_P}, r as (select *, count(*) over (order by p) as upto, count(*) over () as n from p), l as (select max(p) as lim from r where p <= upto * 0.1 / n) select user_id, p, coalesce(p <= lim, false) as kept from p, l""")
def false_discovery(spark, at):
    m = F.pmod(F.col("user_id") * 7919, F.lit(1000))
    p = events(spark, at).select("user_id").distinct().select("user_id", ((m * m).cast("double") / 1_000_000.0).alias("p"))
    return stats.benjamini_hochberg(p, "p", 0.1)


_VALUES = "v as (select user_id as u, cast(json_extract_string(props, '$.k') as bigint) - 50 as y from events)"


@query(f"""with {_VALUES}, per as (select u, sum(y) as s, count(*) as c, row_number() over (order by u) - 1 as i from v group by u), n as (select count(*) as n from per),
draws as (select b, {bootstrap.sql_drawn("b", "i", "n.n")} as k from per, n, range({bootstrap.SAMPLES}) as t(b)),
means as (select b, sum(s)::double / sum(c) as mean from draws join per on per.i = draws.k group by b), r as (select mean, row_number() over (order by mean) - 1 as r from means)
select (select n from n) as n_units, cast((select sum(y) from v) as bigint) as total, (select count(*) from v) as n, {r6("(select mean from r where r = 250)")} as low, {r6("(select mean from r where r = 9750)")} as high""")
def bootstrap_interval(spark, at):
    v = events(spark, at).select(F.col("user_id").alias("u"), (F.col("x") - 50).alias("y"))
    out = bootstrap.cluster_bootstrap(v, "u", "y")
    return out.select("n_units", "total", "n", stats.rounded(F.col("low")).alias("low"), stats.rounded(F.col("high")).alias("high"))


@query(f"""with {_VALUES}, per as (select u, sum(y) as s from v group by u), p as (select sum(s) as p from per)
select count(*) as n_units, case when any_value(p) != 0 then count(*) filter (where sign(s) = -sign(p)) else least(count(*) filter (where s > 0), count(*) filter (where s < 0)) end as n_opposite,
concat_ws('; ', case when count(*) < 10 then 'too few units' end, case when (case when any_value(p) != 0 then count(*) filter (where sign(s) = -sign(p)) else least(count(*) filter (where s > 0), count(*) filter (where s < 0)) end) < 1 then 'no unit against the pooled sign' end) as reasons from per, p""")
def admissibility(spark, at):
    v = events(spark, at).select(F.col("user_id").alias("u"), (F.col("x") - 50).alias("y"))
    return bootstrap.admissible(v, "u", "y")


# --- quality


_CHECKS = f"""case when {sql_key("capture_id")} is null then 'capture_id' end, case when {sql_hash_key("raw_sha256")} is null then 'raw_sha256' end, case when not coalesce({sql_iso_micros("event_time")} is not null, false) then 'event_time' end,
case when not coalesce(n_with_book <= n_markets, false) then 'n_with_book' end, case when not coalesce(completeness_ok = (n_markets >= expected_markets), false) then 'completeness' end"""


@query(f"""select delivery_id, concat_ws(',', {_CHECKS}) as errors from capture_manifests where concat_ws(',', {_CHECKS}) != ''""")
def record_errors(spark, at):
    checks = {"capture_id": key("capture_id").isNotNull(), "raw_sha256": hash_key("raw_sha256").isNotNull(), "event_time": iso_micros("event_time").isNotNull(), "n_with_book": F.col("n_with_book") <= F.col("n_markets"), "completeness": F.col("completeness_ok") == (F.col("n_markets") >= F.col("expected_markets"))}
    out = table(spark, at, "capture_manifests").select("delivery_id", F.array_join(quality.errors(checks), ",").alias("errors"))
    return out.where("errors != ''")


@query("""select 'bracket_trades' as tbl, * from (select 'ask_in_range' as invariant, count(*) filter (where not (early_yes_ask between 0 and 1)) as n_violations, count(*) as n_rows from bracket_trades
union all select 'settled_agrees', count(*) filter (where settled_no != (settled_result = 'no')), count(*) from bracket_trades union all select 'pnl_has_tag', count(*) filter (where not (realized_pnl is null or settlement_source_tag is not null)), count(*) from bracket_trades)""")
def table_invariants(spark, at):
    rules = {"ask_in_range": F.col("early_yes_ask").between(0, 1), "settled_agrees": F.col("settled_no") == (F.col("settled_result") == "no"), "pnl_has_tag": F.col("realized_pnl").isNull() | F.col("settlement_source_tag").isNotNull()}
    return quality.violations(table(spark, at, "bracket_trades"), "bracket_trades", rules)


@query(f"""with {SETTLES}, {CAPTURES}, a as (select event, max(value) as v from settles where event is not null group by event), b as (select event, max(spot) as v from captures where event is not null group by event), c as (select event, min(spot) as v from captures where event is not null group by event)
select event, a.v as settled, b.v as high, c.v as low, case when (a.v is not null)::int + (b.v is not null)::int + (c.v is not null)::int >= 2 then greatest(a.v, b.v, c.v) - least(a.v, b.v, c.v) end as spread,
case when (a.v is not null)::int + (b.v is not null)::int + (c.v is not null)::int < 2 then 'unverifiable' when greatest(a.v, b.v, c.v) - least(a.v, b.v, c.v) <= 5000 then 'clean' else 'dirty' end as verdict from a full join b using (event) full join c using (event)""")
def three_sources(spark, at):
    c = captures(spark, at).where("event is not null").groupBy("event")
    sources = {"settled": settles(spark, at).where("event is not null").groupBy("event").agg(F.max("value").alias("v")), "high": c.agg(F.max("spot").alias("v")), "low": c.agg(F.min("spot").alias("v"))}
    return quality.reconcile(sources, ["event"], "v", 5000)


_NOW = 1_780_444_800_000_000  # 2026-06-03T00:00Z


@query(f"""with {CAPTURES}, f as (select symbol, capture_id, min(t) as first, max(t) as last from captures where t <= {_NOW} group by all)
select symbol, count(*) filter (where first > {_NOW - DAY}) as n_captures, 288 as expected, {r6(f"count(*) filter (where first > {_NOW - DAY}) / 288.0")} as ratio, {_NOW} - max(last) as age_us, {_NOW} - max(last) > 600000000 as stale, count(*) filter (where first > {_NOW - DAY}) / 288.0 < 0.8 as thin from f group by symbol""".replace("288 as expected", "cast(288 as bigint) as expected"))
def family_health(spark, at):
    out = quality.family_health(captures(spark, at), "symbol", "t", "capture_id", F.lit(_NOW), DAY, 300_000_000)
    return out.withColumn("ratio", stats.rounded(F.col("ratio")))


@query(f"""with {EVENTS}, d as (select user_id, cast(floor(t / {DAY}.0) as bigint) as d, bool_or(x >= 90) as hit from ev group by all), l as (select user_id, max(d) filter (where hit) as last from d group by user_id),
s as (select user_id, count(*) filter (where hit) as hit_days, count(*) filter (where not hit and d > last) as misses, last as last_seen from d join l using (user_id) where last is not null group by user_id, last)
select *, case when misses >= 5 then 'expired' when hit_days >= 3 then 'candidate' else 'observed' end as status from s""")
def pattern_states(spark, at):
    d = events(spark, at).select("user_id", floor_div(F.col("t"), DAY).alias("d"), (F.col("x") >= 90).alias("hit"))
    return quality.streak_ledger(d, "user_id", "d", "hit")


@query()
def position_replay(spark, at):
    """Open positions folded from fills in the order of arrival; tested against a plain loop."""
    f = table(spark, at, "paper_fills").select(key("ticker").alias("ticker"), "loaded_at", "fill_row", (F.lower(F.trim("action")) == "buy").alias("is_buy"), "qty", "price")
    return fold.positions(f, "ticker", ["loaded_at", "fill_row"], "is_buy", "qty", "price")
