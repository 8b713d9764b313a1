"""Queries of censuses, persistence and monitoring, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import ladder, stats, tickers
from tapeloom.functions.keys import key, sql_key
from tapeloom.functions.times import climate_day, floor_div, iso_micros, sql_iso_micros
from tapeloom.operators import asof, forecast, quality, sequence, sets
from tapeloom.plans.reference import BOOKS, CAPTURES, DAY, EVENTS, HOUR, books, captures, events, r6
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


@query(f"""with {CAPTURES} select symbol, cast(floor((t - 5 * {HOUR}) / {DAY}.0) as bigint) as day, count(*) as n from captures where symbol is not null and t is not null group by all""")
def captures_per_climate_day(spark, at):
    c = captures(spark, at).where("symbol is not null and t is not null")
    return c.groupBy("symbol", climate_day(F.col("t"), "America/New_York").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with m as (select {sql_key("ticker")} as ticker, {sql_key("event_ticker")} as event, cast(round(floor_strike * 100) as bigint) as lo, cast(round(cap_strike * 100) as bigint) as hi from bracket_markets
  where {sql_key("ticker")} is not null and lower(strike_type) = 'between' and floor_strike is not null and cap_strike is not null qualify row_number() over (partition by {sql_key("ticker")} order by market_row) = 1),
t as (select {sql_key("bracket_ticker")} as ticker, max(cast(round(early_yes_ask * 10000) as bigint)) as ask from bracket_trades group by 1)
select event, {r6("cast(sum(ask * (lo + hi)) as double) / (2 * sum(ask)) / 100.0")} as level from m join t using (ticker) where event is not null and ask is not null group by event having sum(ask) > 0""")
def implied_levels(spark, at):
    """The level a ladder implies: its rungs' middles weighted by their asks."""
    strike = lambda c: F.round(F.col(c) * 100).cast("bigint")
    m = table(spark, at, "bracket_markets").select(key("ticker").alias("ticker"), key("event_ticker").alias("event"), F.lower("strike_type").alias("k"), strike("floor_strike").alias("lo"), strike("cap_strike").alias("hi"), "market_row")
    m = m.where("ticker is not null and k = 'between' and lo is not null and hi is not null").groupBy("ticker").agg(F.min_by(F.struct("event", "lo", "hi"), "market_row").alias("x")).select("ticker", "x.event", "x.lo", "x.hi")
    t = table(spark, at, "bracket_trades").select(key("bracket_ticker").alias("ticker"), F.round(F.col("early_yes_ask") * 10_000).cast("bigint").alias("ask")).groupBy("ticker").agg(F.max("ask").alias("ask"))
    x = m.join(t, "ticker").where("event is not null and ask is not null").groupBy("event").agg(F.sum(F.col("ask") * (F.col("lo") + F.col("hi"))).alias("s"), F.sum("ask").alias("w")).where("w > 0")
    return x.select("event", stats.rounded(F.col("s").cast("double") / (2 * F.col("w")) / 100.0).alias("level"))


@query(f"""with {BOOKS}, f as (select series, ask - bid as s, t - min(t) over (partition by ticker) as age from books), b as (select series, cast(floor(age / {6 * HOUR}.0) as bigint) as bin, cast(sum(s) as double) / count(s) as m from f where s is not null and s > 0 group by all),
r as (select series, count(*) as n, regr_slope(ln(m), bin) as slope from b group by series having count(*) >= 3) select series, n, case when slope < -0.0001 then {r6("ln(2) / -slope")} end as half_life from r""")
def spread_half_life(spark, at):
    b = books(spark, at)
    first = b.groupBy("ticker").agg(F.min("t").alias("t0"))
    x = b.join(first, "ticker").withColumn("s", F.col("ask") - F.col("bid")).where("s > 0")
    bins = x.groupBy("series", floor_div(F.col("t") - F.col("t0"), 6 * HOUR).alias("bin")).agg((F.sum("s").cast("double") / F.count("s")).alias("m"))
    r = bins.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.log("m"), F.col("bin").cast("double")).alias("slope")).where("n >= 3")
    return r.select("series", "n", F.when(F.col("slope") < -0.0001, stats.rounded(F.log(F.lit(2.0)) / -F.col("slope"))).alias("half_life"))


@query(f"""with {BOOKS}, d as (select distinct series, bid as v from books where bid > 0), g as (select series, v - lag(v) over (partition by series order by v) as gap from d) select series, min(gap) as tick, count(*) as n from g group by series""")
def tick_sizes(spark, at):
    """The smallest gap between the prices a series has."""
    d = books(spark, at).where("bid > 0").select("series", F.col("bid").alias("v")).distinct()
    return sequence.deltas(d, ["series"], ["v"], ["v"]).groupBy("series").agg(F.min("d_v").alias("tick"), F.count(F.lit(1)).alias("n"))


@query(f"""with {EVENTS}, h as (select event_type, cast(floor(t / {HOUR}.0) as bigint) as hour, count(*) as n from ev where event_type is not null and t is not null group by all),
j as (select p.event_type, p.hour, list(h.n order by h.hour) as l from h p join h on p.event_type = h.event_type and h.hour between p.hour - 7 and p.hour group by all)
select event_type, hour, {r6("list_aggregate(list_transform(l, lambda x: 1 + x / 1000.0::double), 'product') - 1")} as compound from j where len(l) = 8""")
def compound_of_eight_hours(spark, at):
    """The compounded growth over eight full hours, in their order."""
    h = events(spark, at).where("event_type is not null and t is not null").groupBy("event_type", floor_div(F.col("t"), HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("m"))
    spread = h.select("event_type", "m", F.col("hour").alias("own"), F.explode(F.sequence(F.col("hour"), F.col("hour") + 7)).alias("hour"))
    eight = spread.join(h.select("event_type", "hour"), ["event_type", "hour"]).groupBy("event_type", "hour").agg(F.array_sort(F.collect_list(F.struct("own", "m"))).alias("l")).where(F.size("l") == 8)  # eight at most
    return eight.select("event_type", "hour", stats.rounded(F.aggregate("l", F.lit(1.0), lambda a, x: a * (1 + x["m"] / F.lit(1000.0))) - 1).alias("compound"))


_PAIRS = f"""with {BOOKS}, p as (select series, ask - bid <= 200 as tight, bid is not distinct from lag(bid) over w and ask is not distinct from lag(ask) over w and lag(1) over w is not null as frozen, lag(1) over w is null as first,
  lead(ask - bid) over w <= 200 as next_tight, lead(1) over w is not null as more, ask - bid as s from books window w as (partition by ticker order by t, snap_id))"""


def _neighbours(spark, at):
    b = books(spark, at).withColumn("s", F.col("ask") - F.col("bid"))
    x = sequence.beside(sequence.beside(b, ["ticker"], ["t", "snap_id"], ["bid", "ask"], "before"), ["ticker"], ["t", "snap_id"], ["s"], "next", ahead=True)
    first = F.col("before").isNull()
    return x.withColumn("first", first).withColumn("frozen", ~first & F.col("bid").eqNullSafe(F.col("before.bid")) & F.col("ask").eqNullSafe(F.col("before.ask")))


@query(f"""{_PAIRS} select series, frozen, count(*) as n, count(*) filter (where next_tight) as n_survived from p where tight and more group by series, frozen""")
def tightness_survives(spark, at):
    x = _neighbours(spark, at).where((F.col("s") <= 200) & F.col("next").isNotNull())
    return x.groupBy("series", "frozen").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("next.s") <= 200).alias("n_survived"))


@query(f"""{_PAIRS} select series, count(s) as n_all, cast(sum(s) as bigint) as total_all, count(s) filter (where not frozen and not first) as n_moved, cast(coalesce(sum(s) filter (where not frozen and not first), 0) as bigint) as total_moved from p group by series""")
def moved_against_all(spark, at):
    moved = ~F.col("frozen") & ~F.col("first")
    return _neighbours(spark, at).groupBy("series").agg(F.count("s").alias("n_all"), F.sum("s").alias("total_all"), F.count(F.when(moved, F.col("s"))).alias("n_moved"), F.coalesce(F.sum(F.when(moved, F.col("s"))), F.lit(0)).alias("total_moved"))


@query(f"""with {BOOKS} select case when s <= 100 then '1' when s <= 300 then '2-3' when s <= 1000 then '4-10' else '11+' end as cents, count(*) as n, count(distinct ticker) as n_tickers from (select ask - bid as s, ticker from books) where s is not null group by 1""")
def spread_histogram(spark, at):
    s = F.col("ask") - F.col("bid")
    x = books(spark, at).withColumn("s", s).where("s is not null")
    return x.groupBy(F.when(F.col("s") <= 100, "1").when(F.col("s") <= 300, "2-3").when(F.col("s") <= 1000, "4-10").otherwise("11+").alias("cents")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"))


@query(f"""with {BOOKS}, j as (select ticker, abs(bid - lag(bid) over (partition by ticker order by t, snap_id)) as jump from books) select x as threshold, count(*) as n, count(distinct ticker) as n_tickers from j, unnest([100, 200, 300, 500, 1000]) as u(x) where jump >= x group by x""")
def jump_sweep(spark, at):
    """Jumps by threshold, each counted once under the largest threshold it reaches and summed up from there."""
    j = sequence.deltas(books(spark, at), ["ticker"], ["t", "snap_id"], ["bid"]).withColumn("jump", F.abs("d_bid")).where("jump >= 100")
    reached = F.explode(F.filter(F.array(*[F.lit(x) for x in (100, 200, 300, 500, 1000)]), lambda x: x <= F.col("jump")))
    return j.select("ticker", reached.alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"))


@query(f"""with {CAPTURES}, d as (select symbol, cast(floor(t / {DAY}.0) as bigint) as d, count(distinct capture_id) as n from captures where t is not null and symbol is not null group by all) select symbol, d, n, n < 0.8 * max(n) over (partition by symbol) as thin from d""")
def thin_days(spark, at):
    d = captures(spark, at).where("t is not null and symbol is not null").groupBy("symbol", floor_div(F.col("t"), DAY).alias("d")).agg(F.count_distinct("capture_id").alias("n"))
    most = d.groupBy("symbol").agg(F.max("n").alias("most"))
    return d.join(most, "symbol").select("symbol", "d", "n", (F.col("n") < 0.8 * F.col("most")).alias("thin"))


@query(f"""with {CAPTURES}, b as (select symbol, case when (cast(floor(t / 60000000.0) as bigint) % 60 + 60) % 60 between 20 and 29 then 'a' when (cast(floor(t / 60000000.0) as bigint) % 60 + 60) % 60 between 50 and 59 then 'b' else 'other' end as bucket from captures where t is not null and symbol is not null),
c as (select symbol, count(*) filter (where bucket = 'a') as a, count(*) filter (where bucket = 'b') as b, count(*) filter (where bucket = 'other') as other from b group by symbol)
select *, case when a = 0 and b > 0 then 'a silent' when b = 0 and a > 0 then 'b silent' when a = 0 and b = 0 then 'both silent' else 'ok' end as verdict from c""")
def silent_collectors(spark, at):
    minute = F.pmod(floor_div(F.col("t"), 60_000_000), F.lit(60))
    c = captures(spark, at).where("t is not null and symbol is not null").groupBy("symbol").agg(F.count_if(minute.between(20, 29)).alias("a"), F.count_if(minute.between(50, 59)).alias("b"), F.count_if(~minute.between(20, 29) & ~minute.between(50, 59)).alias("other"))
    verdict = F.when((F.col("a") == 0) & (F.col("b") > 0), "a silent").when((F.col("b") == 0) & (F.col("a") > 0), "b silent").when((F.col("a") == 0) & (F.col("b") == 0), "both silent").otherwise("ok")
    return c.withColumn("verdict", verdict)


@query("""select file_name, count(*) as n, count(*) filter (where payload is null or trim(payload) = '') as n_empty, count(*) filter (where starts_with(payload, '<<<<<<<') or starts_with(payload, '>>>>>>>') or starts_with(payload, '=======')) as n_conflict,
bool_and(regexp_matches(file_name, '^[a-z_]+/(lane-[0-9]+/)?dt=[0-9]{4}-[0-9]{2}-[0-9]{2}\\.jsonl$')) as well_shaped from ledger_lines group by file_name""")
def file_shapes(spark, at):
    shaped = F.col("file_name").rlike(r"^[a-z_]+/(lane-[0-9]+/)?dt=[0-9]{4}-[0-9]{2}-[0-9]{2}\.jsonl$")
    conflict = F.col("payload").rlike(r"^(<<<<<<<|>>>>>>>|=======)")
    return table(spark, at, "ledger_lines").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("payload").isNull() | (F.trim("payload") == "")).alias("n_empty"), F.count_if(conflict).alias("n_conflict"), F.bool_and(shaped).alias("well_shaped"))


@query(f"""with {BOOKS}, {CAPTURES}, b as (select snap_id, substr(series, 3) as k, t from books), c as (select symbol as k, t, min(capture_row) as id from captures where symbol is not null and t is not null group by all),
j as (select b.snap_id, b.k, c.t as ct, b.t from b asof join c on b.k = c.k and b.t >= c.t) select b.k as symbol, count(*) as n, count(*) filter (where j.t - j.ct <= {HOUR}) as n_matched from b left join j using (snap_id) group by b.k""")
def matched_within_an_hour(spark, at):
    """Readings per symbol, and those with a spot capture in the hour before."""
    b = books(spark, at).select("snap_id", F.substring("series", 3, 99).alias("k"), "t")
    c = captures(spark, at).select(F.col("symbol").alias("k"), "t", F.col("capture_row").alias("id"))
    found = asof.asof(b.withColumnRenamed("snap_id", "id"), c, tolerance_us=HOUR).select(F.col("left_id").alias("snap_id"), F.lit(1).alias("hit"))
    return b.join(found, "snap_id", "left").groupBy(F.col("k").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_matched"))


@query(f"""with a as (select delivery_id, {sql_iso_micros("event_time")} as e, {sql_iso_micros("as_of")} as k, {sql_iso_micros("captured_at")} as c from capture_manifests)
select e is null as no_event, k is null as no_as_of, k > c as late, count(*) as n, cast(max(k - e) as bigint) as longest from a group by all""")
def knowledge_lags(spark, at):
    """How long after its event a manifest became known."""
    a = table(spark, at, "capture_manifests").select(iso_micros("event_time").alias("e"), iso_micros("as_of").alias("k"), iso_micros("captured_at").alias("c"))
    return a.groupBy(F.col("e").isNull().alias("no_event"), F.col("k").isNull().alias("no_as_of"), (F.col("k") > F.col("c")).alias("late")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("k") - F.col("e")).alias("longest"))


@query()
def calibrated_forecasts(spark, at):
    """Per symbol, the bias and spread that calibrate an hour's mean and variance as a forecast of the next hour's last spot; tested on synthetic samples."""
    c = captures(spark, at).where("symbol is not null and t is not null and spot is not null").withColumn("hour", floor_div(F.col("t"), HOUR))
    h = c.groupBy("symbol", "hour").agg(F.avg("spot").alias("mean"), F.coalesce(F.var_samp("spot"), F.lit(0.0)).alias("v"), F.max_by("spot", F.struct("t", "capture_row")).alias("last"))
    before = h.select("symbol", (F.col("hour") + 1).alias("hour"), "mean", "v")
    return forecast.fit_spread(h.select("symbol", "hour", F.col("last").alias("y")).join(before, ["symbol", "hour"]), ["symbol"], "y", "mean", "v")


@query("""select market_row, floor((case when lower(strike_type) = 'between' then (floor_strike + cap_strike) / 2 else coalesce(floor_strike, cap_strike) end) * 1000000 + 0.5) / 1000000.0 as coordinate from bracket_markets where strike_type is not null""")
def rung_coordinates(spark, at):
    m = table(spark, at, "bracket_markets").where("strike_type is not null")
    return m.select("market_row", stats.rounded(ladder.coordinate(F.lower("strike_type"), F.col("floor_strike"), F.col("cap_strike"))).alias("coordinate"))


@query(f"""with {BOOKS}, y as (select snap_id, unnest(no_bids) as l, generate_subscripts(no_bids, 1) as i from books) select snap_id, cast(i as integer) as level, 10000 - cast(round(l[1] * 10000) as bigint) as price_tt from y where l[1] is not null""")
def complement_ladder(spark, at):
    c = books(spark, at).select("snap_id", F.posexplode(ladder.complement(F.col("no_bids"))).alias("i", "l"))
    return c.select("snap_id", (F.col("i") + 1).alias("level"), F.round(ladder.price(F.col("l")) * 10_000).cast("bigint").alias("price_tt")).where("price_tt is not null")


@query(f"""with {BOOKS}, l as (select * from books qualify row_number() over (partition by ticker, d order by t desc, snap_id desc) = 1) select event, d, count(*) as n, bool_and(coalesce(bid > 0 and ask < 10000, false)) as executable from l group by event, d""")
def whole_ladders(spark, at):
    """Whether every member of an event had both sides at its last reading of the day."""
    last = sets.pick(books(spark, at), ["ticker", "d"], [F.col("t"), F.col("snap_id")], ["event", "bid", "ask"])
    return last.groupBy("event", "d").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce((F.col("bid") > 0) & (F.col("ask") < 10_000), F.lit(False))).alias("executable"))


@query("""select case when contains(lower(strategy), 'maker') then 'making' when contains(lower(strategy), 'fade') then 'fading' when contains(lower(strategy), 'lag') then 'timing' else 'other' end as category, count(*) as n from paper_orders where strategy is not null group by 1""")
def strategy_categories(spark, at):
    o = table(spark, at, "paper_orders").where("strategy is not null")
    return o.groupBy(tickers.first_rule(F.col("strategy"), {"maker": "making", "fade": "fading", "lag": "timing"}, "other").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""select fill_row, coalesce(list_position(caveats, 'no_queue_model'), 0)::bigint as place, caveats[1] as first from paper_fills where caveats is not null""")
def places_in_arrays(spark, at):
    f = table(spark, at, "paper_fills").where("caveats is not null")
    return f.select("fill_row", F.array_position("caveats", "no_queue_model").alias("place"), F.get("caveats", F.lit(0)).alias("first"))


@query(f"""with {BOOKS}, p as (select series, d, cast(sum(ask - bid) as bigint) as s, count(ask - bid) as c from books group by all), t as (select series, sum(s) as s, sum(c) as c from p where c > 0 group by series)
select p.series, p.d, {r6("cast(t.s - p.s as double) / (t.c - p.c)")} as others from p join t using (series) where p.c > 0 and t.c > p.c""")
def leave_one_day_out(spark, at):
    """Each day's mean of all other days of its series, from sums; days are not paired."""
    p = books(spark, at).withColumn("s", F.col("ask") - F.col("bid")).groupBy("series", "d").agg(F.sum("s").alias("s"), F.count("s").alias("c")).where("c > 0")
    t = p.groupBy("series").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    return p.join(t, "series").where("tc > c").select("series", "d", stats.rounded((F.col("ts") - F.col("s")).cast("double") / (F.col("tc") - F.col("c"))).alias("others"))


@query(f"""with u as (select 'fills' as probe, {sql_key("ticker")} as unit, cast(round(price * 10000) as bigint) as v from paper_fills union all select 'trades', {sql_key("bracket_ticker")}, cast(round(entry_no_ask * 10000) as bigint) from bracket_trades)
select probe, unit, count(v) as n, cast(sum(v) as bigint) as total from u where unit is not null and v is not null group by all""")
def units_of_two_probes(spark, at):
    value = lambda c: F.round(F.col(c) * 10_000).cast("bigint").alias("v")
    fills = table(spark, at, "paper_fills").select(F.lit("fills").alias("probe"), key("ticker").alias("unit"), value("price"))
    trades = table(spark, at, "bracket_trades").select(F.lit("trades").alias("probe"), key("bracket_ticker").alias("unit"), value("entry_no_ask"))
    return fills.unionByName(trades).where("unit is not null and v is not null").groupBy("probe", "unit").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query(f"""with {BOOKS} select event, max(t) as closes, min(t) as opens, count(distinct ticker) as n_tickers from books group by event""")
def group_spans(spark, at):
    return books(spark, at).groupBy("event").agg(F.max("t").alias("closes"), F.min("t").alias("opens"), F.count_distinct("ticker").alias("n_tickers"))


@query("""with e as (select unnest([case when limit_price is null then 'no limit' end, case when qty is null or qty <= 0 then 'no quantity' end, case when strategy is null then 'no strategy' end, case when trim(event_ticker) = '' or event_ticker is null then 'no event' end]) as reason from paper_orders) select reason, count(*) as n from e where reason is not null group by reason""")
def reasons_dropped(spark, at):
    checks = {"no limit": F.col("limit_price").isNotNull(), "no quantity": F.col("qty") > 0, "no strategy": F.col("strategy").isNotNull(), "no event": key("event_ticker").isNotNull()}
    return table(spark, at, "paper_orders").select(F.explode(quality.errors(checks)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
