"""Queries of ordering checks, scored matches, rounds and further statistics, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import stats, tickers
from tapeloom.functions.keys import key, sql_key
from tapeloom.functions.times import floor_div, iso_micros, micros, sql_iso_micros
from tapeloom.operators import asof, bootstrap, matching, nested, sequence, sets
from tapeloom.plans.reference import BOOKS, CAPTURES, DAY, HOUR, SETTLES, books, captures, r6, settles, tt
from tapeloom.session import written
from tapeloom.sources import tape
from tapeloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
FIVE = 300_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- orders of ladders

_QUOTED = f"""m as (select {sql_key("ticker")} as ticker, {sql_key("event_ticker")} as event, {sql_key("symbol")} as symbol, cast(round(floor_strike * 100) as bigint) as lo from bracket_markets
  where {sql_key("ticker")} is not null and {sql_key("event_ticker")} is not null and floor_strike is not null qualify row_number() over (partition by {sql_key("ticker")} order by market_row) = 1),
t as (select {sql_key("bracket_ticker")} as ticker, min(cast(round(early_yes_ask * 10000) as bigint)) as ask, min(cast(round(entry_no_ask * 10000) as bigint)) as no_ask from bracket_trades group by 1),
q as (select m.*, t.ask, t.no_ask from m join t using (ticker) where ask is not null and no_ask is not null)"""


def _quoted(spark, at):
    m = table(spark, at, "bracket_markets").select("market_row", key("ticker").alias("ticker"), key("event_ticker").alias("event"), key("symbol").alias("symbol"), F.round(F.col("floor_strike") * 100).cast("bigint").alias("lo"))
    m = sets.pick(m.where("ticker is not null and event is not null and lo is not null"), ["ticker"], [F.col("market_row")], ["event", "symbol", "lo"], latest=False)
    t = table(spark, at, "bracket_trades").select(key("bracket_ticker").alias("ticker"), tt("early_yes_ask").alias("ask"), tt("entry_no_ask").alias("no_ask")).groupBy("ticker").agg(F.min("ask").alias("ask"), F.min("no_ask").alias("no_ask"))
    return m.join(t, "ticker").where("ask is not null and no_ask is not null")


@query(f"""with {_QUOTED} select b.event, b.ticker, a.ticker as below, 10000 - a.ask - b.no_ask as edge from q b join q a on a.event = b.event and a.lo < b.lo
qualify row_number() over (partition by b.ticker order by a.ask, a.ticker) = 1""")
def ladder_order(spark, at):
    """Each rung against the cheapest of all rungs below it; where the edge is positive the ladder is out of order."""
    x = sequence.best_before(_quoted(spark, at), ["event"], ["lo"], F.struct("ask", "ticker"), "low", width=100_000)
    return x.where("low is not null").select("event", "ticker", F.col("low.ticker").alias("below"), (10_000 - F.col("low.ask") - F.col("no_ask")).alias("edge"))


@query(f"""with {_QUOTED}, r as (select *, row_number() over (partition by event order by lo, ticker) as rung from q), h as (select *, regexp_extract(event, '-(.*)$', 1) as hour from r where symbol is not null)
select b.symbol, b.ticker, a.ticker as earlier, 10000 - a.ask - b.no_ask as edge from h b join h a on a.symbol = b.symbol and a.rung = b.rung and a.hour < b.hour qualify row_number() over (partition by b.ticker order by a.ask, a.ticker) = 1""")
def implied_across_events(spark, at):
    """Each rung against the cheapest rung of its number in the symbol's events before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("event").orderBy("lo", "ticker")  # the rungs of one ladder
    r = _quoted(spark, at).where("symbol is not null").withColumn("rung", F.row_number().over(w)).withColumn("hour", F.regexp_extract("event", "-(.*)$", 1))
    n = r.withColumn("block", tickers.hour_token_micros(F.col("hour"))).where("block is not null")
    x = sequence.best_before(n, ["symbol", "rung"], ["block"], F.struct("ask", "ticker"), "low", width=DAY)
    return x.where("low is not null").select("symbol", "ticker", F.col("low.ticker").alias("earlier"), (10_000 - F.col("low.ask") - F.col("no_ask")).alias("edge"))


# --- scored matches

_TITLES = r"""g as (select line_id, unnest(case when json_type(j) = 'ARRAY' then cast(j as json[]) when json_type(j, '$.manifests') = 'ARRAY' then cast(json_extract(j, '$.manifests') as json[]) else [j] end) as r from (select line_id, payload::json as j from game_pair_lines where payload is not null and json_valid(payload) and trim(payload) != '')),
e as (select coalesce(json_extract_string(r, '$.game.event_title'), json_extract_string(r, '$.event_title')) as title, upper(coalesce(json_extract_string(r, '$.game.event_ticker'), json_extract_string(r, '$.event_ticker'))) as ticker from g),
n as (select ticker, min(title) as title from e where ticker is not null and regexp_matches(title, '^(.+) at (.+)$') group by ticker),
tok as (select ticker, title, lower(regexp_extract(title, '^(.+) at (.+)$', 1)) as one, lower(regexp_extract(title, '^(.+) at (.+)$', 2)) as two, regexp_extract(ticker, '-[0-9]{2}[A-Z]{3}([0-9]{2})([A-Z]{3})([A-Z]{3})', 1) as d, lower(regexp_extract(ticker, '-[0-9]{2}[A-Z]{3}([0-9]{2})([A-Z]{3})([A-Z]{3})', 2)) as c1, lower(regexp_extract(ticker, '-[0-9]{2}[A-Z]{3}([0-9]{2})([A-Z]{3})([A-Z]{3})', 3)) as c2 from n),
games as (select *, row_number() over (order by ticker) as id from tok where d != '')"""


def _games(spark, at):
    """Games by their ticker: title, both teams, their codes and the day."""
    nodes = nested.json_nodes(table(spark, at, "game_pair_lines"), "line_id", "payload", ("event_title", "event_ticker")).where("type = 'string'")
    e = nodes.groupBy("row_id", "parent").agg(F.max(F.when(F.col("field") == "event_title", F.col("text"))).alias("title"), F.upper(F.max(F.when(F.col("field") == "event_ticker", F.col("text")))).alias("ticker"))
    n = e.where(F.col("ticker").isNotNull() & F.col("title").rlike("^(.+) at (.+)$")).groupBy("ticker").agg(F.min("title").alias("title"))
    g = lambda k: F.regexp_extract("ticker", "-[0-9]{2}[A-Z]{3}([0-9]{2})([A-Z]{3})([A-Z]{3})", k)
    t = lambda k: F.regexp_extract("title", "^(.+) at (.+)$", k)
    return n.select("ticker", "title", t(1).alias("one"), t(2).alias("two"), g(1).alias("d"), F.lower(g(2)).alias("c1"), F.lower(g(3)).alias("c2")).where("d != ''")


_SCORE = "case when starts_with({0}, {1}) then case when {0} = {1} then 1.0 else 0.8 end else 0.0 end"


@query(rf"""with {_TITLES}, s as (
  select a.ticker, b.ticker as other, greatest(
    case when least({_SCORE.format("a.one", "b.c1")}, {_SCORE.format("a.two", "b.c2")}) >= 0.3 then {_SCORE.format("a.one", "b.c1")} + {_SCORE.format("a.two", "b.c2")} else 0 end,
    case when least({_SCORE.format("a.one", "b.c2")}, {_SCORE.format("a.two", "b.c1")}) >= 0.3 then {_SCORE.format("a.one", "b.c2")} + {_SCORE.format("a.two", "b.c1")} else 0 end) as score
  from games a join games b on abs(cast(a.d as bigint) - cast(b.d as bigint)) * 24 <= 24),
k as (select ticker, other, score, row_number() over (partition by ticker order by score desc, other) as r, lead(score) over (partition by ticker order by score desc, other) as second from s where score >= 1.2)
select a.ticker, case when k.second is null or k.score - k.second >= 0.25 then k.other end as other, cast(k.score as double) as score, case when k.ticker is null then 'no_match' when k.second is null or k.score - k.second >= 0.25 then 'matched' else 'ambiguous' end as status
from games a left join k on a.ticker = k.ticker and r = 1""")
def scored_games(spark, at):
    """Titles of games against the teams' codes in all tickers of a day around: matched, ambiguous or none."""
    teams = [matching.team_words(F.col("one")).alias("one"), matching.team_words(F.col("two")).alias("two")]
    g = written(_games(spark, at).select("ticker", *teams, F.array("c1").alias("first"), F.array("c2").alias("second"), (F.col("d").cast("bigint") * DAY).alias("t")), "games")
    left = g.select(F.col("ticker").alias("id"), "one", "two", "t")
    right = g.select(F.col("ticker").alias("id"), F.col("first").alias("one"), F.col("second").alias("two"), "t")
    out = matching.match_events(left, right, DAY)
    return out.select(F.col("left_id").alias("ticker"), F.col("right_id").alias("other"), "score", "status")


@query(rf"""with {_TITLES} select ticker, case when starts_with(one, c1) and not starts_with(one, c2) then 1 when starts_with(one, c2) and not starts_with(one, c1) then 2 end as place_of_one,
case when starts_with(two, c1) and not starts_with(two, c2) then 1 when starts_with(two, c2) and not starts_with(two, c1) then 2 end as place_of_two, 3 as place_of_draw from games""")
def outcomes_of_names(spark, at):
    """Which of a game's outcomes each team's name, and a draw, means."""
    g = _games(spark, at).withColumns({"names": F.array(F.col("c1"), F.col("c2"), F.lit("Tie")), "words": F.array(F.array("c1"), F.array("c2"), F.array(F.lit("tie")))})
    place = lambda c, words: matching.best_name(c, words, F.col("names"), F.col("words"))
    g = g.withColumns({"w1": matching.team_words(F.col("one")), "w2": matching.team_words(F.col("two"))})
    return g.select("ticker", place(F.col("one"), F.col("w1")).alias("place_of_one"), place(F.col("two"), F.col("w2")).alias("place_of_two"), place(F.lit("Draw"), F.array(F.lit("draw"))).alias("place_of_draw"))


_SOURCES = r"""w as (select distinct source as name, list_filter(string_split(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x != '' and x != 'the') as words from documents where source is not null)"""


@query(rf"""with {_SOURCES}, l as (select distinct words[1:1] as asks from w where len(words) > 0), j as (select l.asks[1] as word, count(w.name) as n, min(w.name) as sole from l left join w on list_has_all(w.words, l.asks) group by l.asks)
select word, case when n = 1 then sole end as name, case when n = 1 then 'matched' when n > 1 then 'ambiguous' else 'unmatched' end as status from j""")
def sources_with_words(spark, at):
    """For the first word of every source, the one spelling of a source that has it."""
    w = table(spark, at, "documents").where("source is not null").select(F.col("source").alias("id")).distinct().withColumn("words", F.filter(matching.tokens(F.regexp_replace(F.lower("id"), "[^a-z0-9]+", " ")), lambda x: x != "the"))
    asks = w.where(F.size("words") > 0).select(F.slice("words", 1, 1).alias("words")).distinct().select(F.get("words", F.lit(0)).alias("id"), "words")
    return matching.holders(asks, w).select(F.col("left_id").alias("word"), F.col("right_id").alias("name"), "status")


@query(r"""with recursive names as (select distinct regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g') as name from documents where source is not null),
w as (select name as id, list_distinct(list_filter(string_split(name, ' '), lambda x: x != '')) as words from names),
links as (select a.id as a, b.id as b from w a join w b on a.id != b.id and len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))::double >= 0.5),
reach(id, other) as (select id, id from w union select r.id, l.b from reach r join links l on r.other = l.a)
select r.id, min(r.other) as class_id, (select count(*) from links l where l.a = r.id) as n_links from reach r group by r.id""")
def alike_names(spark, at):
    """Source names in classes of those linked by half of their words or more, with the number of links of each."""
    names = table(spark, at, "documents").where("source is not null").select(F.regexp_replace(F.lower("source"), r"[^a-z0-9]+", " ").alias("name")).distinct()
    words = names.select(F.col("name").alias("id"), matching.tokens(F.col("name")).alias("words"))
    return matching.classes(matching.scored_pairs(words, words, 0.5).select("left_id", "right_id"), words.select("id"))


# --- sequences


@query(f"""with {BOOKS}, a as (select ticker, t, snap_id, bid - lag(bid) over w as x, depth - lag(depth) over w as y from books window w as (partition by ticker order by t, snap_id)), k as (select * from a where x is not null and y is not null),
s as (select ticker, count(*)::hugeint as n, sum(x)::hugeint as sx, sum(y)::hugeint as sy, sum(x * x)::hugeint as sxx, sum(y * y)::hugeint as syy, sum(x * y)::hugeint as sxy from k group by ticker having count(*) >= 10),
g as (select k.ticker, x, y from k join s using (ticker) qualify row_number() over (partition by k.ticker order by abs((s.n * x - s.sx) * (s.n * y - s.sy)) desc, t desc, snap_id desc) = 1),
l as (select s.ticker, (n - 1)::double as n, (sx - x)::double as sx, (sy - y)::double as sy, (sxx - x * x)::double as sxx, (syy - y * y)::double as syy, (sxy - x * y)::double as sxy from s join g using (ticker))
select ticker, cast(n as bigint) as n, case when n * sxx - sx * sx > 0 and n * syy - sy * sy > 0 then {r6("(n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy)")} end as r from l""")
def correlation_without_largest(spark, at):
    """Per ticker, the correlation of the steps of bid and depth without the pair that speaks loudest for it."""
    d = sequence.deltas(books(spark, at), ["ticker"], ["t", "snap_id"], ["bid", "depth"]).select("ticker", "t", "snap_id", "d_bid", F.col("d_depth").cast("bigint").alias("d_depth"))
    return sequence.without_largest_product(d, ["ticker"], "d_bid", "d_depth", ["t", "snap_id"], 10).withColumn("r", stats.rounded(F.col("r")))


@query(f"""with {BOOKS}, e as (select series, max(d) as last_day from books group by series), r as (select ticker, max(series) as series, max(d) as d from books group by ticker), gone as (select ticker from r join e using (series) where d < last_day),
s as (select ticker, snap_id, t, bid, ask, lag(t) over w as pt, lag(bid) over w as pb, lag(ask) over w as pa, row_number() over (partition by ticker order by t desc, snap_id desc) as n from books window w as (partition by ticker order by t, snap_id))
select ticker, snap_id, t - pt as gap_us, bid - pb as d_bid, ask - pa as d_ask from s where n = 1 and pt is not null and ticker in (select ticker from gone)""")
def last_steps_of_removed(spark, at):
    """The last two readings of every ticker that is gone before its series ends."""
    b = books(spark, at)
    ends = b.groupBy("series").agg(F.max("d").alias("last_day"))
    gone = b.groupBy("ticker").agg(F.max("series").alias("series"), F.max("d").alias("d")).join(ends, "series").where("d < last_day").select("ticker")
    near = sequence.beside(b.join(gone, "ticker", "left_semi"), ["ticker"], ["t", "snap_id"], ["t", "bid", "ask"], "before")
    last = sets.pick(near, ["ticker"], [F.col("t"), F.col("snap_id")], ["snap_id", "t", "bid", "ask", "before"]).where("before is not null")
    return last.select("ticker", "snap_id", (F.col("t") - F.col("before.t")).alias("gap_us"), (F.col("bid") - F.col("before.bid")).alias("d_bid"), (F.col("ask") - F.col("before.ask")).alias("d_ask"))


@query(f"""with {BOOKS}, v as (select ticker, t, snap_id, case when bid - 6000 >= 4000 - ask and bid - 6000 > 0 then 'high' when 4000 - ask > 0 and 4000 - ask > bid - 6000 then 'low' end as state, greatest(bid - 6000, 4000 - ask) as value from books where bid is not null and ask is not null),
a as (select *, case when lag(1) over w is null or state is distinct from lag(state) over w then 1 else 0 end as new from v window w as (partition by ticker order by t, snap_id)), b as (select *, sum(new) over (partition by ticker order by t, snap_id) as run from a)
select ticker, cast(run as bigint) as run, max(state) as state, min(t) as first, max(t) as last, count(*) as n, arg_min(value, (t, snap_id)) as entry, max(value) as peak from b where state is not null group by ticker, run""")
def direction_episodes(spark, at):
    """Stretches in which the better of two directions stays the same, with their value at entry and at the peak; the first direction wins ties."""
    b = books(spark, at).where("bid is not null and ask is not null")
    high, low = F.col("bid") - 6000, 4000 - F.col("ask")
    state = F.when((high >= low) & (high > 0), "high").when((low > 0) & (low > high), "low")
    return sequence.episodes(b, ["ticker"], ["t", "snap_id"], state, F.greatest(high, low))


@query(f"""with {BOOKS}, p as (select series, ask - bid as s, bid + ask as m, lead(t) over w - t as gap, lead(bid + ask) over w as m2, lead(ask - bid) over w as s2 from books window w as (partition by ticker order by t, snap_id))
select series, count(*) as n, cast(sum(s) as bigint) as spreads, cast(sum(m2 - m) as bigint) as moves, count(*) filter (where m2 > m) as n_sold, count(*) filter (where m2 < m) as n_bought, cast(sum(abs(m2 - m)) as bigint) as adverse from p where gap <= 5400000000 and s > 0 and s2 > 0 group by series""")
def quote_pairs(spark, at):
    """Neighbouring two-sided readings within 90 minutes: spread, move of twice the middle, and on which side a maker would have been filled."""
    b = sequence.beside(books(spark, at).withColumns({"s": F.col("ask") - F.col("bid"), "m": F.col("bid") + F.col("ask")}), ["ticker"], ["t", "snap_id"], ["t", "s", "m"], "next", ahead=True)
    x = b.where((F.col("next.t") - F.col("t") <= 5_400_000_000) & (F.col("s") > 0) & (F.col("next.s") > 0)).withColumn("move", F.col("next.m") - F.col("m"))
    return x.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("spreads"), F.sum("move").alias("moves"), F.count_if(F.col("move") > 0).alias("n_sold"), F.count_if(F.col("move") < 0).alias("n_bought"), F.sum(F.abs("move")).alias("adverse"))


# --- aggregations


@query(f"""with {BOOKS}, l as (select series, d, depth, no_bids[1][2] as queue from books qualify row_number() over (partition by ticker, d order by t desc, snap_id desc) = 1)
select series, d, count(*) as n, {r6("median(depth)")} as median_depth, {r6("median(queue)")} as median_queue from l group by series, d""")
def touch_queues(spark, at):
    """Per series and day the median depth and the median size at the head of the no bids, at each ticker's last reading."""
    last = sets.pick(books(spark, at).withColumn("queue", F.get(F.get("no_bids", F.lit(0)), F.lit(1))), ["ticker", "d"], [F.col("t"), F.col("snap_id")], ["series", "depth", "queue"])
    return last.groupBy("series", "d").agg(F.count(F.lit(1)).alias("n"), stats.rounded(F.median("depth")).alias("median_depth"), stats.rounded(F.median("queue")).alias("median_queue"))


@query(f"""with {BOOKS}, f as (select * from books qualify row_number() over (partition by ticker order by t, snap_id) = 1), w as (select event, count(*) as n, min(t) as t, bool_and(coalesce(bid > 0 and ask < 10000, false)) as whole, cast(sum(ask) as bigint) as asks from f group by event),
s as (select * from w where whole order by t, event limit 50) select count(*) as n, {r6("median(n)")} as median_rungs, {r6("median(asks)")} as median_asks from s""")
def first_whole_ladders(spark, at):
    """Medians over the first 50 ladders that were complete at their members' first readings."""
    first = sets.pick(books(spark, at), ["ticker"], [F.col("t"), F.col("snap_id")], ["event", "t", "bid", "ask"], latest=False)
    w = first.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"), F.bool_and(F.coalesce((F.col("bid") > 0) & (F.col("ask") < 10_000), F.lit(False))).alias("whole"), F.sum("ask").alias("asks"))
    s = w.where("whole").orderBy("t", "event").limit(50)
    return s.agg(F.count(F.lit(1)).alias("n"), stats.rounded(F.median("n")).alias("median_rungs"), stats.rounded(F.median("asks")).alias("median_asks"))


@query(f"""with o as (select {sql_key("order_id")} as k, {sql_key("event_ticker")} as event, least(cast(floor(limit_price * 10) as bigint), 9) as bin, qty from paper_orders where {sql_key("order_id")} is not null and qty > 0 and limit_price is not null qualify row_number() over (partition by {sql_key("order_id")} order by order_row) = 1),
f as (select {sql_key("order_id")} as k, sum(qty) as filled from paper_fills group by 1), j as (select o.*, coalesce(f.filled, 0) >= o.qty as whole, coalesce(f.filled, 0) > 0 as part from o left join f using (k)),
e as (select event, bool_and(whole) as whole from j where event is not null group by event)
select bin, count(*) as n, count(*) filter (where part) as n_filled, count(*) filter (where whole) as n_whole, (select count(*) filter (where whole) from e) as n_whole_events from j group by bin""")
def fill_rates(spark, at):
    """Orders by the tenth of their limit: how many were filled at all and wholly, and in how many events all were."""
    o = table(spark, at, "paper_orders").select("order_row", key("order_id").alias("k"), key("event_ticker").alias("event"), F.least(F.floor(F.col("limit_price") * 10), F.lit(9)).cast("bigint").alias("bin"), "qty").where("k is not null and qty > 0 and bin is not null")
    o = sets.pick(o, ["k"], [F.col("order_row")], ["event", "bin", "qty"], latest=False)
    f = table(spark, at, "paper_fills").select(key("order_id").alias("k"), "qty").where("k is not null").groupBy("k").agg(F.sum("qty").alias("filled"))
    j = o.join(f, "k", "left").select("event", "bin", (F.coalesce("filled", F.lit(0)) >= F.col("qty")).alias("whole"), (F.coalesce("filled", F.lit(0)) > 0).alias("some"))
    events = j.where("event is not null").groupBy("event").agg(F.bool_and("whole").alias("whole")).agg(F.count_if("whole")).scalar()
    return j.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("some").alias("n_filled"), F.count_if("whole").alias("n_whole")).withColumn("n_whole_events", events)


_FLAGS = f"""[case when {sql_iso_micros("event_time")} is null then 'no event time' end, case when n_markets is null then 'no markets' end, case when n_markets < expected_markets then 'short' end, case when not completeness_ok then 'incomplete' end, case when warmup then 'warm-up' end]"""


@query(f"""with m as (select {sql_key("city")} as city, {sql_iso_micros("captured_at")} // {DAY} as d, list_filter({_FLAGS}, lambda x: x is not null) as flags from capture_manifests where {sql_key("city")} is not null),
c as (select city, count(*) as n, count(*) filter (where len(flags) = 0) as n_good, count(distinct d) as n_days, max(d) - min(d) + 1 as span from m group by city), h as (select city, flag, count(*) as n_flag from (select city, unnest(flags) as flag from m) group by all)
select c.city, h.flag, h.n_flag, c.n, c.n_good, {r6("c.n_days / c.span::double")} as coverage, case when c.n_good * 2 >= c.n and c.n_days / c.span::double >= 0.9 then 'pass' else 'fail' end as verdict from c left join h using (city)""")
def city_verdicts(spark, at):
    """Per city the flags of its manifests, the share of days with any, and a verdict."""
    checks = {"no event time": iso_micros("event_time").isNull(), "no markets": F.col("n_markets").isNull(), "short": F.col("n_markets") < F.col("expected_markets"), "incomplete": ~F.col("completeness_ok"), "warm-up": F.col("warmup")}
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    m = table(spark, at, "capture_manifests").select(key("city").alias("city"), floor_div(iso_micros("captured_at"), DAY).alias("d"), flags.alias("flags")).where("city is not null")
    c = m.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("flags") == 0).alias("n_good"), F.count_distinct("d").alias("n_days"), (F.max("d") - F.min("d") + 1).alias("span"))
    h = m.select("city", F.explode("flags").alias("flag")).groupBy("city", "flag").agg(F.count(F.lit(1)).alias("n_flag"))
    coverage = F.col("n_days") / F.col("span")
    return c.join(h, "city", "left").select("city", "flag", "n_flag", "n", "n_good", stats.rounded(coverage).alias("coverage"), F.when((F.col("n_good") * 2 >= F.col("n")) & (coverage >= 0.9), "pass").otherwise("fail").alias("verdict"))


@query(f"""select {sql_key("capture_id")} as capture_id, cast(sum(expected_markets) as bigint) as expected, count(*) as n from capture_manifests where {sql_key("capture_id")} is not null group by 1""")
def expected_by_capture(spark, at):
    m = table(spark, at, "capture_manifests").select(key("capture_id").alias("capture_id"), "expected_markets").where("capture_id is not null")
    return m.groupBy("capture_id").agg(F.sum("expected_markets").alias("expected"), F.count(F.lit(1)).alias("n"))


@query(f"""with {BOOKS} select series, count(*) as n, {r6("sqrt(count(*) filter (where ask - bid <= 200) / count(*)::double * (1 - count(*) filter (where ask - bid <= 200) / count(*)::double) / count(*))")} as halfwidth from books where bid is not null and ask is not null group by series""")
def share_halfwidths(spark, at):
    """Per series the standard error of the share of tight readings, which says what a sample of this size can tell."""
    n, p = F.count(F.lit(1)), F.count_if(F.col("ask") - F.col("bid") <= 200) / F.count(F.lit(1))
    return books(spark, at).where("bid is not null and ask is not null").groupBy("series").agg(n.alias("n"), stats.rounded(F.sqrt(p * (1 - p) / n)).alias("halfwidth"))


@query(f"""with {BOOKS}, r as (select ticker, bid >= 5000 as won from books where bid is not null qualify row_number() over (partition by ticker order by t desc, snap_id desc) = 1), f as (select * from books qualify row_number() over (partition by ticker order by t, snap_id) = 1)
select ticker, won, case when won then ask else 10000 - bid end as ask, {r6("case when won then no_bids[1][2] else yes_bids[1][2] end")} as behind from f join r using (ticker)""")
def winner_side(spark, at):
    """At a ticker's first reading the ask of the side that led at its last, and the size behind it on the other side's bids."""
    b = books(spark, at)
    r = sets.pick(b.where("bid is not null"), ["ticker"], [F.col("t"), F.col("snap_id")], ["bid"]).select("ticker", (F.col("bid") >= 5000).alias("won"))
    first = sets.pick(b, ["ticker"], [F.col("t"), F.col("snap_id")], ["bid", "ask", "yes_bids", "no_bids"], latest=False)
    head = lambda c: F.get(F.get(c, F.lit(0)), F.lit(1))
    return first.join(r, "ticker").select("ticker", "won", F.when(F.col("won"), F.col("ask")).otherwise(10_000 - F.col("bid")).alias("ask"), stats.rounded(F.when(F.col("won"), head("no_bids")).otherwise(head("yes_bids"))).alias("behind"))


# --- predicates and tokens


@query(f"""with {BOOKS} select series, case when starts_with(series, 'KXP') then 'dead tail' when contains(series, 'EL') or contains(series, 'TC') then 'tested' else 'untested' end as triage, regexp_matches(series, 'KX[A-M]') and not regexp_matches(series, 'R$') as included, count(distinct ticker) as n from books group by all""")
def series_triage(spark, at):
    """Series by the first prefix or part of their name that fits, and by patterns taken in and left out."""
    s = F.col("series")
    triage = F.when(s.startswith("KXP"), "dead tail").when(s.contains("EL") | s.contains("TC"), "tested").otherwise("untested")
    return books(spark, at).groupBy("series", triage.alias("triage"), (s.rlike("KX[A-M]") & ~s.rlike("R$")).alias("included")).agg(F.count_distinct("ticker").alias("n"))


_REAL = "('real_ask', 'real_bid', 'broker_truth')"


@query(f"""with t as (select case when price_source_tags.asks in {_REAL} then price_source_tags.asks else 'synthetic' end as tag, price_source_tags.asks in {_REAL} and price_source_tags.bids in {_REAL} as fillable from book_snapshots) select tag, count(*) as n, count(*) filter (where fillable) as n_fillable from t group by tag""")
def tags_and_fillable(spark, at):
    """Tags as they are known, all others as synthetic, and readings whose tags are all real."""
    asks, bids = F.col("price_source_tags.asks"), F.col("price_source_tags.bids")
    all_real = F.forall(F.array(asks, bids), lambda x: F.coalesce(x.isin(*tickers.REAL_TAGS), F.lit(False)))
    return table(spark, at, "book_snapshots").groupBy(tickers.tag_or_synthetic(asks).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count_if(all_real).alias("n_fillable"))


@query(f"""select capture_row, cast(case when 2 * ((t % {HOUR} + {HOUR}) % {HOUR}) > {HOUR} or (2 * ((t % {HOUR} + {HOUR}) % {HOUR}) = {HOUR} and cast(floor(t / {HOUR}.0) as bigint) % 2 != 0) then cast(floor(t / {HOUR}.0) as bigint) + 1 else cast(floor(t / {HOUR}.0) as bigint) end as bigint) as hour from (select capture_row, {sql_iso_micros("captured_at")} as t from hour_captures) where t is not null""")
def nearest_hours(spark, at):
    """The nearest whole hour of each capture; half hours go to the even one."""
    c = captures(spark, at).where("t is not null")
    return c.select("capture_row", tickers.half_even(F.col("t"), HOUR).alias("hour"))


@query(rf"""with k as (select market_row, {sql_iso_micros("close_time")} as c, regexp_extract({sql_key("event_ticker")}, '-(\d{{2}}[A-Z]{{3}}\d{{2}})(\d{{2}})$', 1) as tok, regexp_extract({sql_key("event_ticker")}, '-(\d{{2}}[A-Z]{{3}}\d{{2}})(\d{{2}})$', 2) as hh from bracket_markets),
d as (select market_row, c, hh, cast(strptime('20' || left(tok, 2) || substr(tok, 3, 1) || lower(substr(tok, 4, 2)) || substr(tok, 6), '%Y%b%d') as date) as day from k where tok != '' and cast(hh as int) < 24)
select market_row, cast(datediff('day', date '1970-01-01', day) as bigint) as contract_day, (cast(datediff('day', date '1970-01-01', day) as bigint) - 1) * {DAY} as run_init, cast(datediff('day', date '1970-01-01', day) as bigint) * {DAY} + (cast(hh as bigint) * 60 + 30) * 60000000 as half_past,
case when c is not null then cast(year(make_timestamp(c)) - (case when (month(day) + 5) % 12 + 1 > month(make_timestamp(c)) then 1 else 0 end) as integer) end as report_year, case when c is not null then cast(floor(c / {DAY}.0) as bigint) - cast(datediff('day', date '1970-01-01', day) as bigint) end as days_to_close from d""")
def contract_dates(spark, at):
    """Dates that tokens stand for: the contract's day, the start of the run before it, the half hour read as UTC, a month's year by rollover, days to the close."""
    token = lambda n: F.regexp_extract(key("event_ticker"), r"-(\d{2}[A-Z]{3}\d{2})(\d{2})$", n)
    m = table(spark, at, "bracket_markets").select("market_row", iso_micros("close_time").alias("c"), tickers.token_day(token(1)).alias("contract_day"), tickers.clock_micros(token(1), F.concat(token(2), F.lit("30"))).alias("half_past"), F.month(F.date_from_unix_date(tickers.token_day(token(1)).cast("int"))).alias("month")).where("contract_day is not null and half_past is not null")
    closes = F.date_from_unix_date(floor_div(F.col("c"), DAY).cast("int"))
    report = F.pmod(F.col("month") + 5, F.lit(12)) + 1
    return m.select("market_row", "contract_day", ((F.col("contract_day") - 1) * DAY).alias("run_init"), "half_past", tickers.rolled_year(report, closes).alias("report_year"), (floor_div(F.col("c"), DAY) - F.col("contract_day")).alias("days_to_close"))


@query(r"""with u as (select delivery_id, 'https://host.example' || source_endpoint || '?series_ticker=' || series[1] || '&limit=' || n_markets as url from capture_manifests)
select delivery_id, regexp_extract(url, '^https://[^/]*(/[^?]*)', 1) as path, regexp_extract(url, '[?&]series_ticker=([^&]*)', 1) as series_ticker, cast(regexp_extract(url, '[?&]limit=([^&]*)', 1) as bigint) as n, lower(regexp_replace(regexp_extract(url, '[?&]series_ticker=KX(HIGH|LOW)?([^&]*)', 2), '[^A-Za-z0-9]+', '-', 'g')) as city from u where url is not null""")
def address_parameters(spark, at):
    """Path and parameters of the addresses that manifests were read from, and the city in a series' name."""
    url = F.concat(F.lit("https://host.example"), F.col("source_endpoint"), F.lit("?series_ticker="), F.get("series", F.lit(0)), F.lit("&limit="), F.col("n_markets").cast("string"))
    u = table(spark, at, "capture_manifests").select("delivery_id", url.alias("url")).where("url is not null")
    part = lambda *p: F.try_parse_url(F.col("url"), *[F.lit(x) for x in p])
    city = F.regexp_extract(part("QUERY", "series_ticker"), "^KX(HIGH|LOW)?(.*)$", 2)
    return u.select("delivery_id", part("PATH").alias("path"), part("QUERY", "series_ticker").alias("series_ticker"), part("QUERY", "limit").cast("bigint").alias("n"), tickers.slug(city).alias("city"))


# --- rounds and ticks


@query(f"""with {CAPTURES}, s as (select symbol, cast(floor(t / {DAY}.0) as bigint) as d, t, min(t) over (partition by symbol, cast(floor(t / {DAY}.0) as bigint)) as t0 from captures where symbol is not null and t is not null),
r as (select symbol, d, (t - t0) // {FIVE} as round, count(*) as m from s group by all) select symbol, d, max(round) + 1 as n_rounds, max(round) + 1 - count(*) as n_missed, cast(sum(m - 1) as bigint) as n_dropped from r group by symbol, d""")
def polling_rounds(spark, at):
    """Fixed-rate rounds from each day's first capture on: how many there should be, were missed, and came twice."""
    from tapeloom.operators import quality

    c = captures(spark, at).where("symbol is not null and t is not null").withColumn("d", floor_div(F.col("t"), DAY))
    return quality.rounds(c, ["symbol", "d"], "t", FIVE)


@query(f"""with {CAPTURES}, l as (select cast(floor(t / {HOUR}.0) as bigint) as hour, symbol, bool_or(spot is not null) as ok from captures where symbol is not null and t is not null group by all), n as (select count(distinct symbol) as n from l)
select hour, count(*) as n_legs, count(*) filter (where not ok) as n_failed, (select n from n) - count(*) as n_absent, bool_and(ok) and count(*) = (select n from n) as complete from l group by hour""")
def ticks_of_all_legs(spark, at):
    """Each hour's tick over all legs: a leg that failed or is absent does not hide the others, and a tick is complete if all are there."""
    from tapeloom.operators import quality

    c = captures(spark, at).where("symbol is not null and t is not null").select(floor_div(F.col("t"), HOUR).alias("hour"), "symbol", F.col("spot").isNotNull().alias("ok"))
    return quality.ticks(c, "hour", "symbol", "ok")


# --- joins


@query(f"""with {SETTLES}, {CAPTURES}, s as (select settle_id, event, t from settles where event is not null and t is not null), c as (select event, t, min(capture_row) as id from captures where event is not null and t is not null group by all),
j as (select settle_id, c.id as capture_row, c.t - s.t as lag_us from s join c on s.event = c.event and cast(floor(s.t / {DAY}.0) as bigint) = cast(floor(c.t / {DAY}.0) as bigint) qualify row_number() over (partition by settle_id order by abs(c.t - s.t), c.t) = 1)
select settle_id, capture_row, lag_us, case when lag_us is null then 'unmatched' when abs(lag_us) <= 600000000 then 'near' else 'far' end as bucket from s left join j using (settle_id)""")
def nearest_same_day(spark, at):
    """The nearest capture of the same UTC day, however far, with a signed lag; settles without one stay."""
    day = lambda df: df.select(F.concat_ws("|", "event", floor_div(F.col("t"), DAY)).alias("k"), "t", "id")
    s = settles(spark, at).where("event is not null and t is not null").select("event", "t", F.col("settle_id").alias("id"))
    c = captures(spark, at).where("event is not null and t is not null").select("event", "t", F.col("capture_row").alias("id"))
    near = asof.asof(day(s), day(c), direction="nearest").select(F.col("left_id").alias("settle_id"), F.col("right_id").alias("capture_row"))
    lag = near.join(c.select(F.col("id").alias("capture_row"), F.col("t").alias("ct")), "capture_row")
    out = s.select(F.col("id").alias("settle_id"), "t").join(lag, "settle_id", "left").withColumn("lag_us", F.col("ct") - F.col("t"))
    return out.select("settle_id", "capture_row", "lag_us", F.coalesce(F.when(F.abs("lag_us") <= 600_000_000, "near").when(F.col("lag_us").isNotNull(), "far"), F.lit("unmatched")).alias("bucket"))


@query(f"""with {SETTLES}, {CAPTURES}, c as (select * from captures where event is not null and t is not null), s as (select event, min(t) as close from settles where event is not null and t is not null group by event)
select c.symbol, c.t >= s.close as after, count(*) as n, max(abs(c.t - s.close)) as farthest from c join s using (event) where c.symbol is not null group by all""")
def rows_around_close(spark, at):
    """Captures before and after their event's close, both kept, with the farthest of each."""
    s = settles(spark, at).where("event is not null and t is not null").groupBy("event").agg(F.min("t").alias("close"))
    c = captures(spark, at).where("event is not null and t is not null and symbol is not null").join(s, "event")
    return c.groupBy("symbol", (F.col("t") >= F.col("close")).alias("after")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("t") - F.col("close"))).alias("farthest"))


@query(f"""with {SETTLES}, {CAPTURES}, c as (select event, min(t) as t0 from captures where event is not null and t is not null group by event)
select s.symbol, s.event, s.settle_id, s.booked - s.t as lag_us, c.t0 from settles s left join c using (event) where s.symbol is not null and s.event is not null and s.booked >= s.t qualify row_number() over (partition by s.symbol, s.event order by s.booked - s.t, s.settle_id) = 1""")
def earliest_settles(spark, at):
    """Of each settled hour the row booked soonest after its close, with the hour's first capture where there is one."""
    s = settles(spark, at).where("symbol is not null and event is not null and booked >= t").withColumn("lag_us", F.col("booked") - F.col("t"))
    c = captures(spark, at).where("event is not null and t is not null").groupBy("event").agg(F.min("t").alias("t0"))
    return sets.pick(s, ["symbol", "event"], [F.col("lag_us"), F.col("settle_id")], ["settle_id", "lag_us"], latest=False).join(c, "event", "left").select("symbol", "event", "settle_id", "lag_us", "t0")


@query(f"""with a as (select distinct lower(trim(strategy)) as strategy from city_signals where strategy is not null), b as (select distinct lower(trim(strategy)) as strategy from paper_orders where strategy is not null)
select coalesce(a.strategy, b.strategy) as strategy, case when b.strategy is null then 'unregistered' when a.strategy is null then 'unused' else 'both' end as status, case lower(coalesce(a.strategy, b.strategy)) when 'basis_lag' then 'basis' when 'queue_maker' then 'maker' else 'blocked' end as family from a full join b using (strategy)""")
def registered_strategies(spark, at):
    """Strategies that signals name against those that orders do, with their factor family; an unknown one is blocked."""
    side = lambda n: table(spark, at, n).where("strategy is not null").select(F.lower(F.trim("strategy")).alias("strategy")).distinct().withColumn(n, F.lit(True))
    both = side("city_signals").join(side("paper_orders"), "strategy", "full_outer")
    status = F.when(F.col("paper_orders").isNull(), "unregistered").when(F.col("city_signals").isNull(), "unused").otherwise("both")
    family = F.when(F.col("strategy") == "basis_lag", "basis").when(F.col("strategy") == "queue_maker", "maker").otherwise("blocked")
    return both.select("strategy", status.alias("status"), family.alias("family"))


@query(f"""select 'order' as kind, count(*) as n, cast(sum(qty) as bigint) as total from paper_orders union all select 'fill', count(*), cast(sum(qty) as bigint) from paper_fills""")
def ledger_of_two_kinds(spark, at):
    """Orders and fills written as lines of one ledger and read back by their kind."""
    ledger = tape.tagged({"order": table(spark, at, "paper_orders").select("order_id", "qty", "limit_price"), "fill": table(spark, at, "paper_fills").select("fill_id", "order_id", "qty")})
    back = tape.untagged(ledger, {"order": "order_id string, qty bigint, limit_price double", "fill": "fill_id string, order_id string, qty bigint"})
    return back["order"].select(F.lit("order").alias("kind"), "qty").unionByName(back["fill"].select(F.lit("fill").alias("kind"), "qty")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("total"))


# --- inference

_WINS = """v as (select settled_no as g, symbol, floor(epoch_us(loaded_at) / 3600000000.0)::bigint as u, cast(round(realized_pnl * 10000) as bigint) as y from bracket_trades where realized_pnl is not null and symbol is not null and loaded_at is not null)"""


@query(f"""with {_WINS}, per as (select upper(trim(symbol)) as symbol, u, sum(y) as s, count(*) as c from v group by all), i as (select *, row_number() over (partition by symbol order by u) - 1 as i, count(*) over (partition by symbol) as n from per),
draws as (select symbol, b, {bootstrap.sql_drawn("b", "i", "n")} as k from i, range(1000) as t(b)), means as (select d.symbol, b, sum(s)::double / sum(c) as mean from draws d join i on i.symbol = d.symbol and i.i = d.k group by all),
e as (select symbol, quantile_cont(mean, 0.025) as low, quantile_cont(mean, 0.975) as high, (count(*) filter (where mean <= 0) + 1) / (count(*) + 1)::double as p from means group by symbol),
r as (select *, count(*) over (order by p) as upto, count(*) over () as m from e), l as (select max(p) as lim from r where p <= upto * 0.1 / m), t as (select symbol, count(*) as n_units, cast(sum(s) as bigint) as total, cast(sum(c) as bigint) as n from per group by symbol)
select symbol, n_units, total, n, {r6("low")} as low, {r6("high")} as high, {r6("p")} as p, coalesce(p <= lim, false) as kept from e join t using (symbol), l""")
def gains_by_symbol(spark, at):
    """Per symbol the bootstrap over hours of the mean gain, its one-sided p, and which symbols stand after false discoveries are held at a tenth; 1,000 samples to a symbol."""
    v = table(spark, at, "bracket_trades").select(key("symbol").alias("symbol"), floor_div(micros("loaded_at"), HOUR).alias("u"), tt("realized_pnl").alias("y"))
    out = stats.benjamini_hochberg(bootstrap.grouped_bootstrap(v, ["symbol"], "u", "y", 1000), "p", 0.1)
    return out.select("symbol", "n_units", "total", "n", stats.rounded(F.col("low")).alias("low"), stats.rounded(F.col("high")).alias("high"), stats.rounded(F.col("p")).alias("p"), "kept")
