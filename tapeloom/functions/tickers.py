"""The grammar of tickers and time tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: SERIES-YYMMMDDHH, then a bracket letter with its strike.
BRACKET = r"^([A-Z0-9]+)-(\d{2}[A-Z]{3}\d{4})-([BT])(\d+(?:\.\d+)?)$"
#: The months as tokens spell them.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Fixed value: YYMMMDDHH.
HOUR_TOKEN = r"^\d{2}[A-Za-z]{3}\d{4}$"


def series_of(ticker: Column) -> Column:
    """What stands before the first dash."""
    return F.substring_index(ticker, "-", 1)


def event_of(ticker: Column) -> Column:
    """The ticker without its last part; one of a single part is its own event."""
    return F.regexp_replace(ticker, r"-[^-]*$", "")


def bracket(ticker: Column) -> Column:
    """(series, token, side, strike) of a bracket's ticker; null if it is none."""
    g = lambda n: F.regexp_extract(ticker, BRACKET, n)
    return F.when(ticker.rlike(BRACKET), F.struct(g(1).alias("series"), g(2).alias("token"), g(3).alias("side"), g(4).cast("double").alias("strike")))


def hour_token_micros(token: Column, zone: str = "America/New_York") -> Column:
    """The instant of an hour token YYMMMDDHH of civil time in ``zone``; null for anything else."""
    t = F.upper(token)
    spelled = F.concat(F.lit("20"), F.substring(t, 1, 2), F.lpad((F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(t, 3, 3))).cast("string"), 2, "0"), F.substring(t, 6, 4), F.lit("Z"))
    return F.when(token.rlike(HOUR_TOKEN), F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(spelled, F.lit("yyyyMMddHHX")), zone)))


def number(text: Column) -> Column:
    """A number written as text; blank, junk, NaN and infinity are null."""
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def epoch_micros(value: Column) -> Column:
    """Microseconds of a Unix time in seconds or milliseconds, told apart by magnitude; null under 1e9."""
    return F.when(value >= 1e12, value * 1000).when(value >= 1e9, value * 1_000_000).cast("bigint")


def first_rule(text: Column, rules: dict[str, str], otherwise: str) -> Column:
    """The name of the first rule whose word the text holds."""
    out = F.lit(otherwise)
    for word, name in reversed(rules.items()):
        out = F.when(F.contains(F.lower(text), F.lit(word)), name).otherwise(out)
    return out


def cells(line: Column) -> Column:
    """The cells of a table row written with bars; an escaped bar belongs to its cell."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


#: Tags of prices and results that were really there.
REAL_TAGS = ("real_ask", "real_bid", "broker_truth")


def tag_or_synthetic(tag: Column) -> Column:
    """The tag if it is a real one, else synthetic."""
    return F.when(tag.isin(*REAL_TAGS), tag).otherwise("synthetic")


def token_day(token: Column) -> Column:
    """Days since 1970 of a token YYMMMDD; null for anything else."""
    t = F.upper(token)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(t, 3, 3)).cast("int")
    day = F.try_to_date(F.concat(F.lit("20"), F.substring(t, 1, 2), F.lpad(month.cast("string"), 2, "0"), F.substring(t, 6, 2)), "yyyyMMdd")
    return F.when(t.rlike(r"^\d{2}[A-Z]{3}\d{2}$"), F.unix_date(day).cast("bigint"))


def clock_micros(token: Column, hhmm: Column) -> Column:
    """The instant of a day token with a time HHMM, read as UTC; null if it is no time."""
    hour, minute = F.substring(hhmm, 1, 2).cast("int"), F.substring(hhmm, 3, 2).cast("int")
    return F.when(hhmm.rlike(r"^([01]\d|2[0-3])[0-5]\d$"), token_day(token) * 86_400_000_000 + (hour * 60 + minute).cast("bigint") * 60_000_000)


def rolled_year(month: Column, ends: Column) -> Column:
    """The year of a month that was reported by the day ``ends``: the year before if the month comes later in the year."""
    return F.year(ends) - (month > F.month(ends)).cast("int")


def half_even(t: Column, width: int) -> Column:
    """The nearest multiple of ``width``, as its number; halves go to the even one."""
    rest = F.pmod(t, F.lit(width))
    whole = F.call_function("div", t - rest, F.lit(width))
    return whole + ((rest * 2 > width) | ((rest * 2 == width) & (F.pmod(whole, F.lit(2)) == 1))).cast("bigint")


def slug(text: Column) -> Column:
    """Small letters and digits, runs of anything else as one dash."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"))


#: Fixed value: SERIES-YYMMMDD, then two team codes and a number.
GAME = r"^([A-Z0-9]+)-(\d{2}[A-Z]{3}\d{2})([A-Z]{3})([A-Z]{3})(\d*)$"


def game(ticker: Column) -> Column:
    """(series, day, away, home, error) of a game's ticker; the parts are empty and error says why if it is none."""
    g = lambda n: F.regexp_extract(ticker, GAME, n)
    return F.struct(g(1).alias("series"), g(2).alias("day"), g(3).alias("away"), g(4).alias("home"), F.when(~ticker.rlike(GAME), "no game").alias("error"))
