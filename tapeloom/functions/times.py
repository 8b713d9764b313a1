"""Instants from ISO-8601 strings in extended or basic form, as microseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, time to the minute, optional second and fraction, optional zone.
ISO = (
    r"^\s*(\d{4})-?(\d{2})-?(\d{2})[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*"
    r"([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$"
)


def micros(col: Column | str) -> Column:
    """Microseconds of a time; one without zone, or a date, is read as UTC whatever the session's zone."""
    c = F.col(col) if isinstance(col, str) else col
    days = F.unix_date(c.cast("date")).cast("bigint") * 86_400
    of_day = (F.hour(c.cast("timestamp_ntz")) * 3600 + F.minute(c.cast("timestamp_ntz")) * 60).cast("bigint")
    fraction = (F.extract(F.lit("SECOND"), c.cast("timestamp_ntz")) * 1_000_000).cast("bigint")
    return F.when(F.typeof(c).isin("timestamp_ntz", "date"), (days + of_day) * 1_000_000 + fraction).otherwise(F.unix_micros(c.cast("timestamp")))


def iso_micros(col: Column | str) -> Column:
    """Microseconds of an ISO-8601 string with date and time; no zone means UTC; null where the string is no instant."""
    c = F.col(col) if isinstance(col, str) else col
    spelled = F.replace(F.regexp_replace(F.upper(c), ISO, "$1-$2-$3T$4:$5:$6.$7$8"), F.lit(":."), F.lit(":00."))
    return F.when(c.rlike(ISO), F.unix_micros(F.try_to_timestamp(F.regexp_replace(spelled, r"(T[^Z+-]*)$", "$1Z"))))


def sql_iso_micros(expr: str) -> str:
    """DuckDB twin of :func:`iso_micros`."""
    iso = ISO.replace("'", "''")
    g = lambda n: f"regexp_extract({expr}, '{iso}', {n})"
    zone = f"replace({g(8)}, ':', '')"
    return (
        f"case when regexp_matches({expr}, '{iso}') then "
        f"epoch_us(try_cast({g(1)} || '-' || {g(2)} || '-' || {g(3)} || ' ' || {g(4)} || ':' || {g(5)} || ':' || lpad({g(6)}, 2, '0') as timestamp))"
        f" + cast(rpad(left({g(7)}, 6), 6, '0') as bigint)"
        f" - (case when left({zone}, 1) = '-' then -1 else 1 end) * 60000000 * (case when length({zone}) >= 3 then"
        f" cast(substring({zone}, 2, 2) as bigint) * 60 + (case when length({zone}) >= 5 then cast(substring({zone}, 4, 2) as bigint) else 0 end) else 0 end) end"
    )


def date_key(col: Column | str) -> Column:
    """A calendar day written as YYYY-MM-DD or YYYYMMDD, as the latter; null when blank."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(c, r"[\s-]", "")
    return F.when(F.length(text) > 0, text)


def sql_date_key(expr: str) -> str:
    """DuckDB twin of :func:`date_key`."""
    return rf"nullif(regexp_replace({expr}, '[\s-]', '', 'g'), '')"


def floor_div(value: Column, width: int) -> Column:
    """Integer division rounded down, also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def standard_offset_micros(zone: str, year: int = 2026) -> Column:
    """A zone's offset from UTC in standard time, taken in mid-January."""
    winter = F.to_timestamp(F.lit(f"{year}-01-15 12:00:00"))
    return F.unix_micros(F.from_utc_timestamp(winter, zone)) - F.unix_micros(winter)


def climate_day(t: Column, zone: str) -> Column:
    """Days since 1970 of an instant on a clock that keeps standard time all year."""
    return floor_div(t + standard_offset_micros(zone), 86_400_000_000)
