"""Dates as ISO text. Nothing here depends on the session time zone."""

from pyspark.sql import Column, functions as F

from recollect import fixed
from recollect.functions.text import col, nz, strip

MICROS = 1_000_000
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?"
_ZONE = r"(?:[+-]\d{2}:\d{2})$"


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _div(a: Column, n: int) -> Column:
    """Whole division of non-negative longs, without going through doubles."""
    return F.call_function("div", a, F.lit(n))


def iso_utc(micros) -> Column:
    """Microseconds since 1970 as ISO text in UTC; the fraction only when it is not zero.

    Each part stands once: a generated method of over 8000 bytes isn't compiled by the JVM, and this one is part of every entry's.
    """
    us = col(micros).cast("bigint")
    frac = F.pmod(us, F.lit(MICROS))
    secs = F.call_function("div", us - frac, F.lit(MICROS))
    of_day = F.pmod(secs, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", secs - of_day, F.lit(86400)).cast("int"))
    fraction = F.when(frac == 0, "").otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
    return F.concat(day.cast("string"), F.lit("T"), _two(_div(of_day, 3600)), F.lit(":"),
                    _two(_div(of_day % 3600, 60)), F.lit(":"), _two(of_day % 60), fraction, F.lit("+00:00"))


def mtime_iso(mtime_ns) -> Column:
    """File time in nanoseconds to ISO text; NULL unless positive."""
    ns = col(mtime_ns)
    us = F.round(ns.cast("double") / 1e9 * MICROS).cast("bigint")
    return F.when(ns > 0, iso_utc(us))


def apple_iso(raw) -> Column:
    """Seconds or nanoseconds since 2001 to ISO text; NULL for NULL, 0 and dates out of range."""
    v = col(raw).cast("double")
    secs = F.when(F.abs(v) > fixed.APPLE_NS_ABOVE, v / 1e9).otherwise(v)
    us = F.round(secs * MICROS).cast("bigint") + fixed.APPLE_EPOCH_S * MICROS
    in_range = us.between(-62_135_596_800 * MICROS, 253_402_300_799 * MICROS)
    return F.when(v.isNotNull() & (v != 0) & (F.abs(secs) < 4e11) & in_range, iso_utc(us))


def local_datetime(iso) -> Column:
    """``MM/DD/YYYY h:MM am TZ`` in the display time zone; text that is no date stays as it is."""
    s = strip(nz(iso))
    text = F.replace(s, F.lit("Z"), F.lit("+00:00"))
    text = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(
        F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})($|[+-])", "$1:00$2"))
    zoned = F.when(text.rlike(_ISO + _ZONE), text).when(text.rlike(_ISO + "$"), F.concat(text, F.lit("+00:00")))
    us = F.unix_micros(F.try_to_timestamp(zoned))
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.floor(us / MICROS).cast("decimal(18,6)"))
    here = F.convert_timezone(F.lit("UTC"), F.lit(fixed.LOCAL_TIMEZONE), utc)
    hour = F.hour(here)
    behind = F.pmod(F.hour(utc) - hour, F.lit(24))
    out = F.concat(
        _two(F.month(here)), F.lit("/"), _two(F.dayofmonth(here)), F.lit("/"), F.lpad(F.year(here).cast("string"), 4, "0"),
        F.lit(" "), F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":"), _two(F.minute(here)),
        F.when(hour < 12, F.lit(" am ")).otherwise(F.lit(" pm ")),
        F.when(behind == 7, F.lit("PDT")).otherwise(F.lit("PST")))
    return F.when(s == "", F.lit("")).otherwise(F.coalesce(out, s))


def elapsed(seconds) -> Column:
    """``Ns``, ``Mm Ss`` or ``Hh Mm``."""
    sec = col(seconds).cast("double")
    whole = F.floor(sec)
    m = _div(whole, 60)
    part = lambda v, unit: F.concat(v.cast("bigint").cast("string"), F.lit(unit))
    return (F.when(sec < 60, part(F.bround(sec), "s"))
            .when(m < 60, F.concat(part(m, "m "), part(whole % 60, "s")))
            .otherwise(F.concat(part(_div(m, 60), "h "), part(m % 60, "m"))))
