"""Dates, times and date-times with offsets, parsed and written by column expressions. Bad input gives null."""

from __future__ import annotations

from pyspark.sql import functions as F

_DATE, _TIME, _ZONE = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?", r"(Z|[+-]\d{2}:\d{2})"


def _part(c, pattern, i):
    return F.regexp_extract(c, pattern, i)


def offset_minutes(zone):
    """Minutes of `Z`, `+HH:MM` or `-HH:MM`, to 24:00 at most; empty is 0."""
    h, m = F.substring(zone, 2, 2).cast("int"), F.substring(zone, 5, 2).cast("int")
    away = h * 60 + m
    return F.when(zone.isin("", "Z"), F.lit(0)).when((m < 60) & (away <= 1440), F.when(zone.startswith("-"), -away).otherwise(away)).cast("smallint")


def _days(c, pattern):
    return F.datediff(F.try_to_date(F.concat_ws("-", *(_part(c, pattern, i) for i in (1, 2, 3))), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))


def _micros(c, pattern, first):
    h, m, s = (_part(c, pattern, first + i).cast("int") for i in range(3))
    frac = F.rpad(F.substring(_part(c, pattern, first + 3), 1, 6), 6, "0").cast("int")
    whole = ((h * 60 + m) * 60 + s).cast("long") * 1_000_000 + F.coalesce(frac, F.lit(0))
    return F.when((h < 24) & (m < 60) & (s < 60), whole)


def parse_date(c):
    """struct<days, offset_min> of YYYY-MM-DD with an optional offset."""
    p = f"^{_DATE}{_ZONE}?$"
    days, off = _days(c, p), offset_minutes(_part(c, p, 4))
    return F.when(c.rlike(p) & days.isNotNull() & off.isNotNull(), F.struct(days.alias("days"), off.alias("offset_min")))


def parse_time(c):
    """struct<time_us, offset_min>; the offset is required, digits beyond microseconds are cut."""
    p = f"^{_TIME}{_ZONE}$"
    us, off = _micros(c, p, 1), offset_minutes(_part(c, p, 5))
    return F.when(c.rlike(p) & us.isNotNull() & off.isNotNull(), F.struct(us.alias("time_us"), off.alias("offset_min")))


def parse_datetime(c):
    """struct<epoch_us, offset_min>: microseconds of UTC, and the offset it was written with."""
    p = f"^{_DATE}[T ]{_TIME}{_ZONE}$"
    days, us, off = _days(c, p), _micros(c, p, 4), offset_minutes(_part(c, p, 8))
    epoch = days.cast("long") * 86_400_000_000 + us - off.cast("long") * 60_000_000
    return F.when(c.rlike(p) & epoch.isNotNull(), F.struct(epoch.alias("epoch_us"), off.alias("offset_min")))


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


def format_offset(off):
    away = F.abs(off.cast("int"))
    return F.when(off == 0, F.lit("Z")).otherwise(F.concat(F.when(off < 0, F.lit("-")).otherwise(F.lit("+")), _two(F.floor(away / 60)), F.lit(":"), _two(away % 60)))


def _clock(us):
    s, frac = F.floor(us / 1_000_000), F.lpad((us % 1_000_000).cast("string"), 6, "0")
    text = F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s / 60) % 60), _two(s % 60))
    return F.when(us % 1_000_000 == 0, text).otherwise(F.concat(text, F.lit("."), F.regexp_replace(frac, "0+$", "")))


def format_date(d):
    return F.concat(F.date_format(F.date_from_unix_date(d["days"]), "yyyy-MM-dd"), format_offset(d["offset_min"]))


def format_time(t):
    return F.concat(_clock(t["time_us"]), format_offset(t["offset_min"]))


def format_datetime(t):
    local = t["epoch_us"] + t["offset_min"].cast("long") * 60_000_000
    day = F.floor(local / 86_400_000_000)
    return F.concat(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"), F.lit("T"), _clock(F.pmod(local, F.lit(86_400_000_000))), format_offset(t["offset_min"]))


def time_sort_key(t):
    return F.struct((t["time_us"] - t["offset_min"].cast("long") * 60_000_000).alias("utc_us"), t["offset_min"].alias("offset_min"))
