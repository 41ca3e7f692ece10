"""Checks and small functions on values, as column expressions where Spark has the means."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The position alphabet in byte order, and the longest position.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MAX_POSITION = 64


def position_valid(c):
    return F.coalesce(c.rlike("^[0-9A-Za-z]{1,64}$"), F.lit(False))


def midpoint(low: str, high: str = "zzzz") -> str:
    """The shortest position half-way between two, rounded up. ValueError if 64 characters aren't enough."""
    if not low < high:
        raise ValueError("positions are not in order")

    def number(p: str, n: int) -> int:  # the first n digits
        out = 0
        for c in p[:n].ljust(n, ALPHABET[0]):
            out = out * 62 + ALPHABET.index(c)
        return out

    for n in range(1, MAX_POSITION + 1):
        middle, digits = (number(low, n) + number(high, n) + 1) // 2, ""
        for _ in range(n):
            middle, d = divmod(middle, 62)
            digits = ALPHABET[d] + digits
        if low < digits < high:
            return digits
    raise ValueError("no position of 64 characters fits; reorder explicitly")


@F.pandas_udf(T.StringType())
def midpoints(low: pd.Series, high: pd.Series) -> pd.Series:
    """midpoint() of columns; null beside a null."""
    return pd.Series([None if a is None or b is None else midpoint(a, b) for a, b in zip(low, high, strict=True)], dtype=object)


def bytes_for_dims(sub_type, dims):
    return F.when(sub_type == 0, dims * 4).when(sub_type == 1, dims).when(sub_type == 2, F.ceil(dims / 8).cast("int"))


def decimal_normal(exponent, mantissa):
    """Zero has exponent 0; no other mantissa ends in 0."""
    return F.when(mantissa == 0, exponent == 0).otherwise(mantissa % 10 != 0)


def decimal_value(exponent, mantissa, scale: int = 18):
    return F.concat(mantissa.cast("string"), F.lit("E"), exponent.cast("string")).try_cast(f"decimal(38,{scale})")


def point_valid(lat, lon):
    return lat.between(-90, 90) & lon.between(-180, 180)


def rect_contains(r, lat, lon):
    """A rectangle whose least longitude is greater than its greatest spans the antimeridian."""
    across = r["min_lon"] > r["max_lon"]
    inside = F.when(across, (lon >= r["min_lon"]) | (lon <= r["max_lon"])).otherwise(lon.between(r["min_lon"], r["max_lon"]))
    return lat.between(r["min_lat"], r["max_lat"]) & inside


def rect_intersects(a, b):
    def spans(r):
        return F.when(r["min_lon"] > r["max_lon"], F.array(F.array(r["min_lon"], F.lit(180.0)), F.array(F.lit(-180.0), r["max_lon"]))).otherwise(F.array(F.array(r["min_lon"], r["max_lon"])))

    meets = F.exists(spans(a), lambda x: F.exists(spans(b), lambda y: (x[0] <= y[1]) & (y[0] <= x[1])))
    return (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"]) & meets


def value_error(v):
    """Error code of a value, or null: E005 for what is out of its type's bounds."""
    t, bad = v["data_type"], F.lit("E005")
    return (
        F.when((t == 3) & F.isnan(v["f64"]), bad)
        .when((t == 4) & v["dec"]["mantissa_i64"].isNotNull() & ~decimal_normal(v["dec"]["exponent"], v["dec"]["mantissa_i64"]), bad)
        .when((t == 7) & ~v["date"]["offset_min"].between(-1440, 1440), bad)
        .when((t == 8) & ~(v["time"]["offset_min"].between(-1440, 1440) & v["time"]["time_us"].between(0, 86_399_999_999)), bad)
        .when((t == 9) & ~v["datetime"]["offset_min"].between(-1440, 1440), bad)
        .when((t == 11) & ~point_valid(v["point"]["lat"], v["point"]["lon"]), bad)
        .when((t == 12) & ~(point_valid(v["rect"]["min_lat"], v["rect"]["min_lon"]) & point_valid(v["rect"]["max_lat"], v["rect"]["max_lon"])), bad)
        .when((t == 13) & (F.octet_length(v["embedding"]["data"]) != bytes_for_dims(v["embedding"]["sub_type"], v["embedding"]["dims"])), bad)
    )


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embedding_unpack(sub_type: pd.Series, dims: pd.Series, data: pd.Series) -> pd.Series:
    """Numbers of a packed embedding: f32, i8, or bits (least significant first) as 0 and 1."""
    import numpy as np

    def one(s, n, d):
        raw = np.frombuffer(d, np.uint8)
        return np.frombuffer(d, "<f4") if s == 0 else raw.view(np.int8).astype(np.float32) if s == 1 else np.unpackbits(raw, bitorder="little")[:n].astype(np.float32)

    return pd.Series([None if d is None else one(s, n, d) for s, n, d in zip(sub_type, dims, data, strict=True)])


#: Recurrence parts that a schedule line may have (fixed values of RFC 5545).
_RULE_PARTS = "FREQ|UNTIL|COUNT|INTERVAL|BYSECOND|BYMINUTE|BYHOUR|BYDAY|BYMONTHDAY|BYYEARDAY|BYWEEKNO|BYMONTH|BYSETPOS|WKST"


def schedule_valid(c):
    """Whether a text is a recurrence rule: known parts, each once, FREQ present, UNTIL and COUNT not both."""
    rule = F.regexp_replace(c, "^RRULE:", "")
    shape = rule.rlike(rf"^({_RULE_PARTS})=[A-Z0-9,+-]+(;({_RULE_PARTS})=[A-Z0-9,+-]+)*$")
    names = F.transform(F.split(rule, ";"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    freq = rule.rlike("(^|;)FREQ=(SECONDLY|MINUTELY|HOURLY|DAILY|WEEKLY|MONTHLY|YEARLY)(;|$)")
    both = F.array_contains(names, "UNTIL") & F.array_contains(names, "COUNT")
    return F.coalesce(shape & freq & ~both & (F.size(F.array_distinct(names)) == F.size(names)), F.lit(False))
