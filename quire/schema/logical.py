"""Logical types: what each accepts, and a key that sorts its values.

Acceptance is a Column expression for every type. Sort keys are structs, since Spark has no type for a leap second,
a time with an offset, or a decimal of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"(\d{4})-(\d{2})-(\d{2})"
CLOCK = r"([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)(\.\d+)?"
OFFSET = r"([Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
TIME_UNITS = r"\d+H(?:\d+M(?:\d+S)?)?|\d+M(?:\d+S)?|\d+S"
DATE_UNITS = r"\d+Y(?:\d+M(?:\d+D)?)?|\d+M(?:\d+D)?|\d+D"
DURATION = rf"(?i)^P(?:(?:{DATE_UNITS})(?:T(?:{TIME_UNITS}))?|T(?:{TIME_UNITS})|\d+W)$"
DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"
INTEGER = r"^-?(?:0|[1-9][0-9]*)$"
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"
URI_CHAR = r"(?:[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]|%[0-9A-Fa-f]{2})"
URI = rf"^[A-Za-z][A-Za-z0-9+.-]*:{URI_CHAR}*$"
URI_REFERENCE = rf"^{URI_CHAR}*$"

#: Types whose columns Spark compares itself.
NATIVE = {"date": "date", "timestamp": "timestamp", "int64": "bigint"}


def _day(text: Column) -> Column:
    """Whether the first ten characters are a day of the calendar."""
    return F.substring(text, 1, 10).try_cast("date").isNotNull() & ~text.startswith("0000")


def _minute_utc(clock: Column, offset: Column) -> Column:
    """Minutes of the day, in UTC, from hh:mm and an offset."""
    local = F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")
    shift = F.when(F.lower(offset) == "z", F.lit(0)).otherwise(F.when(F.substring(offset, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1)) * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")))
    return F.pmod(local - shift, F.lit(1440))


def _clock_ok(time: Column) -> Column:
    """A leap second only in the last minute of the UTC day."""
    offset = F.regexp_extract(time, OFFSET + "$", 1)
    return (F.substring(time, 7, 2) != "60") | (_minute_utc(time, offset) == 1439)


def is_date(text: Column) -> Column:
    return F.when(text.rlike(f"^{DATE}$"), _day(text)).otherwise(F.lit(False))


def is_time(text: Column) -> Column:
    return F.when(text.rlike(f"^{CLOCK}{OFFSET}$"), _clock_ok(text)).otherwise(F.lit(False))


def is_date_time(text: Column) -> Column:
    return F.when(text.rlike(f"^{DATE}[Tt]{CLOCK}{OFFSET}$"), _day(text) & _clock_ok(F.substring(text, 12, F.length(text)))).otherwise(F.lit(False))


def is_local_date_time(text: Column) -> Column:
    return F.when(text.rlike(f"^{DATE}[Tt ]{CLOCK}$"), _day(text)).otherwise(F.lit(False))


def is_duration(text: Column) -> Column:
    return text.rlike(DURATION)


def is_int64(text: Column) -> Column:
    return text.rlike(INTEGER) & text.try_cast("bigint").isNotNull()


#: Type -> acceptance test of a string.
ACCEPTS: dict[str, Callable[[Column], Column]] = {
    "date": is_date,
    "time": is_time,
    "date-time": is_date_time,
    "local-date-time": is_local_date_time,
    "duration": is_duration,
    "int64": is_int64,
    "bigint": lambda t: t.rlike(INTEGER),
    "decimal": lambda t: t.rlike(DECIMAL),
    "uri": lambda t: t.rlike(URI),
    "uri-reference": lambda t: t.rlike(URI_REFERENCE),
    "email": lambda t: t.rlike(EMAIL),
    "uuid": lambda t: t.rlike(UUID),
}


def _fraction(text: Column) -> Column:
    """The fraction's digits without trailing zeros, so that equal fractions are equal texts in order."""
    return F.regexp_replace(F.regexp_extract(text, r":\d{2}\.(\d+)", 1), "0+$", "")


def date_time_key(text: Column) -> Column:
    """(minute since 1970 in UTC, second up to 60, fraction): a leap second sorts after second 59."""
    time = F.substring(text, 12, F.length(text))
    day = F.datediff(F.substring(text, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date"))
    offset = F.regexp_extract(text, OFFSET + "$", 1)
    local = F.substring(time, 1, 2).try_cast("int") * 60 + F.substring(time, 4, 2).try_cast("int")
    sign = F.when(F.substring(offset, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    shift = F.when((F.lower(offset) == "z") | (offset == ""), F.lit(0)).otherwise(sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")))
    return F.struct((day.cast("long") * 1440 + local - shift).alias("minute"), F.substring(time, 7, 2).try_cast("int").alias("second"), _fraction(text).alias("fraction"))


def time_key(text: Column) -> Column:
    """(minute of the UTC day, second, fraction)."""
    offset = F.regexp_extract(text, OFFSET + "$", 1)
    return F.struct(_minute_utc(text, offset).alias("minute"), F.substring(text, 7, 2).try_cast("int").alias("second"), _fraction(text).alias("fraction"))


def integer_key(digits: Column) -> Column:
    """(sign, length, digits) of an integer of any length; negative numbers are complemented so that text order holds."""
    negative = digits.startswith("-") & (digits != "-0")
    plain = F.regexp_replace(digits, "^-", "")
    size = F.length(plain)
    return F.struct(F.when(negative, -1).otherwise(1).alias("sign"), F.when(negative, -size).otherwise(size).alias("size"), F.when(negative, F.translate(plain, "0123456789", "9876543210")).otherwise(plain).alias("digits"))


def decimal_key(text: Column) -> Column:
    """(sign, digits before the point, all digits) of a decimal of any length."""
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)$", 1), "0+$", "")
    zero = (whole == "") & (part == "")
    negative = text.startswith("-") & ~zero
    size = F.length(whole)
    digits = F.concat(whole, F.lit("."), part)
    # The final mark makes a shorter negative fraction sort after a longer one.
    flipped = F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~"))
    return F.struct(F.when(negative, -1).when(zero, 0).otherwise(1).alias("sign"), F.when(negative, -size).otherwise(size).alias("size"), F.when(negative, flipped).otherwise(digits).alias("digits"))


def duration_key(text: Column) -> Column:
    """Seconds of a duration without years and months; null with them, as such durations have no order."""
    unit = lambda letter, part: F.coalesce(F.regexp_extract(part, rf"(\d+){letter}", 1).try_cast("decimal(30,0)"), F.lit(0))
    up = F.upper(text)
    days, clock = F.regexp_replace(up, "T.*$", ""), F.when(up.contains("T"), F.regexp_extract(up, "T(.*)$", 1)).otherwise(F.lit(""))
    seconds = unit("W", days) * 604800 + unit("D", days) * 86400 + unit("H", clock) * 3600 + unit("M", clock) * 60 + unit("S", clock)
    return F.when(~days.rlike("[YM]"), seconds)


#: Type -> key that sorts accepted strings.
KEYS: dict[str, Callable[[Column], Column]] = {
    "time": time_key,
    "date-time": date_time_key,
    "local-date-time": date_time_key,
    "bigint": integer_key,
    "decimal": decimal_key,
    "duration": duration_key,
}
