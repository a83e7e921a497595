"""Durations and counts in text, as column expressions; out-of-range values are null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST = (1 << 32) - 1


def _count(text: Column) -> Column:
    """A plain non-negative integer of 32 bits, without spaces."""
    value = F.when(text.rlike(r"^\+?[0-9]+$"), text).try_cast("bigint")
    return F.when(value <= _MOST, value)


def iso_minutes(text: Column) -> Column:
    """Minutes of PT followed by numbers with unit H, M or S in any order."""

    def part(x: Column) -> Column:
        n = F.regexp_replace(x, "[HMS]$", "").try_cast("double")
        return F.when(x.endswith("H"), F.floor(n * 60)).when(x.endswith("M"), F.floor(n)).otherwise(F.round(n / 60)).cast("bigint")

    parts = F.regexp_extract_all(text, F.lit("[0-9.]+[HMS]"), 0)
    return F.when(text.rlike(r"^PT([0-9.]+[HMS])+$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, x: total + part(x)))


def flexible_minutes(text: Column) -> Column:
    """ISO form, else an integer, else all digits together, times 60 where "hour" stands."""
    text = F.trim(text)
    digits = _count(F.regexp_replace(text, "[^0-9]", ""))
    return F.coalesce(iso_minutes(text), _count(text), F.when(F.lower(text).contains("hour"), digits * 60).otherwise(digits))


def import_minutes(text: Column) -> Column:
    """Whole hours before the first H, then minutes that end with M; null if neither is there."""
    text = F.regexp_replace(text, "^(PT)+", "")
    hours = _count(F.regexp_extract(text, "^([^H]*)H", 1)) * 60
    rest = F.when(text.contains("H"), F.regexp_extract(text, "^[^H]*H(.*)M$", 1)).otherwise(F.regexp_extract(text, "^(.*)M$", 1))
    minutes = _count(rest)
    return F.coalesce(hours + minutes, hours, minutes)


def leading_number(text: Column) -> Column:
    """The number a text begins with; no space may precede it."""
    return F.regexp_extract(text, "^[0-9.]*", 0).try_cast("double")


def export_minutes(minutes: Column) -> Column:
    return F.concat(F.lit("PT"), minutes.cast("string"), F.lit("M"))


def first_token(text: Column) -> Column:
    """What stands before the first white space that follows anything else."""
    return F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)


def first_count(text: Column) -> Column:
    """The first token as a non-negative integer of 32 bits."""
    return _count(first_token(text))


def first_float(text: Column) -> Column:
    """The first token as a number."""
    token = F.lower(first_token(text))
    number = F.when(token.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"), F.regexp_replace(token, "^[+-](?=nan)", ""))
    return number.try_cast("double")


def plain(number: Column) -> Column:
    """A number in decimal digits, without an exponent; integral ones without a point."""
    text = F.regexp_replace(F.regexp_replace(number.cast("string"), "Infinity", "inf"), r"\.0(?=E|$)", "")
    sign, digits = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(F.regexp_extract(text, "^-?([0-9.]+)E", 1), r"\.", "")
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.greatest(power, F.length(digits) - 1)
    padded = F.rpad(digits, whole + 1, "0")
    large = F.concat(F.substring(padded, F.lit(1), power + 1), F.when(whole > power, F.concat(F.lit("."), F.substring(padded, power + 2, whole - power))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.when(power.isNull(), text).otherwise(F.concat(sign, F.when(power < 0, small).otherwise(large)))


def with_unit(number: Column, unit: str) -> Column:
    return F.concat(plain(number), F.lit(f" {unit}"))
