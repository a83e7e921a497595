"""Fields that are found or not, with the reason: as structs, flat columns and tagged JSON; scores and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons why a field is not there.
NOT_FOUND, NOT_PROVIDED, AMBIGUOUS, UNPARSED = "Not found in source", "Not provided", "Value was ambiguous", "Could not parse value"


def field(value: Column, reason: str | Column = NOT_FOUND) -> Column:
    """A struct of status, value and justification; just one of the last two is there."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.when(value.isNotNull(), "found").otherwise("not_found").alias("status"), value.alias("value"), F.when(value.isNull(), reason).alias("justification"))


def to_columns(column: Column, name: str, prefix: str | None = None, as_json: bool = False) -> dict[str, Column]:
    """Value, status and justification of a field as flat columns; nested values as JSON text."""
    prefix, is_found = prefix or name, column["status"] == "found"
    value = F.to_json(column["value"]) if as_json else column["value"]
    return {f"{name}_json" if as_json else name: F.when(is_found, value), f"{prefix}_status": F.when(is_found, "found").otherwise("not_found"), f"{prefix}_justification": F.when(~F.coalesce(is_found, F.lit(False)), column["justification"])}


def from_columns(status: Column, value: Column, justification: Column, default: Column) -> Column:
    """The field of flat columns: a found one without a value has the default, one without a reason was not found in the source."""
    is_found = F.coalesce(status == "found", F.lit(False))
    return F.struct(
        F.when(is_found, "found").otherwise("not_found").alias("status"),
        F.when(is_found, F.coalesce(value, default)).alias("value"),
        F.when(~is_found, F.coalesce(justification, F.lit(NOT_FOUND))).alias("justification"),
    )


def tagged(column: Column) -> Column:
    """A field as JSON: {"status":"found","value":…} or {"status":"not_found","justification":…}."""
    return F.to_json(column, {"ignoreNullFields": "true"})


def untagged(text: Column, value_type: str) -> Column:
    """The field of tagged JSON; null where status, or what the status asks for, is missing."""
    found = F.from_json(text, f"status string, value {value_type}, justification string")
    good = ((found["status"] == "found") & found["value"].isNotNull()) | ((found["status"] == "not_found") & found["justification"].isNotNull())
    return F.when(good, found)


def clamped(score: Column) -> Column:
    """Within 0 and 1; null stays null."""
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def normal_score(raw: Column, most: Column) -> Column:
    """`raw` in terms of `most`, within 0 and 1; 0 where `most` is not positive."""
    return F.when(most <= 0, 0.0).otherwise(clamped(F.try_divide(raw, most)))


def now_text(now: Column) -> Column:
    """A time as text with microseconds; texts sort as times do. The session's zone must be UTC."""
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def day_of(days: Column) -> Column:
    """The date that is so many days after the first of 1970."""
    return F.date_from_unix_date(days.cast("int"))


def device_id(path: Column) -> Column:
    """A stable name for the store at `path`."""
    return F.concat(F.lit("device-"), F.lower(F.lpad(F.hex(F.xxhash64(path)), 16, "0")))
