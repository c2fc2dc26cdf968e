"""Scalar expressions: parsing, classification, time blocks, percentages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlytics.schema import (
    BLOCK_HOURS,
    BLOCK_STARTS,
    FAILURE_STATES,
    SUCCESS_STATES,
    UNKNOWN_PROJECT,
    block_label,
)


#: What becomes _ in names of files and folders; reads the same in Python and, with (?U), in Java.
NOT_IN_NAMES = r"[^\w-]"


def integer_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


_ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
_ISO_TIME = r"[T ]\d{1,2}(?::\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?"
_OFFSET = r"Z|[+-]\d{2}:?\d{2}"
_TIMED_OFFSET = rf"({_ISO_TIME})(?:{_OFFSET})$"


def is_success(state: Column) -> Column:
    return F.coalesce(F.upper(state).isin(SUCCESS_STATES), F.lit(False))


def is_failure(state: Column) -> Column:
    return F.coalesce(F.upper(state).isin(FAILURE_STATES), F.lit(False))


def is_snippet(scan_type: Column) -> Column:
    return F.coalesce(F.contains(F.upper(scan_type), F.lit("SNIPPET")), F.lit(False))


def project_label(project: Column, version: Column) -> Column:
    return F.coalesce(project, version, F.lit(UNKNOWN_PROJECT))


def parse_hour(text: Column, formats: Sequence[str] = ()) -> Column:
    """Text to a zone-free timestamp in UTC; null where neither ISO nor any given format fits.

    ISO means a full date, with or without a time; a bare number is no date. An offset such as ``+02:00`` or ``Z``
    is taken into account. Formats are read through the session zone, so keep that at UTC when giving any.
    """
    text = F.trim(text)
    offset = F.regexp_extract(text, f"^{_ISO_DATE}{_ISO_TIME}({_OFFSET})$", 1)
    local = F.when(text.rlike(f"^{_ISO_DATE}({_ISO_TIME})?({_OFFSET})?$"), F.regexp_replace(text, f"{_TIMED_OFFSET}", "$1"))
    hours = F.regexp_extract(offset, r"(\d{2}):?\d{2}$", 1).try_cast("int")
    minutes = F.regexp_extract(offset, r"\d{2}:?(\d{2})$", 1).try_cast("int")
    ahead = F.coalesce(hours * 60 + minutes, F.lit(0)) * F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    parsed = [local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=ahead)]
    parsed += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*parsed)


def floor_hour(ts: Column) -> Column:
    """Start of the hour. Built from the fields because date_trunc would pass through the session zone."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def iso_hour(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 19)


def whole_number(text: Column) -> Column:
    """Text to bigint, taking ``3.0`` for 3 and anything unreadable for null."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def is_whole(text: Column) -> Column:
    """Whether text reads as a whole number, ``3.0`` included and ``3.7`` not."""
    return F.coalesce(text.try_cast("double") == whole_number(text), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, half up, in integer arithmetic; null when whole is 0."""
    whole = F.nullif(whole, F.lit(0))
    tenths = integer_div(part * 2000 + whole, whole * 2)
    return tenths.cast("double") / F.lit(10.0)


def block_start(ts: Column) -> Column:
    return integer_div(F.hour(ts), F.lit(BLOCK_HOURS)).cast("int") * BLOCK_HOURS


def block_order(start: Column) -> Column:
    """0 for the block that starts at 06:00, up to 7 for the one that starts at 03:00."""
    first = F.lit(24 - BLOCK_STARTS[0])
    return integer_div((start + first) % 24, F.lit(BLOCK_HOURS)).cast("int")


def block_name(start: Column) -> Column:
    names = F.array(*[F.lit(block_label(s)) for s in sorted(BLOCK_STARTS)])
    return F.element_at(names, integer_div(start, F.lit(BLOCK_HOURS)).cast("int") + 1)


def hour_class(sph: Column, capacity: int, effective: int, normal: str | None = None) -> Column:
    label = F.when(sph >= capacity, "BREACH").when(sph >= effective, "WARNING")
    return label if normal is None else label.otherwise(normal)


def snippet_severity(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "none").when(pct >= 50, "red").when(pct >= 25, "amber").otherwise("green")
    )


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, f"(?U){NOT_IN_NAMES}", "_")
