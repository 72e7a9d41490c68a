"""Normal forms of the values that identify reviewers, wafers, images and splits, and points in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotlake.operators.scale import trimmed


def word(name: str) -> Column:
    """Trimmed and lower-cased; null if nothing is left."""
    return F.nullif(F.lower(trimmed(name)), F.lit(""))


def split_name(name: str = "split") -> Column:
    """As :func:`word`; train and training are calibration."""
    return F.when(word(name).isin("train", "training"), "calibration").otherwise(word(name))


def wafer_key(name: str = "wafer_id") -> Column:
    """The ASCII letters and digits, upper-cased; null if there are none."""
    return F.nullif(F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit(""))


def image_key(name: str = "image_sha256") -> Column:
    return F.nullif(F.regexp_replace(word(name), "^sha256:", ""), F.lit(""))


def instant(name: str) -> Column:
    """A point in time from ISO-8601 text; text without zone is UTC, unreadable text null."""
    text = trimmed(name)
    return F.when(text.rlike("(?i)(z|utc|[+-][0-9]{2}:?[0-9]{2})\\z"), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
