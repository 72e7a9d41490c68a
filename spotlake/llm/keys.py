"""The normal form of a source's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotlake.functions.names import word


def source_key(name: str = "source") -> Column:
    """One spelling per source: lower case, words joined by underscores."""
    return F.regexp_replace(word(name), "[-\\s]+", "_")
