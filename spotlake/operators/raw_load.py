"""Rows that fail to parse: sound rows come out typed, the others apart with the reason.

A record's structure is read from where its quote characters stand: split at ``"``, the pieces of even position lie
outside quoted fields. Each distinct value of a checked column is cast once; the values that do not pass make a
dictionary of invalid values with reasons, which is joined back to the records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.operators.scale import broadcast_within, stored, trimmed

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

# The columns of the two record layouts.
REFERENCE_COLUMNS = (
    "reference_id", "x_px", "y_px", "label", "reference_method", "registration_status", "registration_rmse_um",
    "source_image_sha256", "reference_image_sha256", "notes", "reference_schema_version",
)
ANNOTATION_COLUMNS = (
    "image_id", "wafer_id", "candidate_id", "x_px", "y_px", "x_mm", "y_mm", "label", "reviewer_id",
    "review_confidence", "notes", "source_image_sha256", "annotation_schema_version",
)
# The labels of each kind of record.
REFERENCE_LABELS = ("confirmed_point", "possible_point", "uncertain")
ANNOTATION_LABELS = (
    "confirmed_point", "line_fragment", "scratch", "particle_or_dust", "detector_artifact", "large_dark_region",
    "possible_point", "uncertain",
)


@dataclass(frozen=True)
class Check:
    """What a column's value must be: a number in [low, high] (``blank``: or nothing), or one of ``labels``."""

    column: str
    low: float = 0.0
    high: float = float("inf")
    blank: bool = False
    labels: tuple[str, ...] = ()

    def fault(self, value: Column) -> Column:
        """The reason against a raw value, null if it is sound."""
        text = trimmed(value)
        if self.labels:
            return F.when(~F.lower(text).isin(*self.labels), F.lit("unknown label"))
        number = F.when(text.rlike(NUMBER), text.try_cast("double"))
        fault = (
            F.when(number.isNull(), F.lit("not a number"))
            .when(F.abs(number) == float("inf"), F.lit("not finite"))
            .when(number < self.low, F.lit(f"below {self.low:g}"))
            .when(number > self.high, F.lit(f"above {self.high:g}"))
        )
        return F.when(text != "", fault) if self.blank else fault


@dataclass(frozen=True)
class Layout:
    kind: str
    columns: tuple[str, ...]
    checks: tuple[Check, ...]
    numbers: tuple[str, ...]


LAYOUTS = (
    Layout(
        "references",
        REFERENCE_COLUMNS,
        (Check("x_px"), Check("y_px"), Check("label", labels=REFERENCE_LABELS), Check("registration_rmse_um", blank=True)),
        ("x_px", "y_px", "registration_rmse_um"),
    ),
    Layout(
        "annotations",
        ANNOTATION_COLUMNS,
        (
            Check("x_px", blank=True), Check("y_px", blank=True), Check("label", labels=ANNOTATION_LABELS),
            Check("review_confidence", high=1.0, blank=True),
        ),
        ("x_px", "y_px", "x_mm", "y_mm", "review_confidence"),
    ),
)


def structured(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, text: str = "line_text", kind: str = "file_kind") -> DataFrame:
    """Add ``structure`` ('quoting', 'column_count' or null) and ``fields`` (null where the structure is broken).

    A null text is an empty record of one field; a kind without layout (or null) has no right number of columns, so
    its records are 'column_count'.
    """
    pieces, n = F.col("__p"), F.size("__p")
    first, last = pieces[0], F.element_at(pieces, -1)
    # The lambdas below see single pieces only: a reference to the whole array would be evaluated once per piece.
    middle = F.when(n >= 3, F.slice(pieces, 2, n - 2)).otherwise(F.array().cast("array<string>"))
    ends_well = lambda p: (p == "") | p.endswith(",")
    starts_well = lambda p: (p == "") | p.startswith(",")
    safe = lambda p: F.replace(p, F.lit("\x01"), F.lit("\x01a"))

    def closed(p: Column, i: Column) -> Column:
        return (i % 2 == 0) | (ends_well(p) & starts_well(p))

    def marked(p: Column, i: Column) -> Column:
        # Inside quotes a comma becomes \x01b, so that splitting at commas leaves it alone; \x01 itself becomes \x01a.
        return F.when(i % 2 == 0, F.replace(safe(p), F.lit(","), F.lit("\x01b"))).when(p == "", F.lit('"')).otherwise(safe(p))

    quoted = (n % 2 == 1) & ends_well(first) & starts_well(last) & F.forall(F.transform(middle, closed), lambda x: x)
    sound = F.when(n == 1, True).otherwise(quoted)
    text_ = F.when(n == 1, safe(first)).otherwise(F.concat(safe(first), F.array_join(F.transform(middle, marked), ""), safe(last)))
    split = F.split(text_, ",", -1)
    plain = F.transform(split, lambda f: F.replace(F.replace(f, F.lit("\x01b"), F.lit(",")), F.lit("\x01a"), F.lit("\x01")))
    expected = F.lit(None).cast("int")
    for layout in layouts:
        expected = F.when(F.col(kind) == layout.kind, len(layout.columns)).otherwise(expected)
    df = df.withColumn("__p", F.split(F.coalesce(F.col(text), F.lit("")), '"', -1)).withColumn("__f", F.when(sound, plain))
    fault = F.when(F.col("__f").isNull(), "quoting").when(~F.coalesce(F.size("__f") == expected, F.lit(False)), "column_count")
    return df.withColumn("structure", fault).withColumn("fields", F.when(fault.isNull(), F.col("__f"))).drop("__p", "__f")


def invalid_values(parsed: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, kind: str = "file_kind") -> DataFrame:
    """The dictionary (kind, column, value, fault): every distinct value of a checked column is cast once."""
    fault = F.lit(None).cast("string")
    for layout in layouts:
        for check in layout.checks:
            at = (F.col("__k") == layout.kind) & (F.col("__c") == check.column)
            fault = F.when(at, check.fault(F.col("__v"))).otherwise(fault)
    return checked_values(parsed, layouts, kind).select("__k", "__c", "__v").distinct().withColumn("fault", fault).where("fault is not null")


def checked_values(parsed: DataFrame, layouts: tuple[Layout, ...], kind: str, *keep: str) -> DataFrame:
    """One row (__k, __c, __v) per record and checked column."""
    values = F.lit(None)
    for layout in layouts:
        own = F.array(
            *[F.struct(F.lit(c.column).alias("c"), F.col("fields")[layout.columns.index(c.column)].alias("v")) for c in layout.checks]
        )
        values = F.when(F.col(kind) == layout.kind, own).otherwise(values)
    rows = parsed.where("fields is not null").select(*keep, F.col(kind).alias("__k"), F.explode(values).alias("__x"))
    return rows.select(*keep, "__k", F.col("__x.c").alias("__c"), F.col("__x.v").alias("__v"))


def rejected(
    parsed: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, key: str = "row_id", kind: str = "file_kind", max_dictionary: int = 200_000
) -> DataFrame:
    """(key, reason, faults) of the records that cannot be loaded; ``faults`` lists 'column: fault'.

    The dictionary is broadcast only up to ``max_dictionary`` entries; beyond, it is joined by shuffle (AQE splits
    values that many records share). Repeated keys give one row per reason; a null key is kept.
    """
    broken = parsed.where("structure is not null").select(key, F.col("structure").alias("reason"), F.array().cast("array<string>").alias("faults"))
    words = broadcast_within(stored(invalid_values(parsed, layouts, kind)), max_dictionary)
    hits = checked_values(parsed, layouts, kind, key).join(words, ["__k", "__c", "__v"])
    wrong = hits.groupBy(key).agg(F.sort_array(F.collect_set(F.concat_ws(": ", "__c", "fault"))).alias("faults"))
    return broken.unionByName(wrong.select(key, F.lit("invalid_value").alias("reason"), "faults"))


def loaded(parsed: DataFrame, bad: DataFrame, layout: Layout, key: str = "row_id", kind: str = "file_kind", keep: tuple[str, ...] = ()) -> DataFrame:
    """The sound records of one layout, typed: numbers as DOUBLE (blank or unreadable free fields: null), text as it stands.

    Rows are matched to ``bad`` by ``key`` (null-safe).
    """
    ids = bad.select(F.col(key).alias("__id"))
    rows = parsed.where((F.col(kind) == layout.kind) & F.col("fields").isNotNull()).join(ids, F.col(key).eqNullSafe(F.col("__id")), "left_anti")
    out = []
    for i, name in enumerate(layout.columns):
        value = F.col("fields")[i]
        text = trimmed(value)
        out.append((F.when(text.rlike(NUMBER), text.try_cast("double")) if name in layout.numbers else value).alias(name))
    return rows.select(key, *keep, *out)
