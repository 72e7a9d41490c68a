"""Queries of the general data problems: records that fail to parse (4) and points near points or in regions (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators.locate import locate
from spotlake.operators.raw_load import ANNOTATION_LABELS, LAYOUTS, REFERENCE_LABELS, loaded, rejected, structured
from spotlake.operators.scale import stored, table

NEAR_PX = 4.0


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The records, split once: dictionary, hits and broken rows all read the stored fields."""
    parsed = structured(table(spark, d, "raw_rows", "row_id", "file_kind", "file_name", "line_no", "line_text"))
    return stored(parsed.drop("line_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(_parsed(spark, d)).select("row_id", "reason").distinct()


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    """How many records fail for which reason and fault, per kind of file."""
    parsed = _parsed(spark, d)
    bad = rejected(parsed).select("row_id", "reason", F.explode_outer("faults").alias("fault"))
    kinds = parsed.select(F.col("row_id").alias("id"), "file_kind")
    return (
        bad.join(kinds, F.col("row_id").eqNullSafe(F.col("id")))
        .groupBy("file_kind", "reason", "fault")
        .agg(F.countDistinct("row_id").alias("records"))
    )


def p4_loaded_references(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    return loaded(parsed, rejected(parsed).select("row_id"), LAYOUTS[0], keep=("file_name", "line_no"))


def p4_loaded_annotations(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    return loaded(parsed, rejected(parsed).select("row_id"), LAYOUTS[1], keep=("file_name", "line_no"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates", "run_id", "defect_id", "image_id", "centroid_x_px", "centroid_y_px")
    whole = "centroid_x_px is not null and centroid_y_px is not null and not isnan(centroid_x_px) and not isnan(centroid_y_px)"
    return rows.where(whole).distinct().withColumnsRenamed({"centroid_x_px": "x", "centroid_y_px": "y"})


def near_references(spark: SparkSession, d: str, centroids: DataFrame) -> DataFrame:
    runs = table(spark, d, "run_catalog").select("run_id", F.lower("source_image_sha256").alias("key")).where("key is not null").distinct()
    points = centroids.join(runs, "run_id")
    others = table(spark, d, "reference_points").select(
        F.col("reference_id").alias("near_id"), F.lower("source_image_sha256").alias("key"), F.col("x_px").alias("x"), F.col("y_px").alias("y")
    )
    return locate(points, others.distinct(), within=NEAR_PX, pid=("run_id", "defect_id"), rid=("near_id",), slab_height=2 * NEAR_PX)


def around_regions(spark: SparkSession, d: str, centroids: DataFrame) -> DataFrame:
    low, high = F.least, F.greatest
    corners = "x0_px is not null and x1_px is not null and y0_px is not null and y1_px is not null"
    boxes = (
        table(spark, d, "mask_regions")
        .where(corners)
        .select(
            F.col("region_id").alias("near_id"), F.col("image_id").alias("key"),
            low("x0_px", "x1_px").alias("x0"), high("x0_px", "x1_px").alias("x1"),
            low("y0_px", "y1_px").alias("y0"), high("y0_px", "y1_px").alias("y1"),
        )
    )
    return locate(centroids.withColumnRenamed("image_id", "key"), boxes.distinct(), pid=("run_id", "defect_id"), rid=("near_id",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    centroids = stored(_centroids(spark, d))
    return near_references(spark, d, centroids).union(around_regions(spark, d, centroids)).distinct()


QUERIES = {
    "p4_found": p4_found,
    "p4_faults": p4_faults,
    "p4_loaded_references": p4_loaded_references,
    "p4_loaded_annotations": p4_loaded_annotations,
    "p5_found": p5_found,
}

_FIELDS = r"""
rows AS (SELECT row_id, file_kind, file_name, line_no, coalesce(line_text, '') AS t FROM raw_rows),
shaped AS (SELECT *,
    regexp_full_match(t, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS sound,
    len(regexp_replace(t, '(?s)"([^"]|"")*"', 'q', 'g')) - len(replace(regexp_replace(t, '(?s)"([^"]|"")*"', 'q', 'g'), ',', '')) + 1 AS n FROM rows),
fields AS (SELECT *, list_transform(regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
    lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:len(f)-1], '""', '"') ELSE f END) AS f FROM shaped),
cells AS (SELECT *,
    CASE file_kind WHEN 'references' THEN f[2] ELSE f[4] END AS x, CASE file_kind WHEN 'references' THEN f[3] ELSE f[5] END AS y,
    lower(trim(CASE file_kind WHEN 'references' THEN f[4] ELSE f[8] END, E' \t\r\n')) AS label,
    CASE file_kind WHEN 'references' THEN f[7] ELSE f[10] END AS extra FROM fields),
numbers AS (SELECT *, trim(x, E' \t\r\n') AS tx, trim(y, E' \t\r\n') AS ty, trim(extra, E' \t\r\n') AS te FROM cells),
typed AS (SELECT *,
    CASE WHEN regexp_full_match(tx, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(tx AS DOUBLE) END AS vx,
    CASE WHEN regexp_full_match(ty, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(ty AS DOUBLE) END AS vy,
    CASE WHEN regexp_full_match(te, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(te AS DOUBLE) END AS ve FROM numbers),
judged AS (SELECT *, CASE
    WHEN NOT sound THEN 'quoting'
    WHEN n <> CASE file_kind WHEN 'references' THEN 11 WHEN 'annotations' THEN 13 ELSE -1 END OR file_kind IS NULL THEN 'column_count'
    WHEN file_kind = 'references' AND (coalesce(NOT (vx >= 0 AND isfinite(vx)), true) OR coalesce(NOT (vy >= 0 AND isfinite(vy)), true)
        OR label NOT IN ('confirmed_point', 'possible_point', 'uncertain')
        OR te <> '' AND coalesce(NOT (ve >= 0 AND isfinite(ve)), true)) THEN 'invalid_value'
    WHEN file_kind = 'annotations' AND (tx <> '' AND coalesce(NOT (vx >= 0 AND isfinite(vx)), true) OR ty <> '' AND coalesce(NOT (vy >= 0 AND isfinite(vy)), true)
        OR label NOT IN ('confirmed_point', 'line_fragment', 'scratch', 'particle_or_dust', 'detector_artifact', 'large_dark_region', 'possible_point', 'uncertain')
        OR te <> '' AND coalesce(NOT (ve >= 0 AND ve <= 1), true)) THEN 'invalid_value' END AS reason FROM typed)
"""

_NUMBER = "CASE WHEN regexp_full_match(trim({0}, E' \\t\\r\\n'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim({0}, E' \\t\\r\\n') AS DOUBLE) END"


def _typed(layout) -> str:
    out = [f"{_NUMBER.format(f'f[{i + 1}]')} AS {c}" if c in layout.numbers else f"f[{i + 1}] AS {c}" for i, c in enumerate(layout.columns)]
    return f"WITH {_FIELDS} SELECT row_id, file_name, line_no, {', '.join(out)} FROM judged WHERE reason IS NULL AND file_kind = '{layout.kind}'"


def _fault(column: str, text: str, value: str, blank: str, above: str = "false") -> str:
    number = f"regexp_full_match({text}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
    return f"""CASE WHEN {blank} AND {text} = '' THEN NULL WHEN NOT {number} THEN {column} || ': not a number' WHEN {value} IS NULL OR isinf({value}) THEN {column} || ': not finite'
        WHEN {value} < 0 THEN {column} || ': below 0' WHEN {above} THEN {column} || ': above 1' END"""


_ANNOTATED = "file_kind = 'annotations'"
_FAULTS = ", ".join([
    _fault("'x_px'", "tx", "vx", _ANNOTATED), _fault("'y_px'", "ty", "vy", _ANNOTATED),
    f"CASE WHEN CASE WHEN {_ANNOTATED} THEN label NOT IN {ANNOTATION_LABELS} ELSE label NOT IN {REFERENCE_LABELS} END THEN 'label: unknown label' END",
    _fault(f"CASE WHEN {_ANNOTATED} THEN 'review_confidence' ELSE 'registration_rmse_um' END", "te", "ve", "true", f"{_ANNOTATED} AND ve > 1"),
])


SQL = {
    "p4_faults": f"""WITH {_FIELDS}, faults AS (SELECT row_id, file_kind, reason,
        unnest(CASE WHEN reason = 'invalid_value' THEN list_filter([{_FAULTS}], lambda f: f IS NOT NULL) ELSE [NULL] END) AS fault FROM judged WHERE reason IS NOT NULL)
SELECT file_kind, reason, fault, count(DISTINCT row_id) AS records FROM faults GROUP BY ALL""",
    "p4_found": f"WITH {_FIELDS} SELECT DISTINCT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded_references": _typed(LAYOUTS[0]),
    "p4_loaded_annotations": _typed(LAYOUTS[1]),
    "p5_found": """
WITH c AS (SELECT DISTINCT run_id, defect_id, image_id, centroid_x_px AS x, centroid_y_px AS y FROM candidates
    WHERE centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL AND NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px))
SELECT DISTINCT c.run_id, c.defect_id, p.reference_id AS near_id FROM c JOIN run_catalog r ON c.run_id = r.run_id
    JOIN reference_points p ON lower(r.source_image_sha256) = lower(p.source_image_sha256)
    WHERE (c.x - p.x_px) * (c.x - p.x_px) + (c.y - p.y_px) * (c.y - p.y_px) <= 16.0
UNION SELECT DISTINCT c.run_id, c.defect_id, m.region_id FROM c JOIN mask_regions m ON c.image_id = m.image_id
    WHERE c.x >= least(m.x0_px, m.x1_px) AND c.x < greatest(m.x0_px, m.x1_px) AND c.y >= least(m.y0_px, m.y1_px) AND c.y < greatest(m.y0_px, m.y1_px)
    AND m.x0_px IS NOT NULL AND m.x1_px IS NOT NULL AND m.y0_px IS NOT NULL AND m.y1_px IS NOT NULL""",
}
