"""Queries of problem 3: percentiles of candidate sizes and distances per wafer, run and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm.percentiles import halvings, joined, percentiles, summary
from spotlake.operators.scale import stored, table

RELATIVE = 0.01
INFINITY = float("inf")


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, wafer_id, day, three metrics) once per candidate; stored values that are no measurement are null.

    A size is a measurement if it is finite and above 0. A distance of 0 is one only for a candidate in the very centre.
    """
    rows = table(
        spark, d, "candidates", "run_id", "defect_id", "wafer_id", "measured_at", "x_mm", "y_mm",
        "equivalent_diameter_um", "area_mm2", "radial_distance_mm",
    ).distinct()
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < INFINITY)
    size = lambda c: F.when(finite(c) & (F.col(c) > 0), F.col(c))
    r = "radial_distance_mm"
    centre = (F.col(r) == 0) & (F.col("x_mm") == 0) & (F.col("y_mm") == 0)
    return rows.select(
        "run_id", "wafer_id", F.to_date("measured_at").alias("day"), size("equivalent_diameter_um").alias("equivalent_diameter_um"),
        size("area_mm2").alias("area_mm2"), F.when(finite(r) & ((F.col(r) > 0) | centre), F.col(r)).alias(r),
    )


METRICS = ("equivalent_diameter_um", "area_mm2", "radial_distance_mm")


def _long(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row (kind, group, metric, value) per measurement and kind of group."""
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("grp")) for k, c in kinds.items()])
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return rows.select(F.explode(values).alias("v"), groups.alias("g")).where("v.value is not null").select("v.*", F.inline("g"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per wafer, run and day."""
    rows = stored(measurements(spark, d))
    return percentiles(_long(rows, {"wafer": "wafer_id", "run": "run_id", "day": "day"}), ["kind", "grp", "metric"])


def p3_day_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day, wafer and metric between fixed midpoints; joined later by adding them up."""
    rows = measurements(spark, d)
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return summary(rows.select("day", "wafer_id", F.inline(values)), ["day", "wafer_id", "metric"], RELATIVE).withColumn("middle", F.round("middle", 12))


def p3_joined_months(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per month from the joined summaries of its days, within ``RELATIVE`` of the exact ones."""
    days = p3_day_summaries(spark, d).withColumn("month", F.date_format("day", "yyyy-MM"))
    months = stored(joined(days, ["month", "metric"]))
    found = percentiles(months, ["month", "metric"], value="middle", weight="n")
    return found.select("month", "metric", "per_mille", "n", F.round("value", 9).alias("value"), F.round(F.abs("value") * RELATIVE / (1 - RELATIVE), 9).alias("error"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_day_summaries, p3_joined_months)}

_MEASURED = """c AS (SELECT DISTINCT run_id, defect_id, wafer_id, measured_at, x_mm, y_mm, equivalent_diameter_um AS e, area_mm2 AS a, radial_distance_mm AS r FROM candidates),
m AS (SELECT wafer_id, CAST(measured_at AS DATE) AS day, 'equivalent_diameter_um' AS metric, e AS value FROM c WHERE isfinite(e) AND e > 0
    UNION ALL SELECT wafer_id, CAST(measured_at AS DATE), 'area_mm2', a FROM c WHERE isfinite(a) AND a > 0
    UNION ALL SELECT wafer_id, CAST(measured_at AS DATE), 'radial_distance_mm', r FROM c WHERE isfinite(r) AND (r > 0 OR r = 0 AND x_mm = 0 AND y_mm = 0))"""
_STEP = f"(ln(2) / {2 ** halvings(RELATIVE)})"
_SUMMED = f"""{_MEASURED}, d AS (SELECT day, wafer_id, metric, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(value) / {_STEP})::INT + 1000000 END AS edge, count(*) AS n FROM m GROUP BY 1, 2, 3, 4),
s AS (SELECT day, wafer_id, metric, edge::INT AS edge, n, round(CASE WHEN edge = 0 THEN 0 ELSE exp((edge - 1000000) * {_STEP}) * (1 - {RELATIVE}) END, 12) AS middle FROM d)"""

SQL = {
    "p3_day_summaries": f"WITH {_SUMMED} SELECT * FROM s",
    "p3_joined_months": f"""WITH {_SUMMED}, j AS (SELECT strftime(day, '%Y-%m') AS month, metric, middle, sum(n) AS n FROM s GROUP BY 1, 2, 3),
u AS (SELECT *, sum(n) OVER (PARTITION BY month, metric ORDER BY middle) AS upto, sum(n) OVER (PARTITION BY month, metric) AS total FROM j), p AS (SELECT unnest([50, 250, 500, 750, 950, 990]) AS per_mille)
SELECT month, metric, per_mille, total::BIGINT AS n, round(middle, 9) AS value, round(middle * {RELATIVE} / (1 - {RELATIVE}), 9) AS error FROM u, p
    WHERE upto >= greatest(1, (total * per_mille + 999) // 1000) AND upto - n < greatest(1, (total * per_mille + 999) // 1000)""",
    "p3_percentiles": """
WITH c AS (SELECT DISTINCT run_id, defect_id, wafer_id, measured_at, x_mm, y_mm, equivalent_diameter_um AS e, area_mm2 AS a, radial_distance_mm AS r FROM candidates),
m AS (SELECT run_id, wafer_id, CAST(CAST(measured_at AS DATE) AS VARCHAR) AS day, 'equivalent_diameter_um' AS metric, e AS value FROM c WHERE isfinite(e) AND e > 0
    UNION ALL SELECT run_id, wafer_id, CAST(CAST(measured_at AS DATE) AS VARCHAR), 'area_mm2', a FROM c WHERE isfinite(a) AND a > 0
    UNION ALL SELECT run_id, wafer_id, CAST(CAST(measured_at AS DATE) AS VARCHAR), 'radial_distance_mm', r FROM c WHERE isfinite(r) AND (r > 0 OR r = 0 AND x_mm = 0 AND y_mm = 0)),
g AS (SELECT 'wafer' AS kind, wafer_id AS grp, metric, value FROM m UNION ALL SELECT 'run', run_id, metric, value FROM m UNION ALL SELECT 'day', day, metric, value FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, grp, metric ORDER BY value) AS k, count(*) OVER (PARTITION BY kind, grp, metric) AS n FROM g),
p AS (SELECT unnest([50, 250, 500, 750, 950, 990]) AS per_mille)
SELECT kind, grp, metric, per_mille, n, value, 0.0::DOUBLE AS error FROM k, p WHERE k = greatest(1, (n * per_mille + 999) // 1000)""",
}
