"""Queries on candidates: rules, geometry, densities and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import geometry as g
from spotlake.functions.scalars import parse_bool, with_poisson_interval
from spotlake.operators import density as dens
from spotlake.operators.rules import FEATURES, Limits, Model, decide, features, reasons
from spotlake.operators.quantiles import quantiles
from spotlake.operators.scale import stored, table

RADIUS_MM, FIELD_MM = 75.0, 25.0
CENTRED = "centroid_x_px is not null and centroid_y_px is not null and not isnan(centroid_x_px) and not isnan(centroid_y_px)"
LIMITS = Limits()
MODEL = Model(
    means=(0.01, 4.2, 4.5, 4.0, 1.6, 0.7, 0.8, 0.9, 0.15, 0.12), scales=(0.01, 0.5, 0.5, 0.5, 0.5, 0.15, 0.1, 0.05, 0.08, 0.06),
    weights=(0.2, 0.3, -0.2, 0.1, -0.9, -0.4, 0.8, 0.5, 1.1, 0.6), intercept=-0.2,
)
RANGES = [("centre", 0.0, 0.4), ("middle", 0.4, 0.8), ("rim", 0.8, 1.0), ("inner_half", 0.0, 0.5)]
RULE_COLUMNS = ("area_px", "equivalent_diameter_px", "aspect_ratio", "eccentricity", "circularity", "solidity", "contrast", "distance_to_valid_boundary_mm")


def candidates(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each delivered candidate once."""
    return table(spark, d, "candidates", "run_id", "defect_id", *columns).distinct()


def _c(*columns: str) -> str:
    return f"(SELECT DISTINCT run_id, defect_id, {', '.join(columns)} FROM candidates)"


def rule_reject(spark, d):
    rows = candidates(spark, d, *RULE_COLUMNS).withColumn("reason", F.array_join(reasons(LIMITS), ";"))
    return rows.groupBy("reason").agg(F.count("*").alias("candidates"))


def reason_counts(spark, d):
    rows = candidates(spark, d, "rejection_reason").where("rejection_reason <> ''")
    return rows.select(F.explode(F.split("rejection_reason", ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def accepted_split(spark, d):
    rows = candidates(spark, d, "wafer_id", "accepted")
    return rows.groupBy("wafer_id").agg(F.count_if(parse_bool(F.col("accepted"))).alias("accepted"), F.count_if(~parse_bool(F.col("accepted"))).alias("rejected"))


def polar_coords(spark, d):
    rows = candidates(spark, d, "x_mm", "y_mm").where("x_mm is not null and y_mm is not null and not isnan(x_mm) and not isnan(y_mm)")
    p = g.polar("x_mm", "y_mm")
    return rows.select("run_id", "defect_id", F.round(p["radial_distance_mm"], 6).alias("radial"), F.round(p["polar_angle_deg"], 6).alias("angle"))


def wafer_coords(spark, d):
    """Centroids in wafer coordinates, the wafer centre taken as the image centre."""
    rows = candidates(spark, d, "centroid_x_px", "centroid_y_px").where(CENTRED)
    runs = table(spark, d, "run_catalog", "run_id", "image_width_px", "image_height_px", "mm_per_pixel").distinct().where("mm_per_pixel > 0")
    joined = rows.join(runs, "run_id").withColumns({"cx": F.col("image_width_px") / 2, "cy": F.col("image_height_px") / 2})
    at = g.wafer_coordinates("centroid_x_px", "centroid_y_px", "cx", "cy", "mm_per_pixel")
    return joined.select("run_id", "defect_id", F.round(at["x_mm"], 6).alias("x"), F.round(at["y_mm"], 6).alias("y"))


def derived_shape(spark, d):
    rows = candidates(spark, d, "area_px", "perimeter_px", "major_axis_length_px", "minor_axis_length_px", "mean_gray_raw", "local_background_gray")
    whole = " and ".join(f"{c} is not null and not isnan({c})" for c in ("perimeter_px", "major_axis_length_px", "minor_axis_length_px", "mean_gray_raw", "local_background_gray"))
    rows = rows.where(whole + " and area_px is not null and perimeter_px > 0 and minor_axis_length_px > 0")
    return rows.select(
        "run_id", "defect_id", F.round(g.circularity("area_px", "perimeter_px"), 6).alias("circularity"),
        F.round(g.aspect_ratio("major_axis_length_px", "minor_axis_length_px"), 6).alias("aspect"),
        F.round(F.col("local_background_gray") - F.col("mean_gray_raw"), 6).alias("contrast"),
    )


def density_by_run(spark, d):
    """Accepted candidates over the run's valid area."""
    counts = candidates(spark, d, "accepted").groupBy("run_id").agg(F.count_if("accepted").alias("count"))
    runs = table(spark, d, "run_catalog", "run_id", "valid_analysis_area_cm2").distinct().withColumnRenamed("valid_analysis_area_cm2", "area_cm2")
    out = dens.rates(runs.join(counts, "run_id", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint"))))
    return out.select("run_id", "count", "area_cm2", F.round("density_cm2", 6).alias("density_cm2"), F.round("sigma_cm2", 6).alias("sigma_cm2"))


def garwood_ci(spark, d):
    """The density's exact Poisson interval per run."""
    rows = with_poisson_interval(density_by_run(spark, d), "count")
    return rows.select("run_id", "count", (F.col("poisson_lower") / F.col("area_cm2")).alias("low_cm2"), (F.col("poisson_upper") / F.col("area_cm2")).alias("high_cm2"))


def _polar_points(spark, d):
    rows = candidates(spark, d, "x_mm", "y_mm", "accepted").where("accepted and x_mm is not null and y_mm is not null and not isnan(x_mm) and not isnan(y_mm)")
    p = g.polar("x_mm", "y_mm")
    return rows.select("accepted", F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.round(p["radial_distance_mm"], 6).alias("r"), F.round(p["polar_angle_deg"], 6).alias("angle"))


_POINTS = f"""p AS (SELECT accepted, x_mm AS x, y_mm AS y, round(sqrt(x_mm * x_mm + y_mm * y_mm), 6) AS r,
    round(CASE WHEN degrees(atan2(y_mm, x_mm)) < 0 THEN degrees(atan2(y_mm, x_mm)) + 360 ELSE degrees(atan2(y_mm, x_mm)) END, 6) AS angle
    FROM {_c('x_mm', 'y_mm', 'accepted')} WHERE accepted AND x_mm IS NOT NULL AND y_mm IS NOT NULL AND NOT isnan(x_mm) AND NOT isnan(y_mm))"""


def radial_equal_width(spark, d):
    out = dens.rings(_polar_points(spark, d), RADIUS_MM)
    return out.select("bin", "count", *[F.round(c, 6).alias(c) for c in ("r_inner_mm", "r_outer_mm", "area_cm2", "density_cm2")])


def radial_equal_area_edges(spark, d):
    return dens.equal_area_edges(_polar_points(spark, d), RADIUS_MM, 6)


def angular_sectors(spark, d):
    out = dens.sectors(_polar_points(spark, d), RADIUS_MM)
    return out.select("bin", "count", "angle_start_deg", "angle_end_deg", F.round("density_cm2", 6).alias("density_cm2"))


def regional_density(spark, d):
    out = dens.regions(_polar_points(spark, d), RANGES, RADIUS_MM)
    return out.select("region", "count", F.round("area_cm2", 6).alias("area_cm2"), F.round("density_cm2", 6).alias("density_cm2"))


def grid_density_dense(spark, d):
    return dens.grid(_polar_points(spark, d), RADIUS_MM).select("x_bin", "y_bin", "count", F.round("density_cm2", 6).alias("density_cm2"))


def field_matrix_cube(spark, d):
    rows = candidates(spark, d, "x_mm", "y_mm", "accepted").where("not isnan(x_mm) and not isnan(y_mm)")
    return dens.field_cube(rows.select(F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), "accepted"), RADIUS_MM, FIELD_MM)


def strata_right_closed(spark, d):
    q = F.col("r") / RADIUS_MM
    stratum = F.when(q <= 0.33, "inner").when(q <= 0.67, "middle").when(q <= 1 + 1e-9, "outer")
    found = _polar_points(spark, d).select(stratum.alias("stratum")).where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("inner",), ("middle",), ("outer",)], "stratum string")
    return names.join(found, "stratum", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def heterogeneity_chi2(spark, d):
    """Pearson's statistic of accepted counts per run against one common density."""
    rows = density_by_run(spark, d).where("area_cm2 > 0")
    total = rows.agg(F.sum("count").alias("n"), F.sum(F.col("area_cm2").cast("decimal(20,6)")).cast("double").alias("s"), F.count("*").alias("runs"))
    expected = F.col("area_cm2") * F.col("n") / F.col("s")
    chi = rows.join(total, F.lit(True)).agg(F.first("runs").alias("runs"), F.sum((F.col("count") - expected) * (F.col("count") - expected) / expected).alias("chi2"))
    per = F.try_divide(F.col("chi2"), F.col("runs") - 1)
    return chi.select("runs", F.round("chi2", 4).alias("chi2"), F.round(per, 4).alias("per_degree"), (per > 1.5).alias("heterogeneous"))


def logistic_score_decision(spark, d):
    rows = decide(candidates(spark, d, *dict.fromkeys([*FEATURES, *RULE_COLUMNS])), MODEL, LIMITS)
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.count_if("accepted_now").alias("accepted"), F.round(F.avg("probability"), 6).alias("mean_probability"))


def classifier_reasons(spark, d):
    """How candidates leave the model, by what the rules said of them and the final reason."""
    rows = decide(candidates(spark, d, *dict.fromkeys([*FEATURES, *RULE_COLUMNS])), MODEL, LIMITS)
    return rows.groupBy("decision", "rule_accepted", "rule_rejection_reason", "final_reason").agg(F.count("*").alias("n"))


def standardize(spark, d):
    """Mean and population deviation of each feature over candidates with a whole feature vector."""
    rows = candidates(spark, d, *FEATURES).select(features().alias("x")).where("x is not null")
    stats = rows.select(F.posexplode("x").alias("feature", "v")).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"))
    return stats


def percentile_window(spark, d):
    """1st and 99th percentile of the raw grey value per run, and the shares clipped by them."""
    rows = stored(candidates(spark, d, "mean_gray_raw").where("mean_gray_raw is not null and not isnan(mean_gray_raw)").select("run_id", "mean_gray_raw"))
    lims = quantiles(rows, ["run_id"], {"low": 0.01, "high": 0.99}, "mean_gray_raw")
    both = rows.join(lims, "run_id").groupBy("run_id", "n", "low", "high").agg(F.count_if(F.col("mean_gray_raw") <= F.col("low")).alias("at_low"), F.count_if(F.col("mean_gray_raw") >= F.col("high")).alias("at_high"))
    return both.select("run_id", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "at_low", "at_high")


def sensitivity_sweep(spark, d):
    """Accepted candidates of each run if the contrast limit is moved to 0.8 ... 1.2 of its value."""
    factors = F.explode(F.array(*[F.lit(f) for f in (0.8, 0.9, 1.0, 1.1, 1.2)]))
    rows = candidates(spark, d, "contrast").where("contrast is not null and not isnan(contrast)").withColumn("factor", factors)
    return rows.groupBy("run_id", "factor").agg(F.count_if(F.col("contrast") >= F.round(F.col("factor") * 0.1, 6)).alias("kept"))


def tile_ownership(spark, d, tile: int = 1024):
    """Candidates per tile core; half-open cores own every centroid once."""
    rows = candidates(spark, d, "image_id", "centroid_x_px", "centroid_y_px").where(CENTRED)
    at = rows.select("image_id", F.floor(F.col("centroid_x_px") / tile).alias("tile_x"), F.floor(F.col("centroid_y_px") / tile).alias("tile_y"))
    return at.groupBy("image_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_reject, reason_counts, accepted_split, polar_coords, wafer_coords, derived_shape, density_by_run, garwood_ci, radial_equal_width,
        radial_equal_area_edges, angular_sectors, regional_density, grid_density_dense, field_matrix_cube, strata_right_closed, heterogeneity_chi2,
        logistic_score_decision, classifier_reasons, standardize, percentile_window, sensitivity_sweep, tile_ownership,
    )
}

_L = LIMITS
_B = "distance_to_valid_boundary_mm"


def _ok(c: str) -> str:
    return f"{c} IS NOT NULL AND NOT isnan({c})"


_FIN = lambda c: f"({c} IS NOT NULL AND isfinite({c}))"
_TESTS = {
    "outside_valid_mask": f"{_ok(_B)} AND {_B} <= 0",
    "too_small": f"area_px < {_L.min_area_px} OR ({_ok('equivalent_diameter_px')} AND equivalent_diameter_px < {_L.min_diameter_px})",
    "too_large": f"area_px > {_L.max_area_px} OR ({_ok('equivalent_diameter_px')} AND equivalent_diameter_px > {_L.max_diameter_px})",
    "too_elongated": f"({_ok('aspect_ratio')} AND aspect_ratio > {_L.max_aspect}) OR ({_ok('eccentricity')} AND eccentricity > {_L.max_eccentricity})",
    "low_circularity": f"{_ok('circularity')} AND circularity < {_L.min_circularity}",
    "low_solidity": f"{_ok('solidity')} AND solidity < {_L.min_solidity}",
    "low_contrast": f"NOT {_FIN('contrast')} OR contrast < {_L.min_contrast}",
    "near_wafer_edge": f"{_ok(_B)} AND {_B} > 0 AND {_B} < {_L.min_edge_mm}",
}
_REASON = "concat_ws(';', " + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for r, t in _TESTS.items()) + ")"
_X = [f"ln(1 + greatest(0.0, {f}))" if i < 4 else f for i, f in enumerate(FEATURES)]
_WHOLE = " AND ".join(_FIN(f) for f in FEATURES)
_Z = f"{MODEL.intercept} + " + " + ".join(f"({x} - {m}) / {s} * ({w})" for x, m, s, w in zip(_X, MODEL.means, MODEL.scales, MODEL.weights, strict=True))
_STEP = RADIUS_MM / 6
_DENSITY = f"""n AS (SELECT run_id, count(*) FILTER (accepted) AS n FROM {_c('accepted')} GROUP BY 1),
dr AS (SELECT run_id, coalesce(n, 0) AS count, valid_analysis_area_cm2 AS area_cm2 FROM (SELECT DISTINCT run_id, valid_analysis_area_cm2 FROM run_catalog) LEFT JOIN n USING (run_id))"""
_BIN = lambda v, lo, hi, n: f"CASE WHEN {v} >= {lo} AND {v} <= {hi} THEN least(floor(({v} - ({lo})) / ({hi} - ({lo})) * {n}), {n - 1})::INT END"
_AREA = math.pi * RADIUS_MM**2 / 100
_CELL = (2 * RADIUS_MM / 40) ** 2 / 100

SQL = {
    "rule_reject": f"SELECT {_REASON} AS reason, count(*) AS candidates FROM {_c(*RULE_COLUMNS)} GROUP BY 1",
    "reason_counts": f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(rejection_reason, ';')) AS reason FROM {_c('rejection_reason')} WHERE rejection_reason <> '') WHERE reason <> '' GROUP BY 1",
    "accepted_split": f"SELECT wafer_id, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT coalesce(accepted, false)) AS rejected FROM {_c('wafer_id', 'accepted')} GROUP BY 1",
    "polar_coords": f"""SELECT run_id, defect_id, round(sqrt(x_mm * x_mm + y_mm * y_mm), 6) AS radial,
        round(CASE WHEN degrees(atan2(y_mm, x_mm)) < 0 THEN degrees(atan2(y_mm, x_mm)) + 360 ELSE degrees(atan2(y_mm, x_mm)) END, 6) AS angle FROM {_c('x_mm', 'y_mm')} WHERE {_ok('x_mm')} AND {_ok('y_mm')}""",
    "wafer_coords": f"""SELECT c.run_id, defect_id, round((centroid_x_px - image_width_px / 2) * mm_per_pixel, 6) AS x, round(-(centroid_y_px - image_height_px / 2) * mm_per_pixel, 6) AS y
        FROM {_c('centroid_x_px', 'centroid_y_px')} c JOIN (SELECT DISTINCT run_id, image_width_px, image_height_px, mm_per_pixel FROM run_catalog WHERE mm_per_pixel > 0) r ON c.run_id = r.run_id WHERE {_ok('centroid_x_px')} AND {_ok('centroid_y_px')}""",
    "derived_shape": f"""SELECT run_id, defect_id, round(4 * pi() * area_px / (perimeter_px * perimeter_px), 6) AS circularity, round(major_axis_length_px / minor_axis_length_px, 6) AS aspect,
        round(local_background_gray - mean_gray_raw, 6) AS contrast FROM {_c('area_px', 'perimeter_px', 'major_axis_length_px', 'minor_axis_length_px', 'mean_gray_raw', 'local_background_gray')}
        WHERE area_px IS NOT NULL AND perimeter_px > 0 AND minor_axis_length_px > 0 AND {' AND '.join(_ok(x) for x in ('perimeter_px', 'major_axis_length_px', 'minor_axis_length_px', 'mean_gray_raw', 'local_background_gray'))}""",
    "density_by_run": f"WITH {_DENSITY} SELECT run_id, count, area_cm2, CASE WHEN area_cm2 > 0 THEN round(count / area_cm2, 6) END AS density_cm2, CASE WHEN area_cm2 > 0 THEN round(sqrt(count) / area_cm2, 6) END AS sigma_cm2 FROM dr",
    "radial_equal_width": f"""WITH {_POINTS}, b AS (SELECT range::INT AS bin FROM range(6)), n AS (SELECT {_BIN('r', 0, RADIUS_MM, 6)} AS bin, count(*) AS n FROM p GROUP BY 1)
        SELECT b.bin, coalesce(n, 0) AS count, round(b.bin * {_STEP}, 6) AS r_inner_mm, round((b.bin + 1) * {_STEP}, 6) AS r_outer_mm,
        round(pi() * (((b.bin + 1) * {_STEP}) ^ 2 - (b.bin * {_STEP}) ^ 2) / 100, 6) AS area_cm2, round(coalesce(n, 0) / (pi() * (((b.bin + 1) * {_STEP}) ^ 2 - (b.bin * {_STEP}) ^ 2) / 100), 6) AS density_cm2 FROM b LEFT JOIN n ON b.bin = n.bin""",
    "radial_equal_area_edges": f"""WITH {_POINTS}, h AS (SELECT {_BIN('r', 0, RADIUS_MM, 4096)} AS step, count(*) AS n FROM p GROUP BY 1), u AS (SELECT step, sum(n) OVER (ORDER BY step) AS upto, sum(n) OVER () AS total FROM h WHERE step IS NOT NULL)
        SELECT k::INT AS k, round((min(step) + 1) * ({RADIUS_MM} / 4096), 9) AS edge FROM u, (SELECT range AS k FROM range(1, 6)) WHERE upto * 6 >= k * total GROUP BY 1""",
    "angular_sectors": f"""WITH {_POINTS}, b AS (SELECT range::INT AS bin FROM range(12)), n AS (SELECT {_BIN('angle', 0.0, 360.0, 12)} AS bin, count(*) AS n FROM p GROUP BY 1)
        SELECT b.bin, coalesce(n, 0) AS count, (b.bin * 30)::DOUBLE AS angle_start_deg, ((b.bin + 1) * 30)::DOUBLE AS angle_end_deg, round(coalesce(n, 0) / ({_AREA} / 12), 6) AS density_cm2 FROM b LEFT JOIN n ON b.bin = n.bin""",
    "regional_density": f"""WITH {_POINTS}, t(region, low, high) AS (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in RANGES)}),
        n AS (SELECT region, count(*) AS n FROM t JOIN p ON r / {RADIUS_MM} >= low AND (r / {RADIUS_MM} < high OR high >= 1 AND r / {RADIUS_MM} <= high) GROUP BY 1)
        SELECT t.region, coalesce(n, 0) AS count, round({_AREA} * (high * high - low * low), 6) AS area_cm2, round(coalesce(n, 0) / ({_AREA} * (high * high - low * low)), 6) AS density_cm2 FROM t LEFT JOIN n USING (region)""",
    "grid_density_dense": f"""WITH {_POINTS}, n AS (SELECT {_BIN('x', -RADIUS_MM, RADIUS_MM, 40)} AS x_bin, {_BIN('y', -RADIUS_MM, RADIUS_MM, 40)} AS y_bin, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT a.range::INT AS x_bin, b.range::INT AS y_bin, coalesce(n, 0) AS count, round(coalesce(n, 0) / {_CELL}, 6) AS density_cm2 FROM range(40) a CROSS JOIN range(40) b LEFT JOIN n ON a.range = x_bin AND b.range = y_bin""",
    "field_matrix_cube": f"""WITH f AS (SELECT greatest(0, least(floor((x_mm + {RADIUS_MM}) / {FIELD_MM}), 5))::INT AS x_field, greatest(0, least(floor(({RADIUS_MM} - y_mm) / {FIELD_MM}), 5))::INT AS y_field, accepted FROM {_c('x_mm', 'y_mm', 'accepted')} WHERE {_ok('x_mm')} AND {_ok('y_mm')})
        SELECT y_field, x_field, count(*) AS candidates, count(*) FILTER (accepted) AS accepted, grouping_id(y_field, x_field)::INT AS level FROM f GROUP BY CUBE (y_field, x_field)""",
    "strata_right_closed": f"""WITH {_POINTS}, s AS (SELECT CASE WHEN r / {RADIUS_MM} <= 0.33 THEN 'inner' WHEN r / {RADIUS_MM} <= 0.67 THEN 'middle' WHEN r / {RADIUS_MM} <= 1 + 1e-9 THEN 'outer' END AS stratum FROM p)
        SELECT t.stratum, count(s.stratum) AS n FROM (VALUES ('inner'), ('middle'), ('outer')) t(stratum) LEFT JOIN s ON t.stratum = s.stratum GROUP BY 1""",
    "heterogeneity_chi2": f"""WITH {_DENSITY}, t AS (SELECT sum(count) AS n, sum(area_cm2::DECIMAL(20, 6))::DOUBLE AS s, count(*) AS runs FROM dr WHERE area_cm2 > 0),
        x AS (SELECT any_value(runs) AS runs, sum((count - area_cm2 * n / s) ^ 2 / (area_cm2 * n / s)) AS chi2 FROM dr, t WHERE area_cm2 > 0)
        SELECT runs, round(chi2, 4) AS chi2, round(chi2 / (runs - 1), 4) AS per_degree, chi2 / (runs - 1) > 1.5 AS heterogeneous FROM x""",
    "logistic_score_decision": f"""WITH s AS (SELECT CASE WHEN {_WHOLE} THEN 1 / (1 + exp(-greatest(-40, least(40, {_Z})))) END AS p, {_TESTS['outside_valid_mask']} OR ({_TESTS['near_wafer_edge']}) AS hard FROM {_c(*dict.fromkeys([*FEATURES, *RULE_COLUMNS]))}),
        t AS (SELECT p, CASE WHEN hard THEN 'blocked_by_geometry' WHEN p IS NULL THEN 'feature_invalid' WHEN p >= 0.75 THEN 'target' WHEN p <= 0.25 THEN 'artifact' ELSE 'uncertain' END AS decision FROM s)
        SELECT decision, count(*) AS n, count(*) FILTER (decision = 'target') AS accepted, round(avg(p), 6) AS mean_probability FROM t GROUP BY 1""",
    "classifier_reasons": f"""WITH s AS (SELECT CASE WHEN {_WHOLE} THEN 1 / (1 + exp(-greatest(-40, least(40, {_Z})))) END AS p, {_TESTS['outside_valid_mask']} OR ({_TESTS['near_wafer_edge']}) AS hard, {_REASON} AS rule FROM {_c(*dict.fromkeys([*FEATURES, *RULE_COLUMNS]))}),
        t AS (SELECT rule, CASE WHEN hard THEN 'blocked_by_geometry' WHEN p IS NULL THEN 'feature_invalid' WHEN p >= 0.75 THEN 'target' WHEN p <= 0.25 THEN 'artifact' ELSE 'uncertain' END AS decision FROM s)
        SELECT decision, rule = '' AS rule_accepted, rule AS rule_rejection_reason, CASE decision WHEN 'target' THEN '' WHEN 'blocked_by_geometry' THEN rule ELSE 'classifier_' || decision END AS final_reason, count(*) AS n FROM t GROUP BY ALL""",
    "standardize": f"""WITH v AS (SELECT unnest([{', '.join(_X)}]) AS v, unnest(range(10)) AS feature FROM {_c(*FEATURES)} WHERE {_WHOLE})
        SELECT feature::INT AS feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM v GROUP BY 1""",
    "percentile_window": f"""WITH c AS (SELECT * FROM {_c('mean_gray_raw')} WHERE {_ok('mean_gray_raw')}), l AS (SELECT run_id, count(*) AS n, quantile_cont(mean_gray_raw, 0.01) AS low, quantile_cont(mean_gray_raw, 0.99) AS high FROM c GROUP BY 1)
        SELECT run_id, n, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (mean_gray_raw <= low) AS at_low, count(*) FILTER (mean_gray_raw >= high) AS at_high FROM c JOIN l USING (run_id) GROUP BY ALL""",
    "sensitivity_sweep": f"SELECT run_id, factor, count(*) FILTER (contrast >= round(factor * 0.1, 6)) AS kept FROM {_c('contrast')}, (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2]::DOUBLE[]) AS factor) WHERE {_ok('contrast')} GROUP BY 1, 2",
    "tile_ownership": f"SELECT image_id, floor(centroid_x_px / 1024)::BIGINT AS tile_x, floor(centroid_y_px / 1024)::BIGINT AS tile_y, count(*) AS n FROM {_c('image_id', 'centroid_x_px', 'centroid_y_px')} WHERE {_ok('centroid_x_px')} AND {_ok('centroid_y_px')} GROUP BY 1, 2, 3",
}
