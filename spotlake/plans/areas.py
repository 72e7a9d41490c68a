"""Queries on densities over the valid area of each wafer: its disc less the mask regions of its image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators import mask_area as area
from spotlake.operators.scale import stored, table
from spotlake.plans.measure import CENTRED, FIELD_MM, RANGES, candidates

# Fixed value: how much wider than its wafer a square image is.
FRAME = 1.08
RINGS, SECTORS, CELLS = 6, 12, 40


def wafers(spark: SparkSession, d: str) -> DataFrame:
    """The wafer of every image of known size and scale, centred in it."""
    rows = table(spark, d, "run_catalog", "image_id", "image_width_px", "image_height_px", "mm_per_pixel").where("image_id is not null and mm_per_pixel > 0 and image_width_px > 0 and image_height_px > 0")
    one = rows.groupBy("image_id").agg(F.max("image_width_px").alias("width"), F.max("image_height_px").alias("height"), F.max("mm_per_pixel").alias("scale"))
    return one.select("image_id", "width", "height", (F.col("width") / 2).alias("cx"), (F.col("height") / 2).alias("cy"), (F.col("width") / (2 * FRAME)).alias("radius"), "scale")


def _runs(spark, d) -> DataFrame:
    boxes = table(spark, d, "mask_regions").select("image_id", F.col("x0_px").alias("x0"), F.col("y0_px").alias("y0"), F.col("x1_px").alias("x1"), F.col("y1_px").alias("y1"))
    return area.signed_runs(wafers(spark, d), boxes)


def _points(spark, d) -> DataFrame:
    """(run_id, accepted, dx, dy in mm, y upwards, share of the radius, angle, radius in mm) of the candidates with a centre."""
    rows = candidates(spark, d, "image_id", "centroid_x_px", "centroid_y_px", "accepted").where(CENTRED)
    rows = rows.join(wafers(spark, d), "image_id")
    dx, dy = (F.col("centroid_x_px") - F.col("cx")) * F.col("scale"), (F.col("cy") - F.col("centroid_y_px")) * F.col("scale")
    rows = rows.select("run_id", "accepted", dx.alias("dx"), dy.alias("dy"), (F.col("radius") * F.col("scale")).alias("reach"))
    return rows.withColumns({"q": F.hypot("dx", "dy") / F.col("reach"), "angle": F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0))})


def _per_run(spark, d, bins: DataFrame, *more) -> DataFrame:
    runs = table(spark, d, "run_catalog", "run_id", "image_id").distinct()
    return stored(bins).join(runs, "image_id").join(wafers(spark, d).select("image_id", "scale", *more), "image_id").drop("image_id")


def _counts(points: DataFrame, **by) -> DataFrame:
    return points.where("accepted").groupBy("run_id", *[c.alias(n) for n, c in by.items()]).agg(F.count("*").alias("count"))


def mask_valid_area(spark, d):
    out = area.valid_pixels(_runs(spark, d))
    return out.select("image_id", "pixels", F.round("area_cm2", 6).alias("area_cm2"), F.round("max_radius_mm", 6).alias("max_radius_mm"))


def ring_densities(spark, d, rate=area.area_densities) -> DataFrame:
    ring = F.when(F.col("q") <= 1, F.least(F.floor(F.col("q") * RINGS), F.lit(RINGS - 1)).cast("int"))
    return rate(_per_run(spark, d, area.ring_pixels(_runs(spark, d), RINGS)), _counts(_points(spark, d).where("q <= 1"), bin=ring), ["run_id", "bin"])


def mask_ring_density(spark, d):
    return ring_densities(spark, d).select("run_id", "bin", "pixels", "count", F.round("valid_area_cm2", 6).alias("valid_area_cm2"), F.round("density_cm2", 6).alias("density_cm2"))


def mask_ring_intervals(spark, d):
    """The exact Poisson interval of every ring's density."""
    return ring_densities(spark, d, area.densities).select("run_id", "bin", "count", "poisson_lower_cm2", "poisson_upper_cm2")


def mask_sector_density(spark, d):
    sector = F.least(F.floor(F.col("angle") / (360.0 / SECTORS)), F.lit(SECTORS - 1)).cast("int")
    out = area.area_densities(_per_run(spark, d, area.sector_pixels(_runs(spark, d), SECTORS)), _counts(_points(spark, d), bin=sector), ["run_id", "bin"])
    return out.select("run_id", "bin", "pixels", "count", F.round("valid_area_cm2", 6).alias("valid_area_cm2"), F.round("density_cm2", 6).alias("density_cm2"))


def mask_region_density(spark, d):
    names = F.array(*[F.struct(F.lit(n).alias("region"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in RANGES])
    points = _points(spark, d).select("run_id", "accepted", "q", F.inline(names))
    points = points.where("q >= low and (q < high or high >= 1 and q <= high)")
    out = area.area_densities(_per_run(spark, d, area.region_pixels(_runs(spark, d), RANGES)), _counts(points, region=F.col("region")), ["run_id", "region"])
    return out.select("run_id", "region", "pixels", "count", F.round("valid_area_cm2", 6).alias("valid_area_cm2"), F.round("density_cm2", 6).alias("density_cm2"))


def mask_grid_density(spark, d):
    """All grid cells of each run, with the share of the cell that is valid; those without valid pixels keep their candidates."""
    side = 2 * F.col("radius") * F.col("scale") / CELLS
    bins = area.cell_pixels(_runs(spark, d), side, F.lit(CELLS), whole=wafers(spark, d))
    cell = lambda c: F.greatest(F.lit(0), F.least(F.floor((F.col(c) + F.col("reach")) / (2 * F.col("reach") / CELLS)), F.lit(CELLS - 1))).cast("int")
    counts = _counts(_points(spark, d).where("abs(dx) <= reach and abs(dy) <= reach"), x_cell=cell("dx"), y_cell=cell("dy"))
    size = F.pow(2 * F.col("radius") * F.col("scale") / CELLS / 10, F.lit(2.0)).alias("cell")
    out = area.area_densities(_per_run(spark, d, bins, size), counts, ["run_id", "x_cell", "y_cell"])
    return out.select("run_id", "x_cell", "y_cell", "pixels", "count", F.round(F.col("valid_area_cm2") / F.col("cell"), 6).alias("valid_fraction"), F.round("density_cm2", 4).alias("density_cm2"))


def mask_fields(spark, d):
    """Local fields of each run: valid area, candidates and density, fields without candidates included."""
    cells = lambda reach: F.greatest(F.lit(1), F.ceil(2 * reach / FIELD_MM)).cast("int")
    bins = area.cell_pixels(_runs(spark, d), F.lit(FIELD_MM), cells(F.col("radius") * F.col("scale")), middle=0.5, down=True)
    at = lambda c: F.greatest(F.lit(0), F.least(F.floor((c + F.col("reach")) / FIELD_MM), cells(F.col("reach")) - 1)).cast("int")
    points = _points(spark, d).select("run_id", "accepted", at(F.col("dx")).alias("x_cell"), at(-F.col("dy")).alias("y_cell"))
    out = area.fields(_per_run(spark, d, bins), points, ["run_id"])
    size = F.col("pixels") * F.col("scale") * F.col("scale") / 100
    own = ["run_id", "field", "x_cell", "y_cell", "pixels", "candidate_count", "accepted_count", "rejected_count"]
    return out.select(*own, F.round(F.coalesce(size, F.lit(0.0)), 6).alias("valid_area_cm2"), F.round(F.when(size > 0, F.col("accepted_count") / size), 6).alias("density_cm2"))


QUERIES = {f.__name__: f for f in (mask_valid_area, mask_ring_density, mask_ring_intervals, mask_sector_density, mask_region_density, mask_grid_density, mask_fields)}

_RUNS = f"""w AS (SELECT image_id, max(image_width_px) AS width, max(image_height_px) AS height, max(mm_per_pixel) AS scale, width / 2 AS cx, height / 2 AS cy, width / (2 * {FRAME}) AS radius FROM run_catalog
    WHERE image_id IS NOT NULL AND mm_per_pixel > 0 AND image_width_px > 0 AND image_height_px > 0 GROUP BY 1),
rw AS (SELECT *, unnest(range(greatest(0, ceil(cy - radius))::BIGINT, least(height - 1, floor(cy + radius))::BIGINT + 1)) AS y FROM w),
disc AS (SELECT image_id, y, greatest(0, ceil(cx - sqrt(greatest(0, radius * radius - (y - cy) * (y - cy)))))::BIGINT AS a, least(width - 1, floor(cx + sqrt(greatest(0, radius * radius - (y - cy) * (y - cy)))))::BIGINT AS b FROM rw),
bars AS (SELECT DISTINCT image_id, least(x0_px, x1_px) AS x0, greatest(x0_px, x1_px) AS x1, unnest(range(least(y0_px, y1_px)::BIGINT, greatest(y0_px, y1_px)::BIGINT)) AS y FROM mask_regions WHERE x0_px <> x1_px AND y0_px IS NOT NULL AND y1_px IS NOT NULL),
fresh AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY image_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM bars),
isles AS (SELECT image_id, y, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, y ORDER BY x0, x1) AS k FROM fresh) GROUP BY image_id, y, k),
cuts AS (SELECT d.image_id, d.y, greatest(a, x0) AS a, least(b, x1 - 1) AS b FROM disc d JOIN isles i ON d.image_id = i.image_id AND d.y = i.y),
px AS MATERIALIZED (SELECT image_id, y, a, b, 1 AS sign, cx, cy, radius, scale FROM disc JOIN w USING (image_id) WHERE a <= b UNION ALL SELECT image_id, y, a, b, -1, cx, cy, radius, scale FROM cuts JOIN w USING (image_id) WHERE a <= b),
pts AS (SELECT run_id, accepted, (x - cx) * scale AS dx, (cy - y) * scale AS dy, radius * scale AS reach, sqrt(dx * dx + dy * dy) / reach AS q,
    CASE WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END AS angle
    FROM (SELECT DISTINCT run_id, defect_id, image_id, centroid_x_px AS x, centroid_y_px AS y, accepted FROM candidates WHERE centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL AND NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px)) JOIN w USING (image_id)),
rr AS (SELECT DISTINCT run_id, image_id, scale, radius FROM run_catalog JOIN w USING (image_id))"""
_OVER = "greatest(0, least(b, {1}) - greatest(a, {0}) + 1) * sign"
_HALF = "sqrt(greatest(0, s * radius * s * radius - (y - cy) * (y - cy)))"


def _upto(shares: str) -> str:
    part = _OVER.format(f"floor(cx - {_HALF}) + 1", f"ceil(cx + {_HALF}) - 1")
    return f"upto AS (SELECT image_id, s, sum(CASE WHEN s >= 1 THEN (b - a + 1) * sign WHEN s * radius > abs(y - cy) THEN {part} ELSE 0 END)::BIGINT AS pixels FROM px, (SELECT unnest({shares}) AS s) GROUP BY 1, 2)"


def _density(bins: str, counts: str, key: str, digits: int = 6) -> str:
    """``bins`` (image_id, key, pixels) and ``counts`` (run_id, key, n) as the common result."""
    return f"""WITH {_RUNS}, {bins}, counts AS ({counts}), j AS (SELECT run_id, {key}, pixels, pixels * scale * scale / 100 AS size FROM bins JOIN rr USING (image_id))
        SELECT run_id, {key}, pixels, coalesce(n, 0) AS count, round(size, 6) AS valid_area_cm2, CASE WHEN size > 0 THEN round(coalesce(n, 0) / size, {digits}) END AS density_cm2 FROM j LEFT JOIN counts USING (run_id, {key})"""


_COT = ", ".join(f"({k}, {1e6 if k == 0 else 0.0 if 4 * k == SECTORS else f'1 / tan(radians({k * 360.0 / SECTORS}))'}, {-1e6 if 2 * (k + 1) == SECTORS else 0.0 if 4 * (k + 1) == SECTORS else f'1 / tan(radians({(k + 1) * 360.0 / SECTORS}))'})" for k in range(SECTORS // 2))
_RANGES = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in RANGES)


def _cells(side: str, n: str, middle: float, down: bool) -> str:
    clip = lambda c: f"greatest(0, least(floor({c}), nn - 1))::BIGINT"
    place = lambda p: clip(f"(({p} + {middle} - cx) * scale + radius * scale) / side")
    edge = lambda k: f"ceil((({k}) * side - radius * scale) / scale + cx - {middle})"
    return f"""cl AS (SELECT *, {clip(f"({'' if down else '-'}(y + {middle} - cy) * scale + radius * scale) / side")} AS y_cell, unnest(range({place('a')}, {place('b')} + 1)) AS x_cell FROM (SELECT *, {side} AS side, {n} AS nn FROM px)),
bins AS (SELECT image_id, x_cell, y_cell, sum({_OVER.format(f"CASE WHEN x_cell = 0 THEN a ELSE {edge('x_cell')} END", f"CASE WHEN x_cell = nn - 1 THEN b ELSE {edge('x_cell + 1')} - 1 END")})::BIGINT AS pixels FROM cl GROUP BY 1, 2, 3 HAVING pixels > 0)"""


_CELL = lambda c, side, n: f"greatest(0, least(floor(({c} + reach) / {side}), {n} - 1))::BIGINT"

SQL = {
    "mask_valid_area": f"""WITH {_RUNS} SELECT image_id, sum((b - a + 1) * sign)::BIGINT AS pixels, round(sum((b - a + 1) * sign) * any_value(scale) * any_value(scale) / 100, 6) AS area_cm2,
        round(max(CASE WHEN sign = 1 THEN sqrt(greatest(abs(a - cx), abs(b - cx)) ^ 2 + (y - cy) ^ 2) END) * any_value(scale), 6) AS max_radius_mm FROM px GROUP BY 1""",
    "mask_ring_density": _density(
        f"{_upto(f'list_transform(range({RINGS + 1}), lambda k: k / {RINGS})')}, bins AS (SELECT image_id, bin, pixels - lag AS pixels FROM (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY s) - 2)::INT AS bin, pixels, lag(pixels) OVER (PARTITION BY image_id ORDER BY s) AS lag FROM upto) WHERE bin >= 0)",
        f"SELECT run_id, least(floor(q * {RINGS}), {RINGS - 1})::INT AS bin, count(*) AS n FROM pts WHERE accepted AND q <= 1 GROUP BY 1, 2", "bin",
    ),
    "mask_sector_density": _density(
        f"""sec(k, o, i) AS (VALUES {_COT}), parts AS (SELECT image_id, CASE WHEN y < cy THEN k ELSE {SECTORS - 1} - k END AS bin,
            {_OVER.format(f"CASE WHEN k = {SECTORS // 2 - 1} THEN a WHEN y < cy THEN floor(cx + (cy - y) * i) + 1 ELSE ceil(cx + (y - cy) * i) END", "CASE WHEN k = 0 THEN b WHEN y < cy THEN floor(cx + (cy - y) * o) ELSE ceil(cx + (y - cy) * o) - 1 END")} AS n FROM px, sec WHERE y <> cy
            UNION ALL SELECT image_id, 0, {_OVER.format('ceil(cx)', 'b')} FROM px WHERE y = cy UNION ALL SELECT image_id, {SECTORS // 2}, {_OVER.format('a', 'ceil(cx) - 1')} FROM px WHERE y = cy),
            bins AS (SELECT image_id, bin::INT AS bin, sum(n)::BIGINT AS pixels FROM parts GROUP BY 1, 2)""",
        f"SELECT run_id, least(floor(angle / {360.0 / SECTORS}), {SECTORS - 1})::INT AS bin, count(*) AS n FROM pts WHERE accepted GROUP BY 1, 2", "bin",
    ),
    "mask_region_density": _density(
        f"""t(region, low, high) AS (VALUES {_RANGES}), {_upto("(SELECT list(v) FROM (SELECT low AS v FROM t UNION SELECT high FROM t))")},
            bins AS (SELECT h.image_id, region, h.pixels - l.pixels AS pixels FROM t JOIN upto l ON l.s = low JOIN upto h ON h.s = high AND h.image_id = l.image_id)""",
        "SELECT run_id, region, count(*) AS n FROM pts JOIN t ON q >= low AND (q < high OR high >= 1 AND q <= high) WHERE accepted GROUP BY 1, 2", "region",
    ),
    "mask_grid_density": f"""WITH {_RUNS}, {_cells(f'2 * radius * scale / {CELLS}', str(CELLS), 0.0, False)},
        n AS (SELECT run_id, {_CELL('dx', f'(2 * reach / {CELLS})', CELLS)} AS x_cell, {_CELL('dy', f'(2 * reach / {CELLS})', CELLS)} AS y_cell, count(*) AS n FROM pts WHERE accepted AND abs(dx) <= reach AND abs(dy) <= reach GROUP BY 1, 2, 3),
        g AS (SELECT *, unnest(range({CELLS})) AS y_cell FROM (SELECT *, unnest(range({CELLS})) AS x_cell FROM rr)),
        j AS (SELECT run_id, x_cell, y_cell, coalesce(pixels, 0) AS pixels, scale, radius FROM g LEFT JOIN bins USING (image_id, x_cell, y_cell))
        SELECT run_id, x_cell, y_cell, pixels, coalesce(n, 0) AS count, round(pixels * scale * scale / 100 / (2 * radius * scale / {CELLS} / 10) ^ 2, 6) AS valid_fraction, CASE WHEN pixels > 0 THEN round(coalesce(n, 0) / (pixels * scale * scale / 100), 4) END AS density_cm2
        FROM j LEFT JOIN n USING (run_id, x_cell, y_cell)""",
    "mask_fields": f"""WITH {_RUNS}, {_cells(str(FIELD_MM), f'greatest(1, ceil(2 * radius * scale / {FIELD_MM}))', 0.5, True)},
        n AS (SELECT run_id, {_CELL('dx', FIELD_MM, f'greatest(1, ceil(2 * reach / {FIELD_MM}))')} AS x_cell, {_CELL('-dy', FIELD_MM, f'greatest(1, ceil(2 * reach / {FIELD_MM}))')} AS y_cell, count(*) AS n, count(*) FILTER (accepted) AS k FROM pts GROUP BY 1, 2, 3),
        j AS (SELECT run_id, x_cell, y_cell, pixels, pixels * scale * scale / 100 AS size FROM bins JOIN rr USING (image_id)),
        f AS (SELECT run_id, x_cell, y_cell, coalesce(pixels, 0) AS pixels, coalesce(n, 0) AS n, coalesce(k, 0) AS k, size FROM j FULL JOIN n USING (run_id, x_cell, y_cell))
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY y_cell, x_cell) AS field, x_cell, y_cell, pixels, n AS candidate_count, k AS accepted_count, n - k AS rejected_count, round(coalesce(size, 0), 6) AS valid_area_cm2,
            CASE WHEN size > 0 THEN round(k / size, 6) END AS density_cm2 FROM f""",
}
