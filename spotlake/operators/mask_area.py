"""Valid area of wafers by ring, sector, region, grid cell and field, from signed pixel runs instead of pixels.

A wafer's rows are runs of its disc, counted once, and the union of its invalid rectangles in each row are runs within the disc,
counted minus once. How many pixels of a run lie in a bin follows from the ends of both, so the work grows with the rows
of the images and the heights of the rectangles, never with their pixels. Rows are made from strips, after the last join, and
go straight into sums: only strips and sums are moved, and neither rows nor cells are ever one side of a join. Rectangles and
discs are joined by sorting: a broadcast is planned from the size of the files, and repeated rectangles take far less there
than in the driver's memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.scalars import with_poisson_interval

SHAPE = ("cx", "cy", "radius", "scale")
# Rows of an image that are handled together, rows of all images in a task.
STRIP, ROWS_EACH = 256, 500_000


def _in_strips(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows ``low`` to ``high`` (excluded) parted at the multiples of STRIP, with the number of the strip."""
    parts = df.withColumn("strip", F.explode(F.sequence(F.floor(F.col(low) / STRIP).cast("int"), F.floor((F.col(high) - 1) / STRIP).cast("int"))))
    return parts.withColumns({low: F.greatest(F.col(low), F.col("strip") * STRIP), high: F.least(F.col(high), (F.col("strip") + 1) * STRIP)})


def disjoint(boxes: DataFrame) -> DataFrame:
    """(image_id, strip, y0, y1, x0, x1): the union of boxes (image_id, x0, y0, x1, y1) as boxes that don't overlap, none across strips.

    Within a strip the rows between two ends of boxes hold the same boxes, so they are united once for all. A strip has at most
    STRIP + 1 ends, so the list of them stays short however many boxes there are.
    """
    parts = _in_strips(boxes, "y0", "y1")
    strip = Window.partitionBy("image_id", "strip")
    parts = parts.withColumn("ends", F.array_sort(F.array_union(F.collect_set("y0").over(strip), F.collect_set("y1").over(strip))))
    between = F.transform("ends", lambda y, k: F.struct(y.alias("low"), F.get("ends", k + 1).alias("high")))
    bands = parts.select("image_id", "strip", "x0", "x1", F.inline(F.filter(between, lambda e: (e["low"] >= F.col("y0")) & (e["low"] < F.col("y1")))))
    by = Window.partitionBy("image_id", "strip", "low").orderBy("x0", "x1")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = bands.withColumn("new", F.when(reach >= F.col("x0"), 0).otherwise(1)).withColumn("bar", F.sum("new").over(by))
    return marked.groupBy("image_id", "strip", F.col("low").alias("y0"), F.col("high").alias("y1"), "bar").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("bar")


def _sound(wafers: DataFrame) -> DataFrame:
    return wafers.dropna().where("radius > 0 and scale > 0 and width > 0 and height > 0")


def signed_runs(wafers: DataFrame, invalid: DataFrame) -> DataFrame:
    """(image_id, y, a, b, sign, cx, cy, radius, scale): pixels a to b of row y count ``sign`` times.

    ``wafers`` (image_id unique, width, height, cx, cy, radius in pixels, scale in mm a pixel) are discs cut by their
    image; ``invalid`` (image_id, x0, y0, x1, y1, half open, in any order of the corners) may overlap. Rows with a null,
    and rectangles of images without wafer, count for nothing. Rectangles are cut to the disc's rows before these are listed.
    """
    rows = _sound(wafers)
    first, last = F.greatest(F.lit(0), F.ceil(F.col("cy") - F.col("radius"))), F.least(F.col("height") - 1, F.floor(F.col("cy") + F.col("radius")))
    discs = rows.where(first <= last).withColumns({"first": first.cast("int"), "end": (last + 1).cast("int"), "width": F.col("width").cast("int")})
    boxes = invalid.dropna(subset=["image_id", "x0", "y0", "x1", "y1"]).join(discs.select("image_id", "width", "first", "end").hint("merge"), "image_id").select(
        "image_id", F.greatest(F.least("x0", "x1").cast("int"), F.lit(0)).alias("x0"), F.least(F.greatest("x0", "x1").cast("int"), "width").alias("x1"),
        F.greatest(F.least("y0", "y1").cast("int"), "first").alias("y0"), F.least(F.greatest("y0", "y1").cast("int"), "end").alias("y1"),
    )
    own = ["image_id", "strip", "y0", "y1", "x0", "x1", *SHAPE]
    whole = _in_strips(discs.select("image_id", F.col("first").alias("y0"), F.col("end").alias("y1"), F.lit(0).alias("x0"), F.col("width").alias("x1"), *SHAPE), "y0", "y1")
    cut = disjoint(boxes.where("x0 < x1 and y0 < y1").distinct()).join(discs.select("image_id", *SHAPE).hint("merge"), "image_id")
    strips = whole.select(*own, F.lit(1).alias("sign")).unionByName(cut.select(*own, F.lit(-1).alias("sign")))
    # Strips are few and short, their rows are many: the number of tasks follows from the rows.
    tasks = max(1, -(-(discs.agg(F.sum((F.col("end") - F.col("first")).cast("bigint"))).first()[0] or 0) // ROWS_EACH))
    spread = strips.repartition(tasks, "image_id", "strip")
    half = F.sqrt(F.greatest(F.lit(0.0), F.col("radius") * F.col("radius") - (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))))
    a, b = F.greatest("x0", F.ceil(F.col("cx") - half).cast("int")), F.least(F.col("x1") - 1, F.floor(F.col("cx") + half).cast("int"))
    return spread.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1))).select("image_id", "y", a.alias("a"), b.alias("b"), "sign", *SHAPE).where("a <= b")


def _inside(low: Column, high: Column) -> Column:
    """Pixels of a run from ``low`` to ``high`` (whole numbers), signed."""
    return F.greatest(F.lit(0), F.least(F.col("b"), high) - F.greatest(F.col("a"), low) + 1) * F.col("sign")


def valid_pixels(runs: DataFrame) -> DataFrame:
    """(image_id, pixels, area_cm2, max_radius_mm): the valid area and the distance of its outermost pixel.

    An end of a disc's run can be invalid, so that distance is at most that of the disc.
    """
    far = F.greatest(F.abs(F.col("a") - F.col("cx")), F.abs(F.col("b") - F.col("cx")))
    out = runs.groupBy("image_id").agg(
        F.sum((F.col("b") - F.col("a") + 1) * F.col("sign")).alias("pixels"), F.max("scale").alias("scale"), F.max(F.when(F.col("sign") == 1, F.hypot(far, F.col("y") - F.col("cy")))).alias("far")
    )
    return out.select("image_id", "pixels", (F.col("pixels") * F.col("scale") * F.col("scale") / 100).alias("area_cm2"), (F.col("far") * F.col("scale")).alias("max_radius_mm"))


def _within(runs: DataFrame, fractions: list[float]) -> DataFrame:
    """(image_id, upto): valid pixels nearer to the centre than each fraction of the radius, in one pass over the runs."""
    dy = F.col("y") - F.col("cy")

    def count(share: float) -> Column:
        if share >= 1:
            return (F.col("b") - F.col("a") + 1) * F.col("sign")
        rho = F.lit(float(share)) * F.col("radius")
        half = F.sqrt(F.greatest(F.lit(0.0), rho * rho - dy * dy))
        return F.when(rho > F.abs(dy), _inside(F.floor(F.col("cx") - half) + 1, F.ceil(F.col("cx") + half) - 1)).otherwise(0)

    return runs.groupBy("image_id").agg(F.array(*[F.sum(count(q)).cast("bigint") for q in fractions]).alias("upto"))


def within_radii(runs: DataFrame, fractions: list[float]) -> DataFrame:
    """(image_id, edge, pixels): valid pixels nearer to the centre than each fraction of the radius; from 1 on, all."""
    return _within(runs, fractions).select("image_id", F.posexplode("upto").alias("edge", "pixels"))


def ring_pixels(runs: DataFrame, bins: int) -> DataFrame:
    """(image_id, bin, pixels) of rings of equal width."""
    parts = [F.struct(F.lit(k).alias("bin"), (F.col("upto")[k + 1] - F.col("upto")[k]).alias("pixels")) for k in range(bins)]
    return _within(runs, [k / bins for k in range(bins + 1)]).select("image_id", F.inline(F.array(*parts)))


def region_pixels(runs: DataFrame, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """(image_id, region, pixels) of named ranges of the normalised radius, closed on the left and at the rim; they may overlap."""
    fractions = sorted({q for _, low, high in ranges for q in (low, high)})
    at = fractions.index
    parts = [F.struct(F.lit(n).alias("region"), (F.col("upto")[at(high)] - F.col("upto")[at(low)]).alias("pixels")) for n, low, high in ranges]
    return _within(runs, fractions).select("image_id", F.inline(F.array(*parts)))


def sector_pixels(runs: DataFrame, bins: int) -> DataFrame:
    """(image_id, bin, pixels) of sectors counter-clockwise from +x; ``bins`` is even, so that none crosses the x axis.

    Within a row the angle runs one way with x, so a sector is a stretch of it.
    """
    if bins % 2:
        raise ValueError("bins must be even")
    half, step = bins // 2, 360.0 / bins
    cot = [1e6] + [0.0 if 2 * k == half else 1 / math.tan(math.radians(k * step)) for k in range(1, half)] + [-1e6]
    up, cx, a, b = F.col("cy") - F.col("y"), F.col("cx"), F.col("a"), F.col("b")
    sums = []
    for k in range(half):  # above the axis a sector holds inner < dx / up <= outer
        high = b if k == 0 else F.floor(cx + up * F.lit(cot[k]))
        low = a if k == half - 1 else F.floor(cx + up * F.lit(cot[k + 1])) + 1
        sums.append(F.when(up > 0, _inside(low, high)))
    for k in reversed(range(half)):  # below it, mirrored, inner <= dx / -up < outer
        high = b if k == 0 else F.ceil(cx - up * F.lit(cot[k])) - 1
        low = a if k == half - 1 else F.ceil(cx - up * F.lit(cot[k + 1]))
        sums.append(F.when(up < 0, _inside(low, high)))
    # On the axis, the centre and all to its right have the angle 0, all to its left 180.
    sums[0] = sums[0].when(up == 0, _inside(F.ceil(cx), b))
    sums[half] = sums[half].when(up == 0, _inside(a, F.ceil(cx) - 1))
    parts = runs.groupBy("image_id").agg(F.array(*[F.sum(c).cast("bigint") for c in sums]).alias("parts"))
    return parts.select("image_id", F.posexplode("parts").alias("bin", "pixels")).where("pixels is not null")


def cell_pixels(runs: DataFrame, side_mm: Column, cells: Column, middle: float = 0.0, down: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """(image_id, x_cell, y_cell, pixels) of square cells from -radius on, y upwards unless ``down``; outer cells take what lies beyond.

    ``middle`` is the place of a pixel's centre within it. Cells that no run reaches are listed for the wafers in ``whole`` only, with 0 pixels.
    """
    sized = lambda df: df.select("*", (F.col("radius") * F.col("scale")).alias("reach"), side_mm.alias("side"), cells.alias("n"))
    rows = sized(runs)
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.col("n") - 1)).cast("int")
    cell = lambda p: clip(F.floor(((p + middle - F.col("cx")) * F.col("scale") + F.col("reach")) / F.col("side")))
    below = (F.col("y") + middle - F.col("cy")) * F.col("scale")
    y_cell = clip(F.floor(((below if down else -below) + F.col("reach")) / F.col("side")))
    edge = lambda k: F.ceil((k * F.col("side") - F.col("reach")) / F.col("scale") + F.col("cx") - middle).cast("int")
    low = lambda k: F.when(k == 0, F.col("a")).otherwise(edge(k))
    high = lambda k: F.when(k == F.col("n") - 1, F.col("b")).otherwise(edge(k + 1) - 1)
    left, right = F.col("left"), F.col("right")
    rows = rows.withColumns({"y_cell": y_cell, "left": cell(F.col("a")), "right": cell(F.col("b"))})
    if whole is not None:  # in each row of cells a run over all of them that counts for nothing
        none = sized(_sound(whole).select("image_id", F.lit(0).alias("y"), F.lit(0).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("sign"), *SHAPE))
        end = (F.col("n") - 1).cast("int")
        rows = rows.unionByName(none.withColumns({"y_cell": F.explode(F.sequence(F.lit(0), end)), "left": F.lit(0), "right": end}))
    # A run covers all columns of the cells between those of its ends, so the runs with the same cells at their ends are summed first.
    sums = rows.groupBy("image_id", "y_cell", "left", "right").agg(
        F.sum(_inside(low(left), high(left))).alias("at_left"), F.sum(_inside(low(right), high(right))).alias("at_right"), F.sum("sign").alias("between"),
        *[F.max(c).alias(c) for c in ("side", "reach", "scale", "cx")],
    )
    spread = sums.withColumn("x_cell", F.explode(F.sequence("left", "right")))
    at = F.col("x_cell")
    pixels = F.when(at == left, F.col("at_left")).when(at == right, F.col("at_right")).otherwise(F.col("between") * (edge(at + 1) - edge(at)))
    return spread.groupBy("image_id", "x_cell", "y_cell").agg(F.sum(pixels).cast("bigint").alias("pixels"))


def area_densities(bins: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``bins`` (keys, pixels, scale) with the counts (keys, count) of each: area and density.

    Where no pixel is valid, the count stays and the density is null. Counts of keys that ``bins`` does not list are left out, so it has to list all.
    """
    out = bins.join(counts, keys, "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    out = out.withColumn("valid_area_cm2", F.col("pixels") * F.col("scale") * F.col("scale") / 100).drop("scale")
    return out.withColumn("density_cm2", F.when(F.col("valid_area_cm2") > 0, F.col("count") / F.col("valid_area_cm2")))


def densities(bins: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``area_densities`` with the exact Poisson interval."""
    out = with_poisson_interval(area_densities(bins, counts, keys), "count")
    per = lambda c: F.when(F.col("valid_area_cm2") > 0, F.col(c) / F.col("valid_area_cm2"))
    return out.withColumns({"poisson_lower_cm2": per("poisson_lower"), "poisson_upper_cm2": per("poisson_upper")}).drop("poisson_lower", "poisson_upper")


def fields(areas: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Local fields: those with valid pixels (keys, x_cell, y_cell, pixels) or points (keys, x_cell, y_cell, ``accepted``), numbered per key.

    Fields without candidates have counts of 0, fields without valid pixels no density. Numbers run along the rows from the first.
    """
    own = [*keys, "x_cell", "y_cell"]
    counts = points.groupBy(*own).agg(F.count("*").alias("candidate_count"), F.count_if("accepted").alias("accepted_count"))
    out = areas.where("pixels > 0").join(counts, own, "full").fillna(0, ["pixels", "candidate_count", "accepted_count"])
    out = out.withColumn("rejected_count", F.col("candidate_count") - F.col("accepted_count"))
    return out.withColumn("field", F.row_number().over(Window.partitionBy(*keys).orderBy("y_cell", "x_cell")))
