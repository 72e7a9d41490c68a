"""Area-normalised densities: whole runs, rings, sectors, regions, grids and local fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.geometry import bin_of, field_index


def rates(df: DataFrame, count: str = "count", area: str = "area_cm2") -> DataFrame:
    """Density and its standard error; null where there is no area, the count stays."""
    n, s = F.col(count), F.col(area)
    return df.withColumns({"density_cm2": F.when(s > 0, n / s), "sigma_cm2": F.when(s > 0, F.sqrt(n.cast("double")) / s)})


def dense_bins(spark, n: int, name: str = "bin") -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def counted(points: DataFrame, bins: DataFrame, number: Column, name: str = "bin") -> DataFrame:
    """Every bin with its number of points; empty bins have 0."""
    counts = points.select(number.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count"))
    return bins.join(counts, name, "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def rings(points: DataFrame, radius_mm: float, bins: int = 6) -> DataFrame:
    """Rings of equal width of a disc."""
    step = radius_mm / bins
    table = counted(points, dense_bins(points.sparkSession, bins), bin_of("r", 0.0, radius_mm, bins))
    inner, outer = F.col("bin") * step, (F.col("bin") + 1) * step
    return rates(table.withColumns({"r_inner_mm": inner, "r_outer_mm": outer, "area_cm2": math.pi * (outer * outer - inner * inner) / 100}))


def sectors(points: DataFrame, radius_mm: float, bins: int = 12) -> DataFrame:
    """Sectors of a disc, counter-clockwise from +x."""
    table = counted(points, dense_bins(points.sparkSession, bins), bin_of("angle", 0.0, 360.0, bins))
    step = 360.0 / bins
    return rates(table.withColumns({"angle_start_deg": F.col("bin") * step, "angle_end_deg": (F.col("bin") + 1) * step, "area_cm2": F.lit(math.pi * radius_mm**2 / 100 / bins)}))


def equal_area_edges(values: DataFrame, high: float, bins: int, fine: int = 4096, value: str = "r") -> DataFrame:
    """Edges that part the values into ``bins`` groups of about equal count, to one of ``fine`` steps.

    Edge k is the end of the first step at which k / bins of the values are reached; edges never run backwards.
    The histogram has at most ``fine`` rows whatever the input.
    """
    hist = values.groupBy(bin_of(value, 0.0, high, fine).alias("step")).agg(F.count("*").alias("n")).where("step is not null")
    total = hist.agg(F.sum("n").alias("total"))
    running = hist.withColumn("upto", F.sum("n").over(Window.orderBy("step"))).join(total, F.lit(True))
    ks = values.sparkSession.range(1, bins).select(F.col("id").cast("int").alias("k"))
    reached = running.join(F.broadcast(ks), F.col("upto") * bins >= F.col("k") * F.col("total"))
    edges = reached.groupBy("k").agg(F.min("step").alias("step"))
    return edges.select("k", F.round((F.col("step") + 1) * (high / fine), 9).alias("edge"))


def regions(points: DataFrame, ranges: list[tuple[str, float, float]], radius_mm: float) -> DataFrame:
    """Named ranges of the normalised radius, closed on the left and at the rim; they may overlap or leave gaps."""
    table = points.sparkSession.createDataFrame(ranges, "region string, low double, high double")
    q = F.col("r") / radius_mm
    inside = (q >= F.col("low")) & ((q < F.col("high")) | ((F.col("high") >= 1.0) & (q <= F.col("high"))))
    counts = points.join(F.broadcast(table), inside).groupBy("region").agg(F.count("*").alias("count"))
    area = math.pi * radius_mm**2 / 100 * (F.col("high") * F.col("high") - F.col("low") * F.col("low"))
    out = table.join(counts, "region", "left").withColumns({"count": F.coalesce("count", F.lit(0).cast("bigint")), "area_cm2": area})
    return rates(out)


def grid(points: DataFrame, reach_mm: float, bins: int = 40) -> DataFrame:
    """A dense square grid over [-reach, reach]; x outer, y inner; every cell is present."""
    spark = points.sparkSession
    cells = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("x_bin"), (F.col("id") % bins).cast("int").alias("y_bin"))
    at = points.select(bin_of("x", -reach_mm, reach_mm, bins).alias("x_bin"), bin_of("y", -reach_mm, reach_mm, bins).alias("y_bin")).dropna()
    counts = at.groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))
    side = 2 * reach_mm / bins
    out = cells.join(counts, ["x_bin", "y_bin"], "left").withColumns(
        {"count": F.coalesce("count", F.lit(0).cast("bigint")), "x_left_mm": -reach_mm + F.col("x_bin") * side, "y_low_mm": -reach_mm + F.col("y_bin") * side, "area_cm2": F.lit(side * side / 100)}
    )
    return rates(out)


def field_cube(points: DataFrame, radius_mm: float, field_mm: float) -> DataFrame:
    """Counts per local field with the totals of rows, columns and the whole; total rows have nulls and a level."""
    x, y, _ = field_index("x", "y", radius_mm, field_mm)
    at = points.select(x.alias("x_field"), y.alias("y_field"), "accepted").where("x_field is not null and y_field is not null")
    return at.cube("y_field", "x_field").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.grouping_id().cast("int").alias("level"))


def runs_of_mask(masks: DataFrame, bins: int, radius_px: float, cx: float, cy: float) -> DataFrame:
    """Valid pixels per ring from mask runs (image_id, y, x_start, x_len); pixels are the unit of work, spread by run."""
    pixels = masks.where("x_len > 0").select("image_id", "y", F.explode(F.sequence("x_start", F.col("x_start") + F.col("x_len") - 1)).alias("x"))
    r = F.hypot(F.col("x") - cx, F.col("y") - cy)
    return pixels.select("image_id", bin_of(r, 0.0, radius_px, bins).alias("bin")).groupBy("image_id", "bin").agg(F.count("*").alias("pixels"))
