"""From image files to written results: tiles, wafer circles, candidates, densities and a status for every image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators.detect import analyse
from spotlake.operators.grey import windowed
from spotlake.operators.rules import Limits
from spotlake.operators.scale import stored
from spotlake.operators.wafer import LEAST_CONFIDENCE, geometry, previews, wafers
from spotlake.sources.tables import write_candidates, write_summary
from spotlake.sources.tiles import read_tiles


def analyse_files(spark: SparkSession, paths: list[str], diameter_mm: float, tile: int = 1024, halo: int = 128, least: float = LEAST_CONFIDENCE,
                  circles: DataFrame | None = None, limits: Limits = Limits(), **how) -> dict[str, DataFrame]:
    """Tables ``candidates``, ``densities``, ``wafers`` and ``summaries`` of image files.

    Circles are searched for, or given as ``circles`` (image_id, cx, cy, radius). An image without an accepted circle or
    without valid area is 'failed' in the summaries and has no density; a theoretical area is never put in its place.
    """
    if not paths:
        raise ValueError("no paths")
    tiles = windowed(read_tiles(spark, paths, tile, halo))
    if circles is None:
        found = stored(wafers(previews(tiles), least))
    else:
        found = circles.select("image_id", "cx", "cy", "radius", F.lit(1.0).alias("confidence"), F.lit("given").alias("polarity"), F.lit(False).alias("cropped"), F.lit(True).alias("accepted"))
    candidates, densities = analyse(tiles, geometry(found, diameter_mm), limits, **how)
    candidates, densities = stored(candidates), stored(densities)
    done = F.coalesce(F.col("area_cm2") > 0, F.lit(False))
    summaries = found.select("image_id", "confidence", "cropped", "accepted").join(densities, "image_id", "left")
    summaries = summaries.select(
        "image_id", F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(~F.col("accepted"), "no wafer was found with enough confidence").when(~done, "no valid area").alias("failure"), "confidence",
        F.when(done, F.col("count")).alias("accepted_count"), F.when(done, F.col("rejected")).alias("rejected_count"),
        F.when(done, F.col("area_cm2")).alias("valid_analysis_area_cm2"), F.when(done, F.col("density_cm2")).alias("point_density_cm2"), done.alias("density_calculated"),
        F.filter(F.array(F.when(F.col("cropped"), "the image cuts the wafer")), lambda w: w.isNotNull()).alias("warnings"),
    )
    return {"candidates": candidates, "densities": densities, "wafers": found, "summaries": summaries}


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    write_candidates(results["candidates"], folder)
    write_summary(results["summaries"], folder)
    for name in ("densities", "wafers"):
        results[name].write.mode("overwrite").parquet(f"{folder}/{name}")
