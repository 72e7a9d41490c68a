"""Exact distances to the nearest boundary point of an image, by cells of growing size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.scale import cut, stored


def nearest_distance(points: DataFrame, boundary: DataFrame, start: float = 64.0) -> DataFrame:
    """(``id``, ``distance``) of every point (id, key, x, y) to the nearest boundary point (key, x, y) of its key.

    Boundary points are joined from the nine cells around; a minimum within the cell size is exact, the points left go
    on with cells twice as large, so a point meets about as many boundary points as a line through three cells holds.
    Points with a null or NaN, and points whose key has no boundary, have no row. Ids must be unique.
    """
    good = "key is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"
    numbers = lambda df, *ids: df.select(*ids, "key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(good)
    edge = stored(numbers(boundary).distinct().withColumnsRenamed({"x": "bx", "y": "by"}))
    left = stored(numbers(points, "id").join(edge.select("key").distinct(), "key", "left_semi"))
    out, size = None, start
    while left.limit(1).count():
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        near = F.explode(F.array(*[F.struct((cell("bx") + i).alias("cx"), (cell("by") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        around = edge.withColumn("c", near).select("key", "bx", "by", "c.*")
        met = left.select("id", "key", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).join(around, ["key", "cx", "cy"])
        least = met.groupBy("id").agg(F.min(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).alias("distance"))
        done = cut(least.where(F.col("distance") <= size))
        out = done if out is None else out.unionByName(done)
        left, size = cut(left.join(done, "id", "left_anti")), size * 2
    return left.select("id", F.lit(None).cast("double").alias("distance")) if out is None else out
