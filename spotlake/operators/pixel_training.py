"""Training rows of the pixel model: features of labelled pixels, taken where the tiles are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.kernels import image as k
from spotlake.operators.grey import grey
from spotlake.operators.masks import BACKGROUND, TARGET
from spotlake.operators.signal import rle_to_mask

# Least and greatest side of a labelled region.
SIDES = (32, 2048)


def fault() -> Column:
    """Why a region (``sample_id``, ``image_id``, ``roi``, ``runs``) cannot be used, the first that applies; null if it can.

    'missing': a null; 'roi': other than four numbers; 'position': it begins outside the image; 'side': a side outside ``SIDES``; 'runs': a run of
    other than three numbers, without length, or beyond the region.
    """
    r, runs = F.col("roi"), F.col("runs")
    size = F.get(r, F.lit(2)).cast("bigint") * F.get(r, F.lit(3))
    sound = lambda u: (F.size(u) == 3) & (F.get(u, F.lit(0)) >= 0) & (F.get(u, F.lit(1)) > 0) & (F.get(u, F.lit(0)).cast("bigint") + F.get(u, F.lit(1)) <= size)
    whole = (F.size(r) == 4) & F.forall(r, lambda v: v.isNotNull())
    return (
        F.when(F.col("sample_id").isNull() | F.col("image_id").isNull() | r.isNull() | runs.isNull(), "missing")
        .when(~whole, "roi")
        .when((F.get(r, F.lit(0)) < 0) | (F.get(r, F.lit(1)) < 0), "position")
        .when(~(F.get(r, F.lit(2)).between(*SIDES) & F.get(r, F.lit(3)).between(*SIDES)), "side")
        .when(~F.coalesce(F.forall(runs, sound), F.lit(False)), "runs")
    )


def left_out(samples: DataFrame) -> DataFrame:
    """(``sample_id``, ``reason``) of the regions that :func:`labelled_pixels` leaves out by :func:`fault`."""
    return samples.select("sample_id", fault().alias("reason")).where("reason is not null")


def labelled_pixels(tiles: DataFrame, samples: DataFrame, tile: int = 1024) -> DataFrame:
    """(``sample_id``, ``id``, ``x``, ``y``): features and class (1 target, 0 background) of every labelled pixel.

    ``samples``: sample_id, image_id, ``roi`` [x, y, width, height] and ``runs`` [start, length, value] over it. A region
    across tiles is labelled in each tile's core, so tiles need a halo of ``HALO`` pixels for features without seams.
    For a model that ``analyse`` is to use, tiles must be ``windowed``, as ``analyse`` reads pixels on the grey scale of their image.
    Regions with a :func:`fault` are left out (:func:`left_out` lists them), as are those whose runs overlap.
    """
    r = F.col("roi")
    good = samples.where(fault().isNull())
    at = lambda i: F.sequence(F.floor(r[i] / tile), F.floor((r[i] + r[i + 2] - 1) / tile))
    placed = good.select("image_id", "sample_id", "roi", "runs", F.explode(at(0)).alias("tx"), at(1).alias("ty")).withColumn("ty", F.explode("ty"))
    lists = placed.groupBy("image_id", (F.col("tx") * tile).cast("int").alias("core_x"), (F.col("ty") * tile).cast("int").alias("core_y")).agg(
        F.collect_list(F.struct(F.col("sample_id").cast("bigint").alias("sample_id"), "roi", "runs")).alias("samples")
    )

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                raw = grey(row)
                for s in row.samples:
                    x, y, w, h = (int(v) for v in s["roi"])
                    try:
                        mask = rle_to_mask((h, w), [[int(v) for v in run] for run in s["runs"]])
                    except (ValueError, TypeError):
                        continue
                    x0, x1 = max(x, row.core_x), min(x + w, row.core_x + row.core_w)
                    y0, y1 = max(y, row.core_y), min(y + h, row.core_y + row.core_h)
                    if x0 >= x1 or y0 >= y1:
                        continue
                    left, top = max(row.x0, x0 - k.HALO), max(row.y0, y0 - k.HALO)
                    around = raw[top - row.y0 : y1 + k.HALO - row.y0, left - row.x0 : x1 + k.HALO - row.x0]
                    features = k.pixel_features(around)[y0 - top : y1 - top, x0 - left : x1 - left]
                    own = mask[y0 - y : y1 - y, x0 - x : x1 - x]
                    v, u = np.nonzero((own == TARGET) | (own == BACKGROUND))
                    place = (v + y0 - y) * w + u + x0 - x
                    yield pd.DataFrame({"sample_id": s["sample_id"], "id": s["sample_id"] * (1 << 22) + place, "x": list(features[v, u]), "y": (own[v, u] == TARGET).astype(np.int32)})

    joined = tiles.join(lists, ["image_id", "core_x", "core_y"])
    return joined.mapInPandas(rows, "sample_id bigint, id bigint, x array<double>, y int")
