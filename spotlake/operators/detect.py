"""From image tiles to candidates: one threshold from summed histograms, detection per tile, rules and densities.

Tiles are rows with a halo; every stage is one pass over them. A candidate belongs to the tile whose core holds its centre.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.geometry import aspect_ratio, circularity, edge_distance_mm, wafer_coordinates
from spotlake.functions.scalars import with_poisson_interval
from spotlake.kernels import image as k
from spotlake.kernels.forest import predict
from spotlake.operators.boundary import nearest_distance
from spotlake.operators.density import rates
from spotlake.operators.grey import grey, pixels, windowed
from spotlake.operators.rules import Limits, reasons
from spotlake.operators.scale import stored
from spotlake.operators.signal import otsu

DETECTED = (
    "image_id string, tile_id int, area_px bigint, centroid_x_px double, centroid_y_px double, perimeter_px double, major_axis_length_px double, "
    "minor_axis_length_px double, eccentricity double, solidity double, mean_gray_raw double, mean_dark_response double, local_background_gray double, "
    "distance_to_valid_boundary_mm double, bounding_box array<int>"
)


def wafer_mask(row, edge_px: float = 0.0) -> np.ndarray:
    """Pixels of the tile within the wafer circle less an edge band."""
    y, x = np.mgrid[row.y0 : row.y0 + row.h, row.x0 : row.x0 + row.w]
    return (x - row.cx) ** 2 + (y - row.cy) ** 2 <= max(0.0, row.radius - edge_px) ** 2


def valid_mask(row, edge_px: float) -> np.ndarray:
    """The wafer less its edge band and less the invalid rectangles (half open), polygons and mask pixels of the image."""
    mask = wafer_mask(row, edge_px)
    for b in row.boxes if row.boxes is not None else ():
        x0, y0, x1, y1 = (max(0, int(v)) for v in (b[0] - row.x0, b[1] - row.y0, b[2] - row.x0, b[3] - row.y0))
        mask[y0:y1, x0:x1] = False
    for corners in row.polygons if row.polygons is not None else ():
        mask &= ~k.polygon_mask(mask.shape, np.array([list(c) for c in corners], float), row.x0, row.y0)
    if getattr(row, "mask_px", None) is not None:
        if (row.mask_image_w, row.mask_image_h) != (row.image_w, row.image_h):
            raise ValueError(f"{row.image_id}: the mask has another size than the image")
        bad = np.frombuffer(row.mask_px, np.dtype(row.mask_dtype)).reshape(int(row.mask_h), int(row.mask_w)) > 0
        dy, dx = int(row.mask_y0) - row.y0, int(row.mask_x0) - row.x0
        top, left = max(0, dy), max(0, dx)
        bad = bad[max(0, -dy) :, max(0, -dx) :][: mask.shape[0] - top, : mask.shape[1] - left]
        mask[top : top + bad.shape[0], left : left + bad.shape[1]] &= ~bad
    return mask


def _response(row, edge_px: float, background: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    need = k.reach(background)
    right, below = row.x0 + row.w, row.y0 + row.h
    sides = ((row.core_x - row.x0, row.x0 > 0), (row.core_y - row.y0, row.y0 > 0), (right - row.core_x - row.core_w, right < row.image_w), (below - row.core_y - row.core_h, below < row.image_h))
    if any(inner and halo < need for halo, inner in sides):
        raise ValueError(f"{row.image_id}: a background of {background} pixels reaches {need} pixels, beyond the halo")
    raw = grey(row)
    full = wafer_mask(row)
    dark, back = k.dark_response(raw, full, background)
    return raw, dark, back, valid_mask(row, edge_px)


def tile_histograms(tiles: DataFrame, edge_px: float, background: int, bins: int = 256) -> DataFrame:
    """(image_id, bin, n): the response of core pixels in the valid mask, over [0, 1]."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                _, dark, _, valid = _response(row, edge_px, background)
                y, x = row.core_y - row.y0, row.core_x - row.x0
                core = np.s_[y : y + row.core_h, x : x + row.core_w]
                n = np.bincount(np.minimum((dark[core][valid[core]] * bins).astype(int), bins - 1), minlength=bins)
                yield pd.DataFrame({"image_id": row.image_id, "bin": np.arange(bins), "n": n})

    return tiles.mapInPandas(count, "image_id string, bin int, n bigint").groupBy("image_id", "bin").agg(F.sum("n").alias("n"))


def thresholds(histograms: DataFrame, offset: float = 0.0, least: float = 0.02, bins: int = 256) -> DataFrame:
    """(image_id, cut): the first cut of three Otsu classes, lifted by ``offset`` and never below ``least``.

    The first, since the third class is that of large dark artefacts, which must not hide faint points; two levels are cut between them.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins)
        n[g["bin"]] = g["n"]
        top = otsu(n, 3 if np.count_nonzero(n) > 2 else 2)[0] if n.sum() else 0
        return pd.DataFrame({"image_id": [g["image_id"].iat[0]], "cut": [max(least, (top + 1) / bins + offset)]})

    return histograms.groupBy("image_id").applyInPandas(one, "image_id string, cut double")


def detect(tiles: DataFrame, edge_px: float, background: int, min_area: int, watershed: bool = True, trees: list | None = None) -> DataFrame:
    """Candidates of every tile (geometry and ``cut`` are columns of ``tiles``), those of its core only, in image coordinates.

    A response counts above the cut; with ``trees`` (a forest of bounded size) the probability of a pixel from the cut on.
    """

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                raw, dark, back, valid = _response(row, edge_px, background)
                hit = dark > row.cut if trees is None else predict(trees, k.pixel_features(raw).reshape(raw.size, -1)).reshape(raw.shape) >= row.cut
                labels, n = k.clean(hit & valid, min_area)
                if watershed:
                    labels, n = k.split_touching(labels, n)
                found = pd.DataFrame(k.measure(labels, n, raw, dark, back, np.zeros_like(dark)))
                if not len(found):
                    continue
                x, y = found["centroid_x_px"] + row.x0, found["centroid_y_px"] + row.y0
                own = (x >= row.core_x) & (x < row.core_x + row.core_w) & (y >= row.core_y) & (y < row.core_y + row.core_h)
                found = found.assign(
                    image_id=row.image_id, tile_id=row.tile_id, centroid_x_px=x, centroid_y_px=y,
                    distance_to_valid_boundary_mm=(row.radius - edge_px - np.hypot(x - row.cx, y - row.cy)) * row.mm_per_px,
                    bounding_box=[[b[0] + row.x0, b[1] + row.y0, b[2] + row.x0, b[3] + row.y0] for b in found["bounding_box"]],
                )[own]
                yield found[[c.split()[0] for c in DETECTED.split(", ")]]

    return tiles.mapInPandas(find, DETECTED)


def boundary_points(tiles: DataFrame, edge_px: float) -> DataFrame:
    """(key, x, y): the pixels outside the valid mask (or the image) next to a valid one; no pixel values are needed."""

    def border(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                around = {"x0": row.core_x - 1, "y0": row.core_y - 1, "w": row.core_w + 2, "h": row.core_h + 2}
                mask = valid_mask(SimpleNamespace(**(row._asdict() | around)), edge_px)
                y, x = np.arange(around["h"]) + around["y0"], np.arange(around["w"]) + around["x0"]
                mask &= ((y >= 0) & (y < row.image_h))[:, None] & ((x >= 0) & (x < row.image_w))[None, :]
                own = np.pad(mask[1:-1, 1:-1], 2)
                near = own[:-2, 1:-1] | own[2:, 1:-1] | own[1:-1, :-2] | own[1:-1, 2:]
                v, u = np.nonzero(near & ~mask)
                yield pd.DataFrame({"key": row.image_id, "x": x[u].astype(float), "y": y[v].astype(float)})

    return tiles.drop("px").mapInPandas(border, "key string, x double, y double").distinct()


def crops(tiles: DataFrame, candidates: DataFrame, half: int = 32, tile: int = 1024) -> DataFrame:
    """The columns of ``candidates`` with ``crop_x0``, ``crop_y0``, ``crop_w``, ``crop_h``, ``dtype`` and ``px``: raw pixels around each.

    ``candidates`` needs ``image_id``, ``centroid_x_px`` and ``centroid_y_px``; one outside the image or without a centre has no crop.
    Crops end at the image and at the halo of the tile that owns the centre, so the halo should be at least ``half``.
    """
    if half < 2:
        raise ValueError("half must be at least 2")
    own = [c for c in candidates.columns if c != "image_id"]
    at = lambda c: (F.floor(F.col(c) / tile) * tile).cast("int")
    placed = candidates.where("centroid_x_px is not null and centroid_y_px is not null and not isnan(centroid_x_px) and not isnan(centroid_y_px)")
    placed = placed.select("image_id", at("centroid_x_px").alias("core_x"), at("centroid_y_px").alias("core_y"), F.struct(*own).alias("__c"))
    names = ["crop_x0", "crop_y0", "crop_w", "crop_h", "dtype", "px"]
    shape = f"image_id string, __c {placed.schema['__c'].dataType.simpleString()}, crop_x0 int, crop_y0 int, crop_w int, crop_h int, dtype string, px binary"

    def cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                whole = pixels(row)
                for c in row.found:
                    x, y = int(np.floor(c["centroid_x_px"])) - row.x0, int(np.floor(c["centroid_y_px"])) - row.y0
                    left, top = max(0, x - half), max(0, y - half)
                    a = whole[top : y + half, left : x + half]
                    out.append((row.image_id, c, left + row.x0, top + row.y0, a.shape[1], a.shape[0], row.dtype, np.ascontiguousarray(a).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "__c", *names])

    # A tile's candidates are bounded by its area, so they travel with it in one list.
    lists = placed.groupBy("image_id", "core_x", "core_y").agg(F.collect_list("__c").alias("found"))
    cut_ = tiles.join(lists, ["image_id", "core_x", "core_y"]).mapInPandas(cut_out, shape)
    return cut_.select("image_id", "__c.*", *names)


def valid_area(tiles: DataFrame, edge_px: float) -> DataFrame:
    """Full, edge, invalid and valid pixels per image from core partial counts; full = edge + invalid + valid."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                y, x = row.core_y - row.y0, row.core_x - row.x0
                core = np.s_[y : y + row.core_h, x : x + row.core_w]
                full, inner, valid = (int(m[core].sum()) for m in (wafer_mask(row), wafer_mask(row, edge_px), valid_mask(row, edge_px)))
                yield pd.DataFrame({"image_id": [row.image_id], "full_px": [full], "inner_px": [inner], "valid_px": [valid], "scale": [row.mm_per_px]})

    slim = tiles.drop("px")
    sums = slim.mapInPandas(count, "image_id string, full_px bigint, inner_px bigint, valid_px bigint, scale double").groupBy("image_id")
    out = sums.agg(*[F.sum(c).alias(c) for c in ("full_px", "inner_px", "valid_px")], F.first("scale").alias("scale"))
    return out.select(
        "image_id", "full_px", (F.col("full_px") - F.col("inner_px")).alias("edge_px"), (F.col("inner_px") - F.col("valid_px")).alias("invalid_px"), "valid_px",
        (F.col("valid_px") * F.col("scale") * F.col("scale") / 100).alias("area_cm2"),
    )


def analyse(tiles: DataFrame, geometry: DataFrame, limits: Limits = Limits(), edge_px: float = 8.0, background: int = 101, offset: float = 0.0,
            invalid: DataFrame | None = None, trees: list | None = None, probability: float = 0.5, polygons: DataFrame | None = None,
            masks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, densities) of tiles and their geometry (``image_id``, ``cx``, ``cy``, ``radius``, ``mm_per_px``).

    Dark spots wider than ``background`` have no response and are no candidates; its reach (``kernels.image.reach``) must lie
    within the tiles' halo. No candidate is dropped: rejected ones keep their reasons. Images without geometry give nothing. ``invalid`` has
    rectangles (``image_id``, ``x0``, ``y0``, ``x1``, ``y1``, half open, in pixels) that count neither as area nor for
    candidates, ``polygons`` (``image_id``, ``corners`` as pairs x, y) likewise; ones with a null are ignored. ``masks``
    are tiles of the same grid whose pixels above 0 are invalid; a mask of another size than its image raises. Where any is given, distances to the valid boundary are those to the nearest pixel that does not count, else to the circle.
    With ``trees``, pixels of at least ``probability`` make candidates. All pixels are read on the grey scale of their image (``windowed``).
    """
    tiles = windowed(tiles)
    widest = min(limits.max_diameter_px, (4 * limits.max_area_px / np.pi) ** 0.5)
    if background < widest:
        warnings.warn(f"a background of {background} pixels does not fill dark spots up to the greatest accepted diameter of {widest:.0f}: wider ones are no candidates", stacklevel=2)
    boxes = "array<array<int>>"
    if invalid is None:
        geometry = geometry.withColumn("boxes", F.lit(None).cast(boxes))
    else:
        box = F.array(F.floor("x0"), F.floor("y0"), F.ceil("x1"), F.ceil("y1")).cast("array<int>")
        lists = invalid.dropna(subset=["image_id", "x0", "y0", "x1", "y1"]).groupBy("image_id").agg(F.collect_list(box).cast(boxes).alias("boxes"))
        geometry = geometry.join(lists, "image_id", "left")
    if polygons is None:
        geometry = geometry.withColumn("polygons", F.lit(None).cast("array<array<array<double>>>"))
    else:
        sound = polygons.where("image_id is not null and size(corners) >= 3").groupBy("image_id").agg(F.collect_list("corners").alias("polygons"))
        geometry = geometry.join(sound, "image_id", "left")
    tiles = tiles.join(F.broadcast(geometry) if geometry.limit(10_001).count() <= 10_000 else geometry, "image_id")
    if masks is not None:
        own = [F.col(c).alias(f"mask_{c}") for c in ("x0", "y0", "w", "h", "image_w", "image_h", "dtype", "px")]
        tiles = tiles.join(masks.select("image_id", "tile_id", *own), ["image_id", "tile_id"], "left")
    # Tiles that the wafer does not touch are dropped before they are decoded.
    gap = lambda lo, n, c: F.greatest(F.col(lo) - F.col(c), F.lit(0.0), F.col(c) - (F.col(lo) + F.col(n)))
    tiles = tiles.where(F.hypot(gap("core_x", "core_w", "cx"), gap("core_y", "core_h", "cy")) <= F.col("radius"))
    if trees is None:
        cuts = stored(thresholds(tile_histograms(tiles, edge_px, background), offset))
        tiles = tiles.join(F.broadcast(cuts) if cuts.limit(10_001).count() <= 10_000 else cuts, "image_id")
    else:
        tiles = tiles.withColumn("cut", F.lit(float(probability)))
    found = detect(tiles, edge_px, background, int(limits.min_area_px), trees=trees)
    if invalid is not None or polygons is not None or masks is not None:
        found = stored(found.withColumn("__id", F.monotonically_increasing_id()))
        far = nearest_distance(found.select(F.col("__id").alias("id"), F.col("image_id").alias("key"), F.col("centroid_x_px").alias("x"), F.col("centroid_y_px").alias("y")), boundary_points(tiles, edge_px))
        found = found.join(far.withColumnRenamed("id", "__id"), "__id", "left").join(geometry, "image_id")
        found = found.withColumn("distance_to_valid_boundary_mm", F.coalesce(F.col("distance") * F.col("mm_per_px"), "distance_to_valid_boundary_mm")).drop("__id", "distance")
    else:
        found = stored(found).join(geometry, "image_id")
    found = found.withColumns(wafer_coordinates("centroid_x_px", "centroid_y_px", "cx", "cy", "mm_per_px"))
    found = found.withColumns({
        "equivalent_diameter_px": F.sqrt(4 * F.col("area_px") / np.pi), "aspect_ratio": aspect_ratio("major_axis_length_px", "minor_axis_length_px"),
        "circularity": circularity("area_px", "perimeter_px"), "contrast": F.col("local_background_gray") - F.col("mean_gray_raw"),
        "distance_to_wafer_edge_mm": edge_distance_mm("radius", F.hypot(F.col("centroid_x_px") - F.col("cx"), F.col("centroid_y_px") - F.col("cy")), "mm_per_px"),
    })
    found = found.withColumn("reasons", reasons(limits)).withColumn("accepted", F.size("reasons") == 0).drop("cx", "cy", "radius", "boxes", "polygons")
    counts = found.groupBy("image_id").agg(F.count_if("accepted").alias("count"), F.count_if(~F.col("accepted")).alias("rejected"))
    areas = valid_area(tiles, edge_px).join(counts, "image_id", "left").fillna(0, ["count", "rejected"])
    return found, with_poisson_interval(rates(areas), "count")
