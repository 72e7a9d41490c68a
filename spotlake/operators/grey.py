"""One grey scale per image: the exact 1st and 99th percentiles of its pixels, joined to its tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.kernels import image as k
from spotlake.operators.scale import broadcast_within, stored


def pixels(row) -> np.ndarray:
    return np.frombuffer(row.px, np.dtype(row.dtype)).reshape(row.h, row.w)


def grey(row) -> np.ndarray:
    """The pixels of a tile in [0, 1]: on the scale of its image if the tile is ``windowed``, else by its type alone."""
    if getattr(row, "low", None) is None:
        return k.as_float01(pixels(row))
    return k.normalize(pixels(row), row.low, row.high, bool(row.inverted))


def _keys(row) -> np.ndarray:
    """The finite core pixels as 32-bit numbers in the order of their float32 values."""
    y, x = row.core_y - row.y0, row.core_x - row.x0
    a = pixels(row)[y : y + row.core_h, x : x + row.core_w].astype(np.float32)
    bits = (a[np.isfinite(a)] + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _value(key: int) -> float:
    bits = np.uint32(key ^ (1 << 31) if key >> 31 else key ^ 0xFFFFFFFF)
    return float(bits.view(np.float32))


def windows(tiles: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """(image_id, ``low``, ``high``): exact percentiles of the finite pixels, interpolated between neighbours.

    The upper halves of the pixels' float32 keys are counted first, then the lower halves where a wanted rank falls. Where
    both percentiles are equal, the least and greatest value stand in, and of a uniform image its value and one more. An
    image without finite pixels has no row.
    """

    def upper(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                key, n = np.unique(_keys(row) >> 16, return_counts=True)
                yield pd.DataFrame({"image_id": row.image_id, "top": key.astype(np.int32), "n": n})

    def ranks(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("top")
        ends = np.cumsum(g["n"].to_numpy())
        last = int(ends[-1]) - 1
        at = [q * last / 100 for q in (low, high)]
        wanted = np.array([0, *[f(p) for p in at for f in (np.floor, np.ceil)], last], np.int64)
        bin_ = np.searchsorted(ends, wanted, side="right")
        inside = wanted - (ends - g["n"].to_numpy())[bin_]
        return pd.DataFrame({"image_id": [g["image_id"].iat[0]], "tops": [g["top"].to_numpy()[bin_].tolist()], "inside": [inside.tolist()], "parts": [[p % 1 for p in at]]})

    def lower(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                keys = _keys(row)
                key, n = np.unique(keys[np.isin(keys >> 16, np.asarray(row.tops))], return_counts=True)
                yield pd.DataFrame({"image_id": row.image_id, "key": key.astype(np.int64), "n": n})

    def ends(key: tuple, counts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"image_id": [], "low": [], "high": []})
        counts, want = counts.sort_values("key"), wanted.iloc[0]
        keys, n, v = counts["key"].to_numpy(), counts["n"].to_numpy(), []
        for top, rank in zip(want["tops"], want["inside"], strict=True):
            own = keys >> 16 == top
            v.append(_value(int(keys[own][np.searchsorted(np.cumsum(n[own]), rank, side="right")])))
        a, b = (v[i] + (v[i + 1] - v[i]) * p for i, p in zip((1, 3), want["parts"], strict=True))
        if not b > a:
            a, b = (v[0], v[5]) if v[5] > v[0] else (v[0], v[0] + 1.0)
        return pd.DataFrame({"image_id": [key[0]], "low": [a], "high": [b]})

    coarse = tiles.mapInPandas(upper, "image_id string, top int, n bigint").groupBy("image_id", "top").agg(F.sum("n").alias("n"))
    wanted = stored(coarse.groupBy("image_id").applyInPandas(ranks, "image_id string, tops array<int>, inside array<bigint>, parts array<double>"))
    marked = tiles.join(broadcast_within(wanted.select("image_id", "tops"), 10_000), "image_id")
    fine = marked.mapInPandas(lower, "image_id string, key bigint, n bigint").groupBy("image_id", "key").agg(F.sum("n").alias("n"))
    return fine.groupBy("image_id").cogroup(wanted.groupBy("image_id")).applyInPandas(ends, "image_id string, low double, high double")


def extrema(tiles: DataFrame) -> DataFrame:
    """(image_id, ``least``, ``greatest``, ``pixels``, ``finite``, ``below``, ``above``): exact extremes of the finite pixels and the shares
    of these beyond the window of ``windowed`` tiles, which are clipped; null without a window or without finite pixels.
    """
    has = "low" in tiles.columns

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                y, x = row.core_y - row.y0, row.core_x - row.x0
                a = pixels(row)[y : y + row.core_h, x : x + row.core_w].astype(np.float64)
                v = a[np.isfinite(a)]
                ends = (float(v.min()), float(v.max())) if len(v) else (None, None)
                out.append((row.image_id, *ends, a.size, len(v), int((v < row.low).sum()) if has else None, int((v > row.high).sum()) if has else None))
            yield pd.DataFrame(out, columns=["image_id", "least", "greatest", "pixels", "finite", "under", "over"])

    each = tiles.mapInPandas(part, "image_id string, least double, greatest double, pixels bigint, finite bigint, under bigint, over bigint")
    sums = [F.sum(c).alias(c) for c in ("pixels", "finite", "under", "over")]
    out = each.groupBy("image_id").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), *sums)
    return out.select("image_id", "least", "greatest", "pixels", "finite", F.try_divide("under", "finite").alias("below"), F.try_divide("over", "finite").alias("above"))


def decimated(tiles: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column of each image, in pieces (image_id, y, x, h, w, dtype, px): places count kept rows and columns.

    A tile gives the kept pixels of its core as they stand; one that holds none gives no row. No image is put together.
    """
    if step < 1:
        raise ValueError("the step is at least 1")

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                y, x = -row.core_y % step, -row.core_x % step
                if y < row.core_h and x < row.core_w:
                    dy, dx = row.core_y - row.y0, row.core_x - row.x0
                    a = pixels(row)[dy : dy + row.core_h, dx : dx + row.core_w][y::step, x::step]
                    out.append((row.image_id, (row.core_y + y) // step, (row.core_x + x) // step, *a.shape, row.dtype, a.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "y", "x", "h", "w", "dtype", "px"])

    return tiles.mapInPandas(part, "image_id string, y int, x int, h int, w int, dtype string, px binary")


def windowed(tiles: DataFrame) -> DataFrame:
    """``tiles`` with the window of their image (``low``, ``high``) and ``inverted``, true where zero is white.

    Tiles that have a window keep it; an image without finite pixels gets [0, 1], in which all its pixels are 0.
    """
    if "low" in tiles.columns:
        return tiles
    found = broadcast_within(stored(windows(tiles)), 10_000)
    out = tiles.join(found, "image_id", "left").withColumns({"low": F.coalesce("low", F.lit(0.0)), "high": F.coalesce("high", F.lit(1.0))})
    return out.withColumn("inverted", F.coalesce("inverted", F.lit(False)) if "inverted" in tiles.columns else F.lit(False))
