"""Same or near-same records across splits by content-defined chunks.

A region's normalised record is the run of columns and the run of rows of its image that it covers; a column or row
of an image is a token whose hash depends on the image and its position only. Each aligned block of tokens is cut once, at a token drawn by
the hash of image and block, so regions that overlap cut alike wherever both cover the image. A chunk is the
product of a chunk of columns and one of rows; equal digests are joined across splits and shared chunk areas are
summed into overlap fractions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.scale import stored

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(29)
    x = x * _B
    return x ^ (x >> np.uint64(32))


def cuts(image: int, axis: int, start: int, length: int, level: int) -> np.ndarray:
    """Cut positions within [start, start + length]: one per aligned block of 2**level tokens, drawn by the block's hash."""
    block = np.arange(start >> level, ((start + length) >> level) + 1, dtype=np.int64)
    salt = _mix(np.array([(image * 128 + axis * 64 + level) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    drawn = _mix(block.view(np.uint64) ^ salt) & np.uint64((1 << level) - 1)
    found = (block << level) + drawn.view(np.int64)
    return found[(found >= start) & (found <= start + length)]


def levels(length: int, least: float, train: bool) -> list[int]:
    """Chunk scales of a side: regions whose overlap is ``least`` of their union share a scale and, on it, a chunk.

    Two blocks fit into the common part of both sides if the block is at most a third of it, and that part is at least
    ``least`` of the longer side. The scale is that of the training region: its own top is at most that of the longer side. The tops of such a
    pair differ by one at most if ``least`` > 0.5, so the fewer, held-out regions are cut on three scales.
    """
    top = max(0, int(np.floor(np.log2(max(1.0, length * least / 3)))))
    return [top] if train else sorted({max(0, top - 1), top, top + 1})


def chunk_rows(rois: pd.DataFrame, least: float) -> pd.DataFrame:
    """One row (id, scale, digest, area) per chunk of the regions (id, image, x, y, w, h, t: of the training split)."""
    out_id, out_scale, out_digest, out_area = [], [], [], []
    for i, image, x, y, w, h, t in zip(*(rois[c].tolist() for c in ("id", "image", "x", "y", "w", "h", "t")), strict=True):
        columns = [(k, cuts(image, 0, x, w, k)) for k in levels(w, least, t)]
        rows = [(k, cuts(image, 1, y, h, k)) for k in levels(h, least, t)]
        for kx, cx in columns:
            for ky, cy in rows:
                if len(cx) < 2 or len(cy) < 2:
                    continue
                hx = _mix(_mix(cx[:-1].view(np.uint64)) + cx[1:].view(np.uint64))
                hy = _mix(_mix(cy[:-1].view(np.uint64)) ^ cy[1:].view(np.uint64))
                base = np.uint64((image ^ (kx << 8) ^ (ky << 16)) & 0xFFFFFFFFFFFFFFFF)
                digest = _mix((hx[:, None] + _mix(hy ^ base)[None, :])).view(np.int64).ravel()
                out_digest.append(digest)
                out_area.append((np.diff(cx)[:, None] * np.diff(cy)[None, :]).ravel())
                out_id.append(np.full(len(digest), i, np.int64))
                out_scale.append(np.full(len(digest), kx * 64 + ky, np.int32))
    parts = {"id": out_id, "scale": out_scale, "digest": out_digest, "area": out_area}
    return pd.DataFrame({k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in parts.items()})


def cross_split_overlaps(regions: DataFrame, least: float = 0.6, train: str = "calibration", held: tuple[str, ...] = ("validation", "locked_test")) -> DataFrame:
    """Pairs of classes of equal regions, one in ``train``, one in a ``held`` split, with overlap >= ``least`` of the union.

    ``regions`` (``image`` text, ``split``, ``x``, ``y``, ``w``, ``h`` integers) may hold repeats and rows of any split;
    rows with a null in these columns or without area are ignored. Returns the image, each class's split and box, the
    chunk overlap fraction (shared chunk area of the smaller region, a lower bound) and the exact ratio. Each split of
    the held side is a class of its own; copies are not expanded.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must lie in (0.5, 1]")
    box = ["x", "y", "w", "h"]
    rows = regions.select("image", "split", *[F.col(c).cast("bigint") for c in box]).dropna().where("w > 0 and h > 0")
    classes = rows.where(F.col("split").isin(train, *held)).distinct()
    sides = classes.groupBy("image").agg(F.max(F.col("split") == train).alias("t"), F.max(F.col("split") != train).alias("e")).where("t and e")
    classes = stored(classes.join(sides.select("image"), "image", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    chunks = classes.select("id", F.xxhash64("image").alias("image"), *box, (F.col("split") == train).alias("t")).mapInPandas(
        lambda parts: (chunk_rows(p, least) for p in parts), "id bigint, scale int, digest bigint, area bigint"
    )
    side = classes.select("id", (F.col("split") == train).alias("t"))
    chunks = stored(chunks.join(side, "id"))
    a = chunks.where("t").select(F.col("id").alias("ta"), "scale", "digest", "area")
    b = chunks.where("not t").select(F.col("id").alias("eb"), "scale", "digest")
    # The chunks of one pair of scales cover a region at most once; of several shared pairs of scales the best counts.
    per_scale = a.join(b, ["digest", "scale"]).groupBy("ta", "eb", "scale").agg(F.sum("area").alias("shared"))
    shared = per_scale.groupBy("ta", "eb").agg(F.max("shared").alias("shared"))
    left = classes.select(F.col("id").alias("ta"), "image", F.col("split").alias("train_split"), *[F.col(c).alias(f"{c}a") for c in box])
    right = classes.select(F.col("id").alias("eb"), F.col("image").alias("image_b"), F.col("split").alias("held_split"), *[F.col(c).alias(f"{c}b") for c in box])
    pairs = shared.join(left, "ta").join(right, "eb").where("image = image_b")
    wide = F.greatest(F.lit(0), F.least(F.expr("xa + wa"), F.expr("xb + wb")) - F.greatest("xa", "xb"))
    high = F.greatest(F.lit(0), F.least(F.expr("ya + ha"), F.expr("yb + hb")) - F.greatest("ya", "yb"))
    common = wide * high
    union = F.expr("wa * ha + wb * hb") - common
    return (
        pairs.withColumn("common", common).withColumn("iou", common / union)
        .where(F.col("iou") >= least)
        .withColumn("chunk_overlap", F.least(F.lit(1.0), F.col("shared") / F.least(F.expr("wa * ha"), F.expr("wb * hb"))))
        .drop("image_b", "shared", "common", "ta", "eb")
    )
