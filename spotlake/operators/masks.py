"""Label masks of samples: their objects, and predictions held against them pixel by pixel and object by object."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.kernels.image import label
from spotlake.operators.matching import hungarian
from spotlake.operators.signal import rle_to_mask

# How masks name pixels.
TARGET, BACKGROUND, IGNORE = 1, 2, 3
COUNTS = ("tp", "fp", "fn", "tn", "labelled_objects", "predicted_objects", "matched_objects")


def run_objects(masks: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, ``value``, ``object``, ``pixels``): the 8-connected objects of each value of run-length masks.

    ``keys`` must be unique. Masks that are null, without shape or with overlapping or outlying runs have no rows.
    """
    kinds = ", ".join(f"`{c}` {masks.schema[c].dataType.simpleString()}" for c in keys)
    flat = masks.where(F.col(f"{column}.runs").isNotNull() & (F.size(f"{column}.shape") == 2))
    flat = flat.select(*keys, F.col(f"{column}.shape").alias("__shape"), F.col(f"{column}.runs").alias("__runs"))

    def find(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    mask = rle_to_mask(tuple(int(v) for v in row["__shape"]), [[int(v) for v in r] for r in row["__runs"]])
                except (ValueError, TypeError):
                    continue
                for value in np.unique(mask[mask > 0]):
                    labels, n = label(mask == value)
                    sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
                    out += [(*(row[c] for c in keys), int(value), i + 1, int(s)) for i, s in enumerate(sizes)]
            yield pd.DataFrame(out, columns=[*keys, "value", "object", "pixels"])

    return flat.mapInPandas(find, f"{kinds}, value int, object int, pixels bigint")


def centres(mask: np.ndarray) -> np.ndarray:
    labels, n = label(mask)
    y, x = np.nonzero(labels)
    at = labels[y, x]
    size = np.maximum(np.bincount(at, minlength=n + 1)[1:], 1)
    return np.column_stack([np.bincount(at, x, n + 1)[1:] / size, np.bincount(at, y, n + 1)[1:] / size])


def compared(truth: np.ndarray, predicted: np.ndarray, tolerance: float = 5.0) -> tuple[list[int], list[float]]:
    """(counts in the order of ``COUNTS``, distances of the matched objects) of one mask.

    Only pixels labelled as target or background count. Objects are assigned once and for all without a penalty, then cut at the
    tolerance, so a far pair can cost a near one its match.
    """
    known, target = (truth == TARGET) | (truth == BACKGROUND), truth == TARGET
    cells = [int((known & a & b).sum()) for a, b in ((target, predicted), (~target, predicted), (target, ~predicted), (~target, ~predicted))]
    a, b = centres(target), centres(predicted)
    errors: list[float] = []
    if len(a) and len(b):
        cost = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
        errors = [float(cost[i, j]) for i, j in zip(*hungarian(cost), strict=True) if cost[i, j] <= tolerance]
    return [*cells, len(a), len(b), len(errors)], errors


def evaluated(samples: DataFrame, group: list[str], tolerance: float = 5.0) -> DataFrame:
    """Summed pixel and object counts per group of samples (``shape``, ``truth`` and ``predicted`` runs), with ratios.

    Each sample is compared where it lies; only its counts are shuffled. Ratios without a denominator are null. A
    null prediction is an empty one; a sample with a null or malformed truth counts nothing.
    """
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in group)
    names = [*group, *COUNTS, "error_sum", "error_max"]
    lead = f"{kinds}, " if group else ""

    def count(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    shape = tuple(int(v) for v in row["shape"])
                    truth = rle_to_mask(shape, [[int(v) for v in r] for r in row["truth"]])
                    predicted = rle_to_mask(shape, [[int(v) for v in r] for r in (row["predicted"] if row["predicted"] is not None else [])]) > 0
                except (ValueError, TypeError):
                    continue
                counts, errors = compared(truth, predicted, tolerance)
                out.append((*(row[c] for c in group), *counts, sum(errors), max(errors, default=None)))
            yield pd.DataFrame(out, columns=names).astype({"error_max": "float64"})

    shape = lead + ", ".join(f"{c} bigint" for c in COUNTS) + ", error_sum double, error_max double"
    rows = samples.select(*group, "shape", "truth", "predicted").mapInPandas(count, shape)
    out = rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in COUNTS], F.sum("error_sum").alias("error_sum"), F.max("error_max").alias("max_error_px"))
    ratio = lambda a, b: F.try_divide(F.col(a), sum((F.col(c) for c in b[1:]), F.col(b[0])))
    return out.select(
        *group, *COUNTS, ratio("tp", ["tp", "fp"]).alias("precision"), ratio("tp", ["tp", "fn"]).alias("recall"), ratio("tp", ["tp", "fp", "fn"]).alias("iou"),
        ratio("matched_objects", ["predicted_objects"]).alias("object_precision"), ratio("matched_objects", ["labelled_objects"]).alias("object_recall"),
        F.try_divide(2 * F.col("matched_objects"), F.col("predicted_objects") + F.col("labelled_objects")).alias("object_f1"),
        F.try_divide("error_sum", "matched_objects").alias("mean_error_px"), "max_error_px",
    )
