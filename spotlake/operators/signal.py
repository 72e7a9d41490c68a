"""Sequences and histograms: sliding medians, run lengths and Otsu thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.scale import numbered, stored


def sliding_median(df: DataFrame, group: list[str], order: list[str], value: str, half: int = 25, out: str = "median", piece: int = 20_000) -> DataFrame:
    """Median of the ``half`` rows before, the row and the ``half`` rows after it, within the group.

    Groups are cut into pieces of ``piece`` rows, each with copies of the rows of its neighbours that its windows reach.
    """
    rows = numbered(df, group, order, "__i")
    home = F.floor(F.col("__i") / piece)
    rows = rows.withColumn("__home", home).withColumn("__p", F.explode(F.array_distinct(F.array(home, F.floor((F.col("__i") - half) / piece), F.floor((F.col("__i") + half) / piece)))))
    over = Window.partitionBy(*group, "__p").orderBy("__i").rowsBetween(-half, half)
    return rows.withColumn(out, F.percentile(value, F.lit(0.5)).over(over)).where("__p = __home").drop("__i", "__p", "__home")


def run_lengths(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: their first position (from 0) and length."""
    rows = stored(numbered(df, group, order, "__i").select(*group, value, "__i"))
    again = numbered(rows, [*group, value], ["__i"], "__k")
    runs = again.groupBy(*group, value, (F.col("__i") - F.col("__k")).alias("__g")).agg(F.min("__i").cast("bigint").alias("start"), F.count("*").alias("length"))
    return runs.drop("__g")


def rle_decode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, ``value``, ``pixels``) of a run-length mask STRUCT<encoding, shape, runs>: labelled pixels per value.

    Runs are [start, length, value]; a null mask or malformed run (other than three numbers, or beyond the shape) is left out.
    """
    size = F.col(column).shape[0].cast("bigint") * F.col(column).shape[1]
    runs = df.select(*keys, size.alias("__size"), F.explode(F.col(f"{column}.runs")).alias("__r")).where("size(__r) = 3")
    runs = runs.where((F.col("__r")[0] >= 0) & (F.col("__r")[1] > 0) & (F.col("__r")[0].cast("bigint") + F.col("__r")[1] <= F.col("__size")))
    return runs.groupBy(*keys, F.col("__r")[2].alias("value")).agg(F.sum(F.col("__r")[1].cast("bigint")).alias("pixels"))


def rle_encode(mask: np.ndarray) -> list[list[int]]:
    """[start, length, value] of the non-zero runs of a label mask in row order."""
    flat = mask.ravel()
    if not len(flat):
        return []
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    length = np.diff(np.append(first, len(flat)))
    keep = flat[first] != 0
    return [[int(a), int(n), int(v)] for a, n, v in zip(first[keep], length[keep], flat[first[keep]], strict=True)]


def rle_to_mask(shape: tuple[int, int], runs: list[list[int]]) -> np.ndarray:
    out = np.zeros(shape[0] * shape[1], np.uint8)
    end = 0
    for start, length, value in sorted(runs):
        if start < end or length <= 0 or start + length > len(out):
            raise ValueError("runs overlap or leave the mask")
        out[start : start + length] = value
        end = start + length
    return out.reshape(shape)


def otsu(counts: np.ndarray, classes: int) -> list[int]:
    """Bins after which a histogram is cut into 2 or 3 classes of greatest variance between them."""
    n = np.concatenate([[0.0], np.cumsum(counts)])
    s = np.concatenate([[0.0], np.cumsum(counts * np.arange(len(counts)))])
    part = lambda a, b: np.where(n[b] > n[a], (s[b] - s[a]) ** 2 / np.maximum(n[b] - n[a], 1e-12), 0.0)
    edges = np.arange(1, len(counts))
    if classes == 2:
        return [int(edges[np.argmax(part(0, edges) + part(edges, len(counts)))]) - 1]
    i, j = np.triu_indices(len(edges), 1)
    score = part(0, edges[i]) + part(edges[i], edges[j]) + part(edges[j], len(counts))
    best = int(np.argmax(score))
    return [int(edges[i[best]]) - 1, int(edges[j[best]]) - 1]


def otsu_cut(df: DataFrame, group: list[str], value: str, bins: int = 256, classes: int = 3) -> DataFrame:
    """First Otsu threshold per group: one pass for the range, one for histograms of at most ``bins`` counts a group."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(*group, F.col(value).alias("v"))
    span = rows.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = rows.join(span, group).groupBy(*group, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    packed = hist.groupBy(*group, "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"))

    @F.pandas_udf("int")
    def first_cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for h in part:
                counts = np.zeros(bins)
                for r in h:
                    counts[r["bin"]] = r["n"]
                out.append(otsu(counts, classes)[0])
            yield pd.Series(out)

    return packed.withColumn("cut", first_cut("h")).select(*group, (F.col("lo") + (F.col("cut") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))
