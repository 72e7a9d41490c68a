"""Points near other points, and the regions around points, by a slab decomposition of the region boundaries.

Boundaries are cut at horizontal lines into slabs; inside a slab the boundary pieces are vertical edges, so they are
ordered by x and bound a row of trapezoids. A region covers a stretch of them and is noted at the few halves, quarters, ... of the row
that make up the stretch. Slabs are spread over the cluster; each point is located by binary search among the edges of its slab and
asks the nested parts around its trapezoid for their regions. "Within r of a point" is the region of the square around that point,
with the exact distance checked afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.scale import blocks, broadcast_within, cut, stored

HEIGHTS = 16


def _bisect(edges: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the last edge <= at within [low, high) for each point; low - 1 if there is none."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low - 1
        middle = (low + high) // 2
        right = open_ & (edges[np.minimum(middle, len(edges) - 1)] <= at)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner index and running position for ranges [start, start + count)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return owner, np.repeat(starts, counts) + np.arange(len(owner)) - first


def locate_in_slabs(points: pd.DataFrame, regions: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of points, row of regions) with equal ``cell``, x0 <= x < x1 and y0 <= y < y1."""
    none = np.empty(0, np.int64)
    if not len(points) or not len(regions):
        return none, none
    cell, x0, x1 = (regions[c].to_numpy() for c in ("cell", "x0", "x1"))
    where, edge = np.concatenate([cell, cell]), np.concatenate([x0, x1])
    order = np.lexsort((edge, where))
    where, edge = where[order], edge[order]
    new = np.ones(len(edge), bool)
    new[1:] = (where[1:] != where[:-1]) | (edge[1:] != edge[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    where, edge = where[new], edge[new]
    noted, region, leaves = _nested(rank[: len(cell)], rank[len(cell) :], len(edge))
    cells, first = np.unique(where, return_index=True)
    last = np.append(first[1:], len(where))
    at, x, y = (points[c].to_numpy() for c in ("cell", "x", "y"))
    slab = np.minimum(np.searchsorted(cells, at), len(cells) - 1)
    known = np.flatnonzero(cells[slab] == at)
    j = _bisect(edge, first[slab[known]], last[slab[known]], x[known])
    inside = j >= first[slab[known]]
    known, j = known[inside], j[inside]
    y0, y1 = regions["y0"].to_numpy(), regions["y1"].to_numpy()
    out = [(none, none)]
    node = j + leaves
    while len(node) and node[0]:
        low, high = np.searchsorted(noted, node), np.searchsorted(noted, node, side="right")
        owner, position = _spread(low, high - low)
        point, found = known[owner], region[position]
        ok = (y0[found] <= y[point]) & (y[point] < y1[found])
        out.append((point[ok], found[ok]))
        node = node >> 1
    points_, regions_ = zip(*out, strict=True)
    return np.concatenate(points_), np.concatenate(regions_)


def _nested(low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(part, range) sorted by part, and the number of leaves: each range [low, high) of leaves as the largest parts of a halving of them.

    Part 1 is the whole, parts 2 p and 2 p + 1 are the halves of part p; a range has at most two parts of each size.
    """
    leaves = 1 << max(0, int(n - 1).bit_length())
    low, high, ids = low + leaves, high + leaves, np.arange(len(low))
    parts, owners = [], []
    while len(ids):
        for side, at in ((low & 1 == 1, low), (high & 1 == 1, high - 1)):
            side = side & (low < high)
            parts.append(at[side])
            owners.append(ids[side])
        low, high = (low + 1) >> 1, high >> 1
        open_ = low < high
        low, high, ids = low[open_], high[open_], ids[open_]
    part, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(part, kind="stable")
    return part[order], owner[order], leaves


def locate(
    points: DataFrame,
    regions: DataFrame,
    within: float | None = None,
    pid: tuple[str, ...] = ("pid",),
    rid: tuple[str, ...] = ("rid",),
    slab_height: float = 256.0,
    rows_each: int = 150_000,
    hot_rows: int = 20_000,
    hot_pairs: int = 20_000_000,
) -> DataFrame:
    """Join points (columns ``pid``, ``key``, ``x``, ``y``) to the regions of the same key around them.

    ``regions`` has (columns ``rid``, ``key``, ``x0``, ``y0``, ``x1``, ``y1``), half open, or with ``within`` the points
    (columns ``rid``, ``key``, ``x``, ``y``) whose distance must be at most ``within``. Returns the columns ``pid`` and
    ``rid`` (their names must differ; other columns are ignored), once per pair of rows. Rows with a null key or null or NaN coordinates match nothing, as do empty
    tables. Regions without area contain nothing.

    Regions fall into classes of height, each with slabs of its own, so that one spans at most three; points are looked up in every
    class there is. A slab whose points or regions exceed ``hot_rows``, or whose points times regions exceed ``hot_pairs``, is split into
    a grid of point parts and region parts, so no task holds more than its share of a crowded image, even if all regions overlap.
    """
    ok = lambda *names: " and ".join(f"{n} is not null and not isnan({n})" for n in names)
    points = points.select(*pid, "key", F.col("x").cast("double"), F.col("y").cast("double"))
    points = points.where("key is not null and " + ok("x", "y"))
    if within is None:
        boxes = regions.select(*rid, "key", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
        boxes = boxes.where("key is not null and " + ok("x0", "y0", "x1", "y1") + " and x0 < x1 and y0 < y1")
    else:
        reach = F.lit(within * (1 + 1e-9)) + F.greatest(F.abs("x"), F.abs("y")) * 1e-12 + 1e-9
        boxes = regions.select(*rid, "key", F.col("x").cast("double"), F.col("y").cast("double"))
        boxes = boxes.where("key is not null and " + ok("x", "y"))
        boxes = boxes.select("*", *[(F.col(c[0]) + (reach if c[1] == "1" else -reach)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    level = F.greatest(F.lit(0.0), F.ceil(F.log(float(HEIGHTS), (F.col("y1") - F.col("y0")) / slab_height))).cast("int")
    boxes = stored(boxes.withColumn("level", level))
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # few: each is HEIGHTS times as high as the one before
    height = F.pow(F.lit(float(HEIGHTS)), "level") * slab_height
    slab = lambda c: F.floor(F.col(c) / height)
    points = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    points = stored(points.withColumn("slab", slab("y")))
    boxes = boxes.withColumn("slab", F.explode(F.sequence(slab("y0"), slab("y1"))))
    slabs = ["key", "level", "slab"]
    r_part = F.least("r", F.lit(hot_rows))
    crowd = (
        points.groupBy(*slabs).agg(F.count("*").alias("p"), F.lit(0).cast("bigint").alias("r"))
        .unionByName(boxes.groupBy(*slabs).agg(F.lit(0).cast("bigint").alias("p"), F.count("*").alias("r")))
        .groupBy(*slabs).agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        .where((F.col("p") > 0) & (F.col("r") > 0) & ((F.greatest("p", "r") > hot_rows) | (F.col("p") * r_part > hot_pairs)))
        .select(*slabs, F.greatest(F.ceil(F.col("p") / hot_rows), F.ceil(F.col("p") * r_part / hot_pairs)).alias("ps"), F.ceil(F.col("r") / hot_rows).alias("rs"))
    )
    crowd = cut(crowd)
    busy = crowd.limit(1).count() > 0
    crowd = broadcast_within(crowd, 100_000)
    n = blocks(points, rows_each) + blocks(boxes, rows_each)

    def placed(df: DataFrame, mine: str, other: str, ids: tuple[str, ...]) -> DataFrame:
        if busy:
            df = df.join(crowd, slabs, "left").withColumn(mine, F.pmod(F.xxhash64(*ids), F.greatest(F.coalesce(mine, F.lit(1)), F.lit(1))))
            df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1)))
        else:
            df = df.withColumns({mine: F.lit(0), other: F.lit(0)})
        df = df.withColumn("cell", F.xxhash64("key", "level", "slab", F.col("ps").cast("bigint"), F.col("rs").cast("bigint")))
        return df.withColumn("part", F.pmod(F.col("cell"), F.lit(n))).drop("key", "level", "slab", "ps", "rs")

    left, right = placed(points, "ps", "rs", pid), placed(boxes, "rs", "ps", rid)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, ids in ((points, pid), (boxes, rid)) for c in ids)

    def join(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        i, j = locate_in_slabs(p, r)
        if within is not None and len(i):
            dx, dy = p["x"].to_numpy()[i] - r["x"].to_numpy()[j], p["y"].to_numpy()[i] - r["y"].to_numpy()[j]
            near = dx * dx + dy * dy <= within * within
            i, j = i[near], j[near]
        return pd.DataFrame({**{c: p[c].to_numpy()[i] for c in pid}, **{c: r[c].to_numpy()[j] for c in rid}})

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(join, schema)
