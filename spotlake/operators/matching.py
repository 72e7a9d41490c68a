"""Matching of points: radius joins, nearest neighbours, one-to-one assignment, staged evaluation and de-duplication."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.geometry import box_iou
from spotlake.operators.locate import locate
from spotlake.operators.scale import blocks, broadcast_within, cut, stored


def pairs_within(left: DataFrame, right: DataFrame, tolerance: float, left_id: str = "a", right_id: str = "b", keep: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, ``keep`` columns of the right, distance) of points (id, key, x, y) of one key at most ``tolerance`` apart."""
    a = left.select(left_id, "key", "x", "y", F.col("x").cast("double").alias("__ax"), F.col("y").cast("double").alias("__ay"))
    b = right.select(right_id, *keep, "key", "x", "y", F.col("x").cast("double").alias("__bx"), F.col("y").cast("double").alias("__by"))
    # The coordinates ride along as ids, so no join brings them back.
    found = locate(a, b, within=tolerance, pid=(left_id, "__ax", "__ay"), rid=(right_id, *keep, "__bx", "__by"), slab_height=max(2 * tolerance, 1e-6)).distinct()
    return found.select(left_id, right_id, *keep, F.hypot(F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")).alias("distance"))


def in_micrometres(left: DataFrame, right: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both point tables with ``x`` and ``y`` in micrometres: from ``x_mm``, ``y_mm`` where every point of the key, on both sides, has
    them finite, else from ``x``, ``y`` in pixels and the key's scale.

    ``scales``: key, mm_per_pixel; one that is missing, not positive or not finite gives null coordinates, with which a point matches
    nothing. Of several scales of a key the greatest counts. ``x_mm`` and ``y_mm`` are dropped.
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    whole = [df.groupBy("key").agg(F.bool_and(finite("x_mm") & finite("y_mm")).alias("mm")) for df in (left, right)]
    whole = whole[0].unionByName(whole[1]).groupBy("key").agg(F.bool_and("mm").alias("__mm"))
    usable = scales.where(finite("mm_per_pixel") & (F.col("mm_per_pixel") > 0)).groupBy("key").agg(F.max("mm_per_pixel").alias("__scale"))
    how = broadcast_within(stored(whole.join(usable, "key", "left")), 1_000_000)
    um = lambda c: F.when(F.col("__mm"), F.col(f"{c}_mm")).otherwise(F.col(c) * F.col("__scale")) * 1000
    scaled = [df.join(how, "key", "left").withColumns({"x": um("x"), "y": um("y")}).select(*[c for c in df.columns if c not in ("x_mm", "y_mm")]) for df in (left, right)]
    return scaled[0], scaled[1]


def nearest(pairs: DataFrame, left_id: str = "a", right_id: str = "b") -> DataFrame:
    """The nearest right point of each left point; ties go to the smaller id."""
    best = pairs.groupBy(left_id).agg(F.min(F.struct("distance", right_id)).alias("m"))
    return best.select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.distance").alias("distance"))


def mutual_nearest(pairs: DataFrame, left_id: str = "a", right_id: str = "b") -> DataFrame:
    """Pairs that are each other's nearest: a one-to-one matching without an assignment problem."""
    there = nearest(pairs, left_id, right_id)
    back = nearest(pairs, right_id, left_id).select(F.col(right_id).alias("__b"), F.col(left_id).alias("__a"))
    return there.join(back, (F.col(right_id) == F.col("__b")) & (F.col(left_id) == F.col("__a"))).drop("__a", "__b")


def least_labels(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, group): connected components by repeated minimum over neighbours and pointer jumping, until nothing moves."""
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).union(pairs.select(F.col(b), F.col(a))).distinct()
    both = stored(both)
    label = cut(both.groupBy(F.col("u").alias("vertex")).agg(F.least(F.min("v"), F.first("u")).alias("group")))
    while True:
        seen = both.join(label.select(F.col("vertex").alias("v"), F.col("group").alias("g")), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("g").alias("g"))
        low = label.join(seen, "vertex").select("vertex", F.least("group", "g").alias("group"), F.col("group").alias("old"))
        up = low.select(F.col("vertex").alias("group"), F.col("group").alias("gg"))
        moved = cut(low.join(up, "group", "left").select("vertex", F.least("group", F.coalesce("gg", "group")).alias("group"), "old"))
        changed = moved.where("group <> old").limit(1).count()
        label = moved.select("vertex", "group")
        if not changed:
            return label


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of a least-cost assignment (shortest augmenting paths with potentials)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = owner[j]
            free = ~used[1:]
            reduced = c[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            k = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[k]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    rows, cols = owner[1:][owner[1:] > 0] - 1, np.flatnonzero(owner[1:] > 0)
    return (cols, rows) if flipped else (rows, cols)


def sparse_assignment(rows: np.ndarray, cols: np.ndarray, costs: np.ndarray, penalty: float) -> set[tuple[int, int]]:
    """(row, column) pairs of least total cost among the given ones, each row left alone costing ``penalty``.

    Shortest augmenting paths over the pairs that exist, so memory grows with the pairs and not with rows times columns.
    """
    order = np.argsort(rows, kind="stable")
    start = np.searchsorted(rows[order], np.arange(rows.max() + 2)).tolist()
    to, cost = cols[order].tolist(), costs[order].tolist()
    u, v = [0.0] * (len(start) - 1), [0.0] * (int(cols.max()) + 1)
    match, owner = [-1] * len(u), [-1] * len(v)
    for i in range(len(u)):
        far, prev, done, heap = {}, {}, {}, []
        row, base, seen, alone, left = i, 0.0, [(i, 0.0)], np.inf, i
        while True:
            if base + penalty - u[row] < alone:
                alone, left = base + penalty - u[row], row
            for e in range(start[row], start[row + 1]):
                j = to[e]
                d = base + cost[e] - u[row] - v[j]
                if j not in done and d < far.get(j, np.inf):
                    far[j], prev[j] = d, row
                    heapq.heappush(heap, (d, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                delta, j = alone, match[left]
                match[left] = -1
                break
            base, j = heapq.heappop(heap)
            if owner[j] < 0:
                delta = base
                break
            done[j] = base
            row = owner[j]
            seen.append((row, base))
        for r, b in seen:
            u[r] += delta - b
        for c, b in done.items():
            v[c] -= delta - b
        while j >= 0:
            r = prev[j]
            match[r], owner[j], j = j, r, match[r]
    return {(r, c) for r, c in enumerate(match) if c >= 0}


def _grouped(pairs: DataFrame, left_id: str, right_id: str, rows_each: int = 100_000) -> DataFrame:
    """``pairs`` with ``__group`` (its connected component) and ``__part``; whole components share a part of about ``rows_each`` pairs."""
    text = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    named = stored(pairs.withColumns({"__a": text("a:", left_id), "__b": text("b:", right_id)}))
    # A pair whose points have no other partner is a component as it stands.
    lone = lambda c, o: named.groupBy(c).agg(F.count("*").alias("n"), F.min(o).alias(o)).where("n = 1").select("__a", "__b")
    single = stored(lone("__a", "__b").join(lone("__b", "__a"), ["__a", "__b"]))
    rest = named.join(single, ["__a", "__b"], "left_anti")
    groups = least_labels(rest, "__a", "__b").select(F.col("vertex").alias("__a"), F.col("group").alias("__group"))
    groups = groups.unionByName(single.select("__a", F.col("__a").alias("__group")))
    return named.join(groups, "__a").withColumn("__part", F.pmod(F.xxhash64("__group"), F.lit(blocks(named, rows_each))))


def _kept(g: pd.DataFrame, penalty: float, matrix_cells: int, max_cells: int | None = None) -> np.ndarray:
    """Which pairs (``__a``, ``__b``, distance) of a component its least-cost matching keeps."""
    if len(g) == 1:
        return np.array([max_cells is None or max_cells > 0])
    rows, i = np.unique(g["__a"], return_inverse=True)
    cols, j = np.unique(g["__b"], return_inverse=True)
    if max_cells is not None and len(rows) * len(cols) > max_cells:
        raise ValueError(f"a component of {len(rows)} x {len(cols)} points exceeds {max_cells} cells")
    if len(rows) * len(cols) > matrix_cells:
        keep = sparse_assignment(i, j, g["distance"].to_numpy(), penalty)
    else:
        cost = np.full((len(rows), len(cols)), penalty)
        cost[i, j] = g["distance"].to_numpy()
        keep = {(x, y) for x, y in zip(*(v.tolist() for v in hungarian(cost)), strict=True) if cost[x, y] < penalty}
    return np.array([(x, y) in keep for x, y in zip(i.tolist(), j.tolist(), strict=True)])


def assign_one_to_one(pairs: DataFrame, tolerance: float, left_id: str = "a", right_id: str = "b", max_cells: int | None = None, matrix_cells: int = 2_000_000) -> DataFrame:
    """Least-cost one-to-one matching of pairs within a tolerance; a point left alone costs twice the tolerance and one.

    The pair graph falls into components; each is solved alone in one task, exactly: as a matrix up to
    ``matrix_cells`` cells, beyond that over its pairs, whose number bounds the memory. No component is refused unless
    ``max_cells`` is given.
    """
    penalty = 2 * tolerance + 1
    grouped = _grouped(pairs.select(left_id, right_id, "distance"), left_id, right_id)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        out = [g[_kept(g, penalty, matrix_cells, max_cells)] for _, g in part.groupby("__group", sort=False)]
        return pd.concat(out)[[left_id, right_id, "distance"]]

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (left_id, right_id, "distance"))
    return grouped.groupBy("__part").applyInPandas(solve, schema)


def staged(pairs: DataFrame, autos: DataFrame, reviewed: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], indeterminate: tuple[str, ...], complete: bool, matrix_cells: int = 2_000_000) -> DataFrame:
    """Outcome of every automatic point (``a``) and every confirmed point that was missed (``b``).

    Stages: confirmed points first, then each negative and each indeterminate label in alphabetical order; every
    stage matches one to one what is left: as many pairs as can be, of these with the least sum of distances. Unmatched automatic
    points are false positives only if the coverage is complete, else indeterminate. All stages of a component of near points run
    in one task; ``pairs`` (a, b, distance) may hold the reviewed ``label``.
    """
    stages = [(positive, "TP")] + [((x,), "FP") for x in sorted(negative)] + [((x,), "indeterminate") for x in sorted(indeterminate)]
    labelled = pairs if "label" in pairs.columns else pairs.join(reviewed.select("b", "label"), "b")
    labelled = labelled.where(F.col("label").isin([x for labels, _ in stages for x in labels])).select("a", "b", "label", "distance").distinct()
    outcome_of = {x: outcome for labels, outcome in stages for x in labels}

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in part.groupby("__group", sort=False):
            if len(g) == 1:
                out.append(g)
                continue
            for labels, _ in stages:
                mine = g[g["label"].isin(labels)]
                if len(mine):
                    # The matching falls into the components of the stage's own pairs, solved together here.
                    hit = mine[_kept(mine, float(mine["distance"].sum()) + 1.0, matrix_cells)]
                    out.append(hit)
                    g = g[~g["__a"].isin(hit["__a"])]
        found = pd.concat(out)
        return pd.DataFrame({"a": found["a"], "b": found["b"], "outcome": found["label"].map(outcome_of)})

    schema = ", ".join(f"`{c}` {labelled.schema[c].dataType.simpleString()}" for c in ("a", "b")) + ", outcome string"
    used = stored(_grouped(labelled, "a", "b").groupBy("__part").applyInPandas(solve, schema))
    rest = autos.select("a").distinct().join(used.select("a"), "a", "left_anti")
    rest = rest.select("a", F.lit(None).cast(reviewed.schema["b"].dataType).alias("b"), F.lit("FP" if complete else "indeterminate").alias("outcome"))
    missed = reviewed.where(F.col("label").isin(*positive)).select("b").distinct().join(used.select("b"), "b", "left_anti")
    missed = missed.select(F.lit(None).cast(autos.schema["a"].dataType).alias("a"), "b", F.lit("FN").alias("outcome"))
    return used.unionByName(rest).unionByName(missed)


def box_pairs(df: DataFrame, key: str, min_iou: float, tile: str) -> DataFrame:
    """(a, b, box_a, box_b), a < b: all pairs of boxes (id, key, tile, box) of one key and other tiles that may overlap by ``min_iou``
    of their union, and some more.

    Repeated pairs can occur. Boxes with a null give nothing; a null tile stands for any tile.
    """
    # With overlap >= t of the union, sides differ by at most 1 / t and centres by (1 - t) / (1 + t) of the longer side.
    reach = max(0.5, (1 - min_iou) / (1 + min_iou)) / min_iou + 1e-6
    b = F.col("box")
    sides = {"x": ((b[0] + b[2]) / 2, (b[2] - b[0]) * reach), "y": ((b[1] + b[3]) / 2, (b[3] - b[1]) * reach)}
    own = lambda n: [F.col("id").alias(n), F.col(tile).alias(f"t{n}"), *[b[i].cast("double").alias(f"{n}{i}") for i in range(4)], F.col(key).alias("key")]
    centres = df.select(*own("a"), *[c.alias(n) for n, (c, _) in sides.items()])
    boxes = df.select(*own("b"), *[(c - h).alias(f"{n}0") for n, (c, h) in sides.items()], *[(c + h).alias(f"{n}1") for n, (c, h) in sides.items()])
    ids = lambda n: (n, f"t{n}", *[f"{n}{i}" for i in range(4)])
    found = locate(centres, boxes, pid=ids("a"), rid=ids("b"), slab_height=32.0)
    # Either box may find the other one; both ways round, the pair is written with the smaller id first.
    across = F.col("ta").isNull() | F.col("tb").isNull() | (F.col("ta") != F.col("tb"))
    corners = lambda n: F.array(*[F.col(f"{n}{i}") for i in range(4)])
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return found.where(across & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), pick(corners("a"), corners("b")).alias("box_a"), pick(corners("b"), corners("a")).alias("box_b")
    )


def box_links(df: DataFrame, key: str, tile: str, min_iou: float = 0.30) -> DataFrame:
    """(id, ``links``): how many boxes (id, key, tile, box) of the same key and another tile overlap each by ``min_iou``.

    Ids must be unique; boxes without links are left out, a null tile stands for any tile.
    """
    hit = box_pairs(df, key, min_iou, tile).where(box_iou("box_a", "box_b") >= min_iou).select("a", "b").distinct()
    return hit.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))


def duplicates(df: DataFrame, key: str, tile: str, max_distance: float = 3.0, min_iou: float = 0.30) -> DataFrame:
    """Groups of candidates seen in different tiles: centroids within ``max_distance`` or boxes with enough overlap.

    ``df``: id, key, tile, x, y, box, core_distance, area. Adds ``group`` (the smallest id of the group) and ``kept``
    (greatest core distance, then area, then smallest id). A null tile stands for any tile.
    """
    points = df.select(F.col("id").alias("a"), F.col(tile).alias("ta"), F.col(key).alias("key"), "x", "y")
    across = F.col("ta").isNull() | F.col("tb").isNull() | (F.col("ta") != F.col("tb"))
    near = locate(points, points.withColumnsRenamed({"a": "b", "ta": "tb"}), within=max_distance, pid=("a", "ta"), rid=("b", "tb"), slab_height=2 * max_distance)
    inside = box_pairs(df, key, min_iou, tile)
    linked = near.where(across & (F.col("a") < F.col("b"))).select("a", "b").union(inside.where(box_iou("box_a", "box_b") >= min_iou).select("a", "b")).distinct()
    groups = least_labels(linked)
    out = df.join(groups, F.col("id") == F.col("vertex"), "left").drop("vertex").withColumn("group", F.coalesce("group", "id"))
    order = Window.partitionBy("group").orderBy(F.desc("core_distance"), F.desc("area"), "id")
    return out.withColumn("kept", F.row_number().over(order) == 1)
