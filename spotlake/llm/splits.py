"""Splits that keep related records together: random-mate contraction of the graph of keys, then cumulative weight."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.scale import cut, prefix_sum, stored


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """(``vertex``, ``component``) of an undirected graph of edges (``a``, ``b``); component is one of its vertices.

    Each round every vertex tosses a coin; a vertex with tails that has a neighbour with heads collapses into the
    smallest such neighbour. The first round collapses vertices with one neighbour, if that is greater, without a coin.
    The rounds' collapses are unwound at the end. Edges with a null end are ignored; an edge
    from a vertex to itself makes that vertex a component of its own unless others reach it. Repeated edges count once.
    Expected rounds grow with the logarithm of the vertices; only the remaining edges are carried on.
    """
    pairs = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    alone = pairs.where("a = b").select(F.col("a").alias("vertex"))
    rest = cut(pairs.where("a < b").distinct())
    collapsed: list[DataFrame] = []
    heads = lambda c, r: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(r)), F.lit(2)) == 1
    while rest.limit(1).count():
        r = len(collapsed)
        both = rest.union(rest.select("b", "a"))
        if r:
            into = both.where(~heads("a", r) & heads("b", r)).groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("parent"))
        else:
            ends = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("parent"), F.count("*").alias("n"))
            into = ends.where("n = 1 and vertex < parent").drop("n")
        into = cut(into)
        collapsed.append(into)
        left = into.select(F.col("vertex").alias("a"), F.col("parent").alias("pa"))
        right = into.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        moved = rest.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        rest = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    if collapsed:
        # A vertex collapses once, so all collapses make a forest no deeper than the rounds; halve its depth until flat.
        known = cut(reduce(DataFrame.union, collapsed).withColumnRenamed("parent", "component"))
        for _ in range((len(collapsed) - 1).bit_length()):
            above = known.select(F.col("vertex").alias("component"), F.col("component").alias("root"))
            known = cut(known.join(above, "component", "left").select("vertex", F.coalesce("root", "component").alias("component")))
    lone = alone.select("vertex", F.col("vertex").alias("component"))
    if known is None:
        return lone.distinct()
    roots = known.select(F.col("component").alias("vertex"), "component").distinct()
    known = known.union(roots)
    return known.union(lone.join(known.select("vertex"), "vertex", "left_anti").distinct())


def assign(groups: DataFrame, shares: list[tuple[str, float]], seed: str = "0", heavy: int = 1000) -> DataFrame:
    """Assign whole groups (``component``, ``weight``) to splits with target shares: adds ``split``.

    Groups above a ``heavy``-th of the total (so at most ``heavy`` of them) go, heaviest first, to the split that lacks
    most; the others are laid in a row in hashed order and cut by cumulative weight into what remains. Shares are
    scaled to sum to 1. A null or negative weight counts as 0. Without a positive share all groups have a null split.
    """
    shares = sorted((s, w) for s, w in shares if s is not None and w and w > 0)
    if not shares:
        return groups.withColumn("split", F.lit(None).cast("string"))
    groups = stored(groups.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0))))
    total = groups.agg(F.sum("weight")).first()[0] or 0
    scale = sum(w for _, w in shares)
    lacking = {s: total * w / scale for s, w in shares}
    big = F.col("weight") * heavy > total
    placed = {}
    for c, w in sorted(groups.where(big).select("component", "weight").collect(), key=lambda x: (-x[1], x[0])):
        to = max(lacking, key=lambda s: (lacking[s], s))
        lacking[to] -= w
        placed.setdefault(to, []).append(c)
    light = prefix_sum(groups.where(~big), "weight", ["component"], "before")
    room = {s: max(0.0, v) for s, v in lacking.items()}
    whole = sum(room.values()) or 1.0
    rest = groups.where(~big).agg(F.sum("weight")).first()[0] or 0
    middle = F.col("before") + F.col("weight") / 2
    ends = np.cumsum([rest * room[s] / whole for s, _ in shares])[:-1]
    # The split's number is that of the ends at or below the middle of the group; any number of splits is one lookup.
    passed = F.size(F.filter(F.lit(ends).cast("array<double>"), lambda e: e <= middle)) if len(ends) else F.lit(0)
    light = light.withColumn("split", F.get(F.lit([s for s, _ in shares]), passed)).drop("before")
    if not placed:
        return light
    where = reduce(lambda x, y: x.when(F.col("component").isin(y[1]), F.lit(y[0])), placed.items(), F)
    return light.unionByName(groups.where(big).withColumn("split", where))
