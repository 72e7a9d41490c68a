"""A random forest on pixel features, grown level by level from distributed histograms; prediction is vectorised over pixels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.scale import cut, stored

EDGES = 31


def predict(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Mean leaf probability; a row goes left on <=."""
    total = np.zeros(len(x))
    for nodes in trees:
        feature, threshold, left, right, p = (np.array([n[k] for n in nodes]) for k in range(5))
        at = np.zeros(len(x), int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += p[at]
    return total / max(1, len(trees))


TREE = "array<struct<feature: int, threshold: double, left: int, right: int, probability: double, samples: int>>"


def train(samples: DataFrame, trees: int = 32, per_class: int = 20_000, seed: int = 1729, depth: int = 8, leaf: int = 8) -> DataFrame:
    """(tree, nodes) from labelled pixels (``x`` array of features, ``y`` 0 or 1, ``id`` unique).

    Every tree sees about ``per_class`` pixels of a class at most, drawn by a hash of id and tree (a bounded sample of the labels), each as
    often as a Poisson draw of its hash says. Features are read as places among ``EDGES`` quantiles. A level is one
    histogram over (tree, node, feature, place): every node takes, of a random root of the features, the split of least Gini impurity
    that leaves ``leaf`` pixels on both sides. All nodes of all trees grow at once; only edges and nodes are small.
    """
    n = {r.y: r["count"] for r in samples.groupBy("y").count().collect()}
    if set(n) != {0, 1}:
        raise ValueError("both classes are needed")
    uniform = lambda salt: F.pmod(F.xxhash64("id", "tree", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    upto, times = math.exp(-1), F.lit(0)
    tail = upto
    for k in range(1, 9):
        times = times + (F.col("__u") >= tail).cast("int")
        upto /= k
        tail += upto
    p = samples.select(F.size("x").alias("p")).first().p
    ends = samples.agg(*[F.percentile_approx(F.col("x")[f], [q / (EDGES + 1) for q in range(1, EDGES + 1)], 10_000).alias(f"f{f}") for f in range(p)]).first()
    edges = [sorted(set(ends[f])) for f in range(p)]
    below = lambda value, ends: sum((F.when(value > e, 1).otherwise(0) for e in ends), F.lit(0))
    places = F.array(*[below(F.col("x")[f], edges[f]) for f in range(p)])
    rows = samples.select("id", "y", places.alias("b")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(uniform(0) < share)
    rows = rows.withColumn("__u", uniform(1)).select("tree", "y", "b", times.alias("w"), F.lit(1).alias("node")).where("w > 0")
    open_, grown, counted = stored(rows), [], []
    of = ["tree", "node"]
    for level in range(depth + 1):
        sums = cut(open_.groupBy(*of).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")))
        counted.append(sums)
        if level == depth or not sums.limit(1).count():
            break
        live = sums.where(f"n >= {2 * leaf} and s > 0 and s < n")
        lots = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda f: F.struct(F.xxhash64("tree", "node", f, F.lit(seed)).alias("h"), f.alias("f")))
        tried = live.select(*of, "n", "s", F.explode(F.slice(F.array_sort(lots), 1, max(1, math.isqrt(p)))).alias("t")).select(*of, "n", "s", "t.f")
        hist = open_.join(F.broadcast(tried), of).groupBy(*of, "n", "s", "f", F.get("b", F.col("f")).alias("place")).agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.col("y")).alias("d"))
        before = Window.partitionBy(*of, "f").orderBy("place")
        sides = hist.withColumns({"nl": F.sum("c").over(before), "sl": F.sum("d").over(before)}).withColumns({"nr": F.col("n") - F.col("nl"), "sr": F.col("s") - F.col("sl")})
        impurity = lambda m, k: F.col(k) * (F.col(m) - F.col(k)) / F.col(m)
        fit = sides.where(f"nl >= {leaf} and nr >= {leaf}").withColumn("g", impurity("nl", "sl") + impurity("nr", "sr")).where(F.col("g") < impurity("n", "s") - 1e-9)
        best = cut(fit.groupBy(*of).agg(F.min(F.struct("g", "f", "place")).alias("m")).select(*of, "m.f", "m.place"))
        grown.append(best)
        right = (F.get("b", F.col("f")) > F.col("place")).cast("int")
        open_ = stored(open_.join(F.broadcast(best), of).select("tree", "y", "b", "w", (F.col("node") * 2 + right).alias("node")))
    whole = counted[0]
    for more in counted[1:]:
        whole = whole.unionByName(more)
    splits = samples.sparkSession.createDataFrame([], "tree int, node int, f int, place int")
    for more in grown:
        splits = splits.unionByName(more)
    threshold = F.array(*[F.array(*[F.lit(float(e)) for e in es]) for es in edges])
    made = whole.join(splits, of, "left").withColumn("at", F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1)
    left = made.select("tree", (F.col("node") / 2).cast("int").alias("node"), (F.col("node") % 2).alias("side"), "at")
    kids = left.groupBy(*of).agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("right"))
    full = made.join(kids, of, "left").select(
        "tree", "at", F.coalesce("f", F.lit(-1)).alias("feature"), F.coalesce(F.get(F.get(threshold, F.col("f")), F.col("place")), F.lit(0.0)).alias("threshold"),
        *[F.when(F.col("f").isNull(), -1).otherwise(F.col(c)).cast("int").alias(c) for c in ("left", "right")],
        ((F.col("s") + 1) / (F.col("n") + 2)).alias("probability"), F.col("n").cast("int").alias("samples"),
    )
    packed = full.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("at", "feature", "threshold", "left", "right", "probability", "samples"))).alias("l"))
    return packed.select("tree", F.transform("l", lambda e: F.struct(e.feature, e.threshold, e.left, e.right, e.probability, e.samples)).cast(TREE).alias("nodes"))
