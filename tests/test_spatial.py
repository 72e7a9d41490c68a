import itertools
import math
import random

import numpy as np
import pytest

from spotlake.functions.scalars import poisson_bounds, with_poisson_interval
from spotlake.operators import density, matching
from spotlake.operators.locate import _nested, locate, locate_in_slabs
from spotlake.operators.scale import prefix_sum
from pyspark.sql import functions as F

POINT = "pid bigint, key string, x double, y double, rid string"


def _points(seed, n, names="ab"):
    rng = random.Random(seed)
    return [(i, rng.choice(names), rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))]), rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))]), "clash") for i in range(n)]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_near_points_equal_brute_force(spark, hot):
    a, b = _points(1, 300), _points(2, 250)
    odd = [(900, None, 1.0, 1.0, ""), (901, "a", None, 1.0, ""), (902, "a", math.nan, 1.0, "")]
    left = spark.createDataFrame(a + odd, POINT).drop("rid")
    right = spark.createDataFrame(b + odd, POINT).drop("rid").withColumnRenamed("pid", "rid")
    got = sorted(map(tuple, locate(left, right, within=2.0, slab_height=4.0, hot_rows=hot).collect()))
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 4)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("hot,height", [(20_000, 10.0), (4, 3.0)])
def test_regions_equal_brute_force(spark, hot, height):
    rng = random.Random(3)
    pts = _points(4, 400)
    boxes = [(f"r{i}", rng.choice("abc"), x, y, x + rng.choice([0.0, 1.0, 20.0]), y + rng.choice([0.0, 2.0, 90.0])) for i in range(400) for x, y in [(float(rng.randint(-40, 40)), float(rng.randint(-40, 40)))]]
    got = sorted(map(tuple, locate(spark.createDataFrame(pts, POINT).drop("rid"), spark.createDataFrame(boxes + [("n", "a", None, 0.0, 1.0, 1.0)], "rid string, key string, x0 double, y0 double, x1 double, y1 double"), slab_height=height, hot_rows=hot).collect()))
    want = sorted((p[0], b[0]) for p in pts for b in boxes if p[1] == b[1] and b[2] <= p[2] < b[4] and b[3] <= p[3] < b[5])
    assert got == want and len(want) > 100


def test_locate_of_nothing_and_repeats(spark):
    none = spark.createDataFrame([], POINT).drop("rid")
    one = spark.createDataFrame([(1, "a", 0.0, 0.0, "")] * 2, POINT).drop("rid")
    assert locate(none, one.withColumnRenamed("pid", "rid"), within=1.0).count() == 0
    assert locate(one, none.withColumnRenamed("pid", "rid"), within=1.0).count() == 0
    assert locate(one, one.withColumnRenamed("pid", "rid"), within=0.0).count() == 4


def test_prefix_sum_is_a_running_sum(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, 7, None])) for i in range(500)]
    out = prefix_sum(spark.createDataFrame(rows, "id bigint, g string, v bigint"), "v", ["id"], "s", ["g"], buckets=16).collect()
    assert len(out) == 500
    for g in ("a", "b", None):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.s)
        ends = sorted((r.s, r.s + (r.v or 0)) for r in mine)
        assert ends[0][0] == 0 and all(a[1] == b[0] or a[0] == a[1] for a, b in zip(ends, ends[1:], strict=False))
        assert max(e for _, e in ends) == sum(r[2] or 0 for r in rows if r[1] == g)


def test_poisson_bounds():
    assert poisson_bounds(0) == (0.0, pytest.approx(-math.log(0.025)))
    for n in (1, 25, 96, 1000):
        low, high = poisson_bounds(n)
        tail = lambda mean, k: sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1))
        assert 1 - tail(low, n - 1) == pytest.approx(0.025, abs=1e-9) and tail(high, n) == pytest.approx(0.025, abs=1e-9)


def test_poisson_is_joined_per_count(spark):
    rows = with_poisson_interval(spark.createDataFrame([(0,), (5,), (5,), (None,)], "count bigint"), "count").collect()
    assert len(rows) == 4 and [r.poisson_lower for r in rows if r["count"] == 5] == [pytest.approx(poisson_bounds(5)[0])] * 2
    assert [r.poisson_upper for r in rows if r["count"] is None] == [None]


def test_densities_conserve_counts_and_area(spark):
    rng = np.random.default_rng(17)
    r, t = 75 * np.sqrt(rng.random(2000)), rng.random(2000) * 2 * np.pi
    pts = spark.createDataFrame([(float(a * np.cos(b)), float(a * np.sin(b)), float(a), float(np.degrees(b)), True) for a, b in zip(r, t, strict=True)] + [(75.0, 0.0, 75.0, 360.0, False)], "x double, y double, r double, angle double, accepted boolean")
    whole = math.pi * 75**2 / 100
    for table in (density.rings(pts, 75.0), density.sectors(pts, 75.0)):
        got = table.agg(F.sum("count").alias("n"), F.sum("area_cm2").alias("a")).first()
        assert got.n == 2001 and got.a == pytest.approx(whole)
    assert density.grid(pts, 75.0).agg(F.sum("count"), F.count("*")).first()[:] == (2001, 1600)
    edges = [r.edge for r in density.equal_area_edges(pts, 75.0, 4).orderBy("k").collect()]
    assert edges == sorted(edges) and edges[1] == pytest.approx(75 * math.sqrt(0.5), rel=0.03)
    cube = density.field_cube(pts, 75.0, 25.0)
    assert cube.where("level = 3").first().candidates == 2001
    assert density.grid(pts.limit(0), 75.0).where("count > 0").count() == 0


def test_hungarian_equals_permutations():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.integers(0, 20, (n, m)).astype(float)
        i, j = matching.hungarian(cost)
        small, large = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[a, b] for a, b in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert len(i) == small and len(set(j)) == len(j) and cost[i, j].sum() == best


def test_optimal_matching(spark):
    pairs = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 10, 1.5), (3, 12, 0.5), (4, 12, 0.4)], "a bigint, b bigint, distance double")
    got = sorted(map(tuple, matching.assign_one_to_one(pairs, 5.0).select("a", "b").collect()))
    assert got == [(1, 11), (2, 10), (4, 12)]
    with pytest.raises(Exception, match="cells"):
        matching.assign_one_to_one(pairs, 5.0, max_cells=1).collect()
    assert matching.assign_one_to_one(pairs.limit(0), 5.0).count() == 0


def test_sparse_assignment_equals_the_matrix():
    rng = np.random.default_rng(2)
    for k in range(200):
        n, m = map(int, rng.integers(1, 12, 2))
        d = np.round(rng.random((n, m)) * 5, k % 3)
        held = rng.random((n, m)) < rng.choice([0.2, 0.5, 1])
        held[np.arange(n), rng.integers(0, m, n)] = True
        cost = np.where(held, d, 11.0)
        want = sum(11 - cost[i, j] for i, j in zip(*matching.hungarian(cost), strict=True))
        i, j = np.nonzero(held)
        got = matching.sparse_assignment(i, j, d[i, j], 11.0)
        assert all(held[x] for x in got) and len({x for x, _ in got}) == len({y for _, y in got}) == len(got)
        assert sum(11 - d[x] for x in got) == pytest.approx(want)


def test_a_component_of_any_size_is_matched(spark):
    rows = [(i, i, 1.0) for i in range(1, 1501)] + [(i, 0, 0.75 if i == 7 else 3.0) for i in range(1, 1501)] + [(9999, 7, 2.0)]
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, distance double")
    got = {(r.a, r.b) for r in matching.assign_one_to_one(pairs, 5.0).collect()}
    assert got == {(i, i) for i in range(1, 1501) if i != 7} | {(7, 0), (9999, 7)}


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        x, y, w, h = rng.uniform(0, 120), rng.uniform(0, 120), rng.choice([2.0, 6.0, 15.0]), rng.choice([2.0, 6.0, 15.0])
        rows.append((i, "im", rng.choice(["t1", "t2", None]), x, y, [x - w, y - h, x + w, y + h], rng.random(), rng.randint(1, 9)))
    df = spark.createDataFrame(rows, "id bigint, key string, tile string, x double, y double, box array<double>, core_distance double, area bigint")

    def linked(p, q):
        if p[2] is not None and p[2] == q[2]:
            return False
        w = max(0, min(p[5][2], q[5][2]) - max(p[5][0], q[5][0])) * max(0, min(p[5][3], q[5][3]) - max(p[5][1], q[5][1]))
        size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        return math.hypot(p[3] - q[3], p[4] - q[4]) <= 3 or w / (size(p[5]) + size(q[5]) - w) >= 0.3

    group = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for p, q in itertools.combinations(rows, 2):
            if linked(p, q) and group[p[0]] != group[q[0]]:
                low, high = sorted((group[p[0]], group[q[0]]))
                group = {k: low if v == high else v for k, v in group.items()}
                changed = True
    out = matching.duplicates(df, "key", "tile").collect()
    assert {r.id: r.group for r in out} == group and sum(r.kept for r in out) == len(set(group.values()))


def test_staged_example(spark):
    """Automatic points at 0, 1, 2; reviewed: confirmed at 0 and 4, scratch at 1, uncertain at 2."""
    autos = spark.createDataFrame([(1, "i", 0.0, 0.0), (2, "i", 1.0, 0.0), (3, "i", 2.0, 0.0)], "a bigint, key string, x double, y double")
    seen = spark.createDataFrame([(10, "i", 0.0, 0.0, "confirmed_point"), (11, "i", 1.0, 0.0, "scratch"), (12, "i", 2.0, 0.0, "uncertain"), (13, "i", 4.0, 0.0, "confirmed_point")], "b bigint, key string, x double, y double, label string")
    pairs = matching.pairs_within(autos, seen.drop("label"), 0.1)
    got = matching.staged(pairs, autos, seen, ("confirmed_point",), ("scratch",), ("uncertain",), True)
    assert {(r.a, r.b, r.outcome) for r in got.collect()} == {(1, 10, "TP"), (2, 11, "FP"), (3, 12, "indeterminate"), (None, 13, "FN")}


def test_staged_matching_is_optimal(spark):
    """A chain of three candidates and three points: the nearest pairs first would leave one pair unmatched."""
    pairs = spark.createDataFrame([(1, 10, "c", 1.0), (1, 11, "c", 0.9), (2, 11, "c", 2.0), (2, 12, "s", 0.1), (3, 12, "s", 1.5), (3, 13, "s", 1.6), (4, 14, "s", 1.0)], "a bigint, b bigint, label string, distance double")
    autos = spark.createDataFrame([(i,) for i in range(1, 6)], "a bigint")
    seen = spark.createDataFrame([(10, "c"), (11, "c"), (12, "s"), (13, "s"), (14, "s"), (15, "c")], "b bigint, label string")
    got = {(r.a, r.b, r.outcome) for r in matching.staged(pairs, autos, seen, ("c",), ("s",), ("u",), False).collect()}
    assert got == {(1, 10, "TP"), (2, 11, "TP"), (3, 12, "FP"), (4, 14, "FP"), (5, None, "indeterminate"), (None, 15, "FN")}
    assert matching.staged(pairs.limit(0), autos.limit(0), seen.limit(0), ("c",), ("s",), ("u",), True).count() == 0


def test_staged_matching_equals_brute_force(spark):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(12), 100 + rng.randrange(12)): round(rng.random(), 6) for _ in range(22)}.items())
    labels = {100 + k: rng.choice("ccs") for k in range(12)}
    pairs = [(a, b, labels[b], d) for (a, b), d in rows]

    def best(edges):
        """(pairs, -cost) greatest over all one-to-one choices."""
        if not edges:
            return (0, 0.0), ()
        (a, b, _, d), rest = edges[0], edges[1:]
        (n, c), took = best([e for e in rest if e[0] != a and e[1] != b])
        return max(((n + 1, c - d), (*took, (a, b))), best(rest))

    _, first = best([e for e in pairs if e[2] == "c"])
    used = {a for a, _ in first}
    _, second = best([e for e in pairs if e[2] == "s" and e[0] not in used])
    autos = spark.createDataFrame([(i,) for i in range(12)], "a bigint")
    seen = spark.createDataFrame(sorted(labels.items()), "b bigint, label string")
    out = matching.staged(spark.createDataFrame(pairs, "a bigint, b bigint, label string, distance double"), autos, seen, ("c",), ("s",), (), True).collect()
    assert {(r.a, r.b) for r in out if r.outcome == "TP"} == set(first) and {(r.a, r.b) for r in out if r.outcome == "FP" and r.b} == set(second)


def test_regions_of_very_different_heights(spark):
    rng = random.Random(12)
    pts = [(i, "a", rng.uniform(0, 50), rng.uniform(-5e5, 5e5), "") for i in range(150)]
    boxes = [(f"r{i}", "a", x, y, x + 20, y + rng.choice([0.5, 3.0, 100.0, 9e5])) for i in range(150) for x, y in [(rng.uniform(0, 40), rng.choice([p[3] for p in pts]) - 0.2)]]
    got = sorted(map(tuple, locate(spark.createDataFrame(pts, POINT).drop("rid"), spark.createDataFrame(boxes, "rid string, key string, x0 double, y0 double, x1 double, y1 double"), slab_height=1.0, hot_pairs=50).collect()))
    assert got == sorted((p[0], b[0]) for p in pts for b in boxes if b[2] <= p[2] < b[4] and b[3] <= p[3] < b[5]) and len(got) > 100


def test_overlapping_regions_take_little_memory():
    import pandas as pd

    n = 20_000
    regions = pd.DataFrame({"cell": 0, "x0": np.arange(n) / n, "x1": 10.0 + np.arange(n) / n, "y0": 0.0, "y1": 1.0})
    part, owner, leaves = _nested(np.arange(n), np.arange(n) + n, 2 * n)
    assert len(part) < 2 * n * math.log2(2 * leaves) and len(owner) == len(part)
    i, j = locate_in_slabs(pd.DataFrame({"cell": [0, 1], "x": [5.0, 5.0], "y": [0.5, 0.5]}), regions)
    assert set(i) == {0} and sorted(j) == list(range(n))
