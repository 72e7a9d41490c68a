import random

import numpy as np
import pytest

from spotlake.llm.consensus import chance_corrected, consensus
from spotlake.llm.overlap import cross_split_overlaps
from spotlake.llm.splits import assign, components

VOTE = "i bigint, annotator string, label string, label_2 string"


def test_consensus_weighs_reviewers(spark):
    rng = random.Random(1)
    truth = {i: rng.choice(["target", "artifact"]) for i in range(400)}
    skill = {"a": 0.97, "b": 0.95, "c": 0.93, "bad": 0.05, "coin": 0.5, "coin2": 0.5}
    rows = []
    for i, t in truth.items():
        for r in rng.sample(sorted(skill), 4):
            right = rng.random() < skill[r]
            rows.append((i, r, t if right else {"target": "artifact", "artifact": "target"}[t], "x"))
    items, annotators, rounds = consensus(spark.createDataFrame(rows, VOTE), ["i"])
    got = {r.i: r.label for r in items.collect()}
    assert len(got) == 400 and 1 < rounds < 60
    assert np.mean([got[i] == t for i, t in truth.items()]) > 0.93
    acc = {(r.annotator, r.label): r.accuracy for r in annotators.collect()}
    assert acc["bad", "target"] < 0.3 < 0.4 < acc["coin", "target"] < 0.65 < 0.8 < acc["a", "target"]


def test_consensus_defined_cases(spark):
    rows = [(1, "a", "x", None), (1, "b", "y", None), (2, None, "x", None), (3, "a", None, None), (None, "a", "x", None)]
    items, _, _ = consensus(spark.createDataFrame(rows, VOTE), ["i"])
    got = {r.i: (r.label, r.votes) for r in items.collect()}
    assert got[1] == ("x", 2) and 2 not in got and 3 not in got and got[None] == ("x", 1)
    items, annotators, rounds = consensus(spark.createDataFrame([], VOTE), ["i"])
    assert items.count() == 0 and annotators.count() == 0 and rounds == 0
    one, _, _ = consensus(spark.createDataFrame([(1, "a", "x", None)], VOTE), ["i"])
    assert one.first().label == "x"


def test_an_unfinished_consensus_says_so(spark):
    rows = [(i, r, t, None) for i in range(40) for r, t in (("a", "x" if i % 2 else "y"), ("b", "x" if i % 3 else "y"), ("c", "x"))]
    df = spark.createDataFrame(rows, VOTE)
    for rounds, done in ((1, False), (60, True)):
        _, annotators, used = consensus(df, ["i"], max_rounds=rounds)
        assert {r.converged for r in annotators.collect()} == {done} and used <= rounds
    assert consensus(df, ["i"], sureness=0.0)[0].count() == 40


def test_many_splits(spark):
    shares = [(f"s{i:04d}", 1.0) for i in range(1500)]
    groups = spark.createDataFrame([(f"g{i}", 1) for i in range(15_000)], "component string, weight bigint")
    out = assign(groups, shares, heavy=10).groupBy("split").count().collect()
    assert len(out) == 1500 and all(5 <= r["count"] <= 15 for r in out)


def test_alpha_matches_pairs(spark):
    rng = random.Random(2)
    votes = [(i, f"r{k}", rng.choice("xyz"), None) for i in range(60) for k in range(rng.choice([1, 2, 4]))]
    got = chance_corrected(spark.createDataFrame(votes, VOTE), ["i"]).first()
    by = {}
    for i, _, label, _ in votes:
        by.setdefault(i, []).append(label)
    units = [v for v in by.values() if len(v) > 1]
    values = [x for v in units for x in v]
    seen = sum(sum(a != b for k, a in enumerate(v) for m, b in enumerate(v) if k != m) / (len(v) - 1) for v in units) / len(values)
    chance = sum(a != b for k, a in enumerate(values) for m, b in enumerate(values) if k != m) / (len(values) * (len(values) - 1))
    assert got.alpha == pytest.approx(1 - seen / chance)
    assert chance_corrected(spark.createDataFrame([], VOTE), ["i"]).first().alpha is None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(35)] + [("hub", str(i)) for i in range(30)] + [(None, "1"), ("z", None), ("s", "s")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    rows = components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert len({r.vertex for r in rows}) == len(rows) == len(parent)
    got = {r.vertex: r.component for r in rows}
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in parent for b in parent)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_assign_keeps_groups_and_shares(spark):
    rows = [(f"c{i}", 1) for i in range(3000)] + [("big", 900), ("zero", 0), ("none", None)]
    out = assign(spark.createDataFrame(rows, "component string, weight bigint"), [("a", 0.7), ("b", 0.15), ("c", 0.15)]).collect()
    assert len(out) == len(rows) and len({r.component for r in out}) == len(rows)
    sums = {s: sum(r.weight for r in out if r.split == s) for s in "abc"}
    assert sums["a"] / 3900 == pytest.approx(0.7, abs=0.01) and sums["b"] / 3900 == pytest.approx(0.15, abs=0.01)
    assert assign(spark.createDataFrame([], "component string, weight bigint"), [("a", 1.0)]).count() == 0


def test_assign_without_a_share(spark):
    groups = spark.createDataFrame([("c", 1)], "component string, weight bigint")
    for shares in ([], [("a", None)], [(None, 1.0)], [("a", 0.0)]):
        assert [tuple(r) for r in assign(groups, shares).select("component", "weight", "split").collect()] == [("c", 1, None)]


ROI = "image string, split string, x bigint, y bigint, w bigint, h bigint, iou string"


def _iou(a, b):
    w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    return w * h / (a[4] * a[5] + b[4] * b[5] - w * h)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    rows = set()
    for _ in range(150):
        image, w, h = f"i{rng.randrange(4)}", rng.choice([1, 2, 3, 7, 40, 130, 600]), rng.choice([1, 2, 5, 33, 200])
        x, y = rng.randrange(300), rng.randrange(300)
        rows.add((image, "calibration", x, y, w, h))
        for _ in range(3):
            j = lambda v, s: max(0, v + rng.randint(-s // 10, s // 10))
            rows.add((image, rng.choice(["validation", "locked_test", "other"]), j(x, w), j(y, h), max(1, j(w, w)), max(1, j(h, h))))
    rows = sorted(rows)
    bad = [(None, "calibration", 1, 1, 5, 5, None), ("i0", None, 1, 1, 5, 5, None), ("i0", "calibration", 1, None, 5, 5, None), ("i0", "validation", 1, 1, 0, 5, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows] * 2 + bad, ROI)
    got = {(r.image, r.xa, r.ya, r.wa, r.ha, r.held_split, r.xb, r.yb, r.wb, r.hb) for r in cross_split_overlaps(df).collect()}
    want = {(a[0], *a[2:], b[1], *b[2:]) for a in rows for b in rows if a[0] == b[0] and a[1] == "calibration" and b[1] in ("validation", "locked_test") and _iou(a, b) >= 0.6}
    assert got == want and len(want) > 50


def test_overlap_fraction_is_a_lower_bound(spark):
    df = spark.createDataFrame([("i", "calibration", 0, 0, 400, 300, None), ("i", "validation", 0, 0, 400, 300, None)], ROI)
    r = cross_split_overlaps(df).first()
    assert r.iou == 1.0 and 0.3 < r.chunk_overlap <= 1.0
    assert cross_split_overlaps(spark.createDataFrame([], ROI)).count() == 0
