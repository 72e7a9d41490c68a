import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import catalog, review, signal, validation
from spotlake.operators.logistic import train
from spotlake.operators.quantiles import medians, quantiles
from spotlake.operators.rules import FEATURES, Limits, Model, decide, reasons
from spotlake.operators.scale import least_rows, numbered


def test_kappa_example(spark):
    rows = [(i, r, lab) for i, (a, b) in enumerate([("confirmed_point",) * 2, ("scratch",) * 2, ("confirmed_point", "scratch")]) for r, lab in (("a", a), ("b", b))]
    verdicts = spark.createDataFrame(rows, "i int, reviewer_id string, label string")
    r = review.pair_agreement(review.reviewer_pairs(verdicts, ["i"])).first()
    assert r.raw_agreement == pytest.approx(2 / 3) and r.kappa == pytest.approx(0.4)


def test_arbitration_and_consensus(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "b", "x"), (3, "a", "x"), (3, "b", "x"), (3, "c", "y"), (4, "a", "x"), (4, "b", "y")]
    out = {r.i: (r.label, r.status) for r in review.arbitrate(spark.createDataFrame(rows, "i int, reviewer_id string, label string"), ["i"]).collect()}
    assert out == {1: ("x", "single_reviewer"), 2: ("x", "unanimous"), 3: ("x", "majority"), 4: ("uncertain", "tie_to_uncertain")}
    rows = [(1, "target", "a"), (1, "uncertain", "a"), (1, "artifact", "b"), (2, "target", "a"), (2, "artifact", "a"), (3, "target", "a"), (3, "target", "b"), (4, "target", "a"), (4, "target", None)]
    out = {r.i: (r.status, r.label) for r in review.consensus_for_training(spark.createDataFrame(rows, "i int, label string, split string"), ["i"]).collect()}
    assert out == {1: ("uncertain", None), 2: ("conflict", None), 3: ("split_conflict", None), 4: ("usable", "target")}


def test_keep_last_and_leakage(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 5, "c"), ("k", None, "d")], "k string, o int, v string")
    assert {(r.k, r.v) for r in review.keep_last(df, ["k"], ["o"]).collect()} == {(None, "b"), ("k", "c")}
    torn = spark.createDataFrame([("w", "a"), ("w", "b"), ("v", "a"), (None, "b")], "w string, s string")
    with pytest.raises(ValueError, match="w in several splits"):
        validation.require_unleaked(torn, "w", "s")
    validation.require_unleaked(torn.where("w = 'v'"), "w", "s")


def test_rules_in_order(spark):
    cols = "area_px bigint, equivalent_diameter_px double, aspect_ratio double, eccentricity double, circularity double, solidity double, contrast double, distance_to_valid_boundary_mm double"
    rows = [(50, 8.0, 1.2, 0.5, 0.9, 0.95, 0.2, 5.0), (1, 1.0, math.inf, 0.99, 0.1, 0.1, math.nan, -1.0), (5000, 80.0, 1.0, 0.1, 0.9, 0.9, 0.2, 0.1), (None,) * 8]
    narrow = Limits(4, 2000, 2.0, 60.0, 3.0, 0.95, 0.35, 0.7, 0.02, 0.5)
    df = spark.createDataFrame(rows, cols)
    got = [r.reasons for r in df.withColumn("reasons", reasons(narrow)).collect()]
    assert got[0] == [] and got[3] == ["low_contrast"]
    assert got[1] == ["outside_valid_mask", "too_small", "too_elongated", "low_circularity", "low_solidity", "low_contrast"]
    assert got[2] == ["too_large", "near_wafer_edge"]
    # The defaults are at their bounds in the third row; below 0.95 of valid pixels a candidate lies outside.
    assert [r.reasons for r in df.withColumn("reasons", reasons()).collect()][2] == []
    share = F.when(F.col("area_px") == 50, 0.95).otherwise(0.949)
    assert [r.reasons[:1] for r in df.withColumn("reasons", reasons(Limits(), share)).collect()] == [[], ["outside_valid_mask"], ["outside_valid_mask"], ["outside_valid_mask"]]


def _features(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = bool(i % 2)
        v = [abs(float(rng.normal(1.5 if t else 1.0, 0.3))) for _ in FEATURES]
        rows.append((i, "target" if t else "artifact", 50, 8.0, 5.0, *v))
    names = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, f"i int, label string, area_px bigint, equivalent_diameter_px double, distance_to_valid_boundary_mm double, {names}")


def test_model_learns_and_decides(spark):
    df = _features(spark)
    model = train(df)
    out = decide(df, model).collect()
    decided = [r for r in out if r.decision in ("target", "artifact")]
    assert len(decided) > 250 and np.mean([r.decision == r.label for r in decided]) > 0.95
    again = train(df)
    assert np.allclose(model.weights, again.weights)
    with pytest.raises(ValueError, match="are needed"):
        train(df.where("label = 'target'"))
    with pytest.raises(ValueError):
        Model((0.0,), (0.0,), (1.0,), 0.0).checked()


def test_signals(spark):
    mask = np.array([[0, 1, 1], [2, 0, 0], [3, 3, 3]], np.uint8)
    runs = signal.rle_encode(mask)
    assert (signal.rle_to_mask(mask.shape, runs) == mask).all()
    with pytest.raises(ValueError):
        signal.rle_to_mask((1, 3), [[0, 2, 1], [1, 1, 2]])
    rng = random.Random(0)
    values = [("a", rng.gauss(m, 0.05)) for m in (0, 1, 3) for _ in range(300)] + [("a", math.nan), ("b", 1.0)]
    got = signal.otsu_cut(spark.createDataFrame(values, "g string, v double"), ["g"], "v").collect()
    assert len(got) == 1 and 0.1 < got[0].threshold < 0.95
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyyx")], "g string, i int, v string")
    assert sorted((r.start, r.length, r.v) for r in signal.run_lengths(rows, ["g"], ["i"], "v").collect()) == [(0, 2, "x"), (2, 3, "y"), (5, 1, "x")]


def test_catalogue(spark):
    df = spark.range(23)
    assert [r.id for r in catalog.page(df, [df.id], 3, 10).collect()] == [20, 21, 22]
    assert catalog.page_info(df.limit(0), 10).first()[:] == (0, 1)
    assert [r.id for r in catalog.evenly_spaced(df.selectExpr("id", "1 as g"), ["g"], ["id"], 3).orderBy("id").collect()] == [0, 11, 22]
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (0, 10), (10, 10), (5, 5), (5, 6)])], "id bigint, x double, y double")
    got = [r.id for r in catalog.farthest_points(pts, 5).orderBy("place").collect()]
    assert got[0] == 4 and set(got[1:]) == {0, 1, 2, 3}
    assert catalog.systematic(spark.range(100), ["id"], 10).count() == 10


def test_bootstrap(spark):
    rows = [(f"w{i}", 100.0 + i, 100.0) for i in range(10)]
    r = validation.bootstrap_bias(spark.createDataFrame(rows, "id string, o double, e double"), "o", "e").first()
    assert r.wafers == 10 and r.low < 0.045 < r.high
    assert validation.bootstrap_bias(spark.createDataFrame(rows[:1], "id string, o double, e double"), "o", "e").first().low is None


def test_decisions_keep_what_the_rules_said(spark):
    df = _features(spark, 40).withColumn("distance_to_valid_boundary_mm", F.when(F.col("i") == 0, -1.0).otherwise(5.0)).withColumn("contrast", F.when(F.col("i") == 1, float("nan")).otherwise(F.col("contrast")))
    model = Model((1.25,) * 10, (0.3,) * 10, (1.0,) * 10, 0.0)
    rows = {r.i: r for r in decide(df, model).collect()}
    assert (rows[0].decision, rows[0].final_reason, rows[0].accepted_now) == ("blocked_by_geometry", rows[0].rule_rejection_reason, False) and "outside_valid_mask" in rows[0].final_reason
    assert (rows[1].decision, rows[1].final_reason, rows[1].model_applied) == ("feature_invalid", "classifier_feature_invalid", False)
    assert all((r.final_reason == "") == r.accepted_now == (r.decision == "target") for r in rows.values())
    assert any(not r.rule_accepted and r.accepted_now for r in rows.values())


def test_pages_are_filtered_and_labelled(spark):
    rows = [("r", 1, True, ""), ("r", 2, False, "too_small; low_contrast"), ("r", 3, False, "low_contrast_2"), ("r", 4, False, None), ("r", 5, None, "low_contrast")]
    df = spark.createDataFrame(rows, "run_id string, defect_id bigint, accepted boolean, rejection_reason string")
    ids = lambda d: sorted(r.defect_id for r in d.collect())
    assert ids(catalog.filtered(df)) == [1, 2, 3, 4, 5] and ids(catalog.filtered(df, "rejected", "low_contrast")) == [2, 5]
    assert ids(catalog.filtered(df, " ACCEPTED ")) == [1] and ids(catalog.filtered(df, item=" 3 ")) == [3] and ids(catalog.filtered(df, "accepted", item="3")) == []
    with pytest.raises(ValueError):
        catalog.filtered(df, "maybe")
    verdicts = spark.createDataFrame([("r", 1, "target"), ("r", 1, "target"), ("r", 2, "target"), ("r", 2, "artifact"), ("r", 3, None), ("q", 4, "target")], "run_id string, defect_id bigint, label string")
    got = {r.defect_id: r.label for r in catalog.with_labels(df, verdicts, ["run_id", "defect_id"]).collect()}
    assert got == {1: "target", 2: "conflict", 3: None, 4: None, 5: None}
    names = spark.createDataFrame([(x,) for x in ("a-1_b.c/d", "..", "a/../b", "", "/a", "a//b", "a b", "...x", None)], "n string")
    assert [r.ok for r in names.select(catalog.safe_name(F.col("n")).alias("ok")).collect()] == [True, False, False, False, False, False, False, True, False]


def test_strata_and_held_out(spark):
    rows = spark.createDataFrame([("TP", 0.1), ("FN", 0.33), ("FP", 0.34), ("indeterminate", 1.0), ("TP", 1.1), ("TP", None)], "outcome string, q double")
    got = {r.stratum: (r.tp, r.fp, r.fn, r["count"], r.precision, r.recall) for r in validation.stratum_metrics(rows, F.col("q")).collect()}
    assert got == {"center": (1, 0, 1, 2, 1.0, 0.5), "middle": (0, 1, 0, 1, 0.0, None), "edge": (0, 0, 0, 1, None, None)}
    scored = spark.createDataFrame([("v", "target", "target"), ("v", "artifact", "uncertain"), ("v", "target", "blocked_by_geometry"), ("l", "target", "artifact")], "split string, label string, decision string")
    got = {r.split: (r.status, r.n, r.decided, r.tp, r.fn) for r in validation.held_out(scored, ["split"]).collect()}
    assert got == {"v": ("held_out_v", 3, 1, 1, 1), "l": ("one_class_only", 1, 1, 0, 1)}


def test_provenance_of_several_hashes(spark):
    known = spark.createDataFrame([("i", "AA"), ("i", "bb "), ("i", "cc"), ("j", None), (None, "x")], "k string, h string")
    said = spark.createDataFrame([(1, "i", "bb"), (2, "i", "dd"), (3, "i", " "), (4, "j", "x"), (5, "z", "x"), (6, None, "x")], "n int, k string, d string")
    got = {r.n: r.provenance for r in review.provenance(said, known, "k", "d", "h").collect()}
    assert got == {1: "match", 2: "mismatch", 3: "not_declared", 4: "source_without_hash", 5: "unknown_source", 6: "unknown_source"}


def test_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([rng.gauss(0, 1), rng.choice([0.0, -0.0, 1e300, -1e-300]), float(rng.randint(0, 3))])) for _ in range(2000)]
    odd = [("a", math.nan), ("a", None), ("c", math.inf), ("d", 7.0)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows + odd, "g string, v double"), ["g"], {"q0": 0.0, "q37": 0.37, "q99": 0.99, "q100": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "d"} and got["d"].q37 == 7.0
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g]
        want = np.quantile(values, [0.0, 0.37, 0.99, 1.0])
        assert got[g].n == len(values) and np.allclose([got[g].q0, got[g].q37, got[g].q99, got[g].q100], want, rtol=1e-12)
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], {"m": 0.5}).count() == 0
    assert medians(spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 6.0)], "x double, y double"), [], ["x", "y"]).first()[:] == (2.0, 5.5)


@pytest.mark.parametrize("rows_each", [7, 10_000])
def test_numbers_and_least_rows(spark, rows_each):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "b"]), i, rng.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r.i: r.n for r in numbered(df, ["g"], ["v", "i"], "n", rows_each).collect()}
    least = sorted((r.g or "", r.p, r.i) for r in least_rows(df, ["g"], ["v", "i"], 3, "p").collect())
    for g in ("a", None, "b"):
        mine = sorted((v, i) for k, i, v in rows if k == g)
        assert [got[i] for _, i in mine] == list(range(len(mine)))
        assert [x for x in least if x[0] == (g or "")] == [(g or "", n + 1, i) for n, (_, i) in enumerate(mine[:3])]


def test_sliding_medians_meet_at_pieces(spark):
    values = [("a", i, float(v)) for i, v in enumerate(np.random.default_rng(5).normal(0, 1, 200))] + [("b", 1, 2.0)]
    df = spark.createDataFrame(values, "g string, i int, v double")
    got = {(r.g, r.i): r.median for r in signal.sliding_median(df, ["g"], ["i"], "v", 5, piece=17).collect()}
    a = [v for g, _, v in values if g == "a"]
    assert len(got) == 201 and all(got["a", i] == pytest.approx(np.median(a[max(0, i - 5) : i + 6])) for i in range(200))
