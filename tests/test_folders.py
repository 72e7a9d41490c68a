"""Result folders, training labels with snapshots, scales in micrometres, and exact facts of images."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.functions.geometry import true_box
from spotlake.operators import catalog, matching, review
from spotlake.operators.config import GENERIC, PROFILES, with_profile
from spotlake.operators.grey import decimated, extrema, windowed
from spotlake.sources.tables import LABEL_COLUMNS, append_operation, read_result_folders, read_training_labels
from spotlake.sources.tiles import read_tiles


def test_training_labels_are_strict(spark, tmp_path):
    def file(name, columns, rows):
        (tmp_path / name).write_text("\n".join([",".join(columns), *[",".join(str(r.get(c, "")) for c in columns) for r in rows]]) + "\n")
        return str(tmp_path / name)

    row = {"run_id": "r", "defect_id": "1", "reviewer_id": "x", "label": " Target", "split": "calibration", "x_mm": "1.5", "contrast": "none"}
    got = read_training_labels(spark, file("a.csv", LABEL_COLUMNS, [row])).first()
    assert (got.label, got.x_mm, got.contrast, got.area_mm2) == ("target", 1.5, None, None)
    with pytest.raises(ValueError, match="missing columns: mean_dark_response"):
        read_training_labels(spark, file("b.csv", LABEL_COLUMNS[:-1], [row]))
    with pytest.raises(ValueError, match="label: r/1; split: r/1; key: r/1"):
        read_training_labels(spark, file("c.csv", LABEL_COLUMNS, [row | {"label": "dot", "split": "test", "reviewer_id": " "}]))


def test_result_folders_are_united(spark, tmp_path):
    def folder(base, name, summary, text):
        (tmp_path / base / name).mkdir(parents=True)
        (tmp_path / base / name / "summary.json").write_text(json.dumps(summary))
        if text:
            (tmp_path / base / name / "defects_accepted.csv").write_text(text)

    folder("ok", "r1", {"input_file_name": "i.tif", "wafer_id": "w", "valid_analysis_area_cm2": 2.0, "mm_per_pixel": 0.1}, "defect_id,centroid_x_px,centroid_y_px,x_mm,y_mm,image_id\n1,1,2,,4,other\n2,x,2,3,4,\n")
    folder("ok", "r2", {"mm_per_pixel": 0.2}, "defect_id,centroid_x_px,centroid_y_px,x_mm,y_mm,image_id\n1,5,6,7,8,\n")
    found = read_result_folders(spark, str(tmp_path / "ok"))
    rows = {(r.run_id, r.defect_id): (r.image_id, r.wafer_id, r.centroid_x_px, r.x_mm, r.accepted) for r in found["accepted"].collect()}
    assert rows == {("r1", "1"): ("i.tif", "w", 1.0, None, True), ("r1", "2"): ("i.tif", "w", None, 3.0, True), ("r2", "1"): ("r2", "r2", 5.0, 7.0, True)}
    assert dict(map(tuple, found["areas"].collect())) == {"w": 2.0, "r2": None} and dict(map(tuple, found["scales"].collect())) == {"i.tif": 0.1, "r2": 0.2}
    for name, columns in (("a", "defect_id,centroid_x_px,centroid_y_px,x_mm,y_mm"), ("b", "centroid_x_px,defect_id,centroid_y_px,x_mm,y_mm")):
        folder("mixed", name, {}, f"{columns}\n1,2,3,4,5\n")
    with pytest.raises(Exception, match="header"):
        read_result_folders(spark, str(tmp_path / "mixed"))["accepted"].collect()
    folder("bad", "r3", {}, "")
    with pytest.raises(ValueError, match="missing: r3"):
        read_result_folders(spark, str(tmp_path / "bad"))


def test_labels_keep_a_snapshot(spark):
    cands = spark.createDataFrame([("r", 1, 0.5, 1.0, True, None, float("nan")), ("r", 2, 0.1, 2.0, False, "too_small", 3.0), ("q", 1, 0.0, 0.0, True, None, 9.0)], "run_id string, defect_id bigint, x_mm double, y_mm double, accepted boolean, rejection_reason string, contrast double")
    runs = spark.createDataFrame([("r", "i.tif", None)], "run_id string, input_file_name string, wafer_id string")
    schema = "run_id string, defect_id string, label string, split string, reviewer_id string, notes string, updated_at_utc string"
    new = lambda *rows: review.with_snapshot(spark.createDataFrame(rows, schema), cands, runs, ["contrast"])
    first = new(("r", "1", "Target", "calibration", "a", "", "2026-01-01"), ("r", " 2", "artifact", "calibration", "a", None, "2026-01-01"))
    got = {r.defect_id: r for r in first.collect()}
    assert (got["2"].rejection_reason_at_annotation_time, got["2"].accepted_at_annotation_time, got["2"].contrast, got["1"].contrast) == ("too_small", "false", 3.0, None)
    assert (got["1"].input_file_name, got["1"].wafer_id, got["1"].label) == ("i.tif", "r", "target") and got["1"].candidates_digest == got["2"].candidates_digest
    again = review.with_snapshot(spark.createDataFrame([("r", "1", "target", "calibration", "a", "", "t")], schema), cands.union(cands).orderBy(F.desc("contrast")), runs, ["contrast"])
    assert again.first().candidates_digest == got["1"].candidates_digest
    both = review.upserted(first, new(("r", "1", "uncertain", "calibration", "a", "", "2025-01-01"), ("q", "1", "target", "validation", "b", "", "2025-01-01")))
    assert {(r.run_id, r.defect_id, r.reviewer_id): r.label for r in both.collect()} == {("r", "1", "a"): "uncertain", ("r", "2", "a"): "artifact", ("q", "1", "b"): "target"}
    assert new().count() == 0 and review.upserted(first.limit(0), first).count() == 2
    with pytest.raises(ValueError, match="no such candidate: r/7"):
        new(("r", "7", "target", "calibration", "a", "", "t"))


def test_points_in_micrometres(spark):
    schema = "id bigint, key string, x double, y double, x_mm double, y_mm double"
    left = [(1, "mm", 5.0, 5.0, 1.0, 2.0), (2, "px", 10.0, 20.0, 1.0, 2.0), (3, "none", 1.0, 1.0, None, 1.0)]
    right = [(4, "mm", None, None, 1.0, 2.05), (5, "px", 11.0, 20.0, float("nan"), 2.0), (6, "none", 1.0, 1.0, 1.0, 1.0), (7, None, 1.0, 1.0, 1.0, 1.0)]
    scales = spark.createDataFrame([("px", 0.02), ("px", 0.01), ("mm", 9.0), ("none", 0.0), ("none", float("nan")), (None, 1.0)], "key string, mm_per_pixel double")
    a, b = matching.in_micrometres(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), scales)
    got = {r.id: (r.x, r.y) for r in a.unionByName(b).collect()}
    want = {1: (1000, 2000), 2: (200, 400), 4: (1000, 2050), 5: (220, 400)}
    assert {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()} and all(got[k] == (None, None) for k in (3, 6, 7))


def test_boxes_slots_warnings_and_profiles(spark, tmp_path):
    boxes = [[1, 2, 3, 4], [1, 2, 1, 4], [1, 2, 3], [1, None, 3, 4], [], None]
    rows = spark.createDataFrame([(b,) for b in boxes], "b array<int>").select(true_box("b").alias("t")).collect()
    assert [r.t for r in rows] == [[1.0, 2.0, 3.0, 4.0], None, None, None, None, None]
    for accepted, rejected, slots in [(9, 9, 5), (1, 9, 5), (9, 1, 5), (2, 1, 5), (0, 0, 5), (3, 3, 0)]:
        a, r = catalog.shared_slots(accepted, rejected, slots)
        assert a <= accepted and r <= rejected and a + r == min(slots, accepted + rejected)
    assert catalog.shared_slots(9, 9, 5) == (3, 2)
    words = spark.createDataFrame([(["b", "a", None], ["a", "c", "b"], None)], "p array<string>, q array<string>, r array<string>")
    assert words.select(catalog.joined_once(F.col("p"), F.col("q"), F.col("r")).alias("w")).first().w == ["b", "a", "c"]
    name = next(n for n in PROFILES if n != GENERIC)
    base = {"detection": {"threshold_offset": 0.0, "k": 1}}
    out = with_profile(base, name)
    assert out["detection"] == {"threshold_offset": 0.03, "k": 1, "method": "blackhat", "threshold_method": "otsu", "use_watershed": False} and out["analysis_profile"]["profile_id"] == name
    assert with_profile(base, " ")["detection"] == base["detection"] and base == {"detection": {"threshold_offset": 0.0, "k": 1}}
    with pytest.raises(ValueError, match="unknown profile"):
        with_profile(base, "other")
    for _ in range(2):
        append_operation(spark.createDataFrame([("o",)], "name string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_extremes_and_decimated_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = {"u": rng.integers(0, 4096, (70, 90)).astype("u2"), "f": rng.normal(0, 5, (50, 33)).astype("f4"), "nan": np.full((9, 9), np.nan)}
    images["f"][3, 4:6] = np.nan, np.inf
    for name, a in images.items():
        np.save(tmp_path / f"{name}.npy", a)
    tiles = read_tiles(spark, [str(tmp_path / f"{n}.npy") for n in images], 32, 4)
    plain = {r.image_id: r for r in extrema(tiles).collect()}
    scaled = windowed(tiles)
    edges = {r.image_id: (r.low, r.high) for r in scaled.select("image_id", "low", "high").distinct().collect()}
    for r in extrema(scaled).collect():
        a = images[r.image_id]
        v = a[np.isfinite(a)].astype(float)
        assert (r.pixels, r.finite) == (a.size, v.size) and plain[r.image_id].below is None
        if v.size:
            low, high = edges[r.image_id]
            assert (r.least, r.greatest, r.below, r.above) == (v.min(), v.max(), (v < low).mean(), (v > high).mean()) and plain[r.image_id].least == v.min()
        else:
            assert (r.least, r.greatest, r.below, r.above) == (None, None, None, None)
    for step in (1, 7, 40):
        got = {n: np.zeros(a[::step, ::step].shape, a.dtype) for n, a in images.items()}
        for p in decimated(tiles, step).collect():
            got[p.image_id][p.y : p.y + p.h, p.x : p.x + p.w] = np.frombuffer(p.px, p.dtype).reshape(p.h, p.w)
        assert all(np.array_equal(got[n], a[::step, ::step], equal_nan=a.dtype.kind == "f") for n, a in images.items())
    with pytest.raises(ValueError):
        decimated(tiles, 0)
