import json

import numpy as np
import pytest

from spotlake.__main__ import main
from spotlake.kernels import forest, image
from spotlake.operators import models
from spotlake.operators.config import load
from spotlake.operators.detect import analyse
from spotlake.operators.pixel_training import labelled_pixels, left_out
from spotlake.operators.rules import FEATURES, Model
from spotlake.operators.signal import rle_encode
from spotlake.sources.tiles import read_tiles
from tests.test_images import scene


def test_models_survive_a_round_trip_and_damage_is_seen():
    n = len(FEATURES)
    model = Model((0.5,) * n, (1.0,) * n, (0.25,) * n, -0.1)
    text = models.candidate_model_json(model)
    assert models.candidate_model(text) == model and json.loads(text)["sha256"] == models.digest(json.loads(text))
    for bad in (text.replace("-0.1", "-0.2"), models.sealed("candidate_model", {**json.loads(text), "names": ["x"] * n}), models.sealed("pixel_model", {})):
        with pytest.raises(ValueError):
            models.candidate_model(bad)
    trees = [[(0, 0.5, 1, 2, 0.5, 9), (-1, 0.0, -1, -1, 0.1, 4), (-1, 0.0, -1, -1, 0.9, 5)]]
    assert models.forest(models.forest_json(trees, 0.6)) == (trees, 0.6)
    for bad in ([], [[]], [[(0, 0.5, 1, 1, 0.5, 9), trees[0][1]]], [[(99, 0.5, 1, 2, 0.5, 9), *trees[0][1:]]], [[trees[0][1], trees[0][2]]]):
        with pytest.raises(ValueError):
            models.checked_forest(bad)
    with pytest.raises(ValueError):
        models.canonical(float("nan"))


def test_settings_files(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"x": 2}, "b": [1]}')
    assert load(str(tmp_path / "a.json"), {"a": {"x": 1, "y": 1}}, {"b": 3}) == {"a": {"x": 2, "y": 1}, "b": 3}
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ValueError):
        load(str(tmp_path / "b.json"), {})


def test_labelled_pixels_have_no_seams_and_train_a_forest(spark, tmp_path):
    a, spots = scene(20, 256, 8)
    np.save(tmp_path / "im.npy", a)
    y, x = np.mgrid[:256, :256]
    near = np.min([np.hypot(x - u, y - v) for u, v in spots], axis=0)
    whole = np.where(near < 2, 1, np.where((near > 6) & (np.hypot(x - 128, y - 128) < 105) & ((x + y) % 9 == 0), 2, 0)).astype(np.uint8)
    roi = [30, 40, 190, 170]
    part = whole[40:210, 30:220]
    rows = [(1, "im", roi, rle_encode(part)), (2, "im", [0, 0, 8, 8], [[0, 1, 1]]), (3, "im", [0, 0, 64, 64], [[5, 9999, 1]]), (4, None, roi, []), (5, "im", None, []), (6, "no", roi, [])]
    samples = spark.createDataFrame(rows, "sample_id int, image_id string, roi array<int>, runs array<array<int>>")
    assert {r.sample_id: r.reason for r in left_out(samples).collect()} == {2: "side", 3: "runs", 4: "missing", 5: "missing"}
    found = labelled_pixels(read_tiles(spark, [str(tmp_path / "im.npy")], 64, image.HALO), samples, 64)
    got = {r.id - (1 << 22): (r.y, r.x) for r in found.collect()}
    want = np.flatnonzero(part.ravel())
    assert sorted(got) == want.tolist()
    features = image.pixel_features(image.as_float01(a))[40:210, 30:220].reshape(-1, 17)
    assert all(got[i][0] == (part.ravel()[i] == 1) and np.allclose(got[i][1], features[i]) for i in want)
    trees = [[tuple(n) for n in r.nodes] for r in forest.train(found, trees=4, per_class=500).orderBy("tree").collect()]
    assert models.checked_forest(trees)
    p = forest.predict(trees, features[want])
    assert np.mean((p >= 0.5) == (part.ravel()[want] == 1)) > 0.95


def test_raster_masks(spark, tmp_path):
    a, _ = scene(20, 256, 5)
    bad = np.zeros((256, 256), np.uint8)
    bad[:, :128] = 255
    for folder, m in (("m", bad), ("n", bad[:200])):
        (tmp_path / folder).mkdir()
        np.save(tmp_path / folder / "im.npy", m)
    np.save(tmp_path / "im.npy", a)
    circle = spark.createDataFrame([("im", 128.0, 128.0, 115.0, 0.2)], "image_id string, cx double, cy double, radius double, mm_per_px double")
    tiles = lambda p: read_tiles(spark, [str(p)], 128, 40)
    box = spark.createDataFrame([("im", 0, 0, 128, 256)], "image_id string, x0 int, y0 int, x1 int, y1 int")
    one = analyse(tiles(tmp_path / "im.npy"), circle, background=21, masks=tiles(tmp_path / "m/im.npy"))
    two = analyse(tiles(tmp_path / "im.npy"), circle, background=21, invalid=box)
    table = lambda df: sorted((r.centroid_x_px, r.centroid_y_px, r.distance_to_valid_boundary_mm, r.accepted) for r in df.collect())
    assert table(one[0]) == table(two[0]) and one[1].first() == two[1].first()
    with pytest.raises(Exception, match="another size"):
        analyse(tiles(tmp_path / "im.npy"), circle, background=21, masks=tiles(tmp_path / "n/im.npy"))[1].collect()


def test_analyze_from_files_to_tables(spark, tmp_path):
    a, spots = scene(15, 256, 2)
    np.save(tmp_path / "im.npy", a)
    np.save(tmp_path / "empty.npy", np.random.default_rng(0).integers(0, 9, (90, 80)).astype("u2"))
    out = str(tmp_path / "out")
    status = main(["analyze", str(tmp_path / "im.npy"), str(tmp_path / "empty.npy"), "--diameter-mm", "50", "--out", out, "--tile", "128", "--halo", "40", "--background", "21"])
    assert status == 1  # one image failed
    rows = {r.image_id: r for r in spark.read.json(f"{out}/summary_json").collect()}
    assert rows["im"].status == "completed" and rows["im"].accepted_count == len(spots) and rows["im"].point_density_cm2 > 0
    assert rows["empty"].status == "failed" and not rows["empty"].density_calculated and rows["empty"].point_density_cm2 is None
    assert spark.read.parquet(f"{out}/candidates").where("accepted = 'true'").count() == len(spots)
