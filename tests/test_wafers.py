import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.kernels import image
from spotlake.operators.boundary import nearest_distance
from spotlake.operators.detect import analyse, boundary_points, crops
from spotlake.operators.masks import compared, evaluated, run_objects
from spotlake.operators.matching import box_links
from spotlake.operators.signal import rle_encode
from spotlake.operators.wafer import filled, geometry, previews, search, wafers
from spotlake.sources.rasters import one_channel
from spotlake.sources.tiles import opened, read_tiles
from tests.test_images import scene


def write_png(path, a, filters):
    """``a``: (h, w, channels); row y is written with filters[y % len(filters)]."""
    h, w, c = a.shape
    step = c * a.dtype.itemsize
    raw = a.astype(a.dtype.newbyteorder(">")).tobytes()
    lines = np.frombuffer(raw, np.uint8).reshape(h, w * step).astype(int)
    out = b""
    for y in range(h):
        kind = filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, int), lines[y][:-step]])
        up = lines[y - 1] if y else np.zeros_like(left)
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        guess = left + up - corner
        da, db, dc = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        out += bytes([kind]) + ((lines[y] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, a.dtype.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    data = zlib.compress(out)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data[:50]) + chunk(b"IDAT", data[50:]) + chunk(b"IEND", b""))


@pytest.mark.parametrize("dtype,channels", [("u1", 1), ("u2", 1), ("u1", 3), ("u2", 4), ("u1", 2)])
def test_png_rows_equal_the_array(tmp_path, dtype, channels):
    a = np.random.default_rng(1).integers(0, np.iinfo(dtype).max, (23, 31, channels)).astype(dtype)
    write_png(tmp_path / "a.png", a, [0, 1, 2, 3, 4])
    got = opened(str(tmp_path / "a.png"))
    want = one_channel(a[..., 0] if channels == 1 else a)
    assert got.shape == (23, 31) and got.rows(0, 23).dtype == dtype and (got.rows(5, 20) == want[5:20]).all()


def test_bmp_rows_and_refusals(tmp_path):
    a = np.random.default_rng(2).integers(0, 255, (9, 7, 3)).astype("u1")
    for name, stored, height in (("up.bmp", a[::-1], 9), ("down.bmp", a, -9)):
        body = b"".join(r[:, ::-1].tobytes().ljust(24, b"\0") for r in stored)
        (tmp_path / name).write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
        assert (opened(str(tmp_path / name)).rows(0, 9) == one_channel(a)).all()
    (tmp_path / "no.png").write_bytes(b"x" * 64)
    for name in ("no.png", "no.jpg"):
        with pytest.raises(ValueError):
            opened(str(tmp_path / name))


def test_png_tiles(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 255, (70, 50, 1)).astype("u1")
    write_png(tmp_path / "p.png", a, [4])
    np.save(tmp_path / "q.npy", a[..., 0])
    rows = read_tiles(spark, [str(tmp_path / "p.png"), str(tmp_path / "q.npy")], 32, 4).collect()
    byte = {n: sorted((r.tile_id, r.x0, r.y0, r.w, r.h, bytes(r.px)) for r in rows if r.image_id == n) for n in ("p", "q")}
    assert len(byte["p"]) == 6 and byte["p"] == byte["q"]


def test_polygons_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        points = rng.uniform(-5, 35, (rng.integers(3, 8), 2))
        got = image.polygon_mask((30, 28), points)
        for y, x in rng.integers(0, 28, (40, 2)):
            inside = False
            for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    inside = not inside
            assert got[y, x] == inside
        assert (image.polygon_mask((20, 18), points, 7, 6) == got[6:26, 7:25]).all()


def test_blobs_blackhat_rings_and_equalisation():
    y, x = np.mgrid[:80, :80]
    a = np.zeros((80, 80))
    for cx, cy, s in ((20, 25, 2.0), (55, 50, 3.0)):
        a += np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
    found = image.blobs(a)
    assert {(u, v) for v, u, _ in found} == {(20, 25), (55, 50)}
    valid = np.ones_like(a, bool)
    valid[:, 40:] = False
    mask = image.blob_mask(a, valid)
    assert mask[25, 20] and not mask[:, 40:].any() and mask.sum() < 200
    hat = image.blackhat((1 - 0.5 * a).astype(np.float32))
    assert hat[25, 20] > 0.4 and hat[5, 5] == 0 and hat.min() >= 0
    labels, n = image.label(a > 0.5)
    raw = np.where(labels > 0, 0.1, 0.8)
    assert n == 2 and image.ring_background(raw, labels, 1, valid, 5) == 0.8 and np.isnan(image.ring_background(raw, labels, 2, valid, 5))
    flat = image.clahe(0.4 + 0.1 * np.random.default_rng(0).random((64, 60)), 40.0)
    assert flat.shape == (64, 60) and flat.max() - flat.min() > 0.8 and 0 <= flat.min() <= flat.max() <= 1
    assert np.ptp(image.clahe(np.full((33, 31), 0.5))) < 1e-6


def test_the_wafer_is_found(spark, tmp_path):
    a, _ = scene(5, 256, 1)
    a = np.roll(a, (7, -9), axis=(0, 1))
    np.save(tmp_path / "im.npy", a)
    np.save(tmp_path / "none.npy", np.random.default_rng(0).integers(0, 9, (100, 120)).astype("u2"))
    tiles = read_tiles(spark, [str(tmp_path / "im.npy"), str(tmp_path / "none.npy")], 100, 3)
    seen = previews(tiles, 128)
    p = seen.where("image_id = 'im'").first()
    want = (a / 65535).reshape(128, 2, 128, 2).mean(axis=(1, 3))
    assert (p.w, p.h, p.step) == (128, 128, 2) and np.allclose(np.frombuffer(p.px, np.float32).reshape(128, 128), want, atol=1e-6)
    rows = {r.image_id: r for r in wafers(seen).collect()}
    r = rows["im"]
    assert r.accepted and r.polarity == "bright-wafer" and not r.cropped and r.confidence > 0.8
    assert abs(r.cx - 119) < 1.5 and abs(r.cy - 135) < 1.5 and abs(r.radius - 256 * 0.45) < 2
    assert not rows["none"].accepted
    g = geometry(wafers(seen), 100.0).collect()
    assert [x.image_id for x in g] == ["im"] and g[0].mm_per_px == pytest.approx(50 / r.radius)
    dark = search(1 - want)
    assert dark["polarity"] == "dark-wafer" and abs((dark["cx"] + 0.5) * 2 - 0.5 - 119) < 1.5
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert filled(ring).sum() == 25


def test_nearest_distances_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    edge = [("a", float(x), float(y)) for x, y in rng.integers(0, 900, (60, 2))] + [("b", 0.0, 0.0), ("b", 0.0, 0.0), ("b", None, 1.0)]
    points = [(i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 1200, (80, 2)))] + [(100, "c", 1.0, 1.0), (101, "a", float("nan"), 1.0), (102, None, 1.0, 1.0)]
    p = spark.createDataFrame(points, "id int, key string, x double, y double")
    b = spark.createDataFrame(edge, "key string, x double, y double")
    got = {r.id: r.distance for r in nearest_distance(p, b, 16.0).collect()}
    want = {i: min(np.hypot(x - u, y - v) for m, u, v in edge if m == k and u is not None) for i, k, x, y in points[:80]}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert nearest_distance(p.limit(0), b).count() == 0 and nearest_distance(p, b.limit(0)).count() == 0


def test_polygons_boundary_and_crops(spark, tmp_path):
    a, spots = scene(25, 256, 5)
    np.save(tmp_path / "im.npy", a)
    circle = spark.createDataFrame([("im", 128.0, 128.0, 115.0, 0.2)], "image_id string, cx double, cy double, radius double, mm_per_px double")
    tiles = read_tiles(spark, [str(tmp_path / "im.npy")], 128, 40)
    shapes = spark.createDataFrame([("im", [[0.0, 0.0], [128.0, 0.0], [128.0, 256.0], [0.0, 256.0]]), ("im", [[1.0, 1.0]]), (None, None)], "image_id string, corners array<array<double>>")
    found, densities = analyse(tiles, circle, background=21, polygons=shapes)
    rows = found.where("accepted").collect()
    assert rows and all(r.centroid_x_px >= 127 for r in rows)
    d = densities.first()
    assert d.full_px == d.edge_px + d.invalid_px + d.valid_px and d.invalid_px > 10_000
    y, x = np.mgrid[-1:257, -1:257]
    valid = ((x - 128) ** 2 + (y - 128) ** 2 <= 107**2) & (x >= 128)
    out = np.column_stack([x[~valid], y[~valid]])
    for r in rows:
        want = np.hypot(out[:, 0] - r.centroid_x_px, out[:, 1] - r.centroid_y_px).min()
        assert r.distance_to_valid_boundary_mm == pytest.approx(want * 0.2)
    plain = tiles.join(circle, "image_id").withColumns({"boxes": F.lit(None), "polygons": F.lit(None)})
    whole = read_tiles(spark, [str(tmp_path / "im.npy")], 256, 0).join(circle, "image_id").withColumns({"boxes": F.lit(None), "polygons": F.lit(None)})
    assert {tuple(r) for r in boundary_points(plain, 8.0).collect()} == {tuple(r) for r in boundary_points(whole, 8.0).collect()}
    some = spark.createDataFrame([("im", 1, 130.4, 127.9, "u"), ("im", 2, 3.0, 250.0, None), ("im", 3, None, 1.0, ""), ("no", 4, 1.0, 1.0, ""), ("im", 5, 999.0, 1.0, "")], "image_id string, n int, centroid_x_px double, centroid_y_px double, dtype_of string")
    cuts = {r.n: r for r in crops(tiles, some, 16, 128).collect()}
    assert cuts.keys() == {1, 2} and cuts[1].dtype_of == "u"
    for r in cuts.values():
        want = a[r.crop_y0 : r.crop_y0 + r.crop_h, r.crop_x0 : r.crop_x0 + r.crop_w]
        assert (np.frombuffer(r.px, r.dtype).reshape(r.crop_h, r.crop_w) == want).all()
    assert (cuts[1].crop_x0, cuts[1].crop_y0, cuts[1].crop_w, cuts[1].crop_h) == (114, 111, 32, 32) and (cuts[2].crop_x0, cuts[2].crop_w, cuts[2].crop_h) == (0, 19, 22)


def test_masks_are_evaluated(spark):
    truth = np.zeros((20, 30), np.uint8)
    truth[2:5, 2:5], truth[10:13, 20:23], truth[15:, :], truth[0, 25:] = 1, 1, 3, 2
    guess = np.zeros_like(truth)
    guess[2:5, 3:6], guess[16:18, 3:6], guess[0, 25:28] = 1, 1, 1
    counts, errors = compared(truth, guess > 0)
    assert counts == [6, 3, 12, 2, 2, 3, 1] and errors == pytest.approx([1.0])
    row = (1, "v", [20, 30], rle_encode(truth), rle_encode(guess))
    bad = [(2, "v", [20, 30], None, None), (3, "v", [2, 2], [[0, 9, 1]], None), (4, "v", [2, 2], [[0, 3, 1], [1, 1, 1]], None), (5, "w", [2, 2], [[0, 1, 1]], None)]
    df = spark.createDataFrame([row, *bad], "id int, split string, shape array<int>, truth array<array<int>>, predicted array<array<int>>")
    got = {r.split: r for r in evaluated(df, ["split"]).collect()}
    assert (got["v"].tp, got["v"].fp, got["v"].object_precision, got["v"].object_recall) == (6, 3, pytest.approx(1 / 3), 0.5)
    assert got["v"].iou == pytest.approx(6 / 21) and got["v"].mean_error_px == pytest.approx(1.0)
    assert got["w"].fn == 1 and got["w"].precision is None and got["w"].recall == 0
    masks = df.select("id", F.struct(F.lit("rle").alias("encoding"), "shape", F.col("truth").alias("runs")).alias("m"))
    found = {(r.id, r.value, r.pixels) for r in run_objects(masks, ["id"], "m").collect()}
    assert found == {(1, 1, 9), (1, 2, 5), (1, 3, 150), (5, 1, 1)}
    assert run_objects(masks.limit(0), ["id"], "m").count() == 0


def test_box_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        x, y, w, h = rng.integers(0, 60, 2).tolist() + rng.integers(1, 40, 2).tolist()
        rows.append((f"c{i}", "ab"[i % 2], None if i % 11 == 0 else f"t{i % 3}", [float(v) for v in (x, y, x + w, y + h)]))
    df = spark.createDataFrame([*rows, ("z", "a", "t", None)], "id string, key string, tile string, box array<double>")
    want = {}
    for i, k, t, p in rows:
        for j, m, u, q in rows:
            common = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
            size = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1])
            if i != j and k == m and (t is None or u is None or t != u) and common / (size - common) >= 0.3:
                want[i] = want.get(i, 0) + 1
    assert want and {r.id: r.links for r in box_links(df, "key", "tile").collect()} == want
