import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.kernels import forest, image
from spotlake.operators.rules import Limits
from spotlake.operators.detect import analyse
from spotlake.operators.grey import grey, windowed, windows
from spotlake.sources.tiles import opened, read_tiles, tile_grid


def write_tiff(path, a, compression=1, rows_per_strip=16, order="<"):
    data = a.astype(a.dtype.newbyteorder(order))
    strips = [data[y : y + rows_per_strip].tobytes() for y in range(0, len(a), rows_per_strip)]
    strips = [zlib.compress(s) for s in strips] if compression == 8 else strips
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    n, at = len(strips), 8
    offsets = np.cumsum([0] + [len(s) for s in strips])[:-1] + at
    extra = at + sum(map(len, strips))
    tags = [(256, 4, 1, a.shape[1]), (257, 4, 1, a.shape[0]), (258, 3, 1, a.dtype.itemsize * 8), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, n, extra), (277, 3, 1, 1), (278, 4, 1, rows_per_strip), (279, 4, n, extra + 4 * n), (339, 3, 1, kind)]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, extra + 8 * n) + b"".join(strips)
    out += struct.pack(f"{order}{n}I", *offsets) + struct.pack(f"{order}{n}I", *map(len, strips)) + struct.pack(order + "H", len(tags))
    for tag, typ, count, value in tags:
        if count * (2 if typ == 3 else 4) <= 4:
            body = struct.pack(order + ("H" if typ == 3 else "I"), offsets[0] if tag == 273 else len(strips[0]) if tag == 279 else value).ljust(4, b"\0")
        else:
            body = struct.pack(order + "I", value)
        out += struct.pack(order + "HHI", tag, typ, count) + body
    path.write_bytes(out + struct.pack(order + "I", 0))


@pytest.mark.parametrize("dtype,compression,order", [("u2", 1, "<"), ("u2", 8, ">"), ("f4", 1, ">"), ("u1", 8, "<")])
def test_tiff_bands_equal_the_array(tmp_path, dtype, compression, order):
    a = (np.random.default_rng(0).random((173, 211)) * 250).astype(dtype)
    write_tiff(tmp_path / "a.tif", a, compression, order=order)
    t = opened(str(tmp_path / "a.tif"))
    assert t.shape == a.shape and all((t.rows(y, z) == a[y:z]).all() for y, z in ((0, 173), (15, 17), (100, 101), (160, 173)))


def test_tiles_cover_each_pixel_once(spark, tmp_path):
    a = np.arange(173 * 211, dtype="u4").reshape(173, 211)
    np.save(tmp_path / "im.npy", a)
    rows = read_tiles(spark, [str(tmp_path / "im.npy")], 64, 9).collect()
    back, seen = np.zeros_like(a), np.zeros(a.shape, int)
    for r in rows:
        px = np.frombuffer(r.px, r.dtype).reshape(r.h, r.w)
        assert (px == a[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]).all()
        core = np.s_[r.core_y : r.core_y + r.core_h, r.core_x : r.core_x + r.core_w]
        back[core] = px[r.core_y - r.y0 : r.core_y - r.y0 + r.core_h, r.core_x - r.x0 : r.core_x - r.x0 + r.core_w]
        seen[core] += 1
    assert (back == a).all() and (seen == 1).all()
    grid = tile_grid(spark.createDataFrame([("im", 211, 173), ("none", 0, 5)], "image_id string, image_w int, image_h int"), 64, 9)
    assert {(r.x0, r.y0, r.w, r.h) for r in grid.collect()} == {(r.x0, r.y0, r.w, r.h) for r in rows}


def test_labels_and_distances_equal_brute_force():
    rng = np.random.default_rng(2)
    for density in (0.2, 0.5, 0.8):
        m = rng.random((17, 23)) < density
        got, n = image.label(m)
        todo, k = m.copy(), 0
        for y, x in np.argwhere(m):
            if not todo[y, x]:
                continue
            k, stack, part = k + 1, [(y, x)], []
            todo[y, x] = False
            while stack:
                a, b = stack.pop()
                part.append((a, b))
                for c in range(max(0, a - 1), min(17, a + 2)):
                    for d in range(max(0, b - 1), min(23, b + 2)):
                        if todo[c, d]:
                            todo[c, d] = False
                            stack.append((c, d))
            assert len({got[p] for p in part}) == 1
        assert n == k
        p = np.argwhere(~np.pad(m, 1)) - 1
        want = np.array([[0 if not m[y, x] else np.sqrt(((p - [y, x]) ** 2).sum(1).min()) for x in range(23)] for y in range(17)])
        assert np.allclose(image.edt(m), want)


def scene(n=40, size=512, seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    a = 0.7 + 0.02 * x / size + rng.normal(0, 0.004, (size, size))
    a[(x - size / 2) ** 2 + (y - size / 2) ** 2 > (size * 0.45) ** 2] = 0.1
    spots = []
    while len(spots) < n:
        cx, cy = rng.uniform(0.15 * size, 0.85 * size, 2)
        if np.hypot(cx - size / 2, cy - size / 2) < size * 0.38 and all(np.hypot(cx - u, cy - v) > 18 for u, v in spots):
            spots.append((cx, cy))
            a -= 0.3 * np.exp(-(((x - cx) ** 2 + (y - cy) ** 2) / (2 * 2.2**2)) ** 2)
    return (np.clip(a, 0, 1) * 65535).astype(np.uint16), spots


def test_detection_finds_every_spot_and_tiling_does_not_matter(spark, tmp_path):
    a, spots = scene()
    np.save(tmp_path / "im.npy", a)
    geometry = spark.createDataFrame([("im", 256.0, 256.0, 230.0, 0.2)], "image_id string, cx double, cy double, radius double, mm_per_px double")
    results = []
    for tile, halo in ((512, 0), (128, 60)):
        found, densities = analyse(read_tiles(spark, [str(tmp_path / "im.npy")], tile, halo), geometry, background=21)
        rows = found.where("accepted").collect()
        d = densities.first()
        results.append((sorted((round(r.centroid_x_px, 1), round(r.centroid_y_px, 1)) for r in rows), d))
    for got, d in results:
        assert len(got) == len(spots) == d["count"]
        assert all(min(np.hypot(x - u, y - v) for u, v in got) < 1.5 for x, y in spots)
        assert d.full_px == d.edge_px + d.valid_px and d.invalid_px == 0 and d.density_cm2 == pytest.approx(d["count"] / d.area_cm2) and d.poisson_lower < d["count"] < d.poisson_upper
    assert results[0][1].valid_px == results[1][1].valid_px
    assert len(set(results[0][0]) & set(results[1][0])) >= len(spots) - 3


def test_pixel_features_have_no_seams():
    a = np.random.default_rng(0).random((90, 80))
    whole = image.pixel_features(a)
    h = image.HALO
    part = image.pixel_features(a[20 - h : 60 + h, 20 - h : 60 + h])[h:-h, h:-h]
    assert whole.shape[-1] == 17 and np.allclose(whole[20:60, 20:60], part)


def test_forest_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(i % 2, 0.6, 4)], i % 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, y int")
    model = [[tuple(n) for n in r.nodes] for r in forest.train(df, trees=6, per_class=300).orderBy("tree").collect()]
    p = forest.predict(model, np.array([r[1] for r in rows]))
    assert np.mean((p >= 0.5) == np.array([r[2] for r in rows])) > 0.9
    with pytest.raises(ValueError):
        forest.train(df.where(F.col("y") == 1))


def test_circle_fit_ignores_outliers():
    t = np.linspace(0, 2 * np.pi, 200)
    x, y = 50 + 30 * np.cos(t), 40 + 30 * np.sin(t)
    x[:6] += 15
    cx, cy, r, _ = image.fit_circle(y, x)
    assert abs(cx - 50) < 0.6 and abs(cy - 40) < 0.3 and abs(r - 30) < 0.4


def test_invalid_rectangles_and_a_pixel_model(spark, tmp_path):
    a, spots = scene(25, 256, 5)
    np.save(tmp_path / "im.npy", a)
    geometry = spark.createDataFrame([("im", 128.0, 128.0, 115.0, 0.2)], "image_id string, cx double, cy double, radius double, mm_per_px double")
    tiles = read_tiles(spark, [str(tmp_path / "im.npy")], 128, 40)
    invalid = spark.createDataFrame([("im", 0, 0, 128, 256), ("im", None, 0, 5, 5), ("other", 0, 0, 9, 9)], "image_id string, x0 int, y0 int, x1 int, y1 int")
    found, densities = analyse(tiles, geometry, background=21, invalid=invalid)
    assert found.where("accepted and centroid_x_px < 127").count() == 0 and found.where("accepted").count() >= 5
    d = densities.first()
    assert d.full_px == d.edge_px + d.invalid_px + d.valid_px and d.invalid_px > 10_000
    y, x = np.mgrid[:256, :256]
    near = np.min([np.hypot(x - u, y - v) for u, v in spots], axis=0)
    scaled = image.normalize(a, *np.percentile(a.astype("f4"), [1, 99]))  # the scale on which the analysis reads the image
    features = image.pixel_features(scaled).reshape(256 * 256, -1)
    inside = (np.hypot(x - 128, y - 128) < 105).ravel()
    rng = np.random.default_rng(0)
    pick = np.concatenate([rng.choice(np.flatnonzero(m.ravel() & inside), 400) for m in (near < 2.0, near > 6.0)])
    rows = [(i, features[p].tolist(), int(i < 400)) for i, p in enumerate(pick)]
    model = forest.train(spark.createDataFrame(rows, "id bigint, x array<double>, y int"), trees=8)
    trees = [[tuple(n) for n in r.nodes] for r in model.orderBy("tree").collect()]
    got = [(r.centroid_x_px, r.centroid_y_px) for r in analyse(tiles, geometry, background=21, trees=trees)[0].where("accepted").collect()]
    assert np.mean([min(np.hypot(u - p, v - q) for p, q in got) < 2 for u, v in spots]) > 0.9


def test_a_large_dark_blob_does_not_hide_faint_points(spark, tmp_path):
    y, x = np.mgrid[:256, :256]
    a = 0.7 + np.random.default_rng(4).normal(0, 0.002, (256, 256))
    a[np.hypot(x - 128, y - 128) > 120] = 0.1
    a[np.hypot(x - 90, y - 128) < 18] = 0.1
    spots = [(130 + 16 * i, 80 + 16 * j) for i in range(5) for j in range(6)]
    for u, v in spots:
        a -= 0.2 * np.exp(-(((x - u) ** 2 + (y - v) ** 2) / (2 * 2.2**2)) ** 2)
    np.save(tmp_path / "im.npy", (np.clip(a, 0, 1) * 65535).astype("u2"))
    geometry = spark.createDataFrame([("im", 128.0, 128.0, 118.0, 0.2)], "image_id string, cx double, cy double, radius double, mm_per_px double")
    found, _ = analyse(read_tiles(spark, [str(tmp_path / "im.npy")], 256, 0), geometry, background=61)
    got = [(r.centroid_x_px, r.centroid_y_px) for r in found.where("accepted").collect()]
    assert all(min([np.hypot(u - p, v - q) for p, q in got], default=99) < 1.5 for u, v in spots)


def test_one_grey_scale_per_image(spark, tmp_path):
    rng = np.random.default_rng(6)
    odd = rng.normal(-40, 900, (90, 70)).astype("f4")
    odd[5, 5:9] = np.nan, np.inf, -np.inf, -0.0
    rare = np.full((90, 70), 7, "u1")
    rare[0, :3] = 3, 9, 9
    images = {"f": odd, "u": rng.integers(0, 4096, (90, 70)).astype("u2"), "rare": rare, "flat": np.full((40, 40), 5, "i4"), "d": rng.normal(0, 1e-3, (50, 90)), "nan": np.full((9, 9), np.nan)}
    for name, a in images.items():
        np.save(tmp_path / f"{name}.npy", a)
    tiles = read_tiles(spark, [str(tmp_path / f"{n}.npy") for n in images], 32, 4)
    got = {r.image_id: (r.low, r.high) for r in windows(tiles).collect()}
    want = {n: tuple(np.percentile(images[n][np.isfinite(images[n])].astype("f4").astype(float), [1, 99])) for n in "fud"}
    assert got == {"rare": (3, 9), "flat": (5, 6)} | {n: pytest.approx(w, rel=1e-9) for n, w in want.items()}
    for r in windowed(tiles).collect():
        assert np.array_equal(grey(r), image.normalize(images[r.image_id], *got.get(r.image_id, (0, 1)))[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w])


def test_scale_type_and_photometric_do_not_change_the_points(spark, tmp_path):
    a, spots = scene(15, 256, 2)
    twelve = (a // 16).astype("u2")
    for name, px in (("bits", twelve), ("scaled", a.astype("f4") * 3 - 5e4)):
        np.save(tmp_path / f"{name}.npy", px)
    write_tiff(tmp_path / "white.tif", 4095 - twelve)
    raw = bytearray((tmp_path / "white.tif").read_bytes())
    tag = struct.pack("<HHI", 262, 3, 1)
    at = raw.index(tag) + len(tag)
    raw[at : at + 2] = b"\0\0"
    (tmp_path / "white.tif").write_bytes(bytes(raw))
    geometry = spark.createDataFrame([(n, 128.0, 128.0, 115.0, 0.2) for n in ("bits", "scaled", "white")], "image_id string, cx double, cy double, radius double, mm_per_px double")
    tiles = read_tiles(spark, [str(tmp_path / n) for n in ("bits.npy", "scaled.npy", "white.tif")], 128, 40)
    found = analyse(tiles, geometry, background=21)[0].where("accepted").collect()
    for name in ("bits", "scaled", "white"):
        got = [(r.centroid_x_px, r.centroid_y_px) for r in found if r.image_id == name]
        assert len(got) == len(spots) and all(min(np.hypot(u - p, v - q) for p, q in got) < 1.5 for u, v in spots)


def test_wide_dark_spots_are_candidates_and_the_halo_must_hold_the_background(spark, tmp_path):
    y, x = np.mgrid[:256, :256]
    a = 0.7 + np.random.default_rng(5).normal(0, 0.002, (256, 256))
    a[np.hypot(x - 128, y - 128) > 120] = 0.1
    a[np.hypot(x - 150, y - 120) < 28] = 0.3
    np.save(tmp_path / "im.npy", (np.clip(a, 0, 1) * 65535).astype("u2"))
    geometry = spark.createDataFrame([("im", 128.0, 128.0, 118.0, 0.2)], "image_id string, cx double, cy double, radius double, mm_per_px double")
    found = analyse(read_tiles(spark, [str(tmp_path / "im.npy")], 256, 0), geometry, Limits(max_area_px=2000, max_diameter_px=60.0))[0].collect()
    assert any(np.hypot(r.centroid_x_px - 150, r.centroid_y_px - 120) < 2 and r.area_px > 2300 and "too_large" in r.reasons for r in found)
    assert image.reach(101) == 105
    tiles = read_tiles(spark, [str(tmp_path / "im.npy")], 128, 104)
    with pytest.raises(Exception, match="beyond the halo"):
        analyse(tiles, geometry)[0].collect()
    with pytest.warns(UserWarning, match="greatest accepted diameter"):
        analyse(tiles, geometry, background=21)
