from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import mask_area as area
from spotlake.plans import areas

WAFER = "image_id string, width int, height int, cx double, cy double, radius double, scale double"
BOX = "image_id string, x0 int, y0 int, x1 int, y1 int"
WAFERS = [("a", 241, 241, 120.0, 120.0, 100.0, 0.25), ("b", 120, 90, 55.3, 41.7, 60.2, 0.5), ("n", 10, 10, None, 5.0, 3.0, 1.0)]
BOXES = [("a", 195, 95, 220, 145), ("a", 220, 145, 200, 120), ("a", 100, 118, 130, 123), ("a", 0, 0, 5, 5), ("a", 50, 60, 50, 90), ("b", 30, 20, 70, 60), ("b", 60, -9, 500, 30), ("b", None, 0, 1, 1), ("z", 0, 0, 9, 9)]


def mask(w):
    name, width, height, cx, cy, radius, scale = w
    y, x = np.mgrid[:height, :width]
    valid = np.hypot(x - cx, y - cy) <= radius
    for i, x0, y0, x1, y1 in BOXES:
        if i == name and x0 is not None:
            valid[max(0, min(y0, y1)) : max(0, max(y0, y1)), max(0, min(x0, x1)) : max(0, max(x0, x1))] = False
    y, x = np.nonzero(valid)
    return (x - cx) * scale, -(y - cy) * scale, x, y


@pytest.fixture(scope="module")
def runs(spark):
    return area.signed_runs(spark.createDataFrame(WAFERS, WAFER), spark.createDataFrame(BOXES, BOX)).cache()


def table(df, *keys):
    return {tuple(r[k] for k in keys): r.pixels for r in df.collect() if r.pixels}


def counts(name, values, bins):
    return {(name, int(k)): int(n) for k, n in enumerate(np.histogram(values, bins)[0]) if n}


def test_bins_equal_pixels(runs):
    rings, sectors, regions, cells, fields, whole = {}, {}, {}, {}, {}, {}
    ranges = [("core", 0.0, 0.35), ("rim", 0.8, 1.0), ("mid", 0.2, 0.81)]
    for w in WAFERS[:2]:
        name, reach, side = w[0], w[5] * w[6], 2 * w[5] * w[6] / 9
        x, y, px, py = mask(w)
        whole[name] = len(x)
        r = np.hypot(x, y)
        rings |= counts(name, r / reach, np.arange(6) / 5 + [0, 0, 0, 0, 0, 1e-9])
        sectors |= counts(name, np.degrees(np.arctan2(y, x)) % 360, np.arange(13) * 30)
        regions |= {(name, n): k for n, a, b in ranges if (k := int(((r / reach >= a) & ((r / reach < b) | (b == 1))).sum()))}
        clip = lambda v, n: np.clip(np.floor(v).astype(int), 0, n - 1)
        n = int(np.ceil(2 * reach / 7.0))
        half = w[6] / 2
        for out, kx, ky in ((cells, clip((x + reach) / side, 9), clip((y + reach) / side, 9)), (fields, clip((x + half + reach) / 7.0, n), clip((reach - y + half) / 7.0, n))):
            for at in zip(kx.tolist(), ky.tolist(), strict=True):
                out[name, *at] = out.get((name, *at), 0) + 1
    got = {r.image_id: (r.pixels, r.area_cm2) for r in area.valid_pixels(runs).collect()}
    assert {k: v[0] for k, v in got.items()} == whole and got["a"][1] == pytest.approx(whole["a"] * 0.025**2)
    assert table(area.ring_pixels(runs, 5), "image_id", "bin") == rings
    assert table(area.sector_pixels(runs, 12), "image_id", "bin") == sectors
    assert table(area.region_pixels(runs, ranges), "image_id", "region") == regions
    reach = F.col("radius") * F.col("scale")
    assert table(area.cell_pixels(runs, 2 * reach / 9, F.lit(9)), "image_id", "x_cell", "y_cell") == cells
    assert table(area.cell_pixels(runs, F.lit(7.0), F.ceil(2 * reach / 7.0), 0.5, True), "image_id", "x_cell", "y_cell") == fields
    with pytest.raises(ValueError):
        area.sector_pixels(runs, 5)


def test_densities_and_fields(spark, runs):
    bins = area.ring_pixels(runs, 5).where("image_id = 'a'").withColumn("scale", F.lit(0.25))
    counts_ = spark.createDataFrame([("a", 0, 0), ("a", 2, 40)], "image_id string, bin int, count bigint")
    rows = {r.bin: r for r in area.densities(bins, counts_, ["image_id", "bin"]).collect()}
    assert len(rows) == 5 and rows[2].density_cm2 == pytest.approx(40 / rows[2].valid_area_cm2) and rows[4].density_cm2 == 0
    assert rows[2].poisson_lower_cm2 < rows[2].density_cm2 < rows[2].poisson_upper_cm2 and rows[4].poisson_lower_cm2 == 0 < rows[4].poisson_upper_cm2
    cells = spark.createDataFrame([("r", 0, 1, 5), ("r", 1, 0, 7), ("r", 2, 2, 0)], "run_id string, x_cell int, y_cell int, pixels bigint")
    points = spark.createDataFrame([("r", 1, 0, True), ("r", 1, 0, False), ("r", 3, 3, None)], "run_id string, x_cell int, y_cell int, accepted boolean")
    got = {(r.x_cell, r.y_cell): (r.field, r.pixels, r.candidate_count, r.accepted_count, r.rejected_count) for r in area.fields(cells, points, ["run_id"]).collect()}
    assert got == {(1, 0): (1, 7, 2, 1, 1), (0, 1): (2, 5, 0, 0, 0), (3, 3): (3, 0, 1, 0, 1)}


def test_nothing(spark):
    none = area.signed_runs(spark.createDataFrame([], WAFER), spark.createDataFrame([], BOX))
    assert none.count() == 0 and area.ring_pixels(none, 3).count() == 0 and area.sector_pixels(none, 4).count() == 0


def above_rows(df):
    """The operators between the listing of pixel rows and the result; they are listed once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lists = [k for k, line in enumerate(plan) if "Generate" in line and ", [y#" in line]
    assert len(lists) == 1
    return [line.strip(" :+-").split()[0] for line in plan[: lists[0]]]


def test_rows_are_no_side_of_a_join(spark):
    runs = area.signed_runs(spark.createDataFrame(WAFERS, WAFER), spark.createDataFrame(BOXES, BOX))
    assert "Join" not in above_rows(runs)
    steps = above_rows(area.cell_pixels(runs, 2 * F.col("radius") * F.col("scale") / 9, F.lit(9)))
    assert "Join" not in steps and "Aggregate" in steps[steps.index("Generate") :]
    assert "Join" not in above_rows(area.region_pixels(runs, [("core", 0.0, 0.35), ("rim", 0.8, 1.0)]))
    assert "Join" not in above_rows(area.ring_pixels(runs, 5))
    assert "Join" not in above_rows(area.valid_pixels(runs))
    assert "Join" not in above_rows(area.sector_pixels(runs, 12))


def test_masks_repeated_in_a_small_file_are_not_broadcast(spark, folders, tmp_path):
    """Repeated masks shrink to a file that Spark would broadcast, whatever their rows take on the driver."""
    spark.read.parquet(f"{folders[1]}/run_catalog.parquet").write.parquet(f"{tmp_path}/run_catalog.parquet")
    masks = spark.read.parquet(f"{folders[1]}/mask_regions.parquet")
    masks.select("*", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("col").coalesce(1).write.parquet(f"{tmp_path}/mask_regions.parquet")
    out = areas.mask_valid_area(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, areas.mask_valid_area(spark, folders[1]).collect()))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_rectangles_of_many_ends(spark):
    """Overlapping, touching and repeated rectangles whose ends fall on and between strips."""
    rng = np.random.default_rng(5)
    xs, ys = np.sort(rng.integers(-20, 720, (60, 2))), np.sort(rng.integers(-20, 720, (60, 2)))
    boxes = [("a", *map(int, (x[0], y[0], x[1], y[1]))) for x, y in zip(xs, ys, strict=True) if y[1] - y[0] < 200 or x[1] - x[0] < 50]
    boxes += [("a", 10, 256, 40, 512), ("a", 40, 255, 60, 513), ("a", 40, 255, 60, 513), ("a", 300, 100, 300, 400), ("a", 90, 300, 95, 301)]
    y, x = np.mgrid[:700, :700]
    inside = np.hypot(x - 350.0, y - 349.5) <= 330
    valid = inside.copy()
    for _, x0, y0, x1, y1 in boxes:
        valid[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = False
    got = area.signed_runs(spark.createDataFrame([("a", 700, 700, 350.0, 349.5, 330.0, 0.1)], WAFER), spark.createDataFrame(boxes, BOX)).collect()
    covered = np.zeros((700, 700), int)
    for r in got:
        covered[r.y, r.a : r.b + 1] += r.sign
    assert (covered == valid).all() and 0 < valid.sum() < inside.sum()


def test_no_interval_is_computed_for_densities_alone(spark, folders):
    plan = lambda name: areas.QUERIES[name](spark, folders[1])._jdf.queryExecution().analyzed().toString()
    assert "bounds(__n" in plan("mask_ring_intervals")
    assert not [name for name in PLAIN if "bounds(__n" in plan(name)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same masks twice: far beyond their images, and cut to them."""
    out = []
    for far, near in ((2**31 - 1, -(2**31) + 1), (3000, 0)):
        d = tmp_path_factory.mktemp("areas")
        spark.createDataFrame([("r1", "a", 600, 600, 0.2), ("r2", "a", 600, 600, 0.2), ("r3", "b", 500, 400, 0.25)], "run_id string, image_id string, image_width_px int, image_height_px int, mm_per_pixel double").write.parquet(f"{d}/run_catalog.parquet")
        masks = [("a", 0, 250, 40, far), ("a", 200, near, 230, 310), ("a", 210, 300, far, 320), ("b", near, near, 100, far), ("b", 250, 190, 260, 210), ("none", 0, near, 5, far)]
        spark.createDataFrame(masks, "image_id string, x0_px int, y0_px int, x1_px int, y1_px int").write.parquet(f"{d}/mask_regions.parquet")
        points = [(r, f"d{k}", i, 37.0 * k % 600, 53.0 * k % 600, k % 3 > 0) for k in range(40) for r, i in (("r1", "a"), ("r2", "a"), ("r3", "b"))]
        spark.createDataFrame(points, "run_id string, defect_id string, image_id string, centroid_x_px double, centroid_y_px double, accepted boolean").write.parquet(f"{d}/candidates.parquet")
        out.append(str(d))
    return out


PLAIN = ["mask_region_density", "mask_grid_density", "mask_ring_density", "mask_sector_density"]
BEYOND = ["mask_fields", "mask_region_density", "mask_ring_intervals", "mask_valid_area", "mask_grid_density", "mask_ring_density", "mask_sector_density"]


@pytest.mark.parametrize("name", BEYOND)
def test_masks_beyond_their_image(spark, folders, name):
    far, cut = (sorted(tuple(r) for r in areas.QUERIES[name](spark, d).collect()) for d in folders)
    assert far == cut and len(far) >= 2


def test_grid_has_every_cell_and_every_accepted_candidate(spark, tmp_path):
    """Candidates in cells that are masked whole, on a wafer that is masked whole and beyond the disc; a run of no name; a run of two images."""
    catalog = [("r1", "a", 600, 600, 0.2), (None, "a", 600, 600, 0.2), ("r2", "b", 300, 200, 0.25), ("r3", "c", 100, 100, 0.5), ("r3", "a", 600, 600, 0.2), ("r4", "d", 1, 1, 0.5)]
    masks = [("a", 200, 200, 400, 420), ("b", -5, -5, 400, 400)]
    points = [("r1", 0, "a", 300.0, 300.0, True), ("r1", 1, "a", 310.0, 309.0, True), ("r1", 2, "a", 310.0, 309.0, False), ("r1", 3, "a", 25.0, 25.0, True), ("r1", 4, "a", 1.0, 300.0, True), ("r1", 5, "a", 150.0, 450.0, True), ("r2", 6, "b", 150.0, 100.0, True), ("r3", 7, "c", 50.0, 50.0, True)]
    given = {
        "run_catalog": (catalog, "run_id string, image_id string, image_width_px int, image_height_px int, mm_per_pixel double"), "mask_regions": (masks, "image_id string, x0_px int, y0_px int, x1_px int, y1_px int"),
        "candidates": (points, "run_id string, defect_id bigint, image_id string, centroid_x_px double, centroid_y_px double, accepted boolean"),
    }
    sql = pytest.importorskip("duckdb").connect()
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = areas.mask_grid_density(spark, str(tmp_path)).collect()
    assert Counter(r.run_id for r in got) == {"r1": 1600, None: 1600, "r2": 1600, "r3": 3200, "r4": 1600}
    own = {(r.x_cell, r.y_cell): r for r in got if r.run_id == "r1"}
    assert len(own) == 1600 and sum(r["count"] for r in own.values()) == 4  # the one at x = 1 lies beyond the grid
    y, x = np.mgrid[:600, :600]
    valid = np.hypot(x - 300.0, y - 300.0) <= 600 / 2.16
    valid[200:420, 200:400] = False
    assert sum(r.pixels for r in own.values()) == valid.sum()
    hidden = [r for r in own.values() if r["count"] and not r.pixels]
    assert sorted((r.x_cell, r.y_cell, r["count"]) for r in hidden) == [(0, 39, 1), (20, 19, 1), (20, 20, 1)] and all(r.density_cm2 is None and r.valid_fraction == 0 for r in hidden)
    assert [(r["count"], r.pixels) for r in got if r.run_id == "r2" and r["count"]] == [(1, 0)] and not sum(r.pixels for r in got if r.run_id in ("r2", "r4"))
    assert {r.density_cm2 for r in own.values() if r.pixels and not r["count"]} == {0.0}
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r[1:]) + (str(r[0]),))
    assert order(got) == order(sql.sql(areas.SQL["mask_grid_density"]).fetchall())
