import pytest

from spotlake.operators.config import merged, odd_pixels, pixels, resolved, reviewed_density, split_faults, sweep


def test_settings():
    base = {"a": {"x": 1, "l": [1, 2]}, "b": 1}
    assert merged(base, {"a": {"l": [3]}}, {"b": {"c": 2}}) == {"a": {"x": 1, "l": [3]}, "b": {"c": 2}} and base["a"]["l"] == [1, 2]
    assert [pixels(v, 10.0) for v in (0.0, 25.0, 35.0, 36.0)] == [1, 2, 4, 4] and odd_pixels(35.0, 10.0) == 5
    out, warnings = resolved({"kernel_um": 35.0, "kernel_px": 9, "area_um2": 200.0, "min_edge_distance_um": 500.0, "k": 2}, 10.0, odd=("kernel_um",))
    assert out["kernel_px"] == 5 and out["area_px"] == 2.0 and out["min_edge_distance_mm"] == 0.5 and warnings == ["kernel_um replaces kernel_px"]
    assert [round(v, 3) for _, v, _ in sweep({"o": 0.0, "t": 10.0}, ("o", "t"))] == [-0.02, -0.01, 0.0, 0.01, 0.02, 8.0, 9.0, 10.0, 11.0, 12.0]
    with pytest.raises(ValueError):
        pixels(1.0, 0.0)


def test_reviews_change_densities(spark):
    rows = [("r", "true", None), ("r", "false", "accept"), ("r", "true", "no"), ("q", "yes", None)]
    areas = spark.createDataFrame([("r", 2.0), ("q", None), ("e", 1.0)], "run_id string, area_cm2 double")
    got = {r.run_id: r for r in reviewed_density(spark.createDataFrame(rows, "run_id string, accepted string, reviewed_accepted string"), areas).collect()}
    assert (got["r"]["count"], got["r"].density_cm2) == (2, 1.0) and got["q"].density_cm2 is None and got["e"].poisson_upper == pytest.approx(3.688879454)


def test_split_faults(spark):
    wafers = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "wafer string")
    splits = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("z", "x"), (None, "x")], "wafer string, split string")
    assert {tuple(r) for r in split_faults(wafers, splits).collect()} == {("c", "not_assigned"), ("z", "unknown"), ("a", "several_splits")}
