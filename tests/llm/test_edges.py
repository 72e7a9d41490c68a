"""Queries of the problems on tables without rows, and on tables with nulls, repeated rows and further columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from spotlake.llm.registry import queries

PASSAGE = " ".join(f"word{i}" for i in range(90))
SCHEMAS = {
    "documents": "doc_id bigint, text string, source string",
    "eval_items": "item_id bigint, suite string, held_split string, text string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "split_targets": "split string, target_share double",
    "training_labels": "run_id string, defect_id string, wafer_id string, label string, split string, reviewer_id string, updated_at_utc string, received_at timestamp_ntz",
    "pixel_samples": "sample_id bigint, image_sha256 string, wafer_id string, split string, roi_xywh array<int>",
    "candidates": "run_id string, defect_id bigint, wafer_id string, measured_at timestamp_ntz, x_mm double, y_mm double, equivalent_diameter_um double, area_mm2 double, radial_distance_mm double",
}
ROWS = {
    "documents": [(1, f"a {PASSAGE} b", "x"), (2, f"other {PASSAGE}", "x"), (3, "", "x"), (4, None, None), (5, "z" * 300_000, "y"), (6, "alone", None)],
    "eval_items": [(1, "s", "test", " ".join(PASSAGE.split()[5:30])), (2, "s", None, None), (3, None, "test", "")],
    "mix_targets": [("x", 0.5, 2), ("y", 0.5, 1), (None, 0.1, 1), ("none", None, None)],
    "split_targets": [("calibration", 0.7), ("validation", 0.3), (None, 0.1), ("locked_test", None)],
    "training_labels": [("r", str(i % 4), f"W{i % 3}", random.Random(i).choice(["target", "artifact"]), ["train", "validation"][i % 3 == 2], f"p{i // 4}", "2026-01-01T00:00:00Z", None) for i in range(16)] + [(None,) * 8, ("r", "9", None, None, None, "p1", None, None)],
    "pixel_samples": [(1, "sha256:aa", "W1", "calibration", [0, 0, 50, 50]), (2, "AA", "W9", "validation", [1, 0, 50, 50]), (3, None, None, None, None), (4, "bb", None, "validation", [0, 0, 0, 5]), (5, "aa", "w-1", "locked_test", [None, 0, 5, 5])],
    "candidates": [("r", i, "w" if i % 2 else None, None, float(i), 1.0, float(i), float("nan"), None) for i in range(9)] + [(None,) * 9],
}
CLASH = ["group", "key", "n", "a", "b", "x", "y", "id", "item", "size", "gram", "place", "__b", "__k0", "component", "weight", "vertex", "value", "part", "image", "before"]
NAMES = ["p1_found", "p1_reviewers", "p2_found", "p2_assignment", "p3_percentiles", "p6_found", "p7_found", "p8_shares", "p9_found"]


def folder(spark, path, change):
    for name, schema in SCHEMAS.items():
        change(name, spark.createDataFrame(ROWS[name], schema).coalesce(1)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("plain"), lambda _, df: df)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Further columns in every table, and repeated rows where rows can repeat."""

    def change(name, df):
        more = df.withColumns({c: F.lit("z") for c in CLASH if c not in df.columns})
        return more.union(more).coalesce(1) if name in ("training_labels", "pixel_samples", "candidates") else more

    return folder(spark, tmp_path_factory.mktemp("wide"), change)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), lambda _, df: df.limit(0))


@pytest.mark.parametrize("name", NAMES)
def test_further_columns_change_nothing(spark, plain, wide, name):
    query = lambda s, d: queries()[name](s, d).drop("rows") if name == "p2_assignment" else queries()[name](s, d)  # repeated rows count there
    assert sorted(map(repr, query(spark, plain).collect())) == sorted(map(repr, query(spark, wide).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


def test_what_is_found(spark, plain):
    rows = lambda name: {tuple(r) for r in queries()[name](spark, plain).collect()}
    assert rows("p6_found") == {(1, 2)} and rows("p7_found") == {(1, 1), (1, 2)} and rows("p9_found") == {(1,), (2,)}
