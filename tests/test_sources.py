import json

import numpy as np
import pytest

from spotlake.operators.raw_load import ANNOTATION_COLUMNS, REFERENCE_COLUMNS
from spotlake.sources.tiles import read_tiles
from spotlake.sources.tables import eligible, read_annotations, read_references, read_run_summaries, write_candidates, write_summary
from spotlake.streaming.windows import last_verdicts, new_files, sessions, tumbling

SHA = "a" * 64


def _csv(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *rows]) + "\n")
    return str(path)


def test_annotations_are_typed_or_refused(spark, tmp_path):
    good = _csv(tmp_path / "one.csv", ANNOTATION_COLUMNS, ["i,w,c,1,2,,,Scratch,rv,0.5,\"a, b\",s,1.0", "i,w,,,,3,4,uncertain,rv,,,s,1.0"])
    rows = read_annotations(spark, [good]).collect()
    assert [(r.x_px, r.x_mm, r.label, r.source_file) for r in rows] == [(1.0, None, "scratch", "one.csv"), (None, 3.0, "uncertain", "one.csv")]
    bad = _csv(tmp_path / "bad.csv", ANNOTATION_COLUMNS, ["i,w,c,1,,,,point,rv,,,s,2.0"])
    with pytest.raises(ValueError, match="label: point.*version: 2.0.*coordinates: c"):
        read_annotations(spark, bad)
    with pytest.raises(ValueError, match="missing columns"):
        read_annotations(spark, _csv(tmp_path / "short.csv", ANNOTATION_COLUMNS[:4], ["i,w,c,1"]))


def test_references_are_checked(spark, tmp_path):
    line = lambda i, label="confirmed_point", status="registered", method="dic", sha=SHA: f"{i},1,2,{label},{method},{status},0.5,{sha},{SHA},,1.0"
    good = read_references(spark, _csv(tmp_path / "r.csv", REFERENCE_COLUMNS, [line("a"), line("b", "uncertain"), line("c", status="not_registered")]))
    assert [r.reference_id for r in eligible(good).collect()] == ["a"]
    for rows, what in (([line("a", sha="zz")], "hash: a"), ([line("a"), line("a")], "repeated"), ([line("a"), line("b", method="koh")], "one method")):
        with pytest.raises(ValueError, match=what):
            read_references(spark, _csv(tmp_path / "x.csv", REFERENCE_COLUMNS, rows))


def test_run_folders_keep_corrupt_ones(spark, tmp_path):
    for name, text in (("r1", json.dumps({"status": "completed", "generated_at_utc": "2026-01-02T00:00:00Z", "warnings": ["w"]})), ("r2", json.dumps({"status": "failed", "generated_at_utc": "2026-01-03T00:00:00Z"})), ("r3", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(text)
    rows = read_run_summaries(spark, str(tmp_path)).collect()
    assert [r.run_id for r in rows] == ["r2", "r1", "r3"] and rows[2].corrupt is not None and rows[0].accepted_count is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, [1, 2, 3, 4], float("nan")), (2, False, None, 1.0)], "defect_id int, accepted boolean, bounding_box array<int>, v double")
    write_candidates(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/candidates")).where("accepted = 'true'").count() == 1
    text = spark.read.option("header", True).csv(str(tmp_path / "c/all_candidates_csv")).orderBy("defect_id").collect()
    assert text[0].bounding_box == "[1,2,3,4]"
    write_summary(df.selectExpr("struct(defect_id as id, struct(v) as n) as run", "bounding_box"), str(tmp_path / "s"))
    flat = spark.read.option("header", True).csv(str(tmp_path / "s/summary_csv"))
    assert flat.columns == ["run.id", "run.n.v", "bounding_box"] and flat.where("`run.n.v` is null").count() == 1


def test_stream_of_verdicts_keeps_the_last(spark, tmp_path):
    schema = "run_id string, defect_id string, reviewer_id string, updated_at_utc string, label string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r.defect_id] = (r.updated_at_utc, r.label)

    for rows in ([("r", "1", "a", "2026-01-02", "x"), ("r", "1", "a", "2026-01-01", "old"), ("r", "2", "a", None, None)], [("r", "1", "a", "2026-01-01", "late"), ("r", "2", "a", "2026-01-05", "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = last_verdicts(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"1": ("2026-01-02", "x"), "2": ("2026-01-05", "y")}


def test_new_files_count_once(spark, tmp_path):
    src, into, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for n in (5, 3, 0):
        if n:
            spark.range(n).coalesce(1).write.mode("append").parquet(src)
        new_files(spark, src, "id bigint", into, mark, lambda df: df.selectExpr("id * 2 as id")).awaitTermination()
    assert spark.read.parquet(into).count() == 8


def test_stream_windows_equal_the_batch(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    rows = spark.range(200).selectExpr("id as event_id", "timestamp_seconds(1767225600 + id * 97 % 20000) as ts", "id % 3 as user_id", "cast(id % 2 as string) as event_type", "cast(id as double) as value")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    for f, name in ((tumbling, "t"), (sessions, "s")):
        stream = f(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), late="1 day")
        stream.writeStream.format("memory").queryName(f"w_{name}").outputMode("complete" if name == "t" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.table("w_t").collect())) == sorted(map(str, tumbling(rows).collect()))


def test_images_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        np.save(tmp_path / folder / "x.npy", np.full((4, 4), ord(folder), "u1"))
    np.save(tmp_path / "y.npy", np.zeros((4, 4), "u1"))
    rows = read_tiles(spark, [str(tmp_path / p) for p in ("a/x.npy", "b/x.npy", "y.npy")], 8, 0).collect()
    assert {r.image_id: r.px[0] for r in rows} == {str(tmp_path / "a/x"): ord("a"), str(tmp_path / "b/x"): ord("b"), "y": 0}
