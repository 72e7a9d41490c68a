"""Typed readers and writers of the tables around a measurement: CSV, JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators.raw_load import ANNOTATION_COLUMNS, ANNOTATION_LABELS, REFERENCE_COLUMNS, REFERENCE_LABELS

VERSION = "1.0"


def read_text_table(spark: SparkSession, paths: list[str] | str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV table with a heading, all columns as text, with the file each row came from; missing columns raise."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    missing = [c for c in columns if c not in [n.lstrip("﻿") for n in raw.columns]]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    rows = raw.toDF(*[n.lstrip("﻿") for n in raw.columns])
    return rows.select(*columns, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file")).to(spark.createDataFrame([], schema + ", source_file string").schema)


def _refuse(df: DataFrame, tests: dict[str, object]) -> None:
    """Raise with up to ten offending values per test; one pass over the rows."""
    found = df.agg(*[F.slice(F.collect_set(F.when(bad, value)), 1, 10).alias(name) for name, (bad, value) in tests.items()]).first()
    wrong = {k: v for k, v in found.asDict().items() if v}
    if wrong:
        raise ValueError("; ".join(f"{k}: {', '.join(map(str, v))}" for k, v in wrong.items()))


def read_annotations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Expert annotations of several files: known labels, version 1.0 and at least one whole coordinate pair per row."""
    rows = read_text_table(spark, paths, ANNOTATION_COLUMNS)
    rows = rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("x_px", "y_px", "x_mm", "y_mm")}).withColumn("label", F.lower(F.trim("label")))
    pair = lambda u: F.col(f"x_{u}").isNotNull() & F.col(f"y_{u}").isNotNull()
    _refuse(rows, {
        "label": (~F.coalesce(F.col("label").isin(*ANNOTATION_LABELS), F.lit(False)), F.coalesce("label", F.lit("(none)"))),
        "version": (F.coalesce(F.trim("annotation_schema_version"), F.lit("")) != VERSION, F.coalesce("annotation_schema_version", F.lit("(none)"))),
        "coordinates": (~(pair("px") | pair("mm")), F.coalesce("candidate_id", F.lit("(no id)"))),
        "reviewer": (F.coalesce(F.trim("reviewer_id"), F.lit("")) == "", F.coalesce("candidate_id", F.lit("(no id)"))),
    })
    return rows


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Registered reference points of one file: known enums, unique ids, one method, hashes of 64 hex digits."""
    rows = read_text_table(spark, path, REFERENCE_COLUMNS)
    rows = rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("x_px", "y_px", "registration_rmse_um")})
    rows = rows.withColumns({c: F.lower(F.trim(c)) for c in ("label", "reference_method", "registration_status", "source_image_sha256", "reference_image_sha256")})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    name = F.coalesce("reference_id", F.lit("(no id)"))
    _refuse(rows, {
        "label": (no(F.col("label").isin(*REFERENCE_LABELS)), name),
        "status": (no(F.col("registration_status").isin("registered", "not_registered")), name),
        "method": (no(F.col("reference_method").isin("dic", "koh", "expert_annotation")), name),
        "hash": (no(F.col("source_image_sha256").rlike("^[0-9a-f]{64}$")), name),
        "coordinates": (no((F.col("x_px") >= 0) & (F.col("y_px") >= 0)), name),
        "rmse": (F.col("registration_rmse_um") < 0, name),
    })
    twice = rows.groupBy("reference_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("repeated reference_id: " + ", ".join(str(r.reference_id) for r in twice))
    if rows.select("reference_method").distinct().limit(2).count() > 1:
        raise ValueError("one method per file")
    return rows


# The columns of the table of training labels, its labels and its splits.
LABEL_COLUMNS = (
    "annotation_schema_version", "run_id", "defect_id", "input_file_name", "wafer_id", "label", "split", "reviewer_id", "notes", "updated_at_utc",
    "defects_csv_sha256", "x_mm", "y_mm", "accepted_at_annotation_time", "rejection_reason_at_annotation_time", "area_mm2", "equivalent_diameter_um",
    "major_axis_length_um", "minor_axis_length_um", "aspect_ratio", "eccentricity", "circularity", "solidity", "contrast", "mean_dark_response",
)
LABEL_VALUES, SPLITS = ("target", "artifact", "uncertain"), ("calibration", "validation", "locked_test")


def read_training_labels(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Training labels: all columns are needed; places and features as doubles; unknown labels or splits and blank keys raise."""
    rows = read_text_table(spark, paths, LABEL_COLUMNS)
    numbers = ("x_mm", "y_mm", *LABEL_COLUMNS[LABEL_COLUMNS.index("area_mm2") :])
    rows = rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in numbers}).withColumns({c: F.lower(F.trim(c)) for c in ("label", "split")})
    name = F.concat_ws("/", "run_id", "defect_id")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    _refuse(rows, {
        "label": (~F.coalesce(F.col("label").isin(*LABEL_VALUES), F.lit(False)), name),
        "split": (~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), name),
        "key": (blank("run_id") | blank("defect_id") | blank("reviewer_id"), name),
    })
    return rows


def read_result_folders(spark: SparkSession, folder: str, numbers: tuple[str, ...] = ("centroid_x_px", "centroid_y_px", "x_mm", "y_mm")) -> dict[str, DataFrame]:
    """Tables ``accepted``, ``areas`` (wafer_id, area_cm2) and ``scales`` (image_id, mm_per_pixel) of all run folders below ``folder``.

    Every folder needs ``summary.json`` and ``defects_accepted.csv``. The accepted rows of all folders are united, with the image and
    wafer of their folder's summary (the folder's name where it states none) and ``numbers`` as doubles; their files must have the same heading.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/*/{{summary.json,defects_accepted.csv}}").select(F.split("path", "/").alias("p"))
    held = files.groupBy(F.element_at("p", -2).alias("run")).agg(F.countDistinct(F.element_at("p", -1)).alias("n")).where("n < 2").limit(10).collect()
    if held:
        raise ValueError("summary.json or defects_accepted.csv is missing: " + ", ".join(sorted(r.run for r in held)))
    schema = "input_file_name string, wafer_id string, valid_analysis_area_cm2 double, mm_per_pixel double"
    own = lambda: F.element_at(F.split(F.input_file_name(), "/"), -2)
    runs = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/summary.json").withColumn("run_id", own())
    runs = runs.withColumns({"image_id": F.coalesce("input_file_name", "run_id"), "wafer_id": F.coalesce("wafer_id", "run_id")})
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(f"{folder}/*/defects_accepted.csv")
    missing = [c for c in ("defect_id", *numbers) if c not in rows.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    rows = rows.drop("image_id", "wafer_id", "run_id", "accepted").withColumns({c: F.expr(f"try_cast({c} as double)") for c in numbers}).withColumn("run_id", own())
    accepted = rows.join(runs.select("run_id", "image_id", "wafer_id"), "run_id").withColumn("accepted", F.lit(True))
    return {
        "accepted": accepted,
        "areas": runs.groupBy("wafer_id").agg(F.max("valid_analysis_area_cm2").alias("area_cm2")),
        "scales": runs.groupBy("image_id").agg(F.max("mm_per_pixel").alias("mm_per_pixel")),
    }


def append_operation(operations: DataFrame, path: str) -> None:
    """Append rows to the history of operations; rows that stand there are never rewritten."""
    operations.write.mode("append").parquet(path)


def eligible(references: DataFrame) -> DataFrame:
    return references.where("label = 'confirmed_point' and registration_status = 'registered'")


def read_run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """``summary.json`` of every run folder, newest first; unreadable ones stay as rows with the text in ``corrupt``."""
    schema = (
        "status string, input_file_name string, input_path string, generated_at_utc string, accepted_count bigint, valid_analysis_area_cm2 double, "
        "point_density_cm2 double, real_annotation_validation_status string, warnings array<string>, corrupt string"
    )
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(f"{folder}/*/summary.json")
    parts = F.split(F.input_file_name(), "/")
    return rows.withColumn("run_id", F.element_at(parts, -2)).orderBy(F.desc_nulls_last("generated_at_utc"), "run_id")


def write_candidates(df: DataFrame, folder: str) -> None:
    """All candidates as Parquet split by acceptance, and as CSV with reasons joined by semicolons and boxes as JSON text."""
    df.write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/candidates")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    as_text = {c: F.array_join(c, ";") if k == "array<string>" else F.to_json(c) for c, k in kinds.items() if k.startswith("array<")}
    df.withColumns(as_text).write.mode("overwrite").option("header", True).csv(f"{folder}/all_candidates_csv")


def flat(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; arrays and maps as JSON text; NaN and infinities as null."""
    def walk(schema, prefix: str) -> list:
        out = []
        for f in schema.fields:
            path = ".".join(f"`{p}`" for p in [*prefix.split("."), f.name] if p)
            kind, name = f.dataType.typeName(), f"{prefix}.{f.name}".lstrip(".")
            if kind == "struct":
                out += walk(f.dataType, name)
            elif kind in ("array", "map"):
                out.append(F.to_json(F.col(path)).alias(name))
            elif kind in ("double", "float"):
                out.append(F.when(~F.isnan(path) & (F.abs(F.col(path)) < float("inf")), F.col(path)).alias(name))
            else:
                out.append(F.col(path).alias(name))
        return out

    return df.select(*walk(df.schema, ""))


def write_summary(df: DataFrame, folder: str) -> None:
    """Summaries as JSON lines and as flat CSV rows."""
    df.write.mode("overwrite").json(f"{folder}/summary_json")
    flat(df).write.mode("overwrite").option("header", True).csv(f"{folder}/summary_csv")


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Each named table below ``folder``; Spark's commit protocol publishes a table only when it is whole."""
    for name, df in tables.items():
        flat(df).write.mode("overwrite").format(fmt).option("header", True).save(f"{folder}/{name}")
