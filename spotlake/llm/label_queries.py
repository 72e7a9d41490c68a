"""Queries of problems 1 (consensus labels), 2 (splits that keep related records together) and 6 (cross-split overlaps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions.names import image_key, instant, split_name, wafer_key, word
from spotlake.llm.consensus import chance_corrected, consensus
from spotlake.llm.overlap import cross_split_overlaps
from spotlake.llm.splits import assign, components
from spotlake.operators.scale import stored, table

ITEM = ["run_id", "defect_id"]


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The latest verdict of each reviewer on each candidate; 'uncertain' ones and blank labels or reviewers left out.

    Equal times fall to the later arrival, then to the label last in the alphabet.
    """
    rows = table(spark, d, "training_labels").select(
        *ITEM, word("reviewer_id").alias("annotator"), word("label").alias("label"), instant("updated_at_utc").alias("at"), "received_at"
    )
    last = rows.where("annotator is not null").groupBy(*ITEM, "annotator").agg(F.max_by("label", F.struct("at", "received_at", "label")).alias("label"))
    return last.where("label is not null and label <> 'uncertain'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items, _, _ = consensus(stored(verdicts(spark, d)), ITEM)
    return items.where("votes >= 3").select(*ITEM, "label")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with a verdict: label, confidence, votes and the share of them that agree."""
    return consensus(stored(verdicts(spark, d)), ITEM)[0]


def p1_reviewers(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every reviewer per consensus label, with the items behind it."""
    return consensus(stored(verdicts(spark, d)), ITEM)[1].withColumnsRenamed({"annotator": "reviewer_id"})


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = chance_corrected(verdicts(spark, d), ITEM)
    return rows.select("units", "ratings", *[F.round(c, 8).alias(c) for c in ("observed", "expected", "alpha")])


def grouped_rows(spark: SparkSession, d: str) -> DataFrame:
    """(key, image, split) of the rows of pixel_samples and training_labels with a usable split and a key."""
    samples = table(spark, d, "pixel_samples").select(wafer_key().alias("wafer"), image_key().alias("image"), split_name().alias("split"))
    labels = table(spark, d, "training_labels").select(wafer_key().alias("wafer"), F.lit(None).cast("string").alias("image"), split_name().alias("split"))
    rows = samples.unionByName(labels).select(F.coalesce("wafer", "image").alias("key"), "image", "split")
    return rows.where("key is not null")


def _linked(rows: DataFrame) -> DataFrame:
    """(key, component): keys and image keys are vertices, told apart by a prefix."""
    edges = rows.select(F.concat(F.lit("k:"), "key").alias("a"), F.coalesce(F.concat(F.lit("i:"), "image"), F.concat(F.lit("k:"), "key")).alias("b"))
    found = components(edges.distinct()).where("vertex like 'k:%'")
    return found.select(F.substr("vertex", F.lit(3)).alias("key"), "component")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_rows(spark, d).where("split is not null").distinct()
    linked = stored(_linked(rows))
    torn = rows.select("key", "split").distinct().join(linked, "key").groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return linked.join(torn.where("a <> b").select("component"), "component", "left_semi").select(F.col("key").alias("group_key"))


def p2_assignment(spark: SparkSession, d: str) -> DataFrame:
    """A split for every key, so that linked keys share one and the rows follow split_targets; all rows count."""
    rows = grouped_rows(spark, d)
    linked = stored(_linked(rows.select("key", "image").distinct()))
    weights = rows.groupBy("key").agg(F.count("*").alias("rows"))
    sized = linked.join(weights, "key")
    groups = sized.groupBy("component").agg(F.sum("rows").alias("weight"))
    targets = [(r.split, r.target_share) for r in table(spark, d, "split_targets").collect()]
    chosen = assign(groups, targets).select("component", "split")
    return sized.join(chosen, "component").select(F.col("key").alias("group_key"), "component", "split", "rows")


def p2_assignment_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the assignment: every key and row once, no component and no image in two splits, rows near their shares.

    ``off`` is the greatest distance of a reached from a target share, beyond what the heaviest component forces.
    """
    made = stored(p2_assignment(spark, d))
    rows = grouped_rows(spark, d).join(made.select(F.col("group_key").alias("key"), F.col("split").alias("to")), "key")
    torn = lambda df, key, split: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("n")).agg(F.count_if(F.col("n") > 1))
    one = made.agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"))
    out = one.join(torn(made, "component", "split").toDF("torn_components"), F.lit(True)).join(torn(rows, "image", "to").toDF("torn_images"), F.lit(True))
    heaviest = made.groupBy("component").agg(F.sum("rows").alias("w")).agg(F.max("w").alias("w"))
    shares = p2_shares(spark, d).join(heaviest, F.lit(True)).agg(F.max(F.abs(F.col("reached_share") - F.col("target_share"))).alias("off"), F.max("w").alias("w"))
    return out.join(shares, F.lit(True)).select("keys", "rows", "torn_components", "torn_images", (F.col("off") <= F.col("w") / F.col("rows")).alias("within"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of rows per split."""
    reached = p2_assignment(spark, d).groupBy("split").agg(F.sum("rows").alias("rows"), F.count("*").alias("keys"))
    targets = table(spark, d, "split_targets").withColumnRenamed("split", "name")
    joined = targets.join(reached, F.col("name") == F.col("split"), "left")
    total = reached.agg(F.sum("rows").alias("total"))
    return joined.join(total, F.lit(True)).select(
        F.col("name").alias("split"), "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("keys", F.lit(0)).alias("keys"),
        F.coalesce(F.col("rows") / F.col("total"), F.lit(0.0)).alias("reached_share"),
    )


def _regions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pixel_samples").where("size(roi_xywh) = 4")
    part = dict(zip("xywh", [F.col("roi_xywh")[i].cast("bigint") for i in range(4)], strict=True))
    return rows.select("sample_id", wafer_key().alias("wafer"), image_key().alias("image"), split_name().alias("split"), *[c.alias(n) for n, c in part.items()])


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(_regions(spark, d))
    return rows, cross_split_overlaps(rows)


def _members(rows: DataFrame, side: str, split: str, suffix: str) -> DataFrame:
    own = ["image", "split", "x", "y", "w", "h"]
    names = {"image": "image", "split": split, **{c: f"{c}{suffix}" for c in "xywh"}}
    return rows.select(F.col("sample_id").alias(side), *[F.col(c).alias(names[c]) for c in own])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows, pairs = _overlaps(spark, d)
    box = lambda s: ["image", {"a": "train_split", "b": "held_split"}[s], *[f"{c}{s}" for c in "xywh"]]
    both = pairs.join(_members(rows, "one", "train_split", "a"), box("a")).join(_members(rows, "two", "held_split", "b"), box("b"))
    return both.select(F.least("one", "two").alias("sample_id_a"), F.greatest("one", "two").alias("sample_id_b")).distinct()


def _touched(spark: SparkSession, d: str) -> DataFrame:
    """The held-out samples, and whether a training sample overlaps them."""
    rows, pairs = _overlaps(spark, d)
    hit = pairs.select("image", F.col("held_split").alias("split"), *[F.col(f"{c}b").alias(c) for c in "xywh"], "iou")
    best = hit.groupBy("image", "split", *"xywh").agg(F.max("iou").alias("iou"))
    held = rows.where("split in ('validation', 'locked_test')").distinct()
    return held.join(best, ["image", "split", *"xywh"], "left")


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("sample_id").alias("samples"),
        F.countDistinct(F.when(F.col("iou").isNotNull(), F.col("sample_id"))).alias("leaked"),
        F.countDistinct(F.when(F.col("iou") == 1, F.col("sample_id"))).alias("leaked_exactly"),
    )


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of overlapping classes of equal regions: boxes, exact ratio, and the share of the smaller one that shared chunks show."""
    return _overlaps(spark, d)[1]


def p6_by_split(spark: SparkSession, d: str) -> DataFrame:
    return _counted(_touched(spark, d).groupBy("split"))


def p6_by_wafer(spark: SparkSession, d: str) -> DataFrame:
    return _counted(_touched(spark, d).groupBy("wafer"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_consensus, p1_reviewers, p1_agreement, p2_found, p2_assignment, p2_assignment_checked, p2_shares, p6_found, p6_overlaps, p6_by_split, p6_by_wafer,
    )
}
