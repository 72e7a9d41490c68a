"""Reviews of several experts: last verdicts, agreement, arbitration, consensus and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.operators.scale import stored

# What the labels of the experts mean.
POSITIVE = ("confirmed_point",)
NEGATIVE = ("detector_artifact", "large_dark_region", "line_fragment", "particle_or_dust", "scratch")
INDETERMINATE = ("possible_point", "uncertain")


def clear_class(label: Column) -> Column:
    """1 for a point, 0 for an artefact, null for labels that leave it open."""
    return F.when(label.isin(*POSITIVE), 1).when(label.isin(*NEGATIVE), 0)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (a total order); null keys count as equal. Partial sums run before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *[F.col("__r").getField(c).alias(c) for c in rest]).select(*df.columns)


def with_snapshot(verdicts: DataFrame, candidates: DataFrame, runs: DataFrame, features: list[str]) -> DataFrame:
    """Verdicts (run_id, defect_id, label, split, reviewer_id, notes, updated_at_utc) with what their candidate was when they were given.

    Adds the run's ``input_file_name`` and ``wafer_id`` (its id where it has none), ``candidates_digest`` (of all rows of the run's
    candidates in any order, by partial sums), ``x_mm``, ``y_mm``, ``accepted_at_annotation_time``,
    ``rejection_reason_at_annotation_time`` and the features, NaN as null. A verdict on a candidate that is not there raises.
    Repeated candidate rows count once; of several runs of one id the least values are taken.
    """
    kinds = {f.name: f.dataType.typeName() for f in candidates.schema.fields}
    number = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    rows = candidates.distinct()
    row = F.xxhash64(*[F.col(c) for c in sorted(candidates.columns)])
    own = rows.groupBy("run_id").agg(F.concat_ws(":", F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).alias("text"))
    digests = own.select("run_id", F.sha2("text", 256).alias("candidates_digest"))
    seen = rows.select(
        "run_id", F.trim(F.col("defect_id").cast("string")).alias("defect_id"), *[number(c).alias(c) for c in ("x_mm", "y_mm")],
        F.coalesce(F.col("accepted").cast("string"), F.lit("")).alias("accepted_at_annotation_time"),
        F.coalesce("rejection_reason", F.lit("")).alias("rejection_reason_at_annotation_time"), *[number(c).alias(c) for c in features], F.lit(True).alias("__there"),
    )
    seen = seen.groupBy("run_id", "defect_id").agg(F.min(F.struct(*[c for c in seen.columns if c not in ("run_id", "defect_id")])).alias("s")).select("run_id", "defect_id", "s.*")
    named = runs.groupBy("run_id").agg(F.min("input_file_name").alias("input_file_name"), F.min("wafer_id").alias("wafer_id"))
    given = verdicts.withColumns({"defect_id": F.trim(F.col("defect_id").cast("string")), "label": F.lower(F.trim("label")), "split": F.lower(F.trim("split")), "reviewer_id": F.trim("reviewer_id")})
    out = stored(given.join(seen, ["run_id", "defect_id"], "left").join(named, "run_id", "left").join(digests, "run_id", "left"))
    lost = out.where("__there is null").select("run_id", "defect_id").limit(5).collect()
    if lost:
        raise ValueError("no such candidate: " + ", ".join(f"{r.run_id}/{r.defect_id}" for r in lost))
    return out.drop("__there").withColumns({"input_file_name": F.coalesce("input_file_name", "run_id"), "wafer_id": F.coalesce("wafer_id", "run_id")})


def upserted(present: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The labels in hand with newer verdicts: per candidate and reviewer the new row replaces the old one, of several new ones the last.

    Columns that one side lacks are null there.
    """
    both = present.withColumn("__new", F.lit(0)).unionByName(verdicts.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = sorted(c for c in both.columns if c not in ("__new", "run_id", "defect_id", "reviewer_id", "updated_at_utc"))
    return keep_last(both, ["run_id", "defect_id", "reviewer_id"], ["__new", "updated_at_utc", *rest]).drop("__new")


def reviewer_pairs(verdicts: DataFrame, item: list[str], reviewer: str = "reviewer_id", label: str = "label") -> DataFrame:
    """Every pair of reviewers' verdicts on an item, the smaller id first (a bounded number per item)."""
    a = verdicts.select(*item, F.col(reviewer).alias("first_reviewer"), F.col(label).alias("first_label"))
    b = verdicts.select(*item, F.col(reviewer).alias("second_reviewer"), F.col(label).alias("second_label"))
    return a.join(b, item).where("first_reviewer < second_reviewer")


def pair_agreement(pairs: DataFrame) -> DataFrame:
    """Per pair of reviewers: shared items, raw agreement, and Cohen's kappa of the clear verdicts.

    Kappa needs two pairs whose labels are both clear and an expected agreement below 1, else it is null.
    """
    x, y = clear_class(F.col("first_label")), clear_class(F.col("second_label"))
    both = x.isNotNull() & y.isNotNull()
    n = F.count_if(both)
    same, xs, ys = F.count_if(both & (x == y)), F.count_if(both & (x == 1)), F.count_if(both & (y == 1))
    out = pairs.groupBy("first_reviewer", "second_reviewer").agg(
        F.count("*").alias("items"), F.count_if(F.col("first_label") == F.col("second_label")).alias("equal"),
        n.alias("clear_pairs"), same.alias("clear_equal"), xs.alias("first_points"), ys.alias("second_points"),
    )
    return out.withColumns({"raw_agreement": F.col("equal") / F.col("items"), "kappa": kappa("clear_pairs", "clear_equal", "first_points", "second_points")})


def kappa(n: str, same: str, first: str, second: str) -> Column:
    """Cohen's kappa from the number of pairs, equal pairs and either side's positives."""
    total = F.col(n).cast("double")
    seen = F.try_divide(F.col(same), total)
    chance = F.try_divide(F.col(first) * F.col(second) + (total - F.col(first)) * (total - F.col(second)), total * total)
    return F.when((F.col(n) >= 2) & (F.abs(1 - chance) > 1e-12), (seen - chance) / (1 - chance))


def class_jaccard(pairs: DataFrame) -> DataFrame:
    """Per label: verdict pairs in which both, or at least one, gave it, and their ratio."""
    sides = pairs.select(F.explode(F.array_distinct(F.array("first_label", "second_label"))).alias("label"), (F.col("first_label") == F.col("second_label")).alias("both"))
    out = sides.groupBy("label").agg(F.count_if("both").alias("agreed"), F.count("*").alias("either"))
    return out.withColumn("jaccard", F.col("agreed") / F.col("either"))


def arbitrate(verdicts: DataFrame, item: list[str], reviewer: str = "reviewer_id", label: str = "label") -> DataFrame:
    """The most frequent label of each item; a tie is 'uncertain'. A single row is 'single_reviewer'."""
    per_label = verdicts.groupBy(*item, label).agg(F.count("*").alias("c"))
    modes = per_label.groupBy(*item).agg(F.max("c").alias("top"), F.count("*").alias("labels"), F.collect_list(F.struct("c", label)).alias("all"))
    firsts = F.filter("all", lambda s: s.c == F.col("top"))
    modes = modes.select(*item, "labels", F.size(firsts).alias("ties"), firsts[0][label].alias("mode"))
    sizes = verdicts.groupBy(*item).agg(F.count("*").alias("verdicts"), F.countDistinct(reviewer).alias("reviewers"))
    status = F.when(F.col("verdicts") == 1, "single_reviewer").when(F.col("labels") == 1, "unanimous").when(F.col("ties") == 1, "majority").otherwise("tie_to_uncertain")
    out = modes.join(sizes, item)
    return out.select(*item, "verdicts", "reviewers", F.when(F.col("ties") > 1, "uncertain").otherwise(F.col("mode")).alias("label"), status.alias("status"))


def consensus_for_training(verdicts: DataFrame, item: list[str]) -> DataFrame:
    """Per item: 'uncertain' if any verdict is, else 'conflict' if labels differ, else 'split_conflict', else 'usable'."""
    out = verdicts.groupBy(*item).agg(
        F.count("*").alias("verdicts"), F.count_if(F.col("label") == "uncertain").alias("unsure"), F.countDistinct("label").alias("labels"),
        F.countDistinct("split").alias("splits"), F.max("label").alias("top"),
    )
    status = F.when(F.col("unsure") > 0, "uncertain").when(F.col("labels") > 1, "conflict").when(F.col("splits") > 1, "split_conflict").otherwise("usable")
    out = out.withColumn("status", status)
    return out.select(*item, "verdicts", "status", F.when(F.col("status") == "usable", F.col("top")).alias("label"))


def provenance(declared: DataFrame, known: DataFrame, key: str, declared_hash: str, known_hash: str) -> DataFrame:
    """Declared source hashes against the known ones of the same key: five states."""
    actual = known.select(F.col(key).alias("__k"), F.nullif(F.lower(F.trim(known_hash)), F.lit("")).alias("__h")).where("__k is not null").distinct()
    sources = actual.groupBy("__k").agg(F.count("__h").alias("__n"))
    pairs = actual.where("__h is not null").select(F.col("__k").alias("__k2"), F.col("__h"))
    said = F.nullif(F.lower(F.trim(declared_hash)), F.lit(""))
    state = (
        F.when(F.col("__k").isNull(), "unknown_source")
        .when(said.isNull(), "not_declared")
        .when(F.col("__n") == 0, "source_without_hash")
        .when(F.col("__h").isNotNull(), "match")
        .otherwise("mismatch")
    )
    rows = declared.join(sources, F.col(key) == F.col("__k"), "left").join(pairs, (F.col(key) == F.col("__k2")) & (said == F.col("__h")), "left")
    return rows.withColumn("provenance", state).drop("__k", "__n", "__k2", "__h")
