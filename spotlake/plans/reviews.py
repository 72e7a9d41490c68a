"""Queries on reviews, labels, references and the run catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions.names import instant, split_name, wafer_key
from spotlake.functions.scalars import base_name, key_of_candidate
from spotlake.operators import catalog as cat
from spotlake.operators import matching as match
from spotlake.operators import review as rev
from spotlake.operators import signal as sig
from spotlake.operators import validation as val
from spotlake.operators.logistic import train
from spotlake.operators.masks import run_objects
from spotlake.operators.pixel_training import SIDES, left_out
from spotlake.operators.rules import FEATURES, decide
from spotlake.operators.scale import stored, table, trimmed
from spotlake.plans.areas import wafers
from spotlake.plans.measure import _TESTS, _WHOLE, _Z, LIMITS, MODEL, RULE_COLUMNS, candidates

TOLERANCE_PX, TOLERANCE_UM = 12.0, 100.0


def _norm(c: str):
    return F.lower(trimmed(c))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Each annotation once, labels and reviewers in one spelling."""
    rows = table(spark, d, "expert_annotations", "annotation_seq", "image_id", "candidate_id", "x_px", "y_px", "label", "reviewer_id", "source_image_sha256").distinct()
    return rows.withColumns({"label": _norm("label"), "reviewer_id": _norm("reviewer_id")})


def named_annotations(spark, d):
    return annotations(spark, d).where("candidate_id is not null and trim(candidate_id) <> ''")


def labels(spark, d) -> DataFrame:
    """The last verdict per candidate and reviewer (by point in time, arrival, label), with one spelling per value."""
    rows = table(spark, d, "training_labels").withColumns({"label": _norm("label"), "reviewer_id": _norm("reviewer_id"), "split": split_name()})
    rows = rows.select("run_id", "defect_id", "reviewer_id", "label", "split", instant("updated_at_utc").alias("at"), "received_at")
    return rev.keep_last(rows, ["run_id", "defect_id", "reviewer_id"], ["at", "received_at", "label", "split"])


def last_per_reviewer(spark, d):
    rows = named_annotations(spark, d).select("image_id", "candidate_id", "reviewer_id", "label", "annotation_seq")
    return rev.keep_last(rows, ["image_id", "candidate_id", "reviewer_id"], ["annotation_seq", "label"])


def _pairs(spark, d):
    return rev.reviewer_pairs(last_per_reviewer(spark, d), ["image_id", "candidate_id"])


def reviewer_pairs_agreement(spark, d):
    out = rev.pair_agreement(_pairs(spark, d))
    return out.withColumns({"raw_agreement": F.round("raw_agreement", 6), "kappa": F.round("kappa", 6)})


def cohen_kappa(spark, d):
    """One kappa over all pairs of clear verdicts."""
    pairs = _pairs(spark, d).withColumns({"first_reviewer": F.lit("a"), "second_reviewer": F.lit("b")})
    return rev.pair_agreement(pairs).select("items", "equal", "clear_pairs", F.round("kappa", 6).alias("kappa"))


def class_jaccard(spark, d):
    return rev.class_jaccard(_pairs(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


def arbitrate_mode_tie(spark, d):
    return rev.arbitrate(last_per_reviewer(spark, d), ["image_id", "candidate_id"])


def consensus_ordered(spark, d):
    return rev.consensus_for_training(labels(spark, d), ["run_id", "defect_id"])


def label_status(spark, d):
    """Verdicts per split and label; missing splits are 'none'."""
    return labels(spark, d).groupBy(F.coalesce("split", F.lit("none")).alias("split"), "label").agg(F.count("*").alias("n"), F.countDistinct("reviewer_id").alias("reviewers"))


def split_leakage(spark, d):
    """Wafers whose annotated rows stand in more than one split."""
    rows = table(spark, d, "training_labels").select(wafer_key().alias("wafer"), split_name().alias("split"))
    return val.torn(rows, "wafer", "split")


def provenance_status(spark, d):
    known = table(spark, d, "run_catalog", "image_id", "source_image_sha256").distinct()
    declared = annotations(spark, d).select("annotation_seq", "image_id", F.col("source_image_sha256").alias("declared"))
    out = rev.provenance(declared, known, "image_id", "declared", "source_image_sha256")
    return out.groupBy("provenance").agg(F.count("*").alias("n"))


def candidate_keys(spark, d):
    rows = annotations(spark, d).where("image_id is not null and x_px is not null and y_px is not null and not isnan(x_px) and not isnan(y_px)")
    key = key_of_candidate(F.col("image_id"), F.col("candidate_id"), F.col("x_px"), F.col("y_px"))
    return rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _autos(spark, d):
    rows = candidates(spark, d, "image_id", "centroid_x_px", "centroid_y_px", "accepted").where("accepted and not isnan(centroid_x_px) and not isnan(centroid_y_px)")
    rows = rows.where("centroid_x_px is not null and centroid_y_px is not null")
    return rows.select(F.concat_ws("/", "run_id", "defect_id").alias("a"), F.col("image_id").alias("key"), F.col("centroid_x_px").alias("x"), F.col("centroid_y_px").alias("y"))


def _reviewed(spark, d):
    rows = annotations(spark, d).where("x_px is not null and y_px is not null and not isnan(x_px) and not isnan(y_px)")
    return rows.select(F.col("annotation_seq").alias("b"), F.col("image_id").alias("key"), F.col("x_px").alias("x"), F.col("y_px").alias("y"), "label")


def _near(spark, d):
    return stored(match.pairs_within(_autos(spark, d), _reviewed(spark, d), TOLERANCE_PX, keep=("label",)))


def proximity_pairs(spark, d):
    return _near(spark, d).select("a", "b", F.round("distance", 6).alias("distance"))


def nearest_reference(spark, d):
    return match.nearest(_near(spark, d)).select("a", "b", F.round("distance", 6).alias("distance"))


def match_mutual(spark, d):
    return match.mutual_nearest(_near(spark, d)).select("a", "b", F.round("distance", 6).alias("distance"))


def match_optimal(spark, d):
    """Least-cost one-to-one matching of accepted candidates and confirmed annotations."""
    return match.assign_one_to_one(_near(spark, d).where("label = 'confirmed_point'"), TOLERANCE_PX)


def match_cascade(spark, d):
    out = match.staged(_near(spark, d), _autos(spark, d), _reviewed(spark, d), rev.POSITIVE, rev.NEGATIVE, rev.INDETERMINATE, complete=True)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


def match_cascade_um(spark, d):
    """Outcomes per image of the staged matching in micrometres: by millimetre coordinates where an image has all of them, else by its pixel scale."""
    autos = candidates(spark, d, "image_id", "centroid_x_px", "centroid_y_px", "x_mm", "y_mm", "accepted").where("accepted and image_id is not null")
    autos = autos.select(F.concat_ws("/", "run_id", "defect_id").alias("a"), F.col("image_id").alias("key"), F.col("centroid_x_px").alias("x"), F.col("centroid_y_px").alias("y"), "x_mm", "y_mm")
    seen = table(spark, d, "expert_annotations", "annotation_seq", "image_id", "x_px", "y_px", "x_mm", "y_mm", "label").distinct().where("image_id is not null")
    seen = seen.select(F.col("annotation_seq").alias("b"), F.col("image_id").alias("key"), F.col("x_px").alias("x"), F.col("y_px").alias("y"), "x_mm", "y_mm", _norm("label").alias("label"))
    scales = table(spark, d, "run_catalog").select(F.col("image_id").alias("key"), "mm_per_pixel").distinct()
    autos, seen = (stored(df) for df in match.in_micrometres(autos, seen, scales))
    placed = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    pairs = stored(match.pairs_within(autos.where(placed), seen.where(placed), TOLERANCE_UM, keep=("label",)))
    out = match.staged(pairs, autos, seen, rev.POSITIVE, rev.NEGATIVE, rev.INDETERMINATE, complete=True)
    rows = out.join(autos.select(F.col("a").alias("ia"), F.col("key").alias("ka")).distinct(), F.col("a") == F.col("ia"), "left")
    rows = rows.join(seen.select(F.col("b").alias("ib"), F.col("key").alias("kb")).distinct(), F.col("b") == F.col("ib"), "left")
    return rows.groupBy(F.coalesce("ka", "kb").alias("image_id"), "outcome").agg(F.count("*").alias("n"))


def semi_matched(spark, d):
    return _autos(spark, d).join(_near(spark, d).select("a"), "a", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


def anti_unmatched(spark, d):
    return _autos(spark, d).join(_near(spark, d).select("a"), "a", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def wafer_metrics(spark, d):
    """Outcomes per image with precision, recall and F1 of candidates against the experts' points."""
    out = match.staged(_near(spark, d), _autos(spark, d), _reviewed(spark, d), rev.POSITIVE, rev.NEGATIVE, rev.INDETERMINATE, complete=True)
    keys = _autos(spark, d).select(F.col("a").alias("ia"), F.col("key").alias("ka"))
    other = _reviewed(spark, d).select(F.col("b").alias("ib"), F.col("key").alias("kb"))
    rows = out.join(keys, F.col("a") == F.col("ia"), "left").join(other, F.col("b") == F.col("ib"), "left").withColumn("image_id", F.coalesce("ka", "kb"))
    return val.outcome_metrics(rows, ["image_id"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def bland_altman(spark, d):
    """Candidate and reference density per source image, by the run's area."""
    runs = table(spark, d, "run_catalog").where("valid_analysis_area_cm2 > 0 and source_image_sha256 is not null")
    runs = runs.groupBy(F.lower("source_image_sha256").alias("sha")).agg(F.max("valid_analysis_area_cm2").alias("area"), F.max("accepted_count").alias("found"))
    refs = table(spark, d, "reference_points").select("reference_id", F.lower("source_image_sha256").alias("sha"), _norm("label").alias("label"), _norm("registration_status").alias("status")).distinct()
    refs = refs.where("label = 'confirmed_point' and status = 'registered'").groupBy("sha").agg(F.count("*").alias("n"))
    rows = runs.join(refs, "sha", "left").select("sha", F.round(F.col("found") / F.col("area"), 6).alias("automatic"), F.round(F.coalesce("n", F.lit(0)) / F.col("area"), 6).alias("reference"))
    out = val.bland_altman(rows, "automatic", "reference")
    return out.select("sha", "automatic", "reference", F.round("mean", 7).alias("mean"), F.round("difference", 6).alias("difference"))


def bootstrap_bias(spark, d):
    rows = bland_altman(spark, d).select(F.col("sha").alias("id"), "automatic", "reference")
    return val.bootstrap_bias(rows, "automatic", "reference")


def class_report(spark, d):
    """Classifier decisions against the usable consensus, per wafer."""
    truth = consensus_ordered(spark, d).where("status = 'usable'").select("run_id", F.col("defect_id").cast("bigint").alias("defect_id"), "label")
    scored = candidates(spark, d, "wafer_id", "classifier_probability").withColumn("probability", F.when(~F.isnan("classifier_probability"), F.col("classifier_probability")))
    out = val.decision_metrics(scored.join(truth, ["run_id", "defect_id"]).where("label in ('target', 'artifact')"), ["wafer_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "recall", "f1")})


def trained_scores(spark, d):
    """A model trained on the usable consensus of the calibration split, wafers in several splits left out, applied to every candidate."""
    cols = list(dict.fromkeys([*FEATURES, *RULE_COLUMNS]))
    torn = split_leakage(spark, d).select("wafer")
    rows = table(spark, d, "training_labels").select("run_id", "defect_id", wafer_key().alias("wafer")).join(torn, "wafer", "left_semi").select("run_id", "defect_id").distinct()
    truth = labels(spark, d).where("split = 'calibration'").join(rows, ["run_id", "defect_id"], "left_anti")
    truth = rev.consensus_for_training(truth, ["run_id", "defect_id"]).where("status = 'usable'").select("run_id", F.col("defect_id").cast("bigint").alias("defect_id"), "label")
    rows = stored(candidates(spark, d, *cols))
    model = train(rows.join(truth, ["run_id", "defect_id"]))
    return decide(rows, model).select("run_id", "defect_id", "probability", "decision", "accepted_now")


def _boxed(spark, d) -> DataFrame:
    rows = candidates(spark, d, "image_id", "centroid_x_px", "centroid_y_px", "bounding_box", "distance_to_valid_boundary_mm", "area_px")
    rows = rows.where("size(bounding_box) = 4 and centroid_x_px is not null and centroid_y_px is not null and not isnan(centroid_x_px) and not isnan(centroid_y_px)")
    return stored(rows.select(
        F.concat_ws("/", "run_id", "defect_id").alias("id"), F.col("image_id").alias("key"), F.col("run_id").alias("tile"), F.col("centroid_x_px").alias("x"), F.col("centroid_y_px").alias("y"),
        F.transform("bounding_box", lambda v: v.cast("double")).alias("box"), F.coalesce(F.nanvl("distance_to_valid_boundary_mm", F.lit(0.0)), F.lit(0.0)).alias("core_distance"), F.col("area_px").alias("area"),
    ))


def dedup_groups(spark, d):
    """Candidates of runs of one image that are the same spot (centres within 3 px or boxes with overlap of 0.3)."""
    return match.duplicates(_boxed(spark, d), "key", "tile").select("id", "group", "kept")


def bbox_iou_links(spark, d):
    """Candidates whose boxes overlap those of other runs of the image by at least 0.3, with the number of partners."""
    return match.box_links(_boxed(spark, d), "key", "tile")


def union_priority(spark, d):
    """One point per image and whole pixel of experts' points and candidates, experts' points first."""
    cell = lambda x, y: [F.floor(x).cast("bigint").alias("x"), F.floor(y).cast("bigint").alias("y")]
    mine = annotations(spark, d).select("image_id", *cell("x_px", "y_px"), F.lit(0).alias("rank"))
    theirs = candidates(spark, d, "image_id", "centroid_x_px", "centroid_y_px").where("not isnan(centroid_x_px) and not isnan(centroid_y_px)")
    rows = mine.unionByName(theirs.select("image_id", *cell("centroid_x_px", "centroid_y_px"), F.lit(1).alias("rank"))).dropna()
    best = rows.groupBy("image_id", "x", "y").agg(F.min("rank").alias("rank"), F.count("*").alias("points"))
    return best.select("image_id", "x", "y", F.when(F.col("rank") == 0, "expert").otherwise("candidate").alias("origin"), "points")


def mask_objects(spark, d):
    """Objects and labelled pixels per sample and label value of the run-length masks, with the largest object."""
    rows = table(spark, d, "pixel_samples", "sample_id", "label_mask_rle").groupBy("sample_id").agg(F.max_by("label_mask_rle", F.to_json("label_mask_rle")).alias("label_mask_rle"))
    found = run_objects(rows, ["sample_id"], "label_mask_rle")
    return found.groupBy("sample_id", "value").agg(F.count("*").alias("objects"), F.sum("pixels").alias("pixels"), F.max("pixels").alias("largest"))


def catalog_entries(spark, d):
    runs = table(spark, d, "run_catalog").drop("received_at").distinct()
    return runs.select(
        "run_id", cat.dataset_kind(F.col("status"), F.col("input_file_name")).alias("kind"), base_name(F.col("input_path")).alias("file"),
        F.when(F.col("status") == "completed", F.col("accepted_count")).alias("accepted_count"), F.size("warnings").cast("bigint").alias("warnings"),
    )


def latest_run(spark, d):
    runs = table(spark, d, "run_catalog").withColumn("at", instant("generated_at_utc"))
    return cat.latest_run(runs.select("run_id", "status", "at").distinct()).select("run_id", "status")


def page_offset(spark, d):
    """The third page of 50 rejected candidates."""
    rows = candidates(spark, d, "accepted", "rejection_reason").where("not accepted")
    return cat.page(rows.select("run_id", "defect_id", "rejection_reason"), [F.col("run_id"), F.col("defect_id")], 3, 50)


def page_filtered(spark, d):
    """The first page of 50 rejected candidates with exactly the reason low_contrast among theirs, with their labels."""
    rows = candidates(spark, d, "accepted", "rejection_reason", "contrast")
    page = cat.page(cat.filtered(rows, "rejected", "low_contrast"), [F.col("run_id"), F.col("defect_id")], 1, 50)
    verdicts = labels(spark, d).select("run_id", F.col("defect_id").try_cast("bigint").alias("defect_id"), "label")
    return cat.with_labels(stored(page), verdicts, ["run_id", "defect_id"]).select("run_id", "defect_id", "rejection_reason", "label")


def run_labels(spark, d):
    """One label per judged candidate: that of all reviewers' last verdicts, or 'conflict'."""
    verdicts = labels(spark, d).select("run_id", "defect_id", "label")
    return cat.with_labels(verdicts.select("run_id", "defect_id").distinct(), verdicts, ["run_id", "defect_id"])


def strata_outcomes(spark, d):
    """True and false positives and misses of the staged matching per radial stratum of the wafer."""
    out = match.staged(_near(spark, d), _autos(spark, d), _reviewed(spark, d), rev.POSITIVE, rev.NEGATIVE, rev.INDETERMINATE, complete=True)
    centre = wafers(spark, d).select(F.col("image_id").alias("key"), "cx", "cy", "radius")
    share = (F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) / F.col("radius")).alias("share")
    one = _autos(spark, d).join(centre, "key").select(F.col("a").alias("ia"), share)
    two = _reviewed(spark, d).join(centre, "key").select(F.col("b").alias("ib"), share.alias("other"))
    rows = out.join(one, F.col("a") == F.col("ia"), "left").join(two, (F.col("b") == F.col("ib")) & F.col("a").isNull(), "left")
    found = val.stratum_metrics(rows, F.coalesce("share", "other"))
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def held_out_report(spark, d):
    """The fixed example model against the usable consensus of each held-out split, wafers in several splits left out."""
    rows = labels(spark, d)
    torn = split_leakage(spark, d).select("wafer")
    wafer = table(spark, d, "training_labels").select("run_id", "defect_id", wafer_key().alias("wafer")).where("wafer is not null").groupBy("run_id", "defect_id").agg(F.min("wafer").alias("wafer"))
    truth = rev.consensus_for_training(rows, ["run_id", "defect_id"]).where("status = 'usable' and label in ('target', 'artifact')")
    split = rows.groupBy("run_id", "defect_id").agg(F.max("split").alias("split"))
    truth = truth.join(split, ["run_id", "defect_id"]).where("split in ('validation', 'locked_test')").join(wafer, ["run_id", "defect_id"], "left").join(torn, "wafer", "left_anti")
    truth = truth.select("run_id", F.col("defect_id").try_cast("bigint").alias("defect_id"), "label", "split")
    scored = decide(candidates(spark, d, *dict.fromkeys([*FEATURES, *RULE_COLUMNS])), MODEL, LIMITS).select("run_id", "defect_id", "probability", "decision")
    return val.held_out(truth.join(scored, ["run_id", "defect_id"]), ["split"]).withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "recall", "f1")})


def page_counts(spark, d):
    return cat.page_info(candidates(spark, d, "accepted").where("not accepted"), 50)


def dense_renumber(spark, d):
    rows = candidates(spark, d, "centroid_x_px", "centroid_y_px").where("not isnan(centroid_x_px) and not isnan(centroid_y_px) and centroid_x_px is not null and centroid_y_px is not null")
    return cat.renumbered(rows, ["run_id"], ["centroid_y_px", "centroid_x_px", "defect_id"]).select("run_id", "defect_id", F.col("number").cast("bigint").alias("number"))


def evenly_spaced(spark, d):
    return cat.evenly_spaced(candidates(spark, d, "accepted"), ["run_id"], ["defect_id"], 8).select("run_id", "defect_id")


def farthest_points(spark, d):
    rows = _autos(spark, d).select(F.xxhash64("a").alias("id"), "x", "y")
    return cat.farthest_points(rows)


def balanced_sample(spark, d):
    """At most 200 candidates of each classifier decision, by seeded hash."""
    return cat.class_sample(candidates(spark, d, "classifier_decision"), "classifier_decision", ["run_id", "defect_id"], 200, 1729)


def sliding_median(spark, d):
    rows = candidates(spark, d, "mean_dark_response").where("mean_dark_response is not null and not isnan(mean_dark_response)")
    return sig.sliding_median(rows, ["run_id"], ["defect_id"], "mean_dark_response").select("run_id", "defect_id", F.round("median", 6).alias("median"))


def rle_encode(spark, d):
    """Runs of equal decisions in the order of candidates."""
    return sig.run_lengths(candidates(spark, d, "accepted"), ["run_id"], ["defect_id"], "accepted")


def rle_pixels(spark, d):
    """Labelled pixels per sample and label value of the run-length masks."""
    rows = table(spark, d, "pixel_samples", "sample_id", "label_mask_rle").groupBy("sample_id").agg(F.any_value("label_mask_rle", True).alias("label_mask_rle"))
    return sig.rle_decode(rows, ["sample_id"], "label_mask_rle")


def regions_left_out(spark, d):
    """How many labelled regions of the pixel samples cannot train a model, and why."""
    rows = table(spark, d, "pixel_samples").select("sample_id", F.col("image_sha256").alias("image_id"), F.col("roi_xywh").alias("roi"), F.col("label_mask_rle.runs").alias("runs"))
    return left_out(rows.distinct()).groupBy("reason").agg(F.count("*").alias("n"))


def multi_otsu(spark, d):
    return sig.otsu_cut(candidates(spark, d, "mean_dark_response"), ["run_id"], "mean_dark_response")


def set_ops(spark, d):
    """Images of the catalogue, candidates and annotations: in all, without candidates, without a run."""
    runs = table(spark, d, "run_catalog").select("image_id").where("image_id is not null")
    found = table(spark, d, "candidates").select("image_id").where("image_id is not null")
    seen = table(spark, d, "expert_annotations").select("image_id").where("image_id is not null")
    tag = lambda df, name: df.select("image_id", F.lit(name).alias("part"))
    parts = [tag(runs.intersect(found).intersect(seen), "in_all"), tag(runs.subtract(found), "no_candidates"), tag(seen.subtract(runs), "no_run"), tag(runs.union(found).union(seen).distinct(), "any")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sha_provenance(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return rows


QUERIES = {
    f.__name__: f
    for f in (
        last_per_reviewer, reviewer_pairs_agreement, cohen_kappa, class_jaccard, arbitrate_mode_tie, consensus_ordered, label_status, split_leakage,
        provenance_status, candidate_keys, proximity_pairs, nearest_reference, match_mutual, match_optimal, match_cascade, match_cascade_um, semi_matched, anti_unmatched,
        wafer_metrics, bland_altman, bootstrap_bias, class_report, trained_scores, dedup_groups, bbox_iou_links, union_priority, mask_objects, catalog_entries, latest_run, page_offset, page_filtered, run_labels, strata_outcomes, held_out_report, page_counts,
        dense_renumber, evenly_spaced, farthest_points, balanced_sample, sliding_median, rle_encode, rle_pixels, regions_left_out, multi_otsu, set_ops, sha_provenance,
    )
}

_N = "lower(trim({0}, E' \\t\\r\\n'))"
_ANN = f"""ann AS (SELECT DISTINCT annotation_seq, image_id, candidate_id, x_px, y_px, {_N.format('label')} AS label, {_N.format('reviewer_id')} AS reviewer_id, source_image_sha256 FROM expert_annotations)"""
_LAST = f"""{_ANN}, last AS (SELECT image_id, candidate_id, reviewer_id, label, annotation_seq FROM ann WHERE candidate_id IS NOT NULL AND trim(candidate_id) <> ''
    QUALIFY row_number() OVER (PARTITION BY image_id, candidate_id, reviewer_id ORDER BY annotation_seq DESC, label DESC) = 1)"""
_PAIRS = f"""{_LAST}, pairs AS (SELECT a.reviewer_id AS first_reviewer, b.reviewer_id AS second_reviewer, a.label AS la, b.label AS lb,
    CASE WHEN a.label = 'confirmed_point' THEN 1 WHEN a.label IN {rev.NEGATIVE} THEN 0 END AS x, CASE WHEN b.label = 'confirmed_point' THEN 1 WHEN b.label IN {rev.NEGATIVE} THEN 0 END AS y
    FROM last a JOIN last b ON a.image_id = b.image_id AND a.candidate_id = b.candidate_id AND a.reviewer_id < b.reviewer_id)"""
_COUNTS = """count(*) AS items, count(*) FILTER (la = lb) AS equal, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS clear_pairs, count(*) FILTER (x = y) AS clear_equal,
    count(*) FILTER (x = 1 AND y IS NOT NULL) AS first_points, count(*) FILTER (y = 1 AND x IS NOT NULL) AS second_points"""
_CHANCE = "((first_points * second_points + (clear_pairs - first_points) * (clear_pairs - second_points)) / (clear_pairs * clear_pairs))"
_KAPPA = f"CASE WHEN clear_pairs >= 2 AND abs(1 - {_CHANCE}) > 1e-12 THEN round((clear_equal / clear_pairs - {_CHANCE}) / (1 - {_CHANCE}), 6) END"
_SPLIT = f"CASE WHEN {_N.format('split')} IN ('train', 'training') THEN 'calibration' ELSE nullif({_N.format('split')}, '') END"
_LABELS = f"""labels AS (SELECT run_id, defect_id, reviewer_id, label, split FROM (SELECT run_id, defect_id, {_N.format('reviewer_id')} AS reviewer_id, {_N.format('label')} AS label, {_SPLIT} AS split,
    try_cast(updated_at_utc AS TIMESTAMPTZ) AS t, received_at FROM training_labels) QUALIFY row_number() OVER (PARTITION BY run_id, defect_id, reviewer_id ORDER BY t DESC NULLS LAST, received_at DESC NULLS LAST, label DESC NULLS LAST, split DESC NULLS LAST) = 1)"""
_CONS = f"""{_LABELS}, cons AS (SELECT run_id, defect_id, count(*) AS verdicts, CASE WHEN count(*) FILTER (label = 'uncertain') > 0 THEN 'uncertain' WHEN count(DISTINCT label) > 1 THEN 'conflict'
    WHEN count(DISTINCT split) > 1 THEN 'split_conflict' ELSE 'usable' END AS status, max(label) AS top FROM labels GROUP BY 1, 2)"""
_NEAR = f"""{_ANN}, autos AS (SELECT run_id || '/' || defect_id AS a, image_id AS key, centroid_x_px AS x, centroid_y_px AS y FROM (SELECT DISTINCT run_id, defect_id, image_id, centroid_x_px, centroid_y_px, accepted FROM candidates)
    WHERE accepted AND centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL AND NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px)),
reviewed AS (SELECT annotation_seq AS b, image_id AS key, x_px AS x, y_px AS y, label FROM ann WHERE x_px IS NOT NULL AND y_px IS NOT NULL AND NOT isnan(x_px) AND NOT isnan(y_px)),
near AS (SELECT DISTINCT a, b, label, sqrt((o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y)) AS distance FROM autos o JOIN reviewed r ON o.key = r.key
    WHERE (o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y) <= {TOLERANCE_PX * TOLERANCE_PX})"""
_NEAREST = "SELECT a, b, distance FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) = 1"
_FINITE = "bool_and(x_mm IS NOT NULL AND y_mm IS NOT NULL AND isfinite(x_mm) AND isfinite(y_mm))"
_NEAR_UM = f"""autos0 AS (SELECT DISTINCT run_id || '/' || defect_id AS a, image_id AS key, centroid_x_px AS x, centroid_y_px AS y, x_mm, y_mm FROM candidates WHERE accepted AND image_id IS NOT NULL),
reviewed0 AS (SELECT DISTINCT annotation_seq AS b, image_id AS key, x_px AS x, y_px AS y, x_mm, y_mm, {_N.format('label')} AS label FROM expert_annotations WHERE image_id IS NOT NULL),
how AS (SELECT key, mm, scale FROM (SELECT key, {_FINITE} AS mm FROM (SELECT key, x_mm, y_mm FROM autos0 UNION ALL SELECT key, x_mm, y_mm FROM reviewed0) GROUP BY 1)
    LEFT JOIN (SELECT image_id AS key, max(mm_per_pixel) AS scale FROM run_catalog WHERE mm_per_pixel > 0 AND isfinite(mm_per_pixel) GROUP BY 1) USING (key)),
autos AS (SELECT a, key, CASE WHEN mm THEN x_mm ELSE x * scale END * 1000 AS x, CASE WHEN mm THEN y_mm ELSE y * scale END * 1000 AS y FROM autos0 JOIN how USING (key)),
reviewed AS (SELECT b, key, CASE WHEN mm THEN x_mm ELSE x * scale END * 1000 AS x, CASE WHEN mm THEN y_mm ELSE y * scale END * 1000 AS y, label FROM reviewed0 JOIN how USING (key)),
near AS (SELECT DISTINCT a, b, label, sqrt((o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y)) AS distance FROM autos o JOIN reviewed r ON o.key = r.key
    WHERE NOT isnan(o.x) AND NOT isnan(o.y) AND NOT isnan(r.x) AND NOT isnan(r.y) AND (o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y) <= {TOLERANCE_UM * TOLERANCE_UM})"""
_CAND = "(SELECT DISTINCT run_id, defect_id, {0} FROM candidates)"


def _cascade(select: str, near: str = _NEAR) -> str:
    """The staged matching: per stage, every one-to-one matching of each component is listed and the best is taken."""
    stages = [("confirmed_point", "TP")] + [(x, "FP") for x in sorted(rev.NEGATIVE)] + [(x, "indeterminate") for x in sorted(rev.INDETERMINATE)]
    out = []
    for i, (label, outcome) in enumerate(stages):
        left = f" AND a NOT IN (SELECT a FROM u{i - 1})" if i else ""
        before = f" UNION ALL SELECT * FROM u{i - 1}" if i else ""
        out.append(f"""s{i} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS r, a, b, distance FROM near WHERE label = '{label}'{left}),
t{i}(r, k) AS (SELECT r, r FROM s{i} UNION SELECT t.r, y.r FROM t{i} t JOIN s{i} x ON t.k = x.r JOIN (SELECT x.r AS q, y.r FROM s{i} x JOIN s{i} y ON x.a = y.a UNION SELECT x.r, y.r FROM s{i} x JOIN s{i} y ON x.b = y.b) y ON y.q = x.r),
g{i} AS MATERIALIZED (SELECT s.*, g FROM s{i} s JOIN (SELECT r, min(k) AS g FROM t{i} GROUP BY 1) USING (r)),
m{i}(g, last, n, cost, aa, bb, rs) AS (SELECT g, r, 1, distance, [a], [b], [r] FROM g{i}
    UNION ALL SELECT m.g, e.r, n + 1, cost + distance, list_append(aa, a), list_append(bb, b), list_append(rs, r) FROM m{i} m JOIN g{i} e ON m.g = e.g AND e.r > last WHERE NOT list_contains(aa, a) AND NOT list_contains(bb, b)),
u{i} AS MATERIALIZED (SELECT a, b, '{outcome}' AS outcome FROM (SELECT unnest(rs) AS r FROM (SELECT rs FROM m{i} QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, cost, rs) = 1)) JOIN s{i} USING (r){before})""")
    used = f"u{len(stages) - 1}"
    return f"""WITH RECURSIVE {near}, {', '.join(out)}, every AS (SELECT a, b, outcome FROM {used} UNION ALL SELECT a, NULL, 'FP' FROM (SELECT DISTINCT a FROM autos) WHERE a NOT IN (SELECT a FROM {used})
        UNION ALL SELECT NULL, b, 'FN' FROM (SELECT DISTINCT b FROM reviewed WHERE label = 'confirmed_point') WHERE b NOT IN (SELECT b FROM {used})) {select}"""


_OPTIMAL = f"""s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS r, a, b, distance FROM near WHERE label = 'confirmed_point'),
t(r, k) AS (SELECT r, r FROM s UNION SELECT t.r, y.r FROM t JOIN s x ON t.k = x.r JOIN (SELECT x.r AS q, y.r FROM s x JOIN s y ON x.a = y.a UNION SELECT x.r, y.r FROM s x JOIN s y ON x.b = y.b) y ON y.q = x.r),
g AS MATERIALIZED (SELECT s.*, g FROM s JOIN (SELECT r, min(k) AS g FROM t GROUP BY 1) USING (r)),
m(g, last, gain, aa, bb, rs) AS (SELECT g, r, distance - {2 * TOLERANCE_PX + 1}, [a], [b], [r] FROM g
    UNION ALL SELECT m.g, e.r, gain + distance - {2 * TOLERANCE_PX + 1}, list_append(aa, a), list_append(bb, b), list_append(rs, r) FROM m JOIN g e ON m.g = e.g AND e.r > last WHERE NOT list_contains(aa, a) AND NOT list_contains(bb, b))"""
_STRATA = """, c AS (SELECT image_id AS key, max(image_width_px) / 2 AS cx, max(image_height_px) / 2 AS cy, max(image_width_px) / (2 * 1.08) AS radius FROM run_catalog WHERE image_id IS NOT NULL AND mm_per_pixel > 0 AND image_width_px > 0 AND image_height_px > 0 GROUP BY 1),
        q AS (SELECT outcome, sqrt((coalesce(o.x, r.x) - cx) ^ 2 + (coalesce(o.y, r.y) - cy) ^ 2) / radius AS q FROM every e LEFT JOIN autos o ON e.a = o.a LEFT JOIN reviewed r ON e.b = r.b JOIN c ON c.key = coalesce(o.key, r.key)),
        n AS (SELECT stratum, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'indeterminate') AS indeterminate
            FROM (VALUES ('center', -1, 0.33), ('middle', 0.33, 0.67), ('edge', 0.67, 1 + 2e-16)) t(stratum, low, high) LEFT JOIN q ON q > low AND q <= high GROUP BY 1),
        p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM n)
        SELECT stratum, tp, fp, fn, indeterminate, tp + fp + fn + indeterminate AS count, round(precision, 6) AS precision, round(recall, 6) AS recall, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM p"""

SQL = {
    "match_optimal": f"WITH RECURSIVE {_NEAR}, {_OPTIMAL} SELECT a, b, distance FROM (SELECT unnest(rs) AS r FROM (SELECT rs FROM m QUALIFY row_number() OVER (PARTITION BY g ORDER BY gain) = 1)) JOIN s USING (r)",
    "strata_outcomes": _cascade(_STRATA),
    "page_filtered": f"""WITH {_LABELS}, p AS (SELECT run_id, defect_id, rejection_reason FROM {_CAND.format('accepted, rejection_reason, contrast')} WHERE NOT accepted AND list_contains(list_transform(string_split(rejection_reason, ';'), lambda x: trim(x)), 'low_contrast')
        ORDER BY run_id, defect_id LIMIT 50), v AS (SELECT run_id, try_cast(defect_id AS BIGINT) AS defect_id, CASE WHEN min(label) = max(label) THEN min(label) ELSE 'conflict' END AS label FROM labels WHERE label IS NOT NULL GROUP BY 1, 2)
        SELECT p.run_id, p.defect_id, rejection_reason, label FROM p LEFT JOIN v USING (run_id, defect_id)""",
    "run_labels": f"WITH {_LABELS} SELECT run_id, defect_id, CASE WHEN min(label) = max(label) THEN min(label) WHEN min(label) IS NOT NULL THEN 'conflict' END AS label FROM labels GROUP BY 1, 2",
    "held_out_report": f"""WITH {_CONS}, torn AS (SELECT wafer FROM (SELECT DISTINCT upper(regexp_replace(wafer_id, '[^A-Za-z0-9]', '', 'g')) AS wafer, {_SPLIT} AS split FROM training_labels) WHERE wafer <> '' AND split IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
        w AS (SELECT run_id, defect_id, min(nullif(upper(regexp_replace(wafer_id, '[^A-Za-z0-9]', '', 'g')), '')) AS wafer FROM training_labels GROUP BY 1, 2), sp AS (SELECT run_id, defect_id, max(split) AS split FROM labels GROUP BY 1, 2),
        truth AS (SELECT run_id, try_cast(defect_id AS BIGINT) AS defect_id, top = 'target' AS t, split FROM cons JOIN sp USING (run_id, defect_id) LEFT JOIN w USING (run_id, defect_id)
            WHERE status = 'usable' AND top IN ('target', 'artifact') AND split IN ('validation', 'locked_test') AND coalesce(wafer NOT IN (SELECT wafer FROM torn), true)),
        s AS (SELECT run_id, defect_id, CASE WHEN {_WHOLE} THEN 1 / (1 + exp(-greatest(-40, least(40, {_Z})))) END AS p, {_TESTS['outside_valid_mask']} OR ({_TESTS['near_wafer_edge']}) AS hard FROM {_CAND.format(', '.join(dict.fromkeys([*FEATURES, *RULE_COLUMNS])))}),
        r AS (SELECT split, t, CASE WHEN hard THEN 'blocked' WHEN p >= 0.75 THEN 'target' WHEN p <= 0.25 THEN 'artifact' END AS v FROM truth JOIN s USING (run_id, defect_id)),
        n AS (SELECT split, count(*) AS n, count(*) FILTER (v IN ('target', 'artifact')) AS decided, count(*) FILTER (t AND v = 'target') AS tp, count(*) FILTER (NOT t AND v = 'target') AS fp, count(*) FILTER (t AND v IS DISTINCT FROM 'target') AS fn,
            count(*) FILTER (NOT t AND v = 'artifact') AS tn, CASE WHEN count(*) FILTER (t) > 0 AND count(*) FILTER (NOT t) > 0 THEN 'held_out_' || split ELSE 'one_class_only' END AS status FROM r GROUP BY 1),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM n)
        SELECT split, n, decided, tp, fp, fn, tn, status, round(decided / n, 6) AS coverage, round(precision, 6) AS precision, round(recall, 6) AS recall, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM q""",
    "last_per_reviewer": f"WITH {_LAST} SELECT * FROM last",
    "reviewer_pairs_agreement": f"WITH {_PAIRS}, c AS (SELECT first_reviewer, second_reviewer, {_COUNTS} FROM pairs GROUP BY 1, 2) SELECT *, round(equal / items, 6) AS raw_agreement, {_KAPPA} AS kappa FROM c",
    "cohen_kappa": f"WITH {_PAIRS}, c AS (SELECT {_COUNTS} FROM pairs) SELECT items, equal, clear_pairs, {_KAPPA} AS kappa FROM c",
    "class_jaccard": f"""WITH {_PAIRS}, s AS (SELECT la AS label, la = lb AS same FROM pairs UNION ALL SELECT lb, false FROM pairs WHERE la <> lb)
        SELECT label, count(*) FILTER (same) AS agreed, count(*) AS either, round(count(*) FILTER (same) / count(*), 6) AS jaccard FROM s GROUP BY 1""",
    "arbitrate_mode_tie": f"""WITH {_LAST}, c AS (SELECT image_id, candidate_id, label, count(*) AS c FROM last GROUP BY 1, 2, 3), t AS (SELECT *, max(c) OVER (PARTITION BY image_id, candidate_id) AS top FROM c),
        m AS (SELECT image_id, candidate_id, sum(c)::BIGINT AS verdicts, count(*) AS labels, count(*) FILTER (c = top) AS ties, max(label) FILTER (c = top) AS mode FROM t GROUP BY 1, 2),
        r AS (SELECT image_id, candidate_id, count(DISTINCT reviewer_id) AS reviewers FROM last GROUP BY 1, 2)
        SELECT image_id, candidate_id, verdicts, reviewers, CASE WHEN ties > 1 THEN 'uncertain' ELSE mode END AS label,
        CASE WHEN verdicts = 1 THEN 'single_reviewer' WHEN labels = 1 THEN 'unanimous' WHEN ties = 1 THEN 'majority' ELSE 'tie_to_uncertain' END AS status FROM m JOIN r USING (image_id, candidate_id)""",
    "consensus_ordered": f"WITH {_CONS} SELECT run_id, defect_id, verdicts, status, CASE WHEN status = 'usable' THEN top END AS label FROM cons",
    "label_status": f"WITH {_LABELS} SELECT coalesce(split, 'none') AS split, label, count(*) AS n, count(DISTINCT reviewer_id) AS reviewers FROM labels GROUP BY 1, 2",
    "split_leakage": f"""WITH s AS (SELECT DISTINCT upper(regexp_replace(wafer_id, '[^A-Za-z0-9]', '', 'g')) AS wafer, {_SPLIT} AS split FROM training_labels)
        SELECT wafer, count(*) AS splits, string_agg(split, ',' ORDER BY split) AS names FROM s WHERE wafer <> '' AND split IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "provenance_status": f"""WITH {_ANN}, k AS (SELECT image_id, list(DISTINCT nullif(lower(trim(source_image_sha256)), '')) FILTER (trim(source_image_sha256) <> '') AS hs FROM run_catalog WHERE image_id IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN k.image_id IS NULL THEN 'unknown_source' WHEN nullif(lower(trim(source_image_sha256)), '') IS NULL THEN 'not_declared' WHEN hs IS NULL THEN 'source_without_hash'
        WHEN list_contains(hs, lower(trim(source_image_sha256))) THEN 'match' ELSE 'mismatch' END AS provenance, count(*) AS n FROM ann LEFT JOIN k ON ann.image_id = k.image_id GROUP BY 1""",
    "candidate_keys": f"""WITH {_ANN} SELECT image_id || '|' || CASE WHEN trim(candidate_id) <> '' THEN 'id:' || candidate_id ELSE 'px:' || format('{{:.3f}}', round(x_px, 3)) || ',' || format('{{:.3f}}', round(y_px, 3)) END AS key, count(*) AS n
        FROM ann WHERE image_id IS NOT NULL AND x_px IS NOT NULL AND y_px IS NOT NULL AND NOT isnan(x_px) AND NOT isnan(y_px) GROUP BY 1""",
    "proximity_pairs": f"WITH {_NEAR} SELECT a, b, round(distance, 6) AS distance FROM near",
    "nearest_reference": f"WITH {_NEAR} SELECT a, b, round(distance, 6) AS distance FROM ({_NEAREST})",
    "match_mutual": f"WITH {_NEAR}, n AS ({_NEAREST}), m AS (SELECT a, b FROM near QUALIFY row_number() OVER (PARTITION BY b ORDER BY distance, a) = 1) SELECT n.a, n.b, round(distance, 6) AS distance FROM n JOIN m ON n.a = m.a AND n.b = m.b",
    "match_cascade": _cascade("SELECT outcome, count(*) AS n FROM every GROUP BY 1"),
    "match_cascade_um": _cascade("SELECT coalesce(o.key, r.key) AS image_id, outcome, count(*) AS n FROM every e LEFT JOIN autos o ON e.a = o.a LEFT JOIN reviewed r ON e.b = r.b GROUP BY 1, 2", _NEAR_UM),
    "wafer_metrics": _cascade("""
        , n AS (SELECT coalesce(o.key, r.key) AS image_id, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn,
            count(*) FILTER (outcome = 'indeterminate') AS indeterminate FROM every e LEFT JOIN autos o ON e.a = o.a LEFT JOIN reviewed r ON e.b = r.b GROUP BY 1),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM n)
        SELECT image_id, tp, fp, fn, indeterminate, round(precision, 6) AS precision, round(recall, 6) AS recall, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM q"""),
    "bbox_iou_links": """WITH c AS (SELECT run_id || '/' || defect_id AS id, image_id AS key, run_id AS tile, bounding_box::DOUBLE[] AS b
            FROM (SELECT DISTINCT run_id, defect_id, image_id, centroid_x_px, centroid_y_px, bounding_box, distance_to_valid_boundary_mm, area_px FROM candidates)
            WHERE len(bounding_box) = 4 AND centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL AND NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px)),
        p AS (SELECT a.id, greatest(0, least(a.b[3], b.b[3]) - greatest(a.b[1], b.b[1])) * greatest(0, least(a.b[4], b.b[4]) - greatest(a.b[2], b.b[2])) AS common,
            (a.b[3] - a.b[1]) * (a.b[4] - a.b[2]) + (b.b[3] - b.b[1]) * (b.b[4] - b.b[2]) AS size FROM c a JOIN c b ON a.key = b.key AND a.tile <> b.tile)
        SELECT id, count(*) AS links FROM p WHERE common / (size - common) >= 0.3 GROUP BY 1""",
    "union_priority": f"""WITH {_ANN}, r AS (SELECT image_id, floor(x_px)::BIGINT AS x, floor(y_px)::BIGINT AS y, 0 AS rank FROM ann WHERE x_px IS NOT NULL AND y_px IS NOT NULL
        UNION ALL SELECT image_id, floor(centroid_x_px)::BIGINT, floor(centroid_y_px)::BIGINT, 1 FROM {_CAND.format('image_id, centroid_x_px, centroid_y_px')}
            WHERE centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL AND NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px))
        SELECT image_id, x, y, CASE min(rank) WHEN 0 THEN 'expert' ELSE 'candidate' END AS origin, count(*) AS points FROM r WHERE image_id IS NOT NULL GROUP BY 1, 2, 3""",
    "dedup_groups": """WITH RECURSIVE c AS (SELECT run_id || '/' || defect_id AS id, image_id AS key, run_id AS tile, centroid_x_px AS x, centroid_y_px AS y, bounding_box::DOUBLE[] AS b,
            CASE WHEN isnan(distance_to_valid_boundary_mm) THEN 0.0 ELSE coalesce(distance_to_valid_boundary_mm, 0.0) END AS core, area_px AS area
            FROM (SELECT DISTINCT run_id, defect_id, image_id, centroid_x_px, centroid_y_px, bounding_box, distance_to_valid_boundary_mm, area_px FROM candidates)
            WHERE len(bounding_box) = 4 AND centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL AND NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px)),
        p AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, greatest(0, least(a.b[3], b.b[3]) - greatest(a.b[1], b.b[1])) * greatest(0, least(a.b[4], b.b[4]) - greatest(a.b[2], b.b[2])) AS common,
            (a.b[3] - a.b[1]) * (a.b[4] - a.b[2]) + (b.b[3] - b.b[1]) * (b.b[4] - b.b[2]) AS size FROM c a JOIN c b ON a.key = b.key AND a.tile <> b.tile),
        e AS (SELECT a, b FROM p WHERE d2 <= 9 OR common / (size - common) >= 0.3),
        reach(a, b) AS (SELECT id, id FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), g AS (SELECT a AS id, min(b) AS grp FROM reach GROUP BY 1)
        SELECT id, grp AS "group", row_number() OVER (PARTITION BY grp ORDER BY core DESC, area DESC, id) = 1 AS kept FROM c JOIN g USING (id)""",
    "semi_matched": f"WITH {_NEAR} SELECT key, count(*) AS n FROM autos WHERE a IN (SELECT a FROM near) GROUP BY 1",
    "anti_unmatched": f"WITH {_NEAR} SELECT key, count(*) AS n FROM autos WHERE a NOT IN (SELECT a FROM near) GROUP BY 1",
    "bland_altman": f"""WITH r AS (SELECT lower(source_image_sha256) AS sha, max(valid_analysis_area_cm2) AS area, max(accepted_count) AS found FROM run_catalog WHERE valid_analysis_area_cm2 > 0 AND source_image_sha256 IS NOT NULL GROUP BY 1),
        f AS (SELECT sha, count(*) AS n FROM (SELECT DISTINCT reference_id, lower(source_image_sha256) AS sha, {_N.format('label')} AS label, {_N.format('registration_status')} AS status FROM reference_points) WHERE label = 'confirmed_point' AND status = 'registered' GROUP BY 1),
        x AS (SELECT r.sha, round(found / area, 6) AS automatic, round(coalesce(n, 0) / area, 6) AS reference FROM r LEFT JOIN f ON r.sha = f.sha)
        SELECT sha, automatic, reference, round(coalesce((automatic + reference) / 2, automatic, reference), 7) AS mean, round(automatic - reference, 6) AS difference FROM x""",
    "class_report": f"""WITH {_CONS}, s AS (SELECT wafer_id, CASE WHEN NOT isnan(classifier_probability) THEN classifier_probability END AS p, top = 'target' AS t FROM {_CAND.format('wafer_id, classifier_probability')} c
        JOIN cons ON c.run_id = cons.run_id AND c.defect_id = try_cast(cons.defect_id AS BIGINT) WHERE status = 'usable' AND top IN ('target', 'artifact')),
        n AS (SELECT wafer_id, count(*) AS n, count(*) FILTER (p >= 0.75 OR p <= 0.25) AS decided, count(*) FILTER (t AND p >= 0.75) AS tp, count(*) FILTER (NOT t AND p >= 0.75) AS fp,
        count(*) FILTER (t AND NOT coalesce(p >= 0.75, false)) AS fn, count(*) FILTER (NOT t AND p <= 0.25) AS tn FROM s GROUP BY 1),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM n)
        SELECT wafer_id, n, decided, tp, fp, fn, tn, round(decided / n, 6) AS coverage, round(precision, 6) AS precision, round(recall, 6) AS recall, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM q""",
    "catalog_entries": """SELECT run_id, CASE WHEN status IS NOT NULL AND status <> 'completed' THEN 'failed' WHEN lower(input_file_name) LIKE '%synthetic%' THEN 'synthetic' ELSE 'real_exploratory' END AS kind, string_split(input_path, '/')[-1] AS file,
        CASE WHEN status = 'completed' THEN accepted_count END AS accepted_count, len(warnings) AS warnings FROM (SELECT DISTINCT * EXCLUDE (received_at) FROM run_catalog)""",
    "latest_run": "SELECT run_id, status FROM (SELECT DISTINCT run_id, status, try_cast(generated_at_utc AS TIMESTAMPTZ) AS t FROM run_catalog) ORDER BY (status = 'completed') DESC, t DESC NULLS LAST, run_id DESC LIMIT 1",
    "page_offset": f"SELECT run_id, defect_id, rejection_reason FROM {_CAND.format('accepted, rejection_reason')} WHERE NOT accepted ORDER BY run_id, defect_id LIMIT 50 OFFSET 100",
    "page_counts": f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 50))::BIGINT AS total_pages FROM {_CAND.format('accepted')} WHERE NOT accepted",
    "dense_renumber": f"SELECT run_id, defect_id, row_number() OVER (PARTITION BY run_id ORDER BY centroid_y_px, centroid_x_px, defect_id) AS number FROM {_CAND.format('centroid_x_px, centroid_y_px')} WHERE NOT isnan(centroid_x_px) AND NOT isnan(centroid_y_px) AND centroid_x_px IS NOT NULL AND centroid_y_px IS NOT NULL",
    "evenly_spaced": f"""WITH r AS (SELECT run_id, defect_id, row_number() OVER (PARTITION BY run_id ORDER BY defect_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM {_CAND.format('accepted')})
        SELECT run_id, defect_id FROM r WHERE i IN (0, floor((n - 1) / 7), floor(2 * (n - 1) / 7), floor(3 * (n - 1) / 7), floor(4 * (n - 1) / 7), floor(5 * (n - 1) / 7), floor(6 * (n - 1) / 7), n - 1)""",
    "sliding_median": f"SELECT run_id, defect_id, round(quantile_cont(mean_dark_response, 0.5) OVER (PARTITION BY run_id ORDER BY defect_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 6) AS median FROM {_CAND.format('mean_dark_response')} WHERE mean_dark_response IS NOT NULL AND NOT isnan(mean_dark_response)",
    "rle_encode": f"""WITH r AS (SELECT run_id, accepted, row_number() OVER (PARTITION BY run_id ORDER BY defect_id) - 1 AS i, row_number() OVER (PARTITION BY run_id, accepted ORDER BY defect_id) - 1 AS k FROM {_CAND.format('accepted')})
        SELECT run_id, accepted, min(i) AS start, count(*) AS length FROM r GROUP BY run_id, accepted, i - k""",
    "rle_pixels": """WITH s AS (SELECT sample_id, any_value(label_mask_rle) AS m FROM pixel_samples WHERE label_mask_rle IS NOT NULL GROUP BY 1), r AS (SELECT sample_id, unnest(m.runs) AS r, m.shape[1]::BIGINT * m.shape[2] AS size FROM s)
        SELECT sample_id, r[3] AS value, sum(r[2])::BIGINT AS pixels FROM r WHERE len(r) = 3 AND r[1] >= 0 AND r[2] > 0 AND r[1] + r[2] <= size GROUP BY 1, 2""",
    "regions_left_out": f"""WITH s AS (SELECT DISTINCT sample_id, image_sha256 AS i, roi_xywh AS r, label_mask_rle.runs AS u FROM pixel_samples),
        t AS (SELECT CASE WHEN sample_id IS NULL OR i IS NULL OR r IS NULL OR u IS NULL THEN 'missing' WHEN len(r) <> 4 OR len(list_filter(r, lambda v: v IS NULL)) > 0 THEN 'roi' WHEN r[1] < 0 OR r[2] < 0 THEN 'position'
            WHEN NOT (r[3] BETWEEN {SIDES[0]} AND {SIDES[1]} AND r[4] BETWEEN {SIDES[0]} AND {SIDES[1]}) THEN 'side'
            WHEN len(list_filter(u, lambda x: coalesce(len(x) = 3 AND x[1] >= 0 AND x[2] > 0 AND x[1]::BIGINT + x[2] <= r[3]::BIGINT * r[4], false))) < len(u) THEN 'runs' END AS reason FROM s)
        SELECT reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY 1""",
    "set_ops": """WITH r AS (SELECT image_id FROM run_catalog WHERE image_id IS NOT NULL), c AS (SELECT image_id FROM candidates WHERE image_id IS NOT NULL), s AS (SELECT image_id FROM expert_annotations WHERE image_id IS NOT NULL)
        SELECT image_id, 'in_all' AS part FROM (FROM r INTERSECT FROM c INTERSECT FROM s) UNION ALL SELECT image_id, 'no_candidates' FROM (FROM r EXCEPT FROM c)
        UNION ALL SELECT image_id, 'no_run' FROM (FROM s EXCEPT FROM r) UNION ALL SELECT image_id, 'any' FROM (FROM r UNION FROM c UNION FROM s)""",
    "sha_provenance": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
