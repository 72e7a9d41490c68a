"""Accepting and rejecting candidates: ordered rules with stated reasons, and a scoring model on top."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.geometry import present
from spotlake.functions.scalars import sigmoid

# The reasons in the order in which they are stated, and those that no model may override.
REASONS = ("outside_valid_mask", "too_small", "too_large", "too_elongated", "low_circularity", "low_solidity", "low_contrast", "near_wafer_edge")
HARD = ("outside_valid_mask", "near_wafer_edge")
# The ten features of the candidate model; the first four enter as log1p.
FEATURES = (
    "area_mm2", "equivalent_diameter_um", "major_axis_length_um", "minor_axis_length_um", "aspect_ratio", "eccentricity",
    "circularity", "solidity", "contrast", "mean_dark_response",
)
LOGGED = 4


@dataclass(frozen=True)
class Limits:
    # The defaults of the rules.
    min_area_px: float = 5
    max_area_px: float = 5000
    min_diameter_px: float = 2.0
    max_diameter_px: float = 80.0
    max_aspect: float = 4.0
    max_eccentricity: float = 0.92
    min_circularity: float = 0.25
    min_solidity: float = 0.60
    min_contrast: float = 0.02
    min_edge_mm: float = 0.0
    min_valid_fraction: float = 0.95


def reasons(limits: Limits = Limits(), valid_fraction: Column | None = None) -> Column:
    """The reasons against a candidate, in order; empty if there are none.

    A missing or NaN size passes the size rules, an infinite aspect ratio is elongated, a contrast that is not finite is low.
    ``valid_fraction`` is the share of a candidate's pixels in the valid mask; without it all are (detection keeps none else).
    """
    c = F.col
    above = lambda name, top: F.coalesce(~F.isnan(name) & (c(name) > top), F.lit(False))
    below = lambda name, low: F.coalesce(~F.isnan(name) & (c(name) < low), F.lit(False))
    boundary = c("distance_to_valid_boundary_mm")
    outside = F.coalesce(~F.isnan(boundary) & (boundary <= 0), F.lit(False))
    if valid_fraction is not None:
        outside = outside | F.coalesce(valid_fraction < limits.min_valid_fraction, F.lit(False))
    area = c("area_px")
    tests = (
        outside,
        F.coalesce(area < limits.min_area_px, F.lit(False)) | below("equivalent_diameter_px", limits.min_diameter_px),
        F.coalesce(area > limits.max_area_px, F.lit(False)) | above("equivalent_diameter_px", limits.max_diameter_px),
        above("aspect_ratio", limits.max_aspect) | above("eccentricity", limits.max_eccentricity),
        below("circularity", limits.min_circularity),
        below("solidity", limits.min_solidity),
        F.coalesce(present("contrast") < limits.min_contrast, F.lit(True)),
        F.coalesce(~F.isnan(boundary) & (boundary > 0) & (boundary < limits.min_edge_mm), F.lit(False)),
    )
    return F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)]), lambda r: r.isNotNull())


def features(logged: int = LOGGED) -> Column:
    """The feature vector, null where one of its values is missing or not finite."""
    values = [F.log1p(F.greatest(F.lit(0.0), present(f))) if i < logged else present(f) for i, f in enumerate(FEATURES)]
    whole = values[0].isNotNull()
    for v, f in zip(values[1:], FEATURES[1:], strict=True):
        whole = whole & present(f).isNotNull()
    return F.when(whole & present(FEATURES[0]).isNotNull(), F.array(*values))


@dataclass(frozen=True)
class Model:
    """A standardised linear model with two thresholds: target from ``accept``, artifact up to ``reject``."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    accept: float = 0.75
    reject: float = 0.25
    names: tuple[str, ...] = field(default=FEATURES)

    def checked(self) -> Model:
        sizes = {len(self.means), len(self.scales), len(self.weights), len(self.names)}
        numbers = [*self.means, *self.scales, *self.weights, self.intercept]
        if len(sizes) != 1 or not all(abs(v) < float("inf") for v in numbers) or not 0 < self.reject < self.accept < 1 or min(self.scales) <= 0:
            raise ValueError("not a usable model")
        return self

    def probability(self) -> Column:
        x = features()
        z = F.lit(self.intercept)
        for i, (m, s, w) in enumerate(zip(self.means, self.scales, self.weights, strict=True)):
            z = z + (x[i] - m) / s * w
        return sigmoid(z)


def decide(df: DataFrame, model: Model, limits: Limits = Limits()) -> DataFrame:
    """Rule reasons, the model's probability and the final decision, with its basis.

    A hard reason blocks; without finite features the model does not apply and nothing is accepted; else the
    probability decides: target, artifact or uncertain. Only a target is accepted. What the rules alone say stays in
    ``rule_accepted`` and ``rule_rejection_reason``; ``final_reason`` is empty for a target, the rules' own where they block,
    else the classifier's.
    """
    model = model.checked()
    df = df.withColumn("reasons", reasons(limits)).withColumn("probability", model.probability())
    p = F.col("probability")
    hard = F.arrays_overlap("reasons", F.array(*map(F.lit, HARD)))
    decision = (
        F.when(hard, "blocked_by_geometry").when(p.isNull(), "feature_invalid").when(p >= model.accept, "target").when(p <= model.reject, "artifact").otherwise("uncertain")
    )
    rule = F.array_join("reasons", ";")
    d = F.col("decision")
    reason = F.when(d == "target", "").when(d == "blocked_by_geometry", rule).otherwise(F.concat(F.lit("classifier_"), d))
    out = df.withColumns({"decision": decision, "model_applied": p.isNotNull(), "rule_accepted": F.size("reasons") == 0, "rule_rejection_reason": rule})
    return out.withColumns({"accepted_now": d == "target", "final_reason": reason, "decision_basis": F.lit("trained_candidate_classifier")})
