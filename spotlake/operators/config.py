"""Settings on the driver (merging, lengths in pixels) and the tables that depend on them."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.scalars import parse_bool, with_poisson_interval
from spotlake.operators.density import rates

# The calibration profiles on record, what they override and what they may claim.
GENERIC = "generic_transparent_rules"
PROFILES = {
    GENERIC: {"status": "generic_unvalidated_defaults", "overrides": {}},
    "cn4n82006412_r40_b2_standard_20260815": {
        "status": "single_wafer_spatial_internal_calibration",
        "overrides": {"detection": {"method": "blackhat", "threshold_method": "otsu", "threshold_offset": 0.030, "use_watershed": False}},
    },
}

SWEEP = (0.8, 0.9, 1.0, 1.1, 1.2)


def merged(base: Mapping, *over: Mapping) -> dict:
    """Later settings win; only mappings are merged, lists and scalars are replaced. Inputs stay as they are."""
    out = dict(base)
    for layer in over:
        for k, v in layer.items():
            both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
            out[k] = merged(out[k], v) if both else v
    return out


def with_profile(settings: Mapping, name: str | None = None, profiles: Mapping[str, Mapping] = PROFILES) -> dict:
    """The settings under a named profile's overrides, with its name and facts as ``analysis_profile``; blank means the generic one."""
    name = (name or "").strip() or GENERIC
    if name not in profiles:
        raise ValueError(f"unknown profile: {name}")
    facts = {k: v for k, v in profiles[name].items() if k != "overrides"}
    return merged(settings, profiles[name].get("overrides", {}), {"analysis_profile": {"profile_id": name, **facts}})


def load(path: str, defaults: Mapping, *over: Mapping) -> dict:
    """Defaults, then the JSON object of a file, then overrides."""
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: an object is needed")
    return merged(defaults, found, *over)


def pixels(length_um: float, um_per_px: float) -> int:
    """A length in whole pixels, half to even, at least 1."""
    if not (math.isfinite(length_um) and length_um >= 0 and math.isfinite(um_per_px) and um_per_px > 0):
        raise ValueError("lengths must be finite and not negative, scales finite and positive")
    return max(1, round(length_um / um_per_px))


def odd_pixels(length_um: float, um_per_px: float) -> int:
    """As :func:`pixels`, raised to the next odd number for kernels."""
    n = pixels(length_um, um_per_px)
    return n if n % 2 else n + 1


def resolved(settings: Mapping[str, float], um_per_px: float, odd: tuple[str, ...] = ()) -> tuple[dict, list[str]]:
    """Settings with ``x_um`` or ``x_um2`` turned into ``x_px``; a physical value wins over a pixel value, with a warning.

    ``min_edge_distance_um`` becomes ``min_edge_distance_mm``.
    """
    out, warnings = {}, []
    for k, v in settings.items():
        if k == "min_edge_distance_um":
            out["min_edge_distance_mm"] = v / 1000
        elif k.endswith("_um2"):
            out[k[:-4] + "_px"] = v / um_per_px**2
        elif k.endswith("_um"):
            out[k[:-3] + "_px"] = odd_pixels(v, um_per_px) if k in odd else pixels(v, um_per_px)
        else:
            out.setdefault(k, v)
    for k in settings:
        stem = k.removesuffix("_um2").removesuffix("_um")
        if stem != k and f"{stem}_px" in settings:
            warnings.append(f"{k} replaces {stem}_px")
    return out, warnings


def sweep(settings: Mapping[str, float], names: tuple[str, ...]) -> list[tuple[str, float, dict]]:
    """(name, value, settings) for five values of each named parameter; around 0, steps of 0.01."""
    out = []
    for name, factor in product(names, SWEEP):
        value = settings[name] * factor if settings[name] else round((factor - 1) * 0.1, 6)
        out.append((name, value, {**settings, name: value}))
    return out


def reviewed_density(candidates: DataFrame, areas: DataFrame) -> DataFrame:
    """Densities after a review: ``reviewed_accepted`` where given, else ``accepted``, over the runs' valid areas.

    A run without a positive valid area keeps its count and has no density; a theoretical area is never put in its place.
    """
    flag = F.coalesce(F.when(F.col("reviewed_accepted").isNotNull(), parse_bool(F.col("reviewed_accepted"))), parse_bool(F.col("accepted")))
    counts = candidates.withColumn("__a", flag).groupBy("run_id").agg(F.count_if("__a").alias("count"), F.count_if(~F.col("__a")).alias("rejected"))
    return with_poisson_interval(rates(areas.join(counts, "run_id", "left").fillna(0, ["count", "rejected"])), "count")


def split_faults(wafers: DataFrame, splits: DataFrame) -> DataFrame:
    """(wafer, fault): wafers without a split, split entries of unknown wafers, and wafers in several splits."""
    known = wafers.select("wafer").where("wafer is not null").distinct()
    given = splits.select("wafer", "split").where("wafer is not null and split is not null").distinct()
    tag = lambda df, what: df.select("wafer", F.lit(what).alias("fault"))
    several = given.groupBy("wafer").count().where("count > 1")
    return (
        tag(known.join(given, "wafer", "left_anti"), "not_assigned")
        .unionByName(tag(given.select("wafer").distinct().join(known, "wafer", "left_anti"), "unknown"))
        .unionByName(tag(several, "several_splits"))
    )
