"""Evaluation tables: metrics per wafer, method comparison, leakage checks, bootstrap and class reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.scalars import precision_recall


def outcome_metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, FN and their ratios (null where undefined) per group of ``outcome`` rows."""
    out = outcomes.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN", "indeterminate")])
    return out.withColumns(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def stratum_metrics(outcomes: DataFrame, share: Column) -> DataFrame:
    """TP, FP and FN of the centre, middle and edge strata of the normalised radius, each closed on the right; all three are present.

    Rows whose radius is unknown or beyond the rim belong to none.
    """
    # The strata's ends.
    name = F.when(share <= 0.33, "center").when(share <= 0.67, "middle").when(share <= 1 + 2.220446049250313e-16, "edge")
    rows = outcomes.withColumn("stratum", name).where("stratum is not null")
    names = F.array(*map(F.lit, ("center", "middle", "edge")))
    every = outcomes.sparkSession.range(1).select(F.explode(names).alias("stratum"))
    out = every.join(outcome_metrics(rows, ["stratum"]), "stratum", "left").fillna(0, ["tp", "fp", "fn", "indeterminate"])
    return out.withColumn("count", F.col("tp") + F.col("fp") + F.col("fn") + F.col("indeterminate"))


def bland_altman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean and difference of two measurements, the mean of a pair with one value being that value."""
    x, y = F.col(a), F.col(b)
    return df.withColumns({"mean": F.coalesce((x + y) / 2, x, y), "difference": x - y})


def limits_of_agreement(df: DataFrame, difference: str = "difference") -> DataFrame:
    d = F.col(difference)
    out = df.agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("spread"))
    return out.withColumns({"low": F.col("bias") - 1.96 * F.col("spread"), "high": F.col("bias") + 1.96 * F.col("spread")})


def torn(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys with rows in more than one split, with the splits; nulls do not count."""
    pairs = df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).select(key, split).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("splits"), F.array_join(F.sort_array(F.collect_list(split)), ",").alias("names")).where("splits > 1")


def require_unleaked(df: DataFrame, key: str, split: str) -> None:
    bad = torn(df, key, split).limit(5).collect()
    if bad:
        raise ValueError(f"{key} in several splits: " + ", ".join(f"{r[key]} ({r.names})" for r in bad))


def decision_metrics(scored: DataFrame, by: list[str], accept: float = 0.75, reject: float = 0.25) -> DataFrame:
    """``label`` (target or artifact) against ``probability``: coverage, and P/R/F1 where undecided targets are missed."""
    p, t = F.col("probability"), F.col("label") == "target"
    up, down = p >= accept, p <= reject
    out = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(up | down).alias("decided"), F.count_if(t & up).alias("tp"), F.count_if(~t & up).alias("fp"),
        F.count_if(t & ~F.coalesce(up, F.lit(False))).alias("fn"), F.count_if(~t & down).alias("tn"),
    )
    return out.withColumns({"coverage": F.try_divide("decided", "n"), **precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))})


def held_out(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per held-out split: decisions (``decision`` of the model) against ``label``, with a status.

    ``status`` is 'held_out_' and the split if both classes occur, else 'one_class_only': then nothing is validated.
    """
    d, t = F.col("decision"), F.col("label") == "target"
    out = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(d.isin("target", "artifact")).alias("decided"), F.count_if(t & (d == "target")).alias("tp"), F.count_if(~t & (d == "target")).alias("fp"),
        F.count_if(t & (d != "target")).alias("fn"), F.count_if(~t & (d == "artifact")).alias("tn"), (F.max(t) & ~F.min(t)).alias("both"),
    )
    status = F.when(F.col("both"), F.concat_ws("_", F.lit("held_out"), *by)).otherwise("one_class_only")
    return out.withColumns({"status": status, "coverage": F.try_divide("decided", "n"), **precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))}).drop("both")


def bootstrap_bias(groups: DataFrame, observed: str, expected: str, draws: int = 2000, seed: int = 17) -> DataFrame:
    """Percentile interval of the total relative bias when whole wafers are drawn with replacement; null below two.

    ``groups`` has one row per wafer (``id``). Every wafer's weight in every draw is Poisson(1) by a seeded stream of
    its own, so draws are sums over the wafers and no wafer table is gathered in one task.
    """
    rows = groups.select(F.xxhash64("id").alias("id"), F.col(observed).cast("double").alias("o"), F.col(expected).cast("double").alias("e")).dropna()

    def weigh(parts):
        for part in parts:
            sums = np.zeros((draws, 2))
            for i, o, e in part.itertuples(index=False):
                w = np.random.default_rng([seed, i & 0xFFFFFFFF, (i >> 32) & 0xFFFFFFFF]).poisson(1.0, draws)
                sums += w[:, None] * np.array([o, e])
            yield pd.DataFrame({"draw": np.arange(draws), "o": sums[:, 0], "e": sums[:, 1], "n": len(part)})

    summed = rows.mapInPandas(weigh, "draw int, o double, e double, n bigint").groupBy("draw").agg(F.sum("o").alias("o"), F.sum("e").alias("e"), F.sum("n").alias("n"))
    bias = summed.withColumn("bias", F.try_divide(F.col("o") - F.col("e"), F.col("e")))
    out = bias.agg(F.max("n").alias("wafers"), F.percentile("bias", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    enough = F.col("wafers") >= 2
    return out.select("wafers", *[F.when(enough, F.col("q")[i]).alias(n) for i, n in enumerate(("low", "middle", "high"))])
