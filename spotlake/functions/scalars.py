"""Small scalar families: ratios, booleans, scores, canonical text and Poisson intervals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings that count as true.
TRUE_WORDS = ("1", "true", "yes", "y", "accepted", "accept")


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den <= 0."""
    return F.when(den > 0, num / den)


def sigmoid(z: Column) -> Column:
    """Of the logit clipped to +-40; null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r))}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def key_of_candidate(image: Column, candidate: Column, x: Column, y: Column) -> Column:
    """image|id:candidate, or image|px:x,y with three digits where there is no id."""
    px = F.concat(F.lit("px:"), F.format_string("%.3f", F.round(x, 3)), F.lit(","), F.format_string("%.3f", F.round(y, 3)))
    return F.concat_ws("|", image, F.when(F.trim(candidate) != "", F.concat(F.lit("id:"), candidate)).otherwise(px))


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series below a + 1 and continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - scale * h)


def _gamma_quantile(p: float, a: float) -> float:
    low, high = 0.0, a + 10 * math.sqrt(a) + 50
    for _ in range(200):
        middle = (low + high) / 2
        if _lower_gamma(a, middle) < p:
            low = middle
        else:
            high = middle
        if high - low <= 1e-14 * high:
            break
    return (low + high) / 2


def poisson_bounds(n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact (Garwood) interval of a Poisson mean after n events; the lower bound of 0 events is 0."""
    if n < 0:
        raise ValueError("counts are not negative")
    tail = (1 - confidence) / 2
    return (0.0 if n == 0 else _gamma_quantile(tail, n)), _gamma_quantile(1 - tail, n + 1)


def with_poisson_interval(df: DataFrame, count: str, confidence: float = 0.95, low: str = "poisson_lower", high: str = "poisson_upper") -> DataFrame:
    """Add the exact interval of ``count``; computed once per distinct count and joined back. A null count has none."""

    @F.pandas_udf("low double, high double")
    def bounds(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([poisson_bounds(int(v), confidence) for v in n], columns=["low", "high"])

    counts = df.select(F.col(count).cast("bigint").alias("__n")).where("__n is not null").distinct().withColumn("__b", bounds("__n"))
    joined = df.join(counts, F.col(count) == F.col("__n"), "left")
    return joined.withColumns({low: F.col("__b.low"), high: F.col("__b.high")}).drop("__n", "__b")


def canonical_name(text: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore, compatibility forms resolved (NFKC)."""
    import unicodedata

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.regexp_replace(F.regexp_replace(folded(text), r"[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")
