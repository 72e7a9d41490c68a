import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from spotlake.llm.percentiles import joined, percentiles, summary

VALUE = "g string, d date, value double, n string, edge string"


def _exact(values, p):
    values = sorted(values)
    return values[max(1, (len(values) * p + 999) // 1000) - 1]


def _rows(seed, n=3000):
    rng = random.Random(seed)
    draw = [lambda: rng.lognormvariate(0, 3), lambda: -rng.random(), lambda: 5.0, lambda: rng.gauss(0, 1e6), lambda: rng.choice([1e-300, 1.7e308, -1.7e308, 0.0, -0.0])]
    return [(rng.choice(["a", "a", "a", "b", None]), datetime.date(2026, 1, rng.randint(1, 5)), rng.choice(draw)(), "x", "y") for _ in range(n)]


def test_percentiles_are_exact(spark):
    rows = _rows(1) + [("a", None, math.nan, "", ""), ("a", None, math.inf, "", ""), ("a", None, None, "", ""), ("empty", None, math.nan, "", "")]
    got = {(r.g, r.per_mille): (r.value, r.n, r.error) for r in percentiles(spark.createDataFrame(rows, VALUE), ["g"], (1, 500, 900, 1000)).collect()}
    for g in ("a", "b", None):
        values = [v for k, _, v, *_ in rows if k == g and v is not None and math.isfinite(v)]
        for p in (1, 500, 900, 1000):
            assert got[g, p] == (_exact(values, p), len(values), 0.0)
    assert ("empty", 500) not in got and len(got) == 12


def test_broadcast_and_shuffled_joins_agree(spark):
    df = spark.createDataFrame(_rows(2, 800), VALUE)
    a, b = (sorted(map(str, percentiles(df, ["g", "d"], broadcast_rows=k).collect())) for k in (0, 10**6))
    assert a == b


def test_error_is_bounded(spark):
    rows = [("a", None, random.Random(i).random() * 100, "", "") for i in range(2000)]
    for r in percentiles(spark.createDataFrame(rows, VALUE), ["g"], error=0.5).collect():
        assert r.error <= 0.5 and abs(r.value - _exact([x[2] for x in rows], r.per_mille)) <= r.error + 1e-9


def test_days_can_be_joined(spark):
    rng = random.Random(5)
    rows = [("a", datetime.date(2026, 1, rng.randint(1, 9)), rng.choice([1, 1, -1]) * rng.lognormvariate(0, 2), "", "") for _ in range(3000)] + [("a", datetime.date(2026, 1, 1), 0.0, "", "")]
    days = summary(spark.createDataFrame(rows, VALUE), ["g", "d"], 0.02)
    merged = joined(days, ["g"])
    assert merged.agg(F.sum("n")).first()[0] == len(rows)
    for r in percentiles(merged, ["g"], value="middle", weight="n").collect():
        exact = _exact([x[2] for x in rows], r.per_mille)
        assert r.n == len(rows) and abs(r.value - exact) <= abs(exact) * 0.02 + 1e-12


def test_empty(spark):
    assert percentiles(spark.createDataFrame([], VALUE), ["g"]).count() == 0
    assert summary(spark.createDataFrame([], VALUE), ["g"]).count() == 0
    with pytest.raises(ValueError):
        summary(spark.createDataFrame([], VALUE), ["g"], 1.5)
