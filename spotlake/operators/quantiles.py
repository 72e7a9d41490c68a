"""Exact quantiles per group by counting passes: no buffer ever holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.scale import broadcast_within, cut, stored

STEPS = 256


def ranked(values: DataFrame, group: list[str], ranks: DataFrame, value: str = "v") -> DataFrame:
    """(group, ``rank``, ``value``): the value that stands at each rank (0 is the least) of its group.

    ``ranks`` has (group, rank); null groups are groups. Values must be finite numbers. Each pass counts the values of every open interval
    in ``STEPS`` parts and keeps the parts, shrunk to the values found there, in which a rank lies; values outside are
    read no more. It ends when every interval is one value.
    """
    number = F.col(value).cast("double") + F.lit(0.0)
    rows = values.select(F.struct(*group, F.lit(0).alias("__one")).alias("g"), number.alias("v"))
    wanted = ranks.select(F.struct(*group, F.lit(0).alias("__one")).alias("g"), F.col("rank").cast("bigint").alias("k")).distinct()
    ends = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = cut(wanted.join(ends, "g").groupBy("g", "lo", "hi").agg(F.lit(0).cast("bigint").alias("below"), F.collect_list("k").alias("ks")))
    done = []
    while True:
        done.append(state.where("lo = hi"))
        state = state.where("lo < hi")
        if not state.limit(1).count():
            break
        side = broadcast_within(state.select("g", "lo", "hi"), 200_000)
        inside = rows.join(side, "g").where("v >= lo and v <= hi")
        rows_in = inside.select("g", "lo", "hi", "v")
        width = F.col("hi") / 2 - F.col("lo") / 2
        share = (F.col("v") / 2 - F.col("lo") / 2) / width
        part = F.when(width <= 0, F.when(F.col("v") > F.col("lo"), STEPS - 1).otherwise(0)).otherwise(F.least(F.floor(share * STEPS), F.lit(STEPS - 1))).cast("int")
        counted = rows_in.groupBy("g", "lo", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy("g", "lo").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        joined = counted.withColumn("upto", upto).join(broadcast_within(state.select("g", "lo", "below", "ks"), 200_000), ["g", "lo"])
        joined = joined.withColumns({"from": F.col("below") + F.col("upto") - F.col("c"), "to": F.col("below") + F.col("upto")})
        joined = joined.withColumn("mine", F.filter("ks", lambda k: (k >= F.col("from")) & (k < F.col("to")))).where("size(mine) > 0")
        state = cut(joined.select("g", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("from").alias("below"), F.col("mine").alias("ks")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("g", F.explode("ks").alias("rank"), F.col("lo").alias("value")).select(*[F.col("g").getField(c).alias(c) for c in group], "rank", "value")


def quantiles(values: DataFrame, group: list[str], shares: dict[str, float], value: str = "v") -> DataFrame:
    """(group, ``n``, one column per share): linearly interpolated quantiles of the finite values of each group."""
    rows = stored(values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf"))).select(*group, F.col(value).alias("v")))
    sizes = stored(rows.groupBy(*group).agg(F.count("*").alias("n")).where("n > 0"))
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    both = F.array(*[r for q in shares.values() for r in (F.floor(at(q)), F.ceil(at(q)))])
    found = ranked(rows, group, sizes.select(*group, F.explode(F.array_distinct(both)).alias("rank")))
    packed = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__m"))
    named = packed.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], "__m")
    on = F.lit(True)
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    low, high = (lambda q: F.col("__m")[F.floor(at(q))]), (lambda q: F.col("__m")[F.ceil(at(q))])
    between = {n: low(q) + (high(q) - low(q)) * (at(q) - F.floor(at(q))) for n, q in shares.items()}
    return sizes.join(named, on).withColumns(between).select(*group, "n", *shares)


def medians(values: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, one median per column)."""
    long = values.select(*group, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*group, "x.*")
    found = quantiles(long, [*group, "c"], {"m": 0.5})
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(c) for c in columns])
