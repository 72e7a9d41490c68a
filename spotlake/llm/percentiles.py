"""Percentiles of very large numeric columns by exact bisection.

Every group keeps a few disjoint value intervals, each with the percentiles whose rank lies in it. A pass counts the
rows below the midpoints of each interval (several midpoints at once), keeps the parts in which a target rank lies
and shrinks them to the values found there, until a part holds one value or is as narrow as the error allowed. Rows
outside all intervals are dropped from the next pass. Counts below given midpoints add up, so partitions and days can
be counted apart; :func:`summary` keeps such counts for fixed midpoints.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.scale import broadcast_within, cut, stored

PARTS = 16


def percentiles(
    values: DataFrame, group: list[str], per_mille: Sequence[int] = (50, 250, 500, 750, 950, 990), error: float = 0.0, value: str = "value",
    weight: str | None = None, broadcast_rows: int = 200_000,
) -> DataFrame:
    """(group columns, ``per_mille``, ``n``, ``value``, ``error``): the value of rank ceil(n * per_mille / 1000), at least 1.

    ``error`` is half the width of the interval left, at most the ``error`` asked for; 0 means the exact value. Null,
    NaN and infinite values do not count; null group values form a group of their own; a group without values does not
    appear. ``weight`` (a positive integer column) repeats a value, as for merged summaries. Every pass shrinks every interval, so
    the passes end by themselves; none is given up.
    """
    names = [f"g{i}" for i in range(len(group))]
    number = F.col(value).cast("double")
    rows = values.select(*[F.col(c).cast("string").alias(n) for c, n in zip(group, names, strict=True)], number.alias("v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("w"))
    rows = rows.where("v is not null and not isnan(v) and abs(v) < double('Infinity') and w > 0")
    # Null-safe keys: nulls become a marker that no value has.
    rows = rows.select(*[F.coalesce(F.concat(F.lit("="), n), F.lit("")).alias(n) for n in names], F.col("v") + F.lit(0.0), "w").toDF(*names, "v", "w")
    kinds = {c: values.schema[c].dataType for c in group}
    rank = lambda p: F.greatest(F.lit(1), F.floor((F.col("n") * p + 999) / 1000)).cast("bigint")
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), rank(p).alias("k")) for p in sorted(set(per_mille))])
    # Parts of all passes: interval, rows below it, and the targets inside.
    state = rows.groupBy(*names).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = cut(state.select(*names, "n", "lo", "hi", F.lit(0).cast("bigint").alias("below"), wanted.alias("targets")))
    done: list[DataFrame] = []
    base = rows
    for turn in count():
        narrow = (F.col("hi") / 2 - F.col("lo") / 2) <= error
        done.append(state.where(narrow))
        state = state.where(~narrow)
        if not state.limit(1).count():
            break
        keyed = state.select(*names, "lo", "hi")
        side = broadcast_within(keyed, broadcast_rows)
        if turn:
            hit = base.join(side.withColumnsRenamed({"lo": "l", "hi": "h"}), names).where("v >= l and v <= h")
            base = stored(hit.select(*names, "v", "w", "l", "h"))
            inside = base
        else:
            inside = base.join(side.withColumnsRenamed({"lo": "l", "hi": "h"}), names)
        width = F.col("h") / 2 - F.col("l") / 2
        share = (F.col("v") / 2 - F.col("l") / 2) / width
        part = F.when(width <= 0, F.when(F.col("v") > F.col("l"), PARTS - 1).otherwise(0)).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))
        counted = inside.groupBy(*names, F.col("l").alias("lo"), part.cast("int").alias("part")).agg(F.sum("w").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        over = Window.partitionBy(*names, "lo").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = counted.withColumn("upto", F.sum("c").over(over))
        joined = upto.join(broadcast_within(state.select(*names, "lo", "n", "below", "targets"), broadcast_rows), [*names, "lo"])
        joined = joined.withColumn("from", F.col("below") + F.col("upto") - F.col("c"))
        mine = F.filter("targets", lambda t: (t.k > F.col("from")) & (t.k <= F.col("below") + F.col("upto")))
        state = cut(joined.withColumn("mine", mine).where(F.size("mine") > 0).select(*names, "n", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("from").alias("below"), F.col("mine").alias("targets")))
        if turn:
            base = base.drop("l", "h")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    half = F.col("hi") / 2 - F.col("lo") / 2
    back = [F.when(F.col(n) != "", F.substr(n, F.lit(2))).cast(kinds[c]).alias(c) for c, n in zip(group, names, strict=True)]
    out = out.withColumn("t", F.explode("targets"))
    return out.select(*back, F.col("t.p").alias("per_mille"), "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + half).alias("value"), half.alias("error"))


def halvings(relative: float) -> int:
    """How often an octave is halved until a value is within ``relative`` of the middle of its part."""
    return max(0, math.ceil(-math.log2(math.log2((1 + relative) / (1 - relative)))))


def summary(values: DataFrame, group: list[str], relative: float = 0.01, value: str = "value") -> DataFrame:
    """Counts between fixed midpoints that do not depend on the data: (group, ``edge``, ``n``, ``middle``).

    The midpoints are those of the bisection of the logarithm to base 2, each octave halved until a part's ends are within
    (1 + relative) / (1 - relative) of each other, on both sides of 0: a value lies within ``relative`` of its ``middle`` (0 stands for itself). Summaries of the same ``relative`` are joined by adding up ``n``; see
    :func:`joined`. Null, NaN and infinite values do not count.
    """
    if not 0 < relative < 1:
        raise ValueError("relative must lie in (0, 1)")
    step = math.log(2) / 2 ** halvings(relative)
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    level = F.ceil(F.log(F.abs(v)) / step).cast("int")
    edge = F.when(v > 0, level + 1_000_000).when(v < 0, -(level + 1_000_000)).otherwise(0).cast("int")
    middle = F.when(F.col("edge") == 0, 0.0).otherwise(F.signum(F.col("edge").cast("double")) * F.exp((F.abs("edge") - 1_000_000) * step) * (1 - relative))
    return rows.groupBy(*group, edge.alias("edge")).agg(F.count("*").alias("n")).withColumn("middle", middle)


def joined(summaries: DataFrame, group: list[str]) -> DataFrame:
    """Summaries of finer groups (days, runs, partitions) added up to ``group``."""
    return summaries.groupBy(*group, "edge").agg(F.sum("n").alias("n"), F.first("middle").alias("middle"))
