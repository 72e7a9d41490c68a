"""Run catalogue and pages: entries, latest run, filtered pages, reason counts and even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.scalars import parse_bool
from spotlake.operators.quantiles import medians
from spotlake.operators.scale import cut, least_rows, numbered, prefix_sum, stored


def dataset_kind(status: Column, name: Column) -> Column:
    return F.when(status != "completed", "failed").when(F.lower(name).contains("synthetic"), "synthetic").otherwise("real_exploratory")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of at most 200 rows in a total order; a top-k per partition feeds the final sort."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("pages start at 1 and have 1 to 200 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def filtered(df: DataFrame, status: str = "all", reason: str = "", item: str = "", id_col: str = "defect_id") -> DataFrame:
    """Candidates of a status (all, accepted or rejected), with a reason among theirs and of an id, both exact; blank means any.

    Needs ``accepted`` and ``rejection_reason`` (joined by ``;``), null reasons being none.
    """
    status, reason, item = (status or "").strip().lower() or "all", (reason or "").strip(), (item or "").strip()
    if status not in ("all", "accepted", "rejected"):
        raise ValueError("status is all, accepted or rejected")
    if status != "all":
        df = df.where(parse_bool(F.col("accepted")) == (status == "accepted"))
    if reason:
        df = df.where(F.array_contains(F.transform(F.split(F.coalesce("rejection_reason", F.lit("")), ";"), lambda r: F.trim(r)), reason))
    return df.where(F.trim(F.col(id_col).cast("string")) == item) if item else df


def with_labels(page: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``label``: that of the last verdicts (keys, ``label``), 'conflict' where they differ, null without any.

    Only the verdicts on the page's keys are aggregated.
    """
    own = verdicts.join(page.select(*keys).distinct(), keys, "left_semi").where("label is not null")
    one = own.groupBy(*keys).agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise("conflict").alias("label"))
    return page.join(one, keys, "left")


def safe_name(text: Column) -> Column:
    """Whether a run id or relative path can be used: letters, digits, dot, dash, underscore, parts by ``/``, none of them only dots or blank."""
    return F.coalesce(text.rlike(r"\A(?!\.+(/|\z))[A-Za-z0-9._-]+(/(?!\.+(/|\z))[A-Za-z0-9._-]+)*\z"), F.lit(False))


def shared_slots(accepted: int, rejected: int, slots: int) -> tuple[int, int]:
    """How many accepted and rejected rows fill ``slots`` places: half each, accepted first, and what one side leaves goes to the other."""
    first = max(min(accepted, (slots + 1) // 2), min(accepted, slots - rejected))
    return first, min(rejected, slots - first)


def joined_once(*lists: Column) -> Column:
    """The values of several arrays, each at its first place; null arrays and null values are left out."""
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])))


def page_info(df: DataFrame, size: int) -> DataFrame:
    """Rows and pages of a filtered table; an empty one has one page."""
    n = F.count("*")
    return df.agg(n.alias("total"), F.greatest(F.lit(1).cast("bigint"), F.ceil(n / size)).alias("total_pages"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest completed run, else the newest failed one."""
    return runs.orderBy((F.col("status") == "completed").desc(), F.desc("at"), F.desc("run_id")).limit(1)


def renumbered(df: DataFrame, group: list[str], order: list[str], out: str = "number") -> DataFrame:
    """1..n within a group in a total order; a group may be spread over many tasks."""
    return numbered(df, group, order, "__at").withColumn(out, F.col("__at") + 1).drop("__at")


def evenly_spaced(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group at even positions from the first to the last (all rows of smaller groups)."""
    rows = stored(numbered(df, group, order, "__i"))
    sizes = rows.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]).agg(F.count("*").alias("__n"))
    on = F.lit(True)
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    place = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("__n") - 1) / max(1, k - 1)))
    return rows.join(sizes, on).where(F.array_contains(place, F.col("__i").cast("bigint"))).drop("__i", "__n", *[f"__g{i}" for i in range(len(group))])


def class_sample(df: DataFrame, label: str, key: list[str], k: int, seed: int) -> DataFrame:
    """Up to k rows of every class without replacement, by the order of a seeded hash."""
    hashed = df.withColumn("__h", F.xxhash64(*key, F.lit(seed)))
    return least_rows(hashed, [label], ["__h", *key], k, "__r").drop("__h", "__r")


def farthest_points(points: DataFrame, k: int = 6) -> DataFrame:
    """k points (id, x, y) spread out: first the one nearest the coordinate medians, then always the farthest from all chosen.

    Every step is one aggregate over the points; ties go to the smallest id.
    """
    points = stored(points)
    middle = medians(points, [], ["x", "y"]).select(F.col("x").alias("mx"), F.col("y").alias("my"))
    rows = cut(points.join(middle, F.lit(True)).withColumn("far", -F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).drop("mx", "my"))
    chosen = []
    while len(chosen) < k:
        best = rows.where(~F.col("id").isin([c.id for c in chosen]) if chosen else F.lit(True)).agg(F.max(F.struct("far", F.struct((-F.col("id")).alias("n")), "id", "x", "y")).alias("m")).first().m
        if best is None:
            break
        away = F.hypot(F.col("x") - best.x, F.col("y") - best.y)
        rows = rows.withColumn("far", F.least("far", away) if chosen else away)
        chosen.append(best)
    return points.sparkSession.createDataFrame([(i + 1, c.id, c.x, c.y) for i, c in enumerate(chosen)], "place int, id bigint, x double, y double")


def systematic(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row of a fixed order, from a distributed running count."""
    return prefix_sum(df.withColumn("__one", F.lit(1)), "__one", order, "__at").where(F.col("__at") % step == 0).drop("__one", "__at")
