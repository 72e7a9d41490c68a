"""Building blocks that keep the larger operators distributed: lineage cuts, checked broadcasts, prefix sums, skew joins."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    present = context.getCheckpointDir()
    if present:
        return present
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(made)
    return made


_written: list[str] = []


def scoped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after which the tables it stored are removed, but for those its result still reads.

    These last until the process ends.
    """

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        before = len(_written)
        kept: set[str] = set()
        try:
            out = query(spark, folder)
            kept = {part for f in out.inputFiles() for part in f.split("/")} if len(_written) > before else kept
            return out
        finally:
            mine = _written[before:]
            removed(spark, [p for p in mine if p.rsplit("/", 1)[1] not in kept])

    return run


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables."""
    if not paths or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(p)


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession() if _written else None
        if spark is not None:
            removed(spark, list(_written))


def cut(df: DataFrame) -> DataFrame:
    """Materialise small, iterated state and forget its plan.

    A written table rather than ``checkpoint()``: a checkpointed frame keeps the constraints of the plan it came from,
    and over rounds of joins with ``coalesce`` those grow exponentially on the driver.
    """
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a compressed table in the shared folder and read it again (large intermediate rows)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else unchanged (a shuffled,
    skew-split join). Texts count with their lengths, arrays with 64 bytes an entry, all else with 16 bytes a column.

    ``df`` should be cheap to count, i.e. come from :func:`cut` or :func:`stored`.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            size = size + 64 * F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes else df


def blocks(df: DataFrame, rows_each: int) -> int:
    """How many hash blocks of about ``rows_each`` rows ``df`` needs."""
    return max(1, -(-df.count() // rows_each))


def prefix_sum(
    df: DataFrame, value: str, order: list[str], out: str, within: list[str] | None = None, buckets: int | None = None, bucket: Column | None = None, rows_each: int = 200_000
) -> DataFrame:
    """Exclusive running sum of ``value`` in the total order (hash bucket of ``order``, ``order``), per ``within``.

    No window ever covers a whole group: rows fall into ``buckets`` hash buckets (as many as give ``rows_each`` rows each,
    at least 16, unless stated), each bucket is summed (with map-side partial sums), the at most ``buckets`` totals of a
    group are accumulated, and rows are only ordered inside their bucket. The order is arbitrary but fixed by the values
    of ``order`` and the buckets. ``bucket`` (an integer of so many values that a bucket stays small) replaces the hash
    bucket to order by something else first. A null ``value`` counts as 0.
    """
    if bucket is None and buckets is None:
        buckets = max(16, blocks(df, rows_each))
    within = within or []
    amount = F.coalesce(F.col(value), F.lit(0))
    df = df.withColumn("__b", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(buckets)) if bucket is None else bucket)
    keys = [*within, "__b"]
    totals = df.groupBy(*keys).agg(F.sum(amount).alias("__t"))
    over = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = df.withColumn("__i", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    starts = starts.toDF(*[f"__k{i}" for i in range(len(keys))], "__s")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (
        left.join(starts, on, "left")
        .withColumn(out, F.col("__i") + F.col("__s"))
        .drop("__b", "__i", "__s", *[f"__k{i}" for i in range(len(keys))])
    )


def least_rows(df: DataFrame, group: list[str], order: list[str], k: int, place: str) -> DataFrame:
    """The first k rows of each group in a total order, numbered from 1; hash parts of a group are cut to k rows before they meet."""
    part = F.pmod(F.xxhash64(*order), F.lit(1024))
    some = df.withColumn("__p", part).withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__p").orderBy(*order))).where(F.col("__r") <= k).drop("__p", "__r")
    return some.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= k)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows_each: int = 200_000) -> DataFrame:
    """0, 1, ... within each group in the order of ``order`` (a total one), without a window over a whole group.

    Rows are sorted by range over all groups, counted per range and group, and numbered within the range from the counts before.
    ``df`` is stored once.
    """
    parts = max(1, blocks(df, rows_each))
    ranged = df.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in [*group, *order]]) if parts > 1 else df
    rows = stored(ranged.withColumn("__p", F.spark_partition_id() if parts > 1 else F.lit(0)))
    keys = [*group, "__p"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__s")
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("__in", inside).join(before, on).withColumn(out, F.col("__in") + F.col("__s")).drop("__in", "__s", "__p", *[f"__k{i}" for i in range(len(keys))])


def trimmed(c: Column | str) -> Column:
    """Without leading and trailing spaces, tabs, CR and LF."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n"))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
