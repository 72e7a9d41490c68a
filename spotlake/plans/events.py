"""Queries on the event and sales tables: windows in time, as-of joins, rollups and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spotlake.operators.scale import broadcast_within, least_rows, stored, table
from spotlake.streaming.windows import sessions, tumbling


def _text_time(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def tumbling_events(spark, d):
    out = tumbling(table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(20,6)")), "1 hour")
    return _text_time(out, "start", "end").withColumn("total", F.round(F.col("total").cast("double"), 4))


def session_events(spark, d):
    return _text_time(sessions(table(spark, d, "events")), "start", "end")


def json_props(spark, d):
    rows = table(spark, d, "events", "event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return rows.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def asof_previous(spark, d):
    """Each event with the time since the user's event before it: an as-of join with itself as one window."""
    rows = table(spark, d, "events", "event_id", "user_id", "ts")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return rows.select("event_id", micros.alias("micros_since"))


def sales_rollup(spark, d):
    """Revenue by region and nation with their totals."""
    line = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    supp = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    supp = supp.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.groupBy("l_suppkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)")).alias("part")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    out = rows.rollup("r_name", "n_name").agg(F.sum("part").alias("revenue"), F.grouping_id().cast("int").alias("level"))
    return out.withColumn("revenue", F.round(F.col("revenue").cast("double"), 2))


def nearest_vectors(spark, d, k: int = 5):
    """The k nearest embeddings of every label's mean vector.

    Means are one row per label and are carried as arrays; each vector is folded with a mean where it is read, and only the k
    nearest of a partition and label are shuffled.
    """
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    flat = rows.select("label", F.posexplode("embedding").alias("i", "v"))
    sums = flat.groupBy("label", "i").agg(F.avg("v").alias("m"))
    means = stored(sums.groupBy(F.col("label").alias("centre")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean")))
    near = F.aggregate(F.zip_with("embedding", "mean", lambda v, m: (v - m) * (v - m)), F.lit(0.0), lambda a, x: a + x)
    # The means are all compared with all vectors, as stated queries; their number is that of the labels.
    dist = rows.select("vec_id", "embedding").join(broadcast_within(means, 100_000), F.size("embedding") == F.size("mean")).select("centre", "vec_id", F.round(near, 7).alias("d2"))
    return least_rows(dist, ["centre"], ["d2", "vec_id"], k, "place").select("centre", "place", "vec_id")


QUERIES = {f.__name__: f for f in (tumbling_events, session_events, json_props, asof_previous, sales_rollup, nearest_vectors)}

SQL = {
    "tumbling_events": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n,
        round(sum(value::DECIMAL(20, 6))::DOUBLE, 4) AS total FROM events GROUP BY ALL""",
    "session_events": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
    "json_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "asof_previous": "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros_since FROM events",
    "sales_rollup": """SELECT r_name, n_name, round(sum((l_extendedprice * (1 - l_discount))::DECIMAL(20, 4))::DOUBLE, 2) AS revenue, grouping_id(r_name, n_name)::INT AS level
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "nearest_vectors": """WITH f AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT label AS centre, i, avg(v) AS m FROM f GROUP BY 1, 2), d AS (SELECT centre, vec_id, round(sum((v - m) * (v - m)), 7) AS d2 FROM f JOIN m USING (i) GROUP BY 1, 2)
        SELECT centre, row_number() OVER (PARTITION BY centre ORDER BY d2, vec_id)::INT AS place, vec_id FROM d QUALIFY place <= 5""",
}
