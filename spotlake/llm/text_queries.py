"""Queries of problems 7 (leaked evaluation texts), 8 (mixing sources) and 9 (long exact spans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm.leak import leaks
from spotlake.llm.mixture import mix
from spotlake.llm.spans import shared_spans
from spotlake.operators.scale import stored, table

PASSAGE_WORDS, PASSAGE_CHARS, COPY_COVERAGE = 12, 400, 0.5


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"), PASSAGE_WORDS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    least = 2 * PASSAGE_WORDS  # the alignment score of the shortest passage
    return _leaks(spark, d).where((F.col("score") >= least) & (F.col("run") >= PASSAGE_WORDS)).select("item_id", "doc_id")


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item, word for word or edited."""
    return _leaks(spark, d).where(F.col("coverage") >= COPY_COVERAGE)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents with a whole passage, with an edited copy, and the best coverage."""
    found = _leaks(spark, d).withColumnRenamed("item_id", "leaked")
    per_item = found.groupBy("leaked").agg(
        F.count_if(F.col("run") >= PASSAGE_WORDS).alias("passages"), F.count_if(F.col("coverage") >= COPY_COVERAGE).alias("copies"), F.max("coverage").alias("coverage")
    )
    items = table(spark, d, "eval_items", "item_id", "suite", "held_split")
    return items.join(per_item, F.col("item_id") == F.col("leaked"), "left").drop("leaked").fillna(0, ["passages", "copies"])


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[1]


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents", "doc_id", "text"), least=PASSAGE_CHARS)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """Per document: characters, shared characters, the share, and how many spans."""
    spans = _spans(spark, d).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("spans"))
    spans = stored(spans).withColumnRenamed("doc_id", "id")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    joined = docs.join(spans, F.col("doc_id") == F.col("id"), "left").drop("id").fillna(0, ["shared_chars", "spans"])
    return joined.withColumn("share", F.coalesce(F.try_divide("shared_chars", "chars"), F.lit(0.0)))


QUERIES = {f.__name__: f for f in (p7_found, p7_copies, p7_items, p8_mixture, p8_shares, p9_found, p9_spans, p9_shared)}

_WINDOWS = f"""
w AS (SELECT doc_id, i, hash(text[i:i + {PASSAGE_CHARS - 1}]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {PASSAGE_CHARS - 2})) AS i FROM documents)),
held AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN held USING (h)),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {PASSAGE_CHARS} THEN 0 ELSE 1 END AS fresh FROM hit),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, min(i) - 1 AS start, max(i) - 1 + {PASSAGE_CHARS} AS "end" FROM numbered GROUP BY doc_id, span)
"""


def _grams(name: str, own: str) -> str:
    # Words are ASCII, so lower() touches A-Z only.
    words = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))"
    return f"""SELECT DISTINCT {own}, array_to_string(w[i:i + {PASSAGE_WORDS - 1}], ' ') AS g
    FROM (SELECT {own}, w, unnest(range(1, len(w) - {PASSAGE_WORDS - 2})) AS i FROM (SELECT {own}, {words} AS w FROM {name}))"""


SQL = {
    "p7_found": f"WITH a AS ({_grams('eval_items', 'item_id')}), b AS ({_grams('documents', 'doc_id')}) SELECT DISTINCT item_id, doc_id FROM a JOIN b USING (g)",
    "p9_found": f"WITH {_WINDOWS} SELECT DISTINCT doc_id FROM spans",
    "p9_spans": f"WITH {_WINDOWS} SELECT * FROM spans",
    "p9_shared": f"""WITH {_WINDOWS}, s AS (SELECT doc_id, sum("end" - start)::BIGINT AS shared_chars, count(*) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0) AS chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(s.spans, 0) AS spans,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(shared_chars, 0)::DOUBLE / length(text) END AS share FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""",
}
