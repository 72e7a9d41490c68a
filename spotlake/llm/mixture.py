"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies. Expected copies are summed up along a fixed order
within the source (documents of about equal size stand together, so sizes are sampled evenly), one random offset is
added, and a document is emitted once per integer boundary that its stretch crosses.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.keys import source_key
from spotlake.operators.scale import blocks, broadcast_within, prefix_sum, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str):
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """Add the number of tokens of a text; a null text has none. Only columns that are used further reach Python."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for part in parts:
            yield pd.Series([0 if t is None else len(encode(t)) for t in part], dtype="int64")

    return documents.withColumn(out, count(text_col))


def rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, rate, cap): expected copies per document of each source of ``sizes`` (source, tokens) with a positive target.

    Shares are scaled to the sources that have tokens. Without ``total`` the mixture is the largest in which every
    source reaches its share within its cap; with one, sources that cannot are used up to their cap.
    """
    use = sizes.where("tokens > 0").join(targets.where("target_share > 0 and max_repeats > 0"), "source")
    use = use.select("source", "tokens", F.col("target_share").alias("w"), F.col("max_repeats").alias("cap"))
    whole = use.agg(F.sum("w").alias("whole"))
    shared = use.join(whole, F.lit(True)).withColumn("most", F.col("cap") * F.col("tokens") * F.col("whole") / F.col("w"))
    if total is None:
        shared = shared.join(shared.agg(F.min("most").alias("total")), F.lit(True))
    else:
        shared = shared.withColumn("total", F.lit(float(total)))
    rate = F.least(F.col("cap").cast("double"), F.col("total") * F.col("w") / F.col("whole") / F.col("tokens"))
    return shared.select("source", rate.alias("rate"), "cap")


def mix(
    documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", total: float | None = None, seed: int = 0, path: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of ``documents`` (id, ``source``, ``text``) for ``targets`` (``source``, ``target_share``, ``max_repeats``).

    The mixture has one row per used document: id, source (in its normal spelling), n_tokens and copies (at most
    max_repeats, rounded up to a whole number of times). Documents whose source is null or has no target are not used.
    A target given twice counts with its greatest share. The report has every target with tokens at hand, tokens
    used, the share reached, documents used and the most copies of one; sources without documents reach 0.
    """
    targets = targets.select(source_key().alias("source"), "target_share", F.col("max_repeats").cast("int").alias("max_repeats"))
    targets = stored(targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats")))
    named = documents.select(F.col(id_col).alias("id"), source_key().alias("source"), "text")
    used = named.join(targets.select("source"), "source", "left_semi")
    sized = stored(token_counts(used, path=path).select("id", "source", "n_tokens"))
    each = max(64, blocks(sized, 2_000_000))
    sizes = stored(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")))
    # One random offset per source, drawn by its name and the seed.
    offset = F.pmod(F.xxhash64("source", F.lit(seed), F.lit("offset")), F.lit(1 << 40)) / float(1 << 40)
    plan = stored(rates(sizes, targets, total).withColumn("offset", offset))
    like = F.floor(F.log2(F.col("n_tokens") + 1.0) * 4) * each + F.pmod(F.xxhash64("id"), F.lit(each))
    placed = prefix_sum(sized.withColumn("one", F.lit(1)), "one", ["id"], "rank", ["source"], bucket=like)
    placed = placed.join(broadcast_within(plan, 100_000), "source")
    crossed = F.floor(F.col("rate") * (F.col("rank") + 1) + F.col("offset")) - F.floor(F.col("rate") * F.col("rank") + F.col("offset"))
    mixture = placed.withColumn("copies", F.least(crossed, F.col("cap").cast("bigint"))).where("copies > 0")
    mixture = stored(mixture.select(F.col("id").alias(id_col), "source", "n_tokens", "copies"))
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
    all_ = reached.agg(F.sum("mixed_tokens").alias("mixed"))
    report = targets.join(sizes, "source", "left").join(reached, "source", "left").join(all_, F.lit(True)).select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "used_documents", "mixed_tokens", "most_copies")],
        F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("mixed")), F.lit(0.0)).alias("reached_share"),
    )
    return mixture, report
