"""Long exact spans shared between records by relative Lempel-Ziv parsing against an index of reference blocks.

Every window of ``least`` characters is keyed by the least hash of the seeds (strings of some characters) in it, so equal
windows have equal keys wherever they stand. A record falls into blocks, the runs of windows of one key; the blocks of
all records are the reference. A block whose text several records hold is one factor as it stands. Any other block is
parsed against every reference block of its key: their suffixes are put in order, and at each place the greatest factor
that another record holds is taken; factors that reach ``least`` are the shared spans. Keys with more blocks than one
task should order are parted: their blocks are cut anew by longer seeds, in the end by whole windows, and parsed alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.rolling import Rolling, code_points, mix, sliding_least
from spotlake.llm.suffixes import Suffixes
from spotlake.operators.scale import broadcast_within, stored

SEED = 64
EDGE = 24
PIECE = 1 << 20
BLOCK = "key bigint, digest bigint, head string, tail string, id bigint, base bigint, start bigint, windows bigint, whole boolean"


def blocks_of(text: str, least: int, piece: int = PIECE, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, digest, start, windows) of the blocks of one text, in pieces of bounded size that overlap by a window.

    Where the seed is the whole window, all windows of a block are equal and the digest is that of one.
    """
    seed = min(seed, least)
    for at in range(0, len(text) - least + 1, piece):
        part = code_points(text[at : at + piece + least - 1])
        rolling = Rolling(mix(part.astype(np.uint64) + np.uint64(1)))
        key = sliding_least(rolling.windows(seed), least - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.concatenate([first[1:], [len(key)]]) - 1
        digest = rolling.spans(first, (first if seed == least else last) + least)
        yield key[first].view(np.int64), digest.view(np.int64), first + at, last - first + 1


def _index(parts: Iterator[pd.DataFrame], least: int, seed: int, digest_bits: int) -> Iterator[pd.DataFrame]:
    edge = min(EDGE, least)
    for part in parts:
        owner, found, heads, tails = [], [], [], []
        for i, text in enumerate(part["text"]):
            for block in blocks_of(text, least, seed=seed):
                owner.append(np.full(len(block[0]), i))
                found.append(block)
                for start, windows in zip(block[2].tolist(), block[3].tolist(), strict=True):
                    heads.append(text[start : start + edge])
                    tails.append(text[start + windows + least - 1 - edge : start + windows + least - 1])
        if found:
            row = np.concatenate(owner)
            key, digest, start, windows = (np.concatenate(c) for c in zip(*found, strict=True))
            doc, base, whole = (part[c].to_numpy()[row] for c in ("id", "base", "whole"))
            short = digest >> np.int64(64 - digest_bits) if digest_bits else 0
            yield pd.DataFrame({"key": key, "digest": short, "head": heads, "tail": tails, "id": doc, "base": base, "start": start + base, "windows": windows, "whole": whole})


def factor(blocks: pd.DataFrame, least: int) -> pd.DataFrame:
    """Factors (id, start, end) of at least ``least`` characters: greatest strings of each block that a block of another record holds.

    ``blocks``: id, start, text, whole (the block's text stands in several records: a reference for all, not parsed itself).
    The order of the suffixes is one of characters, so a factor's text is equal from boundary to boundary.
    """
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "start", "end")})
    if not len(blocks):
        return empty
    doc, start, whole = blocks["id"].to_numpy(), blocks["start"].to_numpy(), blocks["whole"].to_numpy(bool)
    sizes = np.array([len(t) for t in blocks["text"]])
    # A mark that no text has stands after each block: no string of equal characters leaves its block unnoticed.
    codes = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    offset = np.arange(len(codes)) - begin[row]
    codes[offset < sizes[row]] = code_points("".join(blocks["text"]))
    left = sizes[row] - offset
    suffixes = Suffixes(codes, int(sizes.max()))
    at = suffixes.order[left[suffixes.order] >= least]
    if not len(at):
        return empty
    # In the order, the nearest suffixes of other records on both sides hold the longest common prefixes.
    owner = np.where(whole[row[at]], -1 - np.arange(len(at)), doc[row[at]])
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
    before, after = new[run] - 1, np.append(new[1:], len(at))[run]
    length = np.zeros(len(codes), np.int64)
    for near in (before, after):
        known = np.flatnonzero((near >= 0) & (near < len(at)) & ~whole[row[at]])
        common = np.minimum(suffixes.common(at[known], at[near[known]], least), left[at[known]])
        length[at[known]] = np.maximum(length[at[known]], common)
    # A factor begins where the greatest one from the place before ends earlier, so what crosses a boundary is kept.
    end = np.where(length >= least, np.arange(len(codes)) + length, 0)
    keep = np.flatnonzero((end > 0) & (end > np.concatenate([[0], end[:-1]])))
    found = start[row[keep]] + offset[keep]
    return pd.DataFrame({"id": doc[row[keep]], "start": found, "end": found + length[keep]})


def shared_spans(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400, rows_each: int = 2_000, hot: int = 8_000,
    windows_each: int = 1_000_000, digest_bits: int = 64,
) -> DataFrame:
    """(``id_col``, ``start``, ``end``): the maximal spans of each text made of passages of ``least`` characters that
    also stand in the text of another id. Positions are code points, end exclusive.

    Ids must be integers; repeated rows of one id are one record with that id (a passage is shared only between ids).
    Null, empty and short texts have no spans. A task orders the blocks of its keys: about ``rows_each`` blocks, and no
    key with more than ``hot`` blocks or ``windows_each`` windows, which is parted by longer seeds. Blocks count as the same
    text if key, length, digest (of ``digest_bits`` bits) and the text at both boundaries are equal.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("base"), F.col(text_col).alias("text"), F.lit(False).alias("whole"))
    texts = docs.where(f"id is not null and length(text) >= {int(least)}")
    seeds = sorted({min(SEED, least), (min(SEED, least) + least) // 2, least})
    found = []
    for seed in seeds:
        spans, texts = _parsed(texts, least, seed, seed == least, rows_each, hot, windows_each, digest_bits)
        found += spans
        if texts is None:
            break
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return merged(spans).withColumnRenamed("id", id_col)


def _parsed(
    texts: DataFrame, least: int, seed: int, final: bool, rows_each: int, hot: int, windows_each: int, digest_bits: int
) -> tuple[list[DataFrame], DataFrame | None]:
    """Spans of ``texts`` (id, base, text, whole) by blocks of one seed length, and the blocks whose keys are crowded, as texts."""
    rows = stored(texts.mapInPandas(lambda parts: _index(parts, least, seed, digest_bits), BLOCK))
    held = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("whole").alias("w"), F.min("whole").alias("all"))
    common = stored(rows.join(held.where("not all and (w or a <> b)").select("key"), "key"))
    same = ["key", "digest", "head", "tail"] + ([] if final else ["windows"])
    holder = F.min_by(F.struct("base", "start", F.col("windows").alias("n")), F.struct("id", "base", "start")).alias("h")
    several = common.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("other"), F.max("whole").alias("w"), holder).where("w or first <> other")
    several = stored(several.select(*same, "first", "h.base", "h.start", *(["h.n"] if final else [])))
    shared = common.join(several.select(*same, F.lit(True).alias("several")), same, "left")
    judged = stored(shared.withColumn("several", F.coalesce("several", F.lit(False))))
    ends = (F.col("start") + F.col("windows") + (least - 1)).alias("end")
    spans = [judged.where("several and not whole").select("id", "start", ends)]
    torn = judged.where("not several and not whole")
    # One holder stands for all records that share a block.
    one = several.withColumnRenamed("n", "windows") if final else several
    one = one.withColumnRenamed("first", "id").join(torn.select("key").distinct(), "key", "left_semi").withColumn("whole", F.lit(True))
    own = ["key", "id", "base", "start", "windows", "whole", "head", "tail"]
    wanted = stored(torn.select(*own).unionByName(one.select(*own)))
    loads = wanted.groupBy("key").agg(F.count("*").alias("n"), F.sum("windows").alias("w"))
    crowd = stored(loads.where((F.col("n") > hot) | (F.col("w") > windows_each)).select("key"))
    total, windows = wanted.agg(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0))).first()
    crowded = not final and crowd.limit(1).count() > 0
    if not total:
        return spans, None
    by_text = wanted.groupBy("id", "base").agg(F.collect_list(F.struct("key", "start", "windows", "whole", "head", "tail")).alias("blocks"))
    by_text = broadcast_within(stored(by_text), 200_000)

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, base, text, blocks in zip(part["id"], part["base"], part["text"], part["blocks"], strict=True):
                for b in blocks:
                    cut = text[b["start"] - base : b["start"] - base + b["windows"] + least - 1]
                    if len(cut) == b["windows"] + least - 1 and cut.startswith(b["head"]) and cut.endswith(b["tail"]):
                        out.append((b["key"], doc, b["start"], cut, b["whole"]))
            yield pd.DataFrame(out, columns=["key", "id", "start", "text", "whole"])

    fetched = texts.drop("whole").join(by_text, ["id", "base"]).mapInPandas(pick, "key bigint, id bigint, start bigint, text string, whole boolean")
    further = None
    if crowded:
        fetched = stored(fetched)
        further = fetched.join(crowd, "key", "left_semi").select("id", F.col("start").alias("base"), "text", "whole").distinct()
        fetched = fetched.join(crowd, "key", "left_anti")
    n = max(1, total // rows_each, windows // windows_each)
    # A stated number of partitions: by bytes alone, few tasks would order all suffixes.
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, 4 * spark.sparkContext.defaultParallelism))
    placed = fetched.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n))).repartition(tasks, "part")
    spans.append(placed.groupBy("part").applyInPandas(lambda b: factor(b, least), "id bigint, start bigint, end bigint"))
    return spans, further


def merged(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap within an id become one."""
    by = Window.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    numbered = marked.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")
