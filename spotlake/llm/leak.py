"""Evaluation texts leaking into training text: n-gram seeds, then Smith-Waterman alignment.

The corpus is read once for n-grams that may be those of evaluation items, by a bit table of bounded size; a join with the items'
n-grams decides. Every one that a document holds seeds a candidate at its place, however rare or common it is elsewhere, so what
other documents hold never hides a copy. Each place takes its stretch of the document with it, so that places, not documents,
are spread over the cluster, where item and stretch are aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.rolling import Rolling, mix
from spotlake.operators.scale import broadcast_within, stored

GRAM = 6
_byte = np.arange(256)
_is_word = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
_lower = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint64)
_value = mix(_lower + np.uint64(1))
PIECE = 1 << 18


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text's number) of texts laid end to end: text i is data[offsets[i]:offsets[i + 1]].

    Words are runs of ASCII letters and digits in lower case. The bytes are taken in pieces that end outside words.
    """
    inside = _is_word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE)))
        rolling = Rolling(_value[data[start[i] : end[j - 1]]])
        hashes[i:j] = rolling.spans(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return hashes, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size]
    return mix(total)


def align(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """(best local alignment score, longest run of equal words) of two word sequences (Smith-Waterman, linear gaps)."""
    best, run = align_many(item, [text], match, mismatch, gap)
    return int(best[0]), int(run[0])


def align_many(item: np.ndarray, texts: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """:func:`align` of one item with several texts at once, row by row of all their matrices.

    Shorter texts end in cells that match nothing; scores there never exceed those before them.
    """
    width = max(map(len, texts), default=0)
    words_, real = np.zeros((len(texts), width), np.uint64), np.zeros((len(texts), width), bool)
    for i, t in enumerate(texts):
        words_[i, : len(t)] = t
        real[i, : len(t)] = True
    before = np.zeros((len(texts), width + 1), np.int32)
    run = np.zeros_like(before)
    best, longest = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
    slope = (gap * np.arange(width + 1)).astype(np.int32)
    for word in item:
        same = (words_ == word) & real
        now = np.zeros_like(before)
        now[:, 1:] = np.maximum(before[:, :-1] + np.where(same, np.int32(match), np.int32(mismatch)), before[:, 1:] + np.int32(gap))
        np.maximum(now, 0, out=now)
        # Gaps along the row: the best of all earlier cells, each lowered by its distance.
        now = np.maximum(now, np.maximum.accumulate(now - slope, axis=1) + slope)
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        best, longest, before = np.maximum(best, now.max(axis=1)), np.maximum(longest, run.max(axis=1)), now
    return best, longest


def _item_grams(parts: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [word_hashes(t) for t in part["words"]]
        own = [np.unique(grams(w, n).view(np.int64)) for w in found]
        sizes = [len(g) for g in own]
        lengths = np.array([len(w) for w in found], np.int64)
        yield pd.DataFrame({"item": np.repeat(part["item"].to_numpy(), sizes), "size": np.repeat(lengths, sizes), "gram": np.concatenate([*own, np.empty(0, np.int64)])})


def bit_table(marks: DataFrame, most_bits: int = 29) -> tuple[np.ndarray, int]:
    """(words of 64 bits, address bits): a bit is set where some ``gram`` has these leading bits.

    About 64 bits a gram, at most 2**``most_bits`` (64 MiB): beyond, more grams pass that the join then drops, none is lost.
    The driver receives at most that many bytes, whatever the number of grams.
    """
    n = marks.count()
    bits = min(most_bits, max(12, (64 * n).bit_length()))
    place = F.shiftrightunsigned("gram", 64 - bits)
    rows = marks.select(F.shiftright(place, 6).alias("at"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    packed = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("w")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[packed["at"].to_numpy(np.int64)] = packed["w"].to_numpy(np.int64).view(np.uint64)
    return table, bits


def _hits(table, bits: int, n: int):
    shape = pa.schema([("id", pa.int64()), ("gram", pa.int64()), ("at", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            text = batch.column("text").cast(pa.large_utf8())
            buffers = text.buffers()
            offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if len(text) and buffers[2] else np.empty(0, np.uint8)
            offsets = offsets - (offsets[0] if len(offsets) else 0)
            hashes, owner = words(data, offsets)
            gram = grams(hashes, n)
            place = gram >> np.uint64(64 - bits)
            at = np.flatnonzero((known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            at = at[owner[at] == owner[at + n - 1]]
            first = np.searchsorted(owner, owner[at])
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(ids[owner[at]], pa.int64()), pa.array(gram[at].view(np.int64)), pa.array(at - first)], schema=shape)

    return find


def leaks(
    documents: DataFrame, items: DataFrame, passage: int = 12, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = 1_000_000, places_each: int = 1_000,
) -> DataFrame:
    """(item, document, ``score``, ``coverage``, ``run``) of every document that shares an n-gram with an item.

    ``score`` is the best local alignment (2 for an equal word, -1 for another or a gap), ``coverage`` its share of the
    item's full score, ``run`` the longest shared passage in words. Every pair with ``run`` >= ``passage`` is found;
    edited copies are found if they share any 6 words in a row with the item (``passage`` words if that is less).
    Items and documents may be many: the corpus is read twice, once for seeds and once for the places around them. Ids must be
    integers; null ids, null and empty texts give nothing; repeated rows give one pair.
    """
    spark = documents.sparkSession
    n = min(GRAM, passage)
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    chosen = stored(items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("words")).where("item is not null and words is not null").distinct())
    marks = stored(chosen.mapInPandas(lambda parts: _item_grams(parts, n), "item bigint, size bigint, gram bigint"))
    bits_of = bit_table(marks.select("gram").distinct())
    table = spark.sparkContext.broadcast(bits_of[0])
    hits = stored(docs.mapInArrow(_hits(table, bits_of[1], n), "id bigint, gram bigint, at bigint"))
    found = hits.join(broadcast_within(marks, broadcast_rows), "gram")
    # A place is a stretch of four item lengths, aligned with an item length before and after it.
    places = stored(found.select("item", "size", "id", F.floor(F.col("at") / (4 * F.col("size"))).alias("place")).distinct())
    load = places.groupBy("id").agg(F.ceil(F.count("*") / places_each).alias("parts"))
    part = F.pmod(F.xxhash64("item", "place"), "parts")
    per_doc = places.join(load, "id").groupBy("id", part.alias("part")).agg(F.collect_list(F.struct("item", "size", "place")).alias("places"))
    per_doc = broadcast_within(stored(per_doc), broadcast_rows)

    def stretches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, text, here in zip(part["id"], part["text"], part["places"], strict=True):
                hashes = word_hashes(text)
                for p in here:
                    low = max(0, (4 * p["place"] - 1) * p["size"])
                    out.append((p["item"], doc, hashes[low : (4 * p["place"] + 5) * p["size"]].tobytes()))
            yield pd.DataFrame(out, columns=["item", "id", "stretch"])

    cut_out = docs.join(per_doc, "id").mapInPandas(stretches, "item bigint, id bigint, stretch binary").distinct()
    texts = broadcast_within(chosen, broadcast_rows)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for (item, text), group in part.groupby(["item", "words"], sort=False):
                own = word_hashes(text)
                ids, cells = group["id"].to_numpy(), [np.frombuffer(b, np.uint64) for b in group["stretch"]]
                step = max(1, 200_000 // max(1, max(map(len, cells))))
                for k in range(0, len(cells), step):
                    best, run = align_many(own, cells[k : k + step])
                    out.append(pd.DataFrame({"item": item, "id": ids[k : k + step], "score": best, "coverage": best / (2 * len(own)), "run": run}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["item", "id", "score", "coverage", "run"])

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    scored = cut_out.repartition(spread, "item", "id", "stretch").join(texts, "item").mapInPandas(score, "item bigint, id bigint, score bigint, coverage double, run bigint")
    out = scored.groupBy("item", "id").agg(F.max("score").alias("score"), F.max("coverage").alias("coverage"), F.max("run").alias("run"))
    return out.withColumnsRenamed({"item": item_col, "id": id_col})
