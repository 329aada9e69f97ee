"""Benchmark decontamination by winnowing.

Words are hashed, and every run of GRAM words gets a hash of its own. Of each SPAN - GRAM + 1 adjacent
runs, which together cover SPAN words, the one with the least hash is kept (the rightmost of equals).
Two texts that share SPAN words in a row keep the same run within them, so joining the kept runs of
documents and of benchmark items finds every such span. Each kept run carries the words around it;
after the join the match is extended to both sides word by word, up to the edge of the spans that can
hold the run, which gives exactly the shared spans of SPAN words or more around it.

An item of fewer words than SPAN is one window of its own length. For the lengths that occur, the runs
of that length are compared whole.

Before the join a filter of fixed size, made of the items' hashes, drops runs of documents that cannot
match. Its size doesn't depend on the items; with many of them it lets more through, and the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import checkpointed, lowered, mix, slices, text_bytes, word_hashes, words_of

SPAN = 13
GRAM = 5
#: Bits of the filter of the items' hashes: 2 MB however many items there are.
FILTER_BITS = 24
#: Kept runs of items up to so many rows are broadcast (their number is counted first); more are joined by shuffle.
BROADCAST_ROWS = 200_000

#: What a word is made of: letters and digits of ASCII and all bytes of other characters.
INSIDE = np.ones(256, bool)
INSIDE[0x00:0x30] = INSIDE[0x3A:0x61] = INSIDE[0x7B:0x80] = False

_RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("at", T.LongType()),  # its first word
        T.StructField("length", T.IntegerType()),  # words of the run: GRAM, or a short item's own length
        T.StructField("left", T.ArrayType(T.LongType())),  # the words before it, nearest first
        T.StructField("right", T.ArrayType(T.LongType())),  # the words after it, nearest first
    ]
)


def _hashed_words(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice, and where each row's words begin (and end)."""
    data, offsets = text_bytes(batch.column(text))
    data = lowered(data)
    start, stop, first = words_of(data, offsets, INSIDE)
    return word_hashes(data, start, stop), first


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words (of the whole slice; the caller masks runs that cross rows)."""
    total = max(0, len(words) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + total])
    return out


def _row_ends(first: np.ndarray, n_words: int) -> np.ndarray:
    """For each word, the end of its row's words."""
    return np.repeat(first[1:], np.diff(first)) if n_words else np.zeros(0, np.int64)


def _kept(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the runs that some window of SPAN words keeps."""
    width = SPAN - GRAM + 1
    total = len(grams) - width + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(total)
    best, least = at.copy(), grams[:total].copy()
    for k in range(1, width):
        lower = grams[k : k + total] <= least
        least = np.where(lower, grams[k : k + total], least)
        best[lower] = at[lower] + k
    return np.unique(best[at + SPAN <= ends[:total]])


def _around(words: np.ndarray, at: int, length: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    reach = SPAN - GRAM if length == GRAM else 0
    left, right = words[max(begin, at - reach) : at][::-1], words[at + length : min(end, at + length + reach)]
    return left.view(np.int64), right.view(np.int64)


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)


def _item_runs(items: DataFrame) -> DataFrame:
    """Kept runs of items, an item of 1 to SPAN - 1 words as one whole run (marked by a length of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, first = _hashed_words(part, "text")
            ends = _row_ends(first, len(words))
            grams = _gram_hashes(words, GRAM)
            kept = _kept(grams, ends)
            row = np.searchsorted(first, kept, side="right") - 1
            ids = part.column("id").to_pylist()
            out = [(ids[r], int(grams[k].view(np.int64)), k - first[r], GRAM, *_around(words, k, GRAM, first[r], first[r + 1])) for k, r in zip(kept.tolist(), row.tolist(), strict=True)]
            for r, n in enumerate(np.diff(first).tolist()):
                if 0 < n < SPAN:
                    whole = _gram_hashes(words[first[r] : first[r + 1]], n)[0]
                    out.append((ids[r], int(whole.view(np.int64)), 0, -n, [], []))
            yield _batch(out, _RUNS)

    return items.mapInArrow(run, _RUNS)


def shared_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counts, spans): id, t1, t2 and n_words of every row; and t1, t2, item_id, start, stop (words) of shared spans.

    A text is known by the 128-bit hash (t1, t2) of itself, so ids may be null or repeat.

    The spans of a document and an item cover just the words inside occurrences of the item's windows
    (SPAN words in a row, or all of a shorter item); they can overlap and repeat. Null texts have no
    words.
    """
    spark = docs.sparkSession
    items = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text"))
    text = F.coalesce(F.col(f"`{doc_text}`"), F.lit(""))
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    item_runs = checkpointed(_item_runs(items))
    # The filter and the lengths of short items: both of fixed size. Its bits are set where the hashes are, by aggregation.
    bits = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words64 = item_runs.groupBy((bits / 64).cast("long").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) % 64 as int))")).alias("mask"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words64.toLocalIterator():  # at most 2^18 rows
        table[row.slot] = row.mask
    short = sorted(-r.length for r in item_runs.filter("length < 0").select("length").distinct().collect())  # at most SPAN - 1 rows
    n_items = item_runs.count()
    shipped = spark.sparkContext.broadcast(table)
    schema = T.StructType([*docs.schema.fields[:3], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType(_RUNS.fields[1:])))])
    run_kind = pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("length", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)

        def seen(hashes: np.ndarray) -> np.ndarray:
            at = hashes >> np.uint64(64 - FILTER_BITS)
            return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        for part in slices(batches, "text"):
            words, first = _hashed_words(part, "text")
            ends = _row_ends(first, len(words))
            grams = _gram_hashes(words, GRAM)
            found: list = [[] for _ in range(part.num_rows)]
            kept = _kept(grams, ends)
            kept = kept[seen(grams[kept])]
            rows = np.searchsorted(first, kept, side="right") - 1
            for k, r in zip(kept.tolist(), rows.tolist(), strict=True):
                left, right = _around(words, k, GRAM, first[r], first[r + 1])
                found[r].append({"hash": int(grams[k].view(np.int64)), "at": k - first[r], "length": GRAM, "left": left, "right": right})
            for n in short:
                hashes = _gram_hashes(words, n)
                at = np.arange(len(hashes))
                at = at[(at + n <= ends[: len(hashes)]) & seen(hashes)]
                for k, r in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), strict=True):
                    found[r].append({"hash": int(hashes[k].view(np.int64)), "at": k - first[r], "length": -n, "left": [], "right": []})
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "t1", "t2")), pa.array(np.diff(first)), pa.array(found, pa.list_(run_kind))], names=schema.names)

    scanned = checkpointed(docs.mapInArrow(run, schema))
    runs = scanned.select("t1", "t2", F.explode("runs").alias("r")).select("t1", "t2", "r.*")
    theirs = item_runs.select("hash", "length", F.col("id").alias("item"), F.col("left").alias("item_left"), F.col("right").alias("item_right"))
    if n_items <= BROADCAST_ROWS:
        theirs = F.broadcast(theirs)
    # How many words agree next to the run on either side: the first place where they differ.
    agree = "coalesce(array_position(zip_with(slice({0}, 1, least(size({0}), size({1}))), slice({1}, 1, least(size({0}), size({1}))), (a, b) -> a <> b), true), 0)"
    reach = lambda a, b: F.expr(f"case when {agree.format(a, b)} > 0 then {agree.format(a, b)} - 1 else least(size({a}), size({b})) end")
    spans = (
        runs.join(theirs, ["hash", "length"])
        .withColumns({"before": reach("`left`", "item_left"), "after": reach("`right`", "item_right")})
        .filter(f"length < 0 or before + after >= {SPAN - GRAM}")
        .select("t1", "t2", F.col("item").alias("item_id"), (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.abs("length") + F.col("after")).alias("stop"))
    )
    return scanned.select("id", "t1", "t2", "n_words"), spans


def contaminated(counts: DataFrame, spans: DataFrame, share: int = 20) -> DataFrame:
    """``counts`` with n_hit, n_items, items and contaminated, from the two results of ``shared_spans``."""
    spans = checkpointed(spans.distinct())
    doc = ["t1", "t2"]
    hit = spans.select(*doc, F.explode(F.sequence("start", F.col("stop") - 1)).alias("word")).distinct().groupBy(*doc).agg(F.count(F.lit(1)).alias("n_hit"))
    held = spans.select(*doc, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*doc).agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    return counts.join(hit.join(held, doc), doc, "left").select(
        *counts.columns,
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.expr(f"coalesce(n_hit > 0 and {share} * n_hit >= n_words, false)").alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """For each row: doc_id, n_words, n_hit, n_items, items (their ids as sorted strings), contaminated.

    contaminated: some word is hit and n_hit * share >= n_words. Null and empty texts have no words and
    are clean; with no items every document is. Rows of equal texts get equal results. Other columns are dropped.
    """
    found = contaminated(*shared_spans(docs, items, doc_id, doc_text, item_id, item_text), share)
    return found.select(F.col("id").alias(doc_id), "n_words", "n_hit", "n_items", "items", "contaminated")
