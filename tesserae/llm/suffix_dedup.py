"""Removal of repeated strings by distributed prefix doubling.

Every byte that lies in a string of ``length`` bytes which starts anywhere else too is removed.

Ranks. Positions are ranked by their first bytes: two positions get one rank if these bytes agree.
Ranks of h bytes give ranks of up to 2h: the rank of (rank at p, rank at p + offset). Ranks are named
by 64-bit hashes of the bytes, so that no order has to be made; Spark deals the names (and pairs of
names) out, and counts decide what is unique and drops out of the next round.

Which positions. Ranking every byte position in Spark would write many times the input. Of the first
ranks (half the length) only a sample is dealt out: within each string of ``length`` bytes, the
position whose half-length rank has the least hash (the rightmost of equals) is its anchor. Equal
strings have their anchors at equal places, so a string can only repeat if its anchor's rank does.
Neighbouring strings mostly share the anchor: they make a run, which is one row.

1. Rank the anchors; ranks that occur once drop out.
2. Of each run left, rank all it covers. A run that repeats as a whole is repeated; one row has decided
   for all its strings.
3. Where one anchor rank goes with several whole runs, one run of each kind is opened, first into bins
   of strings at like distances from the anchor, which are ranked in the same two ways (what all strings
   of the bin hold, and all that they cover), and then, where a bin is not decided so, string by string:
   a string is the pair of the half-length ranks at its start and at the offset that ends with it.
   Pairs that occur once drop out.

A text is known by a 128-bit hash of itself, not by its id, so ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import FILTER_BITS, RollingHash, SpanHash, checkpointed, filter_table, in_filter, mix, slices, text_bytes, top_bits, words_of, written

LENGTH = 400
#: Strings of an opened run that are ranked together before they are ranked one by one.
BIN = 32
_PLACE = np.uint64((1 << 28) - 1)
#: Words that a passage must have in common with another document's to be reported.
PASSAGE = 50
#: What a word is made of: all bytes but ASCII white space.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


class Runs:
    """The runs of one slice: anchors, first and last string starts (places of units), and the row of each.

    Units are the slice's bytes, or the words that ``start`` and ``stop`` bound; ``offsets`` says where
    each row's units begin (and end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> None:
        self.half = half = (length + 1) // 2
        self.data, self.start, self.stop = data, start, stop
        none = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.row = none
        n = int(offsets[-1])
        big = np.flatnonzero(np.diff(offsets) >= length)
        if not len(big):
            return
        order = RollingHash(data, 11)
        if start is None:
            raw = (order.sums[half:] - order.sums[: n - half + 1]) * order.down[: n - half + 1]
        else:
            raw = (order.sums[stop[half - 1 :]] - order.sums[start[: n - half + 1]]) * order.down[start[: n - half + 1]]
        raw &= ~_PLACE
        raw |= _PLACE - (np.arange(len(raw), dtype=np.uint64) & _PLACE)
        reach, width = length - half + 1, 1  # least of each ``reach`` adjacent ones, by doubling
        while 2 * width <= reach:
            raw = np.minimum(raw[: len(raw) - width], raw[width:])
            width *= 2
        if width < reach:
            raw = np.minimum(raw[: len(raw) - (reach - width)], raw[reach - width :])
        anchor = (_PLACE - (raw & _PLACE)).astype(np.int64)
        if n > int(_PLACE):  # a giant text: places are kept modulo 2^28
            anchor += (np.arange(len(anchor)) - anchor + int(_PLACE)) // (int(_PLACE) + 1) * (int(_PLACE) + 1)
        inside = np.zeros(len(anchor) + 1, np.int8)
        inside[offsets[big]] += 1
        np.add.at(inside, offsets[big + 1] - length + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        change = anchor[1:] != anchor[:-1]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= change | ~inside[:-1]
        ends[:-1] &= change | ~inside[1:]
        self.low, self.high = np.flatnonzero(begins), np.flatnonzero(ends)
        self.anchor = anchor[self.low]
        self.row = np.searchsorted(offsets, self.low, side="right") - 1
        self.first = SpanHash(data, 11)

    def spans(self, hashes: SpanHash, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of the units from ``low`` to before ``high``."""
        return hashes.spans(low, high) if self.start is None else hashes.spans(self.start[low], self.stop[high - 1])

    def keys(self) -> np.ndarray:
        """The anchors' ranks."""
        return self.spans(self.first, self.anchor, self.anchor + self.half) if len(self.anchor) else np.zeros(0, np.uint64)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slice with one blank after each word and no other white space; its words' starts and stops, and where each row's words begin."""
    start, stop, first = words_of(data, offsets, WORD)
    keep = WORD[data]
    keep[1:] |= WORD[data[:-1]]
    place = np.cumsum(keep) - 1
    spaced = np.where(WORD[data], data, np.uint8(32))[keep]
    return spaced, place[start], place[stop - 1] + 1, first


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _record(arrays: list, schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64()) if isinstance(a, np.ndarray) else a for a in arrays], names=schema.names)


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def repeated_spans(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(t1, t2, low, high): for texts by their hashes, spans of string starts (bytes, high included) that repeat.

    The strings that start there, of ``length`` bytes each, are those that start anywhere else too,
    in the same text or in another row's. Rows of equal texts share their spans. Spans can touch.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    texts = _texts(df, text_col).filter(F.octet_length("text") >= length)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield _record([Runs(*text_bytes(part.column("text")), length).keys()], _longs("key"))

    keys = texts.select("text").mapInArrow(ranked, _longs("key"))
    repeated = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shipped = filter_table(repeated, top_bits(F.col("key")))
    fields = _longs("key", "f1", "f2", "t1", "t2", "low", "high")

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            runs = Runs(data, offsets, length)
            keys = runs.keys()
            keep = np.flatnonzero(in_filter(keys >> np.uint64(64 - FILTER_BITS), table))
            if not len(keep):
                continue
            low, high, row = runs.low[keep], runs.high[keep], runs.row[keep]
            shape = (runs.anchor[keep] - low).astype(np.uint64)
            f1 = mix(runs.first.spans(low, high + length) + shape)
            f2 = mix(SpanHash(data, 12).spans(low, high + length) + shape)
            t1, t2 = (part.column(c).to_numpy()[row] for c in ("t1", "t2"))
            yield _record([keys[keep], f1, f2, t1, t2, low - offsets[row], high - offsets[row]], fields)

    runs = written(texts.mapInArrow(covered, fields), "runs")
    classes = runs.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min(F.struct("t1", "low")).alias("r"))
    classes = checkpointed(classes)
    whole = runs.drop("key").join(classes.filter("n > 1").select("f1", "f2"), ["f1", "f2"], "left_semi").select("t1", "t2", "low", "high")

    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("key")
    opened = checkpointed(classes.join(several, "key", "left_semi").select("r.t1", "r.low", "f1", (F.col("n") == 1).alias("single")))
    place = F.shiftrightunsigned(F.col("t1").bitwiseXOR(F.shiftleft(F.col("low"), 64 - FILTER_BITS)), 64 - FILTER_BITS)
    shipped_runs = filter_table(opened, place)
    context_type = T.StructType([*_longs("f1", "t1", "t2", "low", "anchor", "size").fields, T.StructField("context", T.BinaryType())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped_runs.value.view(np.uint64)
        shift = np.uint64(64 - FILTER_BITS)
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            runs = Runs(data, offsets, length)
            low = (runs.low - offsets[runs.row]).astype(np.uint64)
            t1, t2 = (part.column(c).to_numpy() for c in ("t1", "t2"))
            keep = np.flatnonzero(in_filter((t1[runs.row].view(np.uint64) ^ (low << shift)) >> shift, table)) if len(low) else low.astype(np.int64)
            if not len(keep):
                continue
            begin, last, row = runs.low[keep], runs.high[keep], runs.row[keep]
            shape = (runs.anchor[keep] - begin).astype(np.uint64)
            f1 = mix(runs.first.spans(begin, last + length) + shape)
            raw = [data[i : j + length].tobytes() for i, j in zip(begin, last, strict=True)]
            yield _record([f1, t1[row], t2[row], low[keep], runs.anchor[keep] - begin, last - begin + 1, pa.array(raw, pa.binary())], context_type)

    # The join drops what only the filter let through; copies of a text give a run more than once, which does no harm.
    found = texts.mapInArrow(contexts, context_type).join(opened, ["t1", "low", "f1"]).drop("f1")
    found = written(found.withColumn("run", F.monotonically_increasing_id()), "contexts")
    return whole.unionByName(_opened_spans(found, length))


def _opened_spans(found: DataFrame, length: int) -> DataFrame:
    """Of opened runs the spans of repeated strings, first by bins of BIN strings, then string by string."""
    bin_fields = T.StructType([*_longs("run", "bin", "core", "g1", "g2", "from", "to").fields, T.StructField("single", T.BooleanType())])
    half = (length + 1) // 2
    width = min(BIN, max(1, length // 8))

    def laid_out(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = text_bytes(part.column("context"))
        return data, offsets[:-1], part.column("anchor").to_numpy(), part.column("size").to_numpy()

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of one bin begin BIN * bin to BIN * (bin + 1) - 1 bytes before the anchor, whatever their run's ends are."""
        for part in slices(batches, "context"):
            data, at, anchor, size = laid_out(part)
            low_bin, high_bin = (anchor - size + 1) // width, anchor // width
            n = high_bin - low_bin + 1
            row = np.repeat(np.arange(len(n)), n)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low_bin[row]
            far = np.minimum(anchor[row], number * width + width - 1)  # of the bin's strings here, the farthest and nearest to the anchor
            near = np.maximum(anchor[row] - size[row] + 1, number * width)
            base = at[row] + anchor[row]
            one, two = SpanHash(data, 11), SpanHash(data, 12)
            core = mix(one.spans(base - number * width, base + length - (number * width + width - 1)) + number.astype(np.uint64))
            shape = (far * 4096 + near).astype(np.uint64)
            g1, g2 = (mix(h.spans(base - far, base + length - near) + shape) for h in (one, two))
            run, single = part.column("run").to_numpy()[row], part.column("single").take(pa.array(row))
            yield _record([run, number, core, g1, g2, anchor[row] - far, anchor[row] - near, single], bin_fields)

    binned = written(found.select("run", "anchor", "size", "context", "single").mapInArrow(bins, bin_fields), "bins")
    kinds = binned.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min("core").alias("core"), F.min(F.struct("run", "from", "to", "single")).alias("r"), F.bool_or("single").alias("wanted"))
    kinds = checkpointed(kinds)
    whole = binned.filter("single").select("g1", "g2", "run", "from", "to").join(kinds.filter("n > 1 and wanted").select("g1", "g2"), ["g1", "g2"], "left_semi").select("run", "from", "to")
    several = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or(F.expr("n = 1 and wanted")).alias("wanted")).filter("kinds > 1 and wanted").select("core")
    opened = kinds.join(several, "core", "left_semi").select("r.run", F.struct("r.from", "r.to", F.expr("n = 1 and wanted").alias("single")).alias("b"))
    opened = opened.groupBy("run").agg(F.collect_list("b").alias("bins"))  # at most the bins of one run
    pair_fields = T.StructType([*_longs("x", "y", "run", "at").fields, T.StructField("single", T.BooleanType())])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pair of half-length ranks at each string's start and at the offset that ends with it."""
        for part in slices(batches, "context"):
            data, at, _, _ = laid_out(part)
            lists = part.column("bins")
            begin, end, single = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            n = end - begin + 1
            row, single = np.repeat(row, n), np.repeat(single, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            start = at[row] + place
            x = SpanHash(data, 11).spans(start, start + half)
            y = SpanHash(data, 12).spans(start + length - half, start + length)
            yield _record([x, y, part.column("run").to_numpy()[row], place, pa.array(single)], pair_fields)

    pairs = found.select("run", "anchor", "size", "context").join(opened, "run").mapInArrow(strings, pair_fields)
    pairs = written(pairs, "pairs")
    twice = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.bool_or("single").alias("wanted")).filter("n > 1 and wanted").select("x", "y")
    edges = pairs.filter("single").join(twice, ["x", "y"], "left_semi").select("run", F.col("at").alias("from"), F.col("at").alias("to"))
    spans = whole.unionByName(edges).join(found.select("run", "t1", "t2", F.col("low").alias("base")), "run")
    return spans.select("t1", "t2", (F.col("base") + F.col("from")).alias("low"), (F.col("base") + F.col("to")).alias("high"))


def sharing_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE) -> DataFrame:
    """id (long, distinct): the documents that hold a passage of ``words`` words or more which another document holds too.

    The same ranks and runs as above, over words instead of bytes: words are runs of bytes other than
    ASCII white space, however far apart. Rows of one id are one document, whose own repeats don't
    count; rows without an id are known by their text. A document is reported as soon as one of its runs
    occurs whole elsewhere; only where none does are the runs of its anchors opened string by string.
    """
    if words < 2:
        raise ValueError("words must be at least 2")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(text)).alias("id"), text.alias("text")).filter(F.octet_length("text") >= 2 * words - 1)

    def runs_of(part: pa.RecordBatch) -> Runs:
        data, start, stop, first = _spaced(*text_bytes(part.column("text")))
        return Runs(data, first, words, start, stop)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield _record([runs_of(part).keys()], _longs("key"))

    keys = texts.select("text").mapInArrow(ranked, _longs("key"))
    shipped = filter_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), top_bits(F.col("key")))
    fields = _longs("key", "f1", "f2", "id")

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)
        for part in slices(batches, "text"):
            runs = runs_of(part)
            keys = runs.keys()
            keep = np.flatnonzero(in_filter(keys >> np.uint64(64 - FILTER_BITS), table))
            if not len(keep):
                continue
            low, end, row = runs.low[keep], runs.high[keep] + words, runs.row[keep]
            shape = (runs.anchor[keep] - low).astype(np.uint64)
            f1, f2 = (mix(runs.spans(h, low, end) + shape) for h in (runs.first, SpanHash(runs.data, 12)))
            yield _record([keys[keep], f1, f2, part.column("id").to_numpy()[row]], fields)

    runs = written(texts.mapInArrow(covered, fields), "word-runs")
    classes = checkpointed(runs.groupBy("f1", "f2").agg(F.min("key").alias("key"), F.min("id").alias("a"), F.max("id").alias("b")))
    whole = checkpointed(runs.join(classes.filter("a <> b").select("f1", "f2"), ["f1", "f2"], "left_semi").select("id").distinct())
    alone = classes.filter("a = b").join(whole.select(F.col("id").alias("a")), "a", "left_anti").select("key").distinct()
    opened = classes.join(alone, "key", "left_semi").groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("key")
    # Of each class one document's run is opened: of those that are found already, one stands for all.
    opened = checkpointed(classes.join(opened, "key", "left_semi").select("f1", F.xxhash64("a").alias("place")))
    shipped_runs, shipped_ids = filter_table(opened, top_bits(F.col("f1"))), filter_table(opened, top_bits(F.col("place")))
    string_fields = _longs("x", "y", "id")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = shipped_runs.value.view(np.uint64), shipped_ids.value.view(np.uint64)

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_filter(batch.column("place").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS), ids)
                if hit.any():
                    yield batch.filter(pa.array(hit))

        for part in slices(wanted(), "text"):
            runs = runs_of(part)
            if not len(runs.low):
                continue
            f1 = mix(runs.spans(runs.first, runs.low, runs.high + words) + (runs.anchor - runs.low).astype(np.uint64))
            keep = np.flatnonzero(in_filter(f1 >> np.uint64(64 - FILTER_BITS), table))
            if not len(keep):
                continue
            n = runs.high[keep] - runs.low[keep] + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs.low[keep], n)
            x, y = (runs.spans(h, at, at + words) for h in (runs.first, SpanHash(runs.data, 12)))
            yield _record([x, y, part.column("id").to_numpy()[np.repeat(runs.row[keep], n)]], string_fields)

    # Runs that only the filter let through are runs of the texts too and do no harm.
    laid = written(texts.withColumn("place", F.xxhash64("id")).mapInArrow(strings, string_fields), "word-strings")
    twice = laid.groupBy("x", "y").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("x", "y")
    return whole.unionByName(laid.join(twice, ["x", "y"], "left_semi").select("id")).distinct()


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > reach[:-1]
    begin = np.flatnonzero(fresh)
    return starts[begin], reach[np.append(begin[1:], len(starts)) - 1]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every row; with ``keep_bytes`` also kept (binary).

    Null and short texts lose nothing (a null has no bytes). Texts that occur twice and have ``length``
    bytes or more lose everything. Repeated rows and ids give repeated rows. Other columns are dropped.
    """
    spans = checkpointed(repeated_spans(df, text_col, length).groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("spans")))  # bounded by the text
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    shipped = filter_table(spans, top_bits(F.col("t1")))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])]
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *_longs("n_bytes", "n_removed", "n_spans").fields, T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if keep_bytes else [])])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)
        for batch in batches:
            hit = in_filter(batch.column("t1").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS), table)
            if hit.any():
                yield batch.filter(pa.array(hit))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)
        for batch in batches:
            hit = in_filter(batch.column("t1").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS), table)
            if not hit.all():
                rest = batch.filter(pa.array(~hit))
                yield from cut(iter([rest.append_column("spans", pa.nulls(rest.num_rows))]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            rows = []
            for i, found in enumerate(part.column("spans")):
                own = data[offsets[i] : offsets[i + 1]]
                removed = runs = 0
                if found.is_valid:
                    flat = found.values.flatten()
                    starts, stops = merged(flat[0].to_numpy(), flat[1].to_numpy() + length)
                    removed, runs = int((stops - starts).sum()), len(starts)
                    edges = np.zeros(len(own) + 1, np.int8)
                    edges[starts] += 1
                    edges[stops] -= 1
                    kept = own[np.cumsum(edges[:-1]) == 0].tobytes()
                else:
                    kept = own.tobytes()
                rows.append((len(own), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names) - 1))], names=names)

    hit = docs.mapInArrow(touched, docs.schema).join(spans, ["t1", "t2"], "left").select("id", "text", "spans").mapInArrow(cut, schema)
    return hit.unionByName(docs.mapInArrow(untouched, schema)).withColumnRenamed("id", id_col)
