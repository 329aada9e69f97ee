"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

A word goes if it lies in a window of ``window`` consecutive words that also starts in a document of a
smaller id. A document is parsed against reference blocks, pieces of earlier documents: from the first
place at which a block has the document's next ``window`` words it takes the longest phrase that the
block has anywhere (a factor), and goes on behind it. Factors of ``window`` words or more are duplicate
spans. A window that crosses the end of a factor can be in the block too, elsewhere; so each of these is
looked up. All other windows lie in a factor or start at a place that was looked up.

Which blocks. Parsing every document against every block is out of the question, and a phrase that
many documents share needs one source only, its first holder. An index of anchors finds it:

1. Of the half windows in each window the one of the least hash is its anchor; windows that share it make a
   run. Equal windows have equal anchors, so runs whose anchor no other document has are done with.
2. Runs of equal content are one class; its holders are parsed against its first holder.
3. Where an anchor has several classes, the first holder of each is parsed against those of the others that
   are earlier; beyond FEW classes the windows of one run of each class are named instead, and their
   holders are parsed against the first holder of each.

A document therefore meets only the blocks it needs, each once and with the stretch that holds the windows
in question; a block that many documents need is indexed in several tasks, with a share of the
documents in each. The parse compares words, so that what the index proposes is confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import FILTER_BITS, SpanHash, checkpointed, filter_table, hot_join, in_filter, mix, parted, sized_filter, slices, text_bytes, top_bits, word_hashes, words_of, written
from tesserae.llm.suffix_dedup import WORD, Runs, _longs, _record, _spaced, merged

#: Words of a window.
WINDOW = 13
#: Windows that start in one piece of a text: what a block holds.
PIECE = 4096
#: Documents that one copy of a block serves, and classes of an anchor that meet each other.
SERVED, FEW = 500, 8
#: The bits by which anchors are counted; two that share them only pass a filter together.
_NAMED = np.uint64(((1 << 64) - 1) & ~((1 << 20) - 1))


def _piece_ids(doc: np.ndarray, t1: np.ndarray, part: np.ndarray) -> np.ndarray:
    """64-bit names of pieces; two of one name are both parsed, which does no harm."""
    return mix(mix(doc.astype(np.int64).view(np.uint64)) ^ t1.view(np.uint64) ^ (part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A hash of each run of ``window`` words; equal ones are compared before they count."""
    out = np.zeros(max(0, len(words) - window + 1), np.uint64)
    for k in range(window):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return mix(out)


class Block:
    """A reference block (hashes of its words), indexed by its windows."""

    def __init__(self, words: np.ndarray, window: int = WINDOW) -> None:
        self.words, self.window = words, window
        hashes = _window_hashes(words, window)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def _longest(self, words: np.ndarray, at: int, places: np.ndarray) -> int:
        """Words of the longest phrase of the block that ``words`` has at ``at``; ``places`` hold the first of them."""
        n = self.window
        while len(places) > 1:
            if at + n == len(words):
                return n
            on = places[places + n < len(self.words)]
            on = on[self.words[on + n] == words[at + n]]
            if not len(on):
                return n
            places = on
            n += 1
        most = min(len(words) - at, len(self.words) - int(places[0]))
        differ = np.flatnonzero(words[at + n : at + most] != self.words[places[0] + n : places[0] + most])
        return n + int(differ[0]) if len(differ) else most

    def parse(self, words: np.ndarray, hashes: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The duplicate spans (words from, to) of a document: long factors, and the windows at their ends that the block has."""
        window = self.window
        hashes = _window_hashes(words, window) if hashes is None else hashes
        if not len(hashes) or not len(self.sorted):
            return []
        low = np.searchsorted(self.sorted, hashes)
        place = self.order[np.minimum(low, len(self.order) - 1)]
        hit = self.sorted[np.minimum(low, len(self.order) - 1)] == hashes
        at = np.flatnonzero(hit)
        step = np.arange(window)
        at = at[(self.words[place[at][:, None] + step] == words[at[:, None] + step]).all(axis=1)]
        high = np.searchsorted(self.sorted, hashes[at], side="right")
        spans: list[tuple[int, int]] = []
        k = 0
        while k < len(at):
            i = int(at[k])
            end = i + self._longest(words, i, self.order[low[i] : high[k]])
            spans.append((i, end))
            k = int(np.searchsorted(at, end))
            across = int(np.searchsorted(at, max(i + 1, end - window + 1)))
            spans += [(int(s), int(s) + window) for s in at[across:k]]
        return spans


def _firsts(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, repeated): one row (doc, t1, t2, text) of each text, of its least id; and (t1, t2, first, n) of those in several rows."""
    repeated = named.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(repeated.filter("n > 1"))
    later = hot_join(named.select("doc", "t1", "t2"), repeated, ["t1", "t2"], "n").filter("doc <> first").select("doc", "t1", "t2").distinct()
    touched, others = parted(named, F.col("t1"), repeated, "t1")
    kept = written(touched.join(later.hint("merge"), ["doc", "t1", "t2"], "left_anti").dropDuplicates(["doc", "t1", "t2"]), "firsts")
    return others.unionByName(kept), repeated


def _runs_of(part: pa.RecordBatch, window: int) -> Runs:
    data, start, stop, first = _spaced(*text_bytes(part.column("text")))
    runs = Runs(data, first, window, start, stop)
    runs.first_word = first
    return runs


def _wanted(texts: DataFrame, window: int) -> DataFrame:
    """piece, s_piece, low, high: of pieces of texts the stretch of words, and the block (a piece of a text of a smaller id) that it must be parsed against."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            runs = _runs_of(part, window)
            keys = runs.keys()
            order = np.lexsort((keys, runs.row))  # a text counts once for each of its anchors
            row, keys = runs.row[order], keys[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            yield _record([keys[fresh] & _NAMED], _longs("key"))

    keys = texts.select("text").mapInArrow(ranked, _longs("key"))
    repeated = checkpointed(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    shipped, bits = sized_filter(repeated, "key")
    fields = T.StructType([*_longs("key", "f1", "doc", "piece").fields, *_ints("low", "high").fields, T.StructField("long", T.BooleanType())])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)
        for part in slices(batches, "text"):
            runs = _runs_of(part, window)
            keys = runs.keys()
            keep = np.flatnonzero(in_filter(keys >> np.uint64(64 - bits), table))
            if not len(keep):
                continue
            low, end, row = runs.low[keep], runs.high[keep] + window, runs.row[keep]
            f1 = mix(runs.spans(SpanHash(runs.data, 12), low, end) + (runs.anchor[keep] - low).astype(np.uint64))
            doc, t1 = (part.column(c).to_numpy()[row] for c in ("doc", "t1"))
            long = np.diff(runs.first_word) >= PIECE + window  # of several pieces
            number, at = np.divmod(low - runs.first_word[row], PIECE)
            piece = _piece_ids(doc, t1, number)
            order = np.lexsort((at, f1, piece))  # equal runs of a piece are one row, from the first to the last
            fresh = np.ones(len(order), bool)
            fresh[1:] = (piece[order[1:]] != piece[order[:-1]]) | (f1[order[1:]] != f1[order[:-1]])
            first = order[fresh]
            last = order[np.append(np.flatnonzero(fresh)[1:], len(order)) - 1]
            back = np.argsort(first)  # in the order of the text, which packs best
            first, last = first[back], last[back]
            yield _record([keys[keep][first], f1[first], doc[first], piece[first], pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32()), pa.array(long[row[first]])], fields)

    rows = texts.select("doc", "t1", "text")
    runs = written(rows.mapInArrow(covered, fields), "runs")
    classes = runs.groupBy("key", "f1").agg(F.min(F.struct("doc", "piece", "low", "high", "long")).alias("s"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select("key", "f1", F.col("s.doc").alias("s_doc"), F.col("s.piece").alias("s_piece"), F.col("s.low").alias("low"), F.col("s.high").alias("high"), F.col("s.long").alias("long"), F.when(F.col("last") > F.col("s.doc"), F.col("n")).alias("n")), "classes")
    shared = classes.filter("n is not null").select("key", "f1", "s_doc", "s_piece", "n")
    whole = hot_join(runs.drop("long"), shared, ["key", "f1"], "n").filter("doc > s_doc").select("piece", "s_piece", "low", "high")

    kinds = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("s_doc").alias("a"), F.max("s_doc").alias("b")).filter("kinds > 1 and a < b")
    kinds = checkpointed(kinds.select("key", (F.col("kinds") > FEW).alias("many")))
    columns = ["key", "f1", "doc", "piece", "low", "high"]
    firsts = classes.select("key", "f1", F.col("s_doc").alias("doc"), F.col("s_piece").alias("piece"), "low", "high")
    # A long text can have a class in several pieces; all of them meet the other classes.
    again = runs.filter("long").join(classes.filter("long").select("key", "f1", "s_doc", "s_piece").hint("merge"), ["key", "f1"])
    holders = firsts.unionByName(again.filter("doc = s_doc and piece <> s_piece").select(*columns))
    few = kinds.filter("not many").select("key")
    held = firsts.join(few.hint("merge"), "key").groupBy("key").agg(F.collect_list(F.struct("doc", "piece")).alias("held"))  # FEW at most
    met = holders.join(held.hint("merge"), "key").select("doc", "piece", "low", "high", F.explode("held").alias("s")).filter("s.doc < doc").select("piece", F.col("s.piece").alias("s_piece"), "low", "high")

    opened = checkpointed(holders.join(kinds.filter("many").hint("merge"), "key", "left_semi").select("f1", "piece", F.col("f1").bitwiseXOR(F.col("piece")).alias("place")))
    shipped_runs, shipped_pieces = filter_table(opened, top_bits(F.col("place"))), filter_table(opened, top_bits(F.col("piece")))
    string_fields = T.StructType([*_longs("x", "y", "doc", "piece").fields, *_ints("low", "high").fields])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = shipped_runs.value.view(np.uint64), shipped_pieces.value.view(np.uint64)
        shift = np.uint64(64 - FILTER_BITS)

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, t1 = batch.column("doc").to_numpy(), batch.column("t1").to_numpy()
                octets = text_bytes(batch.column("text"))[1]
                n = np.diff(octets) // (2 * PIECE) + 1  # pieces that a text can have
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = np.zeros(len(n), bool)
                hit[row[in_filter(_piece_ids(doc[row], t1[row], number) >> shift, held)]] = True
                if hit.any():
                    yield batch.filter(pa.array(hit))

        for part in slices(wanted(), "text"):
            runs = _runs_of(part, window)
            if not len(runs.low):
                continue
            doc, t1 = (part.column(c).to_numpy()[runs.row] for c in ("doc", "t1"))
            second = SpanHash(runs.data, 12)
            f1 = mix(runs.spans(second, runs.low, runs.high + window) + (runs.anchor - runs.low).astype(np.uint64))
            number, begin = np.divmod(runs.low - runs.first_word[runs.row], PIECE)
            piece = _piece_ids(doc, t1, number)
            keep = np.flatnonzero(in_filter((f1 ^ piece) >> shift, table))
            if not len(keep):
                continue
            n = runs.high[keep] - runs.low[keep] + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs.low[keep], n)
            x, y = (runs.spans(h, at, at + window) for h in (runs.first, second))
            begin = pa.array(np.repeat(begin[keep], n), pa.int32())
            yield _record([x, y, np.repeat(doc[keep], n), np.repeat(piece[keep], n), begin, begin], string_fields)

    # Runs that only the filters let through are runs of the texts too and do no harm.
    laid = written(rows.mapInArrow(strings, string_fields), "windows")
    sources = laid.groupBy("x", "y").agg(F.min(F.struct("doc", "piece")).alias("s"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).filter("last > s.doc")
    sources = sources.select("x", "y", F.col("s.doc").alias("s_doc"), F.col("s.piece").alias("s_piece"), "n")
    part = hot_join(laid, checkpointed(sources), ["x", "y"], "n").filter("doc > s_doc").select("piece", "s_piece", "low", "high")
    routes = whole.unionByName(met).unionByName(part).groupBy("piece", "s_piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return written(routes.withColumn("high", F.col("high") + (2 * window - (window + 1) // 2)), "routes")  # the words of the longest run


def _ints(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


def _pieces(texts: DataFrame, used: DataFrame, window: int) -> DataFrame:
    """piece, doc, t1, part, text: the pieces in ``used`` (piece). One holds the windows of the runs that begin at PIECE places, its words joined by one blank."""
    fields = T.StructType([*_longs("piece", "doc", "t1", "part").fields, T.StructField("text", T.StringType())])
    shipped = filter_table(used, top_bits(F.col("piece")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)
        for part in slices(batches, "text"):
            data, start, stop, first = _spaced(*text_bytes(part.column("text")))
            size = np.diff(first)
            n = np.maximum(1, -(-(size - window + 1) // PIECE))
            row = np.repeat(np.arange(len(n)), n)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, t1 = (part.column(c).to_numpy()[row] for c in ("doc", "t1"))
            piece = _piece_ids(doc, t1, number)
            keep = np.flatnonzero(in_filter(piece >> np.uint64(64 - FILTER_BITS), table) & (size[row] > 0))
            low = number[keep] * PIECE
            high = np.minimum(low + PIECE + 2 * window, size[row[keep]]) + first[row[keep]]
            low += first[row[keep]]
            held = [data[a:b].tobytes() for a, b in zip(start[low].tolist(), stop[high - 1].tolist(), strict=True)]
            yield _record([piece[keep], doc[keep], t1[keep], number[keep], pa.array(held, pa.binary()).cast(pa.string())], fields)

    return texts.select("doc", "t1", "text").mapInArrow(cut, fields)


def duplicate_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, t1, low, high: spans of words (high excluded) of each text that texts of smaller doc hold, as the parses give them."""
    routes = _wanted(texts, window)
    blocks = checkpointed(routes.groupBy("s_piece").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.expr(f"n div {SERVED} + 1")))
    dealt = hot_join(routes, blocks, "s_piece", "n").withColumn("copy", F.pmod(F.xxhash64("piece"), F.col("copies")))
    asked = dealt.select("piece", "s_piece", "copy", F.lit(1).alias("role"), "low", "high")
    whole = blocks.select(F.col("s_piece").alias("piece"), "s_piece", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"), F.lit(0).alias("role"), F.lit(0).alias("low"), F.lit(2 * PIECE + 4 * window).alias("high"))
    pieces = _pieces(texts, checkpointed(asked.select("piece").unionByName(whole.select("piece")).distinct()), window)
    stretch = F.when(F.col("role") == 0, F.col("text")).otherwise(F.array_join(F.expr("slice(split(text, ' '), low + 1, high - low)"), " "))
    laid = asked.unionByName(whole).join(pieces.hint("merge"), "piece").select("s_piece", "copy", "role", "doc", "t1", (F.col("part") * PIECE + F.col("low")).alias("base"), stretch.alias("text"))
    laid = laid.repartition("s_piece", "copy").sortWithinPartitions("s_piece", "copy", "role")
    fields = _longs("doc", "t1", "low", "high")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[tuple[int, Block]] = []  # of one name; nearly always one
        name, ended = None, True
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            start, stop, first = words_of(data, offsets, WORD)
            words = word_hashes(data, start, stop)
            hashes = _window_hashes(words, window)
            source, doc, t1, base, role = (part.column(c).to_numpy() for c in ("s_piece", "doc", "t1", "base", "role"))
            found: list[tuple[int, int, int]] = []
            for i in range(part.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                if role[i] == 0:
                    if ended or source[i] != name:
                        current, name, ended = [], source[i], False
                    current.append((int(doc[i]), Block(words[a:b], window)))
                    continue
                ended = True
                spans = [s for d, block in current if d < doc[i] for s in block.parse(words[a:b], hashes[a : max(a, b - window + 1)])]
                if spans:
                    low, high = merged(*np.array(spans).T)
                    found += [(i, x, y) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            if found:
                row, low, high = np.array(found).T
                yield _record([doc[row], t1[row], low + base[row], high + base[row]], fields)

    return laid.mapInArrow(parse, fields)


def _removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """t1, t2, first, n_removed, kept (binary): what is left of the texts that have spans."""
    fields = T.StructType([*_longs("t1", "t2", "first", "n_removed").fields, T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, start, stop, first = _spaced(*text_bytes(part.column("text")))
            gone, kept = [], []
            for i, held in enumerate(part.column("spans")):
                flat = held.values.flatten()
                low, high = merged(flat[0].to_numpy(), flat[1].to_numpy())
                a, b = int(first[i]), int(first[i + 1])
                edges = np.append(np.insert(high, 0, 0), 0), np.append(low, b - a)
                stay = [(x, y) for x, y in zip(edges[0][:-1].tolist(), edges[1].tolist(), strict=True) if y > x]
                gone.append(int((high - low).sum()))
                kept.append(b" ".join(data[start[a + x] : stop[a + y - 1]].tobytes() for x, y in stay))
            yield _record([part.column("t1"), part.column("t2"), part.column("doc"), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], fields)

    found = checkpointed(spans.groupBy("doc", "t1").agg(F.collect_set(F.struct("low", "high")).alias("spans")))  # bounded by the text's windows
    touched = parted(texts, F.col("t1"), found, "t1")[0]
    return touched.join(found.hint("merge"), ["doc", "t1"]).select("doc", "t1", "t2", "text", "spans").mapInArrow(cut, fields)


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row; with ``keep_text`` also kept, the words left, joined by one blank.

    Words are runs of bytes other than ASCII white space. Null, empty and short texts lose nothing. Of equal
    texts of ``window`` words or more all but those of the least id lose everything; rows of one id are not
    earlier than each other. A null id is neither earlier nor later than any: its row keeps all, and others lose
    nothing to it. Texts of any length are read whole, in pieces. An empty table gives no rows. Other
    columns are dropped, whatever their names.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    texts, repeated = _firsts(rows.drop("id").filter((F.octet_length("text") >= 2 * window - 1) & F.col("doc").isNotNull()))
    cut = _removed(texts, duplicate_spans(texts, window))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    cut = written(cut.select("t1", "t2", "first", "n_removed", digest, *(["kept"] if keep_text else [])), "cut")
    outcome = cut.withColumnRenamed("first", "own").join(repeated.hint("merge"), ["t1", "t2"], "full").withColumns({"first": F.coalesce("first", "own"), "n": F.coalesce("n", F.lit(1))}).drop("own")
    outcome = outcome.withColumnsRenamed({"kept_sha256": "cut_sha256", "kept": "cut"})

    all_fields = T.StructType([T.StructField("id", rows.schema["id"].dataType), *_longs("doc", "t1", "t2", "n_words").fields, T.StructField("whole_sha256", T.StringType()), *([T.StructField("whole", T.BinaryType())] if keep_text else [])])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, start, stop, first = _spaced(*text_bytes(part.column("text")))
            whole = [data[start[a] : stop[b - 1]].tobytes() if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            arrays = [*(part.column(c) for c in ("id", "doc", "t1", "t2")), np.diff(first), pa.array([hashlib.sha256(w).hexdigest() for w in whole], pa.string())]
            yield _record([*arrays, *([pa.array(whole, pa.binary())] if keep_text else [])], all_fields)

    met = hot_join(rows.mapInArrow(described, all_fields), outcome, ["t1", "t2"], "n")
    gone = F.col("doc") > F.col("first")
    own = F.col("doc").isNotNull() & F.col("n_removed").isNotNull()
    none = hashlib.sha256(b"").hexdigest()
    columns = [
        F.when(gone & (F.col("n_words") >= window), F.col("n_words")).when(~F.coalesce(gone, F.lit(False)) & own, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(gone & (F.col("n_words") >= window), F.lit(none)).when(~F.coalesce(gone, F.lit(False)) & own, F.col("cut_sha256")).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(gone & (F.col("n_words") >= window), F.lit("")).when(~F.coalesce(gone, F.lit(False)) & own, F.decode("cut", "UTF-8")).otherwise(F.decode("whole", "UTF-8")).alias("kept"))
    return met.select(F.col("id").alias(id_col), "n_words", *columns)
