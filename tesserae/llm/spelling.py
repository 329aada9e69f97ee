"""Spelling variants: words one edit apart, by a forward and a reversed sorted dictionary.

One edit (a code point inserted, deleted or replaced) leaves a half of the shorter word intact. Of words
of L or L + 1 code points, the forward dictionary brings together those with the same first L // 2, the
reversed one those with the same last L - L // 2: blocks, which lie side by side when the dictionaries are
sorted. Each of two near words is in one such block with the other; a pair with the first half in common
belongs to the forward block alone, so no pair is found twice.

A skewed block is subdivided in the same way: of what lies between the parts that its words have in common, one
edit leaves a half intact, so its words go to a block with a longer head and to one with a longer tail. At
one open code point this ends, with no more words than the alphabet has. Which blocks are skewed is
counted before anything is gathered, and every pair that is in a block is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import checkpointed, parted, written

#: Least code points and occurrences of a word; how many times as frequent a word's form is.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Pairs of one block beyond which it is subdivided.
BLOCK_PAIRS = 2000
#: Code points of a text that are split into words at once, and words that a task counts before it passes them on.
PIECE, HELD = 1 << 20, 200_000
#: Pairs that are verified at once, and the width (code points) up to which words lie in one array.
PAIRS_AT_ONCE, WIDTH = 1 << 18, 64
#: Above any length: the pair may have any head in common.
_ANY = 1 << 30

_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _pieces(text: str) -> Iterator[list[bytes]]:
    """The runs of A-Z, a-z and U+00C0 to U+00FF, as Latin-1 with A-Z in lower case; of a long text piece by piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _RUNS[ord(text[end]) if ord(text[end]) < 256 else 0] != 32:
            end += 1  # no run is cut
        yield text[at:end].encode("latin-1", "replace").translate(_RUNS).split()
        at = end


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, noise: int = 0) -> DataFrame:
    """word, n: the words of all texts with their occurrences, words of ``min_length`` code points or more.

    With ``noise`` a run loses a code point where the CRC-32 h of ``<id>:<run>`` is divided by it, the one at h modulo the run's length.
    Null texts have no words; a null id is an empty text before the colon. Rows count as often as they come.
    """
    fields = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def passed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=fields.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                before = zlib.crc32(f"{name}:".encode())
                for runs in _pieces(text.as_py()):
                    for run, n in Counter(runs).items():
                        if len(run) < min_length:
                            continue
                        if noise and (h := zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)) % noise == 0:
                            cut = h % len(run)
                            run = run[:cut] + run[cut + 1 :]
                            if len(run) < min_length:
                                continue
                        held[run] += n
                    if len(held) >= HELD:
                        yield passed(held)
                        held = Counter()
        if held:
            yield passed(held)

    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    return texts.mapInArrow(count, fields).groupBy("word").agg(F.sum("n").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """The two blocks of each row: head and tail are the code points that the block has in common, below bounds its pairs' common heads."""
    gap = "size - head - tail"
    longer = f"struct(size, cast(head + ({gap}) div 2 as int) as head, tail, below)"
    other = f"struct(size, head, cast(tail + ({gap}) - ({gap}) div 2 as int) as tail, cast(head + ({gap}) div 2 as int) as below)"
    return rows.select("word", "n", F.explode(F.expr(f"array({longer}, {other})")).alias("b")).select("word", "n", "b.*")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with what their block's words have in common (its tail reversed, as in the reversed dictionary) and the block's hash."""
    rows = rows.withColumns({"front": F.expr("left(word, head)"), "back": F.expr("reverse(right(word, tail))")})
    return rows.withColumn("block", F.xxhash64("size", "head", "tail", "front", "back"))


def _pairs_of_blocks(placed: DataFrame) -> DataFrame:
    short = F.char_length("word") == F.col("size")
    counted = placed.groupBy("block").agg(F.count_if(short).alias("s"), F.count_if(~short).alias("l"), F.min(F.expr("size - head - tail")).alias("gap"))
    return counted.select("block", "gap", "l", (F.col("s") * (F.col("s") - 1) / 2 + F.col("s") * F.col("l")).alias("pairs"))


def blocks(words: DataFrame, min_length: int = MIN_LENGTH, most: int = BLOCK_PAIRS) -> DataFrame:
    """Rows (word, n, size, head, tail, below, front, back, block) of blocks with at most ``most`` pairs and longer words, or one open code point.

    ``size`` is the length of the block's shorter words; a word takes part with its own length and, as the
    longer of a pair, with one less. A block is taken for skewed if its hash hits a filter of fixed size;
    those that hit it by chance are subdivided too, which changes no result.
    """
    length = F.char_length("word").cast("int")
    sizes = F.filter(F.array(length, length - 1), lambda s: s >= min_length)
    rows = _halves(words.select("word", "n", F.explode(sizes).alias("size"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(_ANY).alias("below")))
    ready = None
    while True:
        placed = _placed(rows)
        skewed = checkpointed(_pairs_of_blocks(placed).filter((F.greatest("pairs", "l") > most) & (F.col("gap") > 1)).select("block"))
        if skewed.isEmpty():
            return placed if ready is None else ready.unionByName(placed)
        hit, rest = parted(placed, F.col("block"), skewed, "block")
        open_ = F.expr("size - head - tail > 1")
        rest = rest.unionByName(hit.filter(~open_))
        ready = rest if ready is None else ready.unionByName(rest)
        rows = written(_halves(hit.filter(open_)), "subdivided")


def _commons(words: list[bytes], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points that the words of each pair (i, j) have in common at the front and at the back; no two are equal."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max()) + 1
    out = []
    for turned in (words, [w[::-1] for w in words]):
        table = np.array(turned, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
        out.append((table[i] != table[j]).argmax(axis=1))  # ends differ from letters: words have no zero byte
    return out[0], out[1]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _near(words: list[bytes], size: np.ndarray, head: np.ndarray, tail: np.ndarray, below: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are one edit apart and belong to their block; i is a shorter word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    front, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    wide = np.maximum(lengths[i], lengths[j]) > WIDTH
    at = np.flatnonzero(~wide)
    if len(at):
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        front[at], back[at] = _commons([words[k] for k in used], place[: len(at)], place[len(at) :])
    for k in np.flatnonzero(wide):
        front[k], back[k] = _common(words[i[k]], words[j[k]]), _common(words[i[k]][::-1], words[j[k]][::-1])
    intact = lengths[i] - (lengths[i] == lengths[j])
    return (front + back >= intact) & (front >= head[i]) & (back >= tail[i]) & (front < below[i]) & (size[i] == size[j]) & (head[i] == head[j]) & (tail[i] == tail[j])


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, most: int = BLOCK_PAIRS) -> DataFrame:
    """word, n, other, other_n: each pair of distinct words that are one edit apart, once; ``words`` holds each word once.

    The blocks' rows are dealt to ranges of the sorted dictionaries and sorted there; a task scans its
    range and holds no more than a block beyond what it verifies at once.
    """
    fields = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("other", T.StringType()), T.StructField("other_n", T.LongType())])
    names = ["word", "n", "size", "head", "tail", "below", "block"]
    order = ["front", "back", "size", "head"]
    dealt = blocks(words, min_length, most).repartitionByRange(*order).sortWithinPartitions(*order, "word").select(*names)

    def verified(part: pa.Table) -> Iterator[pa.RecordBatch]:
        text, n = part.column("word").combine_chunks(), part.column("n").to_numpy()
        words = [w.encode("latin-1") for w in text.to_pylist()]
        size, head, tail, below, block = (part.column(c).to_numpy() for c in names[2:])
        fresh = np.ones(len(block), bool)
        fresh[1:] = block[1:] != block[:-1]
        which = np.cumsum(fresh) - 1
        short = np.fromiter(map(len, words), np.int64, len(words)) == size
        rank = np.lexsort((~short, which))  # each block's shorter words before its longer ones
        end = np.append(np.flatnonzero(fresh)[1:], len(block))[which[rank]]  # of the row's block
        mates = np.where(short[rank], end - 1 - np.arange(len(rank)), 0)  # a shorter word meets all that follow it
        total = np.cumsum(mates)
        at = 0
        while at < len(rank):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            k = mates[at:stop]
            first = np.repeat(np.arange(at, stop), k)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
            i, j = rank[first], rank[second]
            good = _near(words, size, head, tail, below, i, j) if len(i) else np.zeros(0, bool)
            i, j = pa.array(i[good]), pa.array(j[good])
            if len(i):
                yield pa.RecordBatch.from_arrays([text.take(i), pa.array(n[i]), text.take(j), pa.array(n[j])], names=fields.names)
            at = stop

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            part = pa.Table.from_batches(held)
            block = part.column("block").to_numpy()
            whole = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            yield from verified(part.slice(0, whole))
            rest = part.slice(whole)
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from verified(pa.Table.from_batches(held))

    return dealt.mapInArrow(scan, fields)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that is reached from each word of (word, form); a chain has no cycle, since n grows along it."""
    up = written(forms.select("word", F.col("form").alias("up")), "pointers")
    while True:  # follow forms, twice as far each time
        far = up.select(F.col("word").alias("up"), F.col("up").alias("far"))
        longer = written(up.join(far.hint("merge"), "up", "left").select("word", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "pointers")
        up = longer.select("word", "up")
        if longer.filter("moved").isEmpty():
            return up.select("word", F.col("up").alias("root"))


def variants(words: DataFrame, min_length: int = MIN_LENGTH, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of ``words`` (word, n; each word once, Latin-1 letters).

    n_near counts the words one edit away. The form is the most frequent of these (of equals the first in
    code-point order) if it is ``ratio`` times as frequent or more; root follows forms to the last. Words
    shorter than ``min_length`` have no near words. No words give no rows.
    """
    words = words.select("word", "n")
    links = written(near_words(words.filter(F.char_length("word") >= min_length), min_length), "near-words")
    both = links.unionByName(links.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n"), "forms")
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = 0) -> DataFrame:
    """``variants`` of the words with at least ``min_count`` occurrences in all texts of ``df``.

    Null and empty texts have no words; repeated rows and ids count as often as they come; a text or a run
    of any length is read whole. No rows, or no such words, give no rows. Other columns are ignored.
    """
    counted = word_counts(df, id_col, text_col, min_length, noise)
    return variants(written(counted.filter(F.col("n") >= min_count), "dictionary"), min_length, ratio)
