"""Byte-level BPE by segment trees over adjacent pair ranks.

Each pre-token is a row of symbols. A segment tree over its adjacent pairs holds (rank, place) and
keeps the least at the root: the leftmost pair of the lowest rank. A merge rewrites the leaf of the
merged pair and those of its two neighbours, and the tree is repaired along their paths only, in
logarithmic time. It ends when the root holds no mergeable pair. Short pre-tokens of one size class
advance in lock step as rows of numpy arrays; a long one gets a scalar tree of the same kind.

The vocabulary is a file of the `tokenizers` library. The driver reads it and ships it as arrays,
whose size the vocabulary bounds. Pre-tokens repeat, so every worker keeps up to CACHE_WORDS results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import slices

#: Pre-tokens kept by a worker before it starts over; bounds its memory, not the result.
CACHE_WORDS = 400_000
#: Pre-tokens of up to so many symbols are merged in lock step.
LOCK_STEP = 64
#: How byte-level vocabularies of this kind split text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1) << np.int64(62)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Vocabulary:
    """Ids of bytes and merges as sorted arrays; built on the driver, small enough to ship (it grows with the vocabulary only)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = byte_alphabet()
        of_char = {c: b for b, c in enumerate(alphabet)}
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in alphabet], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = bytes(of_char[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.pieces[i] = content.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where they don't merge; negative ids stand for no symbol."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)


def merge_rows(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge every row of ``symbols`` (ids, then -1 up to a power-of-two width) to its end; merged-away places become -1."""
    rows, width = symbols.shape
    symbols = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1)  # place ``width``: no symbol
    after = np.tile(np.arange(1, width + 2), (rows, 1))
    before = np.tile(np.arange(-1, width), (rows, 1))
    before = np.concatenate([before, np.full((rows, 1), width - 1)], axis=1)
    places = np.arange(width)
    tree = np.full((rows, 2 * width), _NONE, np.int64)
    ranks = vocabulary.rank(symbols[:, :width], symbols[:, 1:])
    tree[:, width:] = np.where(ranks == _NONE, _NONE, ranks * width + places)
    step = width
    while step > 1:  # each level is the minimum of the one below
        tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
        step //= 2
    levels = width.bit_length() - 1
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        root = tree[live, 1]
        place = root % width
        symbols[live, place] = new = vocabulary.made[root // width]
        gone = after[live, place]
        beyond = after[live, gone]
        symbols[live, gone] = -1
        after[live, place] = beyond
        before[live, np.minimum(beyond, width)] = place
        left = before[live, place]
        follows = np.where(beyond < width, symbols[live, np.minimum(beyond, width)], -1)
        rank = vocabulary.rank(new, follows)
        tree[live, width + gone] = _NONE
        tree[live, width + place] = np.where(rank == _NONE, _NONE, rank * width + place)
        has_left = left >= 0
        rank = vocabulary.rank(np.where(has_left, symbols[live, left], -1), new)
        left = np.where(has_left, left, place)  # without a left neighbour the place itself is looked at again
        tree[live, width + left] = np.where(has_left, np.where(rank == _NONE, _NONE, rank * width + left), tree[live, width + place])
        for leaf in (gone, place, left):
            node = width + leaf
            for _ in range(levels):
                node = node >> 1
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        live = live[tree[live, 1] != _NONE]
    return symbols[:, :width]


def merge_long(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """The same for one long row, with a scalar tree."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    ids = np.full(width + 1, -1, np.int64)
    ids[:n] = symbols
    ranks = vocabulary.rank(ids[:-1], ids[1:])
    none = int(_NONE)
    tree = [none] * width + [none if r == none else r * width + i for i, r in enumerate(ranks.tolist())]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    ranked = _rank_table(vocabulary)
    made = vocabulary.made
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        node = width + place
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    def pair(place: int) -> int:
        beyond = after[place]
        rank = ranked.get((symbols[place] << 32) | symbols[beyond]) if beyond < n else None
        return none if rank is None else rank * width + place

    while (root := tree[1]) != none:
        rank, place = divmod(root, width)
        gone = after[place]
        symbols[place], symbols[gone] = int(made[rank]), -1
        after[place] = beyond = after[gone]
        if beyond < n:
            before[beyond] = place
        put(gone, none)
        put(place, pair(place))
        if (left := before[place]) >= 0:
            put(left, pair(left))
    return [s for s in symbols if s >= 0]


def _rank_table(vocabulary: Vocabulary) -> dict[int, int]:
    table = getattr(vocabulary, "_table", None)
    if table is None:
        table = vocabulary._table = dict(zip(vocabulary.keys.tolist(), vocabulary.ranks.tolist(), strict=True))
    return table


class Encoder:
    """Encodes and decodes texts with one vocabulary; keeps what it has merged."""

    def __init__(self, vocabulary: Vocabulary, as_ids: bool = True, cache_words: int = CACHE_WORDS) -> None:
        """as_ids: pre-tokens are kept as lists of ids; else as ids joined by commas and the bytes decoded from them."""
        self.vocabulary, self.as_ids, self.cache_words = vocabulary, as_ids, cache_words
        self.split = regex.compile(SPLIT)
        contents = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, contents)) + ")") if contents else None
        self.names = list(map(str, range(len(vocabulary.pieces))))
        self.width = [max(2, 1 << max(0, n - 1).bit_length()) for n in range(LOCK_STEP + 1)]
        self.ids: dict = {}
        self.raw: dict = {}

    def pre_tokens(self, text: str) -> list:
        """Pre-tokens in order; the strings of added tokens stand for themselves, as (content,) tuples."""
        if self.added is None or not self.added.search(text):
            return self.split.findall(text)
        found: list = []
        for i, part in enumerate(self.added.split(text)):
            found += [(part,)] if i % 2 else self.split.findall(part)
        return found

    def learn(self, words: set) -> None:
        """Merge the pre-tokens that are not known yet."""
        by_width: dict[int, list] = {}
        long: list = []
        for word in words:
            if isinstance(word, tuple):
                self.keep(word, [self.vocabulary.added[word[0]]])
                continue
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LOCK_STEP:
                long.append((word, raw))
            else:
                by_width.setdefault(self.width[len(raw)], []).append((word, raw))
        for word, raw in long:
            self.keep(word, merge_long(self.vocabulary, self.vocabulary.byte_ids[list(raw)].tolist()))
        for width, group in by_width.items():
            for start in range(0, len(group), 4096):
                part = group[start : start + 4096]
                symbols = np.full((len(part), width), -1, np.int64)
                lengths = np.array([len(raw) for _, raw in part])
                symbols[np.arange(width) < lengths[:, None]] = self.vocabulary.byte_ids[np.frombuffer(b"".join([raw for _, raw in part]), np.uint8)]
                merged = merge_rows(self.vocabulary, symbols)
                left = merged >= 0
                ids, ends, begin = merged[left].tolist(), np.cumsum(left.sum(axis=1)).tolist(), 0
                for (word, _), end in zip(part, ends, strict=True):
                    self.keep(word, ids[begin:end])
                    begin = end

    def keep(self, word, ids: list[int]) -> None:
        if self.as_ids:
            self.ids[word] = ids
        else:
            names, pieces = self.names, self.vocabulary.pieces
            self.ids[word] = ",".join([names[i] for i in ids])
            self.raw[word] = b"".join([pieces[i] for i in ids])

    def batch(self, texts: list[str]) -> list[list]:
        """The pre-tokens of each text, all of them known afterwards."""
        cuts = [self.pre_tokens(t) for t in texts]
        new = set().union(*cuts)
        if len(self.ids) + len(new) > self.cache_words:
            self.ids, self.raw = {}, {}
        self.learn(new - self.ids.keys())
        return cuts

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for word in cut for i in self.ids[word]] for cut in self.batch(texts)]

    def decode(self, ids: list[int]) -> str:
        pieces = self.vocabulary.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: how many ids, the SHA-256 of the ids joined by commas, and that of the text decoded from them."""
        for cut in self.batch(texts):
            ids = ",".join(map(self.ids.__getitem__, cut))
            raw = b"".join(map(self.raw.__getitem__, cut)).decode("utf-8", "replace").encode()
            yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _mapped(df: DataFrame, keep: list[str], text_col: str, path: str, fields: list[T.StructField], columns, as_ids: bool) -> DataFrame:
    """``keep`` and new columns made by ``columns(encoder, texts)``, a list of arrow arrays."""
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, as_ids)
        for part in slices(batches, text_col):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns(encoder, texts)], names=[f.name for f in schema])

    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of each whole text as an array in ``out`` (it replaces a column of that name).

    Null and empty texts have no ids. Strings of added tokens become their ids, as the library does by default.
    """
    keep = [c for c in df.columns if c != out]
    return _mapped(df, keep, text_col, path, [T.StructField(out, T.ArrayType(T.IntegerType()))], lambda e, texts: [pa.array(e.encode(texts), pa.list_(pa.int32()))], True)


def tokenized(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (array), n_tokens, and lossless: whether decoding the ids gives the text again.

    Null and empty texts have no ids and count as lossless.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]

    def columns(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        ids = encoder.encode(texts)
        same = [encoder.decode(i) == t for i, t in zip(ids, texts, strict=True)]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)]

    return _mapped(df, list(keep), text_col, path, fields, columns, True)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """The other way: texts from arrays of ids; bytes that aren't UTF-8 become U+FFFD. A null array gives an empty text."""
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: what encoding each whole text and decoding its ids gives, as digests.

    Null and empty texts: no tokens, digests of the empty string. Repeated rows give repeated rows; an empty table none.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def columns(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        found = list(encoder.digests(texts))
        return [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _mapped(df, [id_col], text_col, path, fields, columns, False)
