"""Vector functions as column expressions."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.regex import finder
from tesserae.functions.text import CONCEPTS

DIMENSIONS = 384
#: How often a concept counts, against once for a word.
CONCEPT_WEIGHT = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length and for zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (scale == 0) | scale.isNull(), 0.0).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))[0]


def similarity(a: Column, b: Column) -> Column:
    """Cosine within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a over the characters' code units (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


_WORD, _HAN = re.compile("[a-z0-9]+"), re.compile("[㐀-鿿]")
_SHOWN = finder(CONCEPTS)
#: Tokens whose hashes a task remembers, and texts that it embeds at a time; they bound its memory, not the result.
MOST_HASHES, STEP = 50_000, 256


def embedding_tokens(text: str) -> list[str]:
    """Words, trigrams of words of four or more letters, Han characters and pairs, and concepts, which count several times."""
    text = unicodedata.normalize("NFKC", text).lower()
    words, han = _WORD.findall(text), _HAN.findall(text)
    tokens = [f"w:{w}" for w in words] + [f"g:{w[i : i + 3]}" for w in words if len(w) >= 4 for i in range(len(w) - 2)]
    tokens += [f"c:{c}" for c in han] + [f"b:{a}{b}" for a, b in itertools.pairwise(han)]
    return tokens + [f"s:{name}" for name in _SHOWN(text) for _ in range(CONCEPT_WEIGHT)]


def _fnv1a(token: str) -> int:
    h = 2166136261
    for c in token:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def embed_text(text: str | None, dimensions: int = DIMENSIONS, hashes: dict[str, int] | None = None) -> np.ndarray:
    """A signed feature hash of the text's tokens, of length one (zero without tokens); ``hashes`` keeps what was hashed before."""
    hashes = {} if hashes is None else hashes
    counted = Counter(embedding_tokens(text or ""))
    if not counted:
        return np.zeros(dimensions)
    held = np.empty(len(counted), np.int64)
    for i, token in enumerate(counted):
        h = hashes.get(token)
        if h is None:
            if len(hashes) >= MOST_HASHES:
                hashes.clear()
            h = hashes[token] = _fnv1a(token)
        held[i] = h
    times = np.fromiter(counted.values(), np.float64, len(counted))
    v = np.bincount(held % dimensions, np.where(held >> 31, -times, times), dimensions)
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def local_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """``embed_text`` of a column: no model and no network."""

    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes: dict[str, int] = {}
        for texts in batches:
            for at in range(0, max(1, len(texts)), STEP):
                rows = [embed_text(t, dimensions, hashes) for t in texts[at : at + STEP].to_pylist()]
                flat = np.concatenate(rows) if rows else np.zeros(0)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dimensions, pa.int32()), pa.array(flat))

    return F.arrow_udf(embed, T.ArrayType(T.DoubleType()))(text)
