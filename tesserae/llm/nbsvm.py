"""Linear classifiers on n-gram indicators that are scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams it holds, hashed into 2^BITS places. For each place the
ratio r = log(share of the class's counts / share of the other's) is taken from the labelled rows; a
text is the vector of r at its places, scaled to length one, and a linear hinge-loss model over these
vectors is fitted by dual coordinate descent. Margins become probabilities by a logistic curve
fitted to rows that the model hasn't seen.

A bounded sample of labelled rows (``sample_rows``, by least hash of the id) is fitted on the driver.
Scoring runs over every whole text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import RollingHash, lowered, mix, slices, text_bytes, words_of

BITS = 18
_BLANK = np.ones(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = False


@dataclasses.dataclass(frozen=True)
class Features:
    """Which n-grams count: runs of ``chars`` bytes and of ``words`` words (split at ASCII white space)."""

    chars: tuple[int, ...]
    words: tuple[int, ...] = ()
    lower: bool = True


def places(batch: pa.RecordBatch, text: str, features: Features) -> Iterator[np.ndarray]:
    """For each row the sorted distinct places of its n-grams."""
    data, offsets = text_bytes(batch.column(text))
    if features.lower:
        data = lowered(data)
    hashes = RollingHash(data)
    shift = np.uint64(64 - BITS)
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, and where each row's begin and end
    ends = np.arange(len(data) + 1)
    for n in features.chars:
        start = ends[: max(0, len(data) - n + 1)]
        found = (hashes.spans(start, start + n) >> shift).astype(np.int32)
        grams.append((found, offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)))
    if features.words:
        start, stop, first = words_of(data, offsets, _BLANK)
        words = hashes.spans(start, stop)
        for n in features.words:
            total = max(0, len(words) - n + 1)
            run = np.full(total, n, np.uint64)
            for k in range(n):
                run = mix(run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + total])
            grams.append(((run >> shift).astype(np.int32), first[:-1], np.maximum(first[:-1], first[1:] - n + 1)))
    held = np.zeros(1 << BITS, bool)
    for row in range(batch.num_rows):
        for found, begin, end in grams:
            held[found[begin[row] : end[row]]] = True
        own = np.flatnonzero(held)
        held[own] = False
        yield own


@dataclasses.dataclass
class Model:
    """weights: by place, the ratio already multiplied in. A margin m scores 1 / (1 + exp(-(slope * m + offset)))."""

    features: Features
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, own: np.ndarray) -> float:
        ratios = self.ratios[own]
        return float(self.weights[own].sum() / max(1e-9, np.sqrt((ratios * ratios).sum()))) + self.bias if len(own) else self.bias

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(own) + self.offset, -60, 60))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)]
    for own, y in zip(rows, labels, strict=True):
        counts[int(y)][own] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: float, rounds: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + cost * sum of hinge losses, one dual variable at a time.

    Each row has length one, besides a constant entry of 1 for the bias.
    """
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own, x, y = rows[i], values[i], signs[i]
            slack = y * (weights[own] @ x + bias) - 1
            new = min(max(alpha[i] - slack / (x @ x + 1), 0.0), cost)
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                weights[own] += step * y * x
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def _unit(own: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    x = ratios[own]
    return x / max(1e-9, np.sqrt(x @ x))


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method on softened labels."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -60, 60)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray, features: Features, cost: float = 1.0, rounds: int = 12) -> Model:
    """A model from places and 0/1 labels. With one class only (or no rows) every text scores that class's share."""
    labels = np.asarray(labels, float)
    n = len(rows)
    if n == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (n + 2)
        return Model(features, np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))

    def learned(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        some = [rows[i] for i in pick]
        ratios = log_count_ratios(some, labels[pick])
        weights, bias = dual_coordinate_descent(some, [_unit(own, ratios) for own in some], 2 * labels[pick] - 1, cost, rounds)
        return ratios, weights * ratios, bias

    margins = np.zeros(n)
    folds = np.arange(n) % 3
    if min(labels.sum(), n - labels.sum()) >= 6:  # margins of rows unseen by the model that gives them
        for k in range(3):
            part = Model(features, *learned(np.flatnonzero(folds != k)), 1.0, 0.0)
            for i in np.flatnonzero(folds == k):
                margins[i] = part.margin(rows[i])
        slope, offset = logistic_curve(margins, labels)
    else:
        slope, offset = 2.0, 0.0
    return Model(features, *learned(np.arange(n)), slope, offset)


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, cost: float = 1.0) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels`` (id, label) that have a text; the sample is fixed by the ids.

    Rows with a null id, label or text are left out; a repeated id counts once, with its larger label.
    """
    chosen = (
        labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(F.max(F.col(f"`{label}`")).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("places", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = [p.astype(np.int32).tobytes() for p in places(part, "text", features)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(own, pa.binary())], names=schema.names)

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(chosen), "id").select(F.col("id").cast("long").alias("id"), "y", "text").mapInArrow(run, schema)  # at most sample_rows ids
    # Of several texts under one id the one of the least places counts, so no more rows reach the driver than ids were chosen.
    once = found.groupBy("id").agg(F.max("y").alias("y"), F.min("places").alias("places")).collect()  # at most sample_rows rows of at most 2^BITS places
    kept = [(row.y, bytes(row.places)) for row in sorted(once, key=lambda row: row.id)]
    return fit([np.frombuffer(p, np.int32) for _, p in kept], np.array([y for y, _ in kept]), features, cost)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """id, ``keep`` and ``out`` (0 to 1) of every row; null and empty texts score as a text without n-grams.

    A column named ``out`` is replaced. Repeated rows score alike; an empty table gives no rows.
    """
    names = [c for c in dict.fromkeys([id_col, *keep]) if c != out]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for part in slices(batches, text_col):
            scores = [model.score(own) for own in places(part, text_col, model.features)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, schema)
