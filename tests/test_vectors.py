import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import vectors


def made(rng, n, clusters=12, width=16):
    centres = rng.normal(size=(clusters, width))
    rows = (centres[rng.integers(clusters, size=n)] + 0.1 * rng.normal(size=(n, width))).astype(np.float32)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def brute(rows, asks, k):
    m = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    s = np.round(m @ m.T, 6)
    out = {}
    for i, (own, _) in enumerate(rows):
        if asks(own):
            order = sorted((-s[i, j], other) for j, (other, _) in enumerate(rows) if other != own)
            out[own] = [(other, -x) for x, other in order[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r.id, r.similarity))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        clear = {i for i, s in want[q] if s > want[q][-1][1] + 2e-6}
        assert clear <= {i for i, _ in got[q]}


@pytest.mark.parametrize(("cells", "block_rows"), [(None, 4096), (7, 10), (1, 50)])
def test_cells_give_what_all_pairs_give(spark, cells, block_rows):
    rows = made(np.random.default_rng(3), 300)
    rows += [(1000 + i, rows[5][1]) for i in range(90)] + [(2000, [0.0] * 16), (2001, [0.0] * 16), (2002, [-x for x in rows[7][1]])]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (3000, None)], "vec_id long, embedding array<float>")
    for asks, column in ((lambda i: True, F.lit(True)), (lambda i: i % 50 == 0, F.col("vec_id") % 50 == 0)):
        got = found(vectors.nearest_by_cells(df, F.coalesce(column, F.lit(False)), 4, cells=cells, block_rows=block_rows))
        same(got, brute(rows, asks, 4))
    hot = got[2000] and found(vectors.nearest_by_cells(df, F.col("vec_id") >= 1000, 4, cells=cells))[1001]
    assert [i for i, _ in hot] == [5, 1000, 1002, 1003]


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.nearest_by_cells(spark.createDataFrame([], schema), F.lit(True), 3).count() == 0
    assert found(vectors.nearest_by_cells(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], schema), F.lit(True), 3)) == {1: [(2, 0.707107)], 2: [(1, 0.707107)]}


def test_far_cells_are_skipped(spark):
    rows = made(np.random.default_rng(4), 2000, clusters=20)
    held, pivots = vectors.in_cells(spark.createDataFrame(rows, "id long, v array<float>"))
    sizes = held.groupBy("cell").agg(F.min("far").alias("near"), F.max("far").alias("far")).collect()
    asked = held.select(F.col("id").alias("query"), "v", "cell")
    floors = asked.select("query", F.lit(0.95).alias("floor"))
    read = vectors.cells_to_read(asked, floors, sizes, pivots).count()
    assert read < 0.4 * len(rows) * (len(sizes) - 1)


def test_what_a_task_holds_does_not_follow_its_batch(monkeypatch):
    """Products, and the rows handed on, are made in steps; ties by place as in a stable sort."""
    rng = np.random.default_rng(4)
    similar = np.round(rng.normal(size=(40, 300)), 1)
    assert np.array_equal(vectors._first(similar, 7), np.argsort(-similar, axis=1, kind="stable")[:, :7])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["id"])
    parts = list(vectors._steps(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= vectors.STEP and sum(p.num_rows for p in parts) == 1000


@pytest.mark.parametrize("step", [1, 7])
def test_steps_change_nothing(spark, monkeypatch, step):
    monkeypatch.setattr(vectors, "STEP", step)
    rows = made(np.random.default_rng(8), 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(found(vectors.nearest_by_cells(df, F.col("vec_id") % 3 == 0, 5, cells=6, block_rows=40)), brute(rows, lambda i: i % 3 == 0, 5))
    same(found(vectors.nearest(df, F.col("vec_id") % 30 == 0, 5, block_rows=40)), brute(rows, lambda i: i % 30 == 0, 5))


def test_no_row_is_stored_once_for_each_cell(spark, monkeypatch):
    """Vectors without clusters: every query reads nearly all cells, and was stored with its vector once for each."""
    stored = []
    kept = vectors.settled
    monkeypatch.setattr(vectors, "settled", lambda df: stored.append(kept(df)) or stored[-1])
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 16)).astype(np.float32))]
    got = found(vectors.nearest_by_cells(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True), 3, cells=40))
    same(got, brute(rows, lambda i: True, 3))
    assert max(df.count() for df in stored) <= vectors.SHARES * 4 * len(rows)


def test_embedding_remembers_few_hashes_and_finds_concepts_as_their_patterns_do(spark, monkeypatch):
    import random
    import re

    from tesserae.functions import text, vector
    from tesserae.functions.regex import ascii_borders, finder

    monkeypatch.setattr(vector, "MOST_HASHES", 10)
    hashes = {}
    words = [f"word{i} cat{i}" for i in range(300)]
    a = vector.embed_text(" ".join(words), hashes=hashes)
    assert len(hashes) <= 10 and np.array_equal(a, vector.embed_text(" ".join(words)))

    rng, found = random.Random(2), finder(text.CONCEPTS)
    whole = [(name, re.compile(ascii_borders(p), re.I)) for name, p in text.CONCEPTS]
    bits = [b for _, p in text.CONCEPTS for b in re.findall(r"\w+", p)] + [" ", "-", "\n", "s", "ı"]
    for _ in range(800):
        told = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))).lower()
        assert found(told) == [name for name, p in whole if p.search(told)], told

    rows = [(i, None if i == 3 else f"text {i} my dog {i}") for i in range(600)]
    got = spark.createDataFrame(rows, "i long, t string").select("i", vector.local_embedding(F.col("t")).alias("e")).collect()
    assert len(got) == 600 and all(np.array_equal(r.e, vector.embed_text(rows[r.i][1])) for r in got)
