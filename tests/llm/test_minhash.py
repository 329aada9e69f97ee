import random

import numpy as np

from tesserae.llm import minhash, spelling
from tesserae.llm.components import components
from tests.llm.conftest import odd_rows, words


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(rng, groups, copies, length, edits):
    rows = []
    for _ in range(groups):
        base = words(rng, length).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(w)))
    return rows


def result(df, **k):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **k).collect()}


def test_components_against_brute_force(spark, docs_of):
    rng = random.Random(6)
    rows = near_copies(rng, 6, 12, 80, 9) + [(900, "A b"), (901, "a B"), (902, "alone"), (903, ""), (904, None), (905, "alone")]
    rng.shuffle(rows)
    for size in (2, 5):
        assert result(docs_of(rows), shingle=size) == brute(rows, size, 80)


def test_a_large_group_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    rows = near_copies(rng, 1, 120, 60, 12)
    assert result(docs_of(rows), shingle=2) == brute(rows, 2, 80)


def test_odd_rows(spark, docs_of):
    got = minhash.near_duplicates(docs_of(odd_rows()), shingle=2).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and not by[5].kept and by[1].kept and by[2].n_shingles == 0
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(docs_of([]), shingle=2).count() == 0


def test_every_place_of_a_sketch_is_filled():
    for n in (1, 2, 3, 50, 2000):
        sets = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        grid = minhash.sketches(sets, np.array([0, n]))
        assert (grid != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    grid = minhash.sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]), places=512)
    assert abs((grid[0] == grid[1]).mean() - 800 / 1200) < 0.08


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_estimates_of_size_do_not_multiply_over_the_rounds(spark):
    """Each round joined what the one before had made, and squared its estimated size: a number of thousands of digits."""
    rng = random.Random(9)
    names = rng.sample(range(1000), 200)
    got = components(spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long"))
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    ends = spelling.roots(chain)
    assert {(r.id, r.component) for r in got.collect()} == {(i, min(names)) for i in names}
    assert {(r.word, r.root) for r in ends.collect()} == {(f"w{i}", "w40") for i in range(40)}
    for df in (got, ends):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30


def test_ids_of_several_texts_have_one_result(spark, docs_of):
    texts = [" ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1])]
    results = {tuple(sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs_of(rows[k:] + rows[:k]), shingle=2).collect())) for k in range(3)}
    assert len(results) == 1


def test_columns_of_any_name(spark, docs_of):
    rows = [(i, f"one two three four {i // 2}") for i in range(6)]
    wide = docs_of(rows)
    for name in ("id", "sig", "key", "place", "bands", "component", "kept", "hash"):
        wide = wide.withColumn(name, wide["doc_id"] * 0)
    assert result(wide, shingle=2) == result(docs_of(rows), shingle=2)
