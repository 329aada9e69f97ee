import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import spelling
from tests.llm.conftest import odd_rows


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, noise, least=7):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def brute_variants(counts, least=7, ratio=10):
    near = {w: [v for v in counts if len(w) >= least and len(v) >= least and one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def run(words):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in words.collect())


def made_words(rng, n, letters="abé", low=7, high=12):
    found = set()
    while len(found) < n:
        found.add("".join(rng.choice(letters) for _ in range(rng.randrange(low, high))))
    return sorted(found)


@pytest.mark.parametrize("most", [0, 3, 50, 10**9])
def test_near_words_against_brute_force(spark, most):
    rng = random.Random(5)
    words = made_words(rng, 250) + ["z" * 200, "z" * 199 + "y", "z" * 201, "x" * 70, "x" * 71] + ["common" + a + b for a in "abcdefgh" for b in "ijkl"]
    got = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most=most).collect()
    pairs = [tuple(sorted((r.word, r.other))) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_blocks_are_small(spark):
    words = ["prefix" + a + b + c + "suffix" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    found = spelling.blocks(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most=100)
    sizes = found.groupBy("block", "size", "head", "tail").agg(F.count_if(F.length("word") == F.col("size")).alias("s"), F.count(F.lit(1)).alias("n"))
    assert all(r.s * (r.s - 1) / 2 + r.s * (r.n - r.s) <= 100 and r.n <= 101 for r in sizes.collect())


def test_forms_and_roots_against_brute_force(spark):
    rng = random.Random(6)
    counts = {w: rng.choice([2, 3, 20, 30, 400, 5000]) for w in made_words(rng, 200, "ab")} | {"short": 5000, "shart": 2}
    assert run(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_variants(counts)


@pytest.mark.parametrize("noise", [0, 3, 31])
def test_texts_against_brute_force(spark, docs_of, noise):
    rng = random.Random(7)
    vocabulary = made_words(rng, 60, "aÀz×", 6, 10)
    rows = [(rng.choice([None, *range(30)]), rng.choice([" ", "漢", "-1", "\u0000"]).join(rng.choice(vocabulary[:6] if rng.random() < 0.6 else vocabulary).upper() for _ in range(rng.randrange(80)))) for _ in range(60)]
    rows += [*odd_rows(), *rows[:3], (70, "longrun" * 4000), (71, "longrun" * 4000)]
    counts = {w: n for w, n in brute_words(rows, noise).items() if n >= 2}
    got = run(spelling.spelling_variants(docs_of(rows).withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(2)}), noise=noise))
    assert got == brute_variants(counts)


def test_long_texts_in_pieces(spark, docs_of, monkeypatch):
    text = "abcdefgh ijklmnop\tqrstuvwxyz " * 9
    assert [len(p) for p in spelling._pieces("abc " * 3)] == [3]
    monkeypatch.setattr(spelling, "PIECE", 5)
    assert [r for p in spelling._pieces(text) for r in p] == text.encode().split()


def test_no_rows(spark, docs_of):
    assert spelling.spelling_variants(docs_of([])).count() == 0
    assert spelling.spelling_variants(docs_of([(1, None), (2, "one two")])).count() == 0
