import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import substring_dedup
from tests.llm.conftest import odd_rows


def brute(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def run(df, window):
    return sorted((tuple(r) for r in substring_dedup.remove_passages(df, window=window, keep_text=True).collect()), key=repr)


def made_rows(rng, n, vocabulary):
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))) for _ in range(9)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"{i}w{k}" for k in range(rng.randrange(12))) for _ in range(3)]
        blank = rng.choice([" ", "\n", " \t "])
        rows.append((i, blank.join([parts[0], rng.choice(passages), parts[1], " ".join(rng.choice(passages).split()[rng.randrange(9) :]), parts[2]]).replace(" ", blank)))
    rng.shuffle(rows)
    return [*rows, (90, rows[0][1]), (91, None), (92, ""), (93, passages[0] + " " + passages[0]), (94, "own " * 40), (94, "own " * 40), (None, rows[3][1]), (95, rows[3][1] + " end"), (-4, rows[5][1]), (94, passages[1])]


@pytest.mark.parametrize(("window", "vocabulary"), [(2, "abcdefghijklmnop"), (5, "ab"), (13, "ab"), (13, ["é", "漢字", "word"])])
def test_against_brute_force(spark, docs_of, window, vocabulary):
    rows = made_rows(random.Random(window), 60, vocabulary)
    assert run(docs_of(rows), window) == brute(rows, window)


def test_small_pieces_and_shared_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 10)
    monkeypatch.setattr(substring_dedup, "SERVED", 3)
    rows = made_rows(random.Random(8), 80, "abc")
    assert run(docs_of(rows), 7) == brute(rows, 7)


def test_a_passage_in_several_pieces_of_long_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 8)
    rng = random.Random(9)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9, 16))) for _ in range(5)]
    rows = [(i, " ".join(rng.choice([*passages, *(p.replace(rng.choice("abc"), "x") for p in passages), f"{i} own", "some words"]) for _ in range(30))) for i in range(25)]
    assert run(docs_of(rows), 6) == brute(rows, 6)


def test_contract_and_odd_rows(spark, docs_of):
    odd = odd_rows()
    rows = [*odd, (9, next(t for i, t in odd if i == 6)[1000:]), (11, "alpha beta " + " ".join(f"word{i % 977} the of" for i in range(50)))]
    extra = {c: F.lit("x") for c in ("doc", "t1", "first", "n", "kept", "n_words", "part", "whole", "id")}
    assert run(docs_of(rows).withColumns(extra), 13) == brute(rows, 13)
    assert [tuple(r) for r in substring_dedup.remove_passages(docs_of([(1, None)])).collect()] == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert substring_dedup.remove_passages(docs_of([])).count() == 0


def test_factors_are_the_longest_and_ends_are_checked():
    block = substring_dedup.Block(np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 5, 6, 7, 3, 5, 6, 8], np.uint64), window=3)
    assert block.parse(np.array([0, 1, 2, 3, 4, 5, 6, 0], np.uint64)) == [(1, 7)]
    assert block.parse(np.array([2, 3, 4, 9, 0], np.uint64)) == [(0, 4)]
    # 5 6 ends the first factor, and 5 6 8 crosses its end
    assert block.parse(np.array([4, 5, 6, 8], np.uint64)) == [(0, 3), (1, 4)]
    assert block.parse(np.array([1, 2], np.uint64)) == [] and substring_dedup.Block(np.zeros(0, np.uint64), 3).parse(np.array([1, 2, 3], np.uint64)) == []


def test_repetitive_texts_parse_in_time():
    words = np.ones(4000, np.uint64)
    assert substring_dedup.Block(words).parse(np.append(words, np.uint64(2))) == [(0, 4000)]
