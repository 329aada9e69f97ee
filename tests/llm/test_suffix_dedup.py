import hashlib
import random
from collections import Counter

import pytest

from tesserae.llm import suffix_dedup
from tests.llm.conftest import odd_rows


def brute(rows, length):
    counts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(df, length):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, length=length).collect()), key=repr)


@pytest.mark.parametrize(("letters", "length"), [("ab", 16), ("abcdefgh ", 24), ("a", 20), ("xyé漢", 31)])
def test_against_brute_force(spark, docs_of, letters, length):
    rng = random.Random(13)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(10, 90))) for _ in range(8)]
    rows = []
    for i in range(50):
        parts = ["".join(rng.choice("qrstuvw" + letters) for _ in range(rng.randrange(40))) for _ in range(3)]
        rows.append((i, parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[rng.randrange(10) :] + parts[2]))
    rows += [(90, rows[0][1]), (91, None), (92, ""), (93, passages[0] * 3)]
    assert run(docs_of(rows), length) == brute(rows, length)


def test_contract_length_and_odd_rows(spark, docs_of):
    rng = random.Random(14)
    passage = "".join(rng.choice("abcdefghij klm") for _ in range(700))
    rows = [(i, "".join(rng.choice("nopqrst uv") for _ in range(rng.randrange(300))) + passage[: rng.randrange(380, 700)] + "".join(rng.choice("nopq") for _ in range(90))) for i in range(25)]
    rows += [r for r in odd_rows() if r[0] != 6]
    assert run(docs_of(rows), 400) == brute(rows, 400)


def test_kept_bytes_and_no_rows(spark, docs_of):
    got = suffix_dedup.remove_repeats(docs_of([(1, "abc" * 20), (2, "abc" * 20), (3, "other")]), length=30, keep_bytes=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {1: b"", 2: b"", 3: b"other"}
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


def test_words_in_common_against_brute_force(spark, docs_of):
    rng = random.Random(15)
    passages = [" ".join(rng.choice("ab") + rng.choice("cdef") for _ in range(rng.randrange(6, 30))) for _ in range(9)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"{i}w{k}" for k in range(rng.randrange(12))) for _ in range(3)]
        blank = rng.choice([" ", "\n", " \t "])
        rows.append((i, blank.join([parts[0], rng.choice(passages), parts[1], rng.choice(passages).replace(" ", blank), parts[2]])))
    rows += [(90, rows[0][1]), (91, None), (92, ""), (93, passages[0] + " " + passages[0]), (94, "own " * 40), (94, "own " * 40)]
    for n in (2, 5, 10, 13):
        holders = {}
        for i, t in rows:
            w = (t or "").split()
            for k in range(len(w) - n + 1):
                holders.setdefault(tuple(w[k : k + n]), set()).add(i)
        want = {i for h in holders.values() if len(h) > 1 for i in h}
        assert {r.id for r in suffix_dedup.sharing_documents(docs_of(rows), words=n).collect()} == want


def test_words_in_common_with_odd_rows(spark, docs_of):
    rows = [*odd_rows(), (9, next(t for i, t in odd_rows() if i == 6)[1000:])]
    assert {r.id for r in suffix_dedup.sharing_documents(docs_of(rows)).collect()} == {6, 9}
    assert suffix_dedup.sharing_documents(docs_of([])).count() == 0
