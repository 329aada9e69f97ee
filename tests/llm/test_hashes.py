import numpy as np

from tesserae.llm import minhash
from tesserae.llm.common import PRIME, SpanHash, _reduced, _times, mix, word_hashes


def alternation(rounds):
    """The Thue-Morse word of 2^rounds letters and its complement: alike for every polynomial modulo 2^64."""
    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(rounds):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_spans_against_their_definition():
    data = np.random.default_rng(3).integers(0, 256, 2_500_000, dtype=np.uint8)
    base = int(mix(np.array([12], np.uint64))[0]) % (PRIME - 512) + 512
    hashes = SpanHash(data, 12)
    for i, j in ((0, 0), (0, 9), (1_048_570, 1_048_590), (2_499_000, 2_500_000)):
        want = sum((int(b) + 1) * pow(base, k, PRIME) for k, b in enumerate(data[i:j])) % PRIME
        got = _times(_reduced(hashes.sums[j : j + 1] + (np.uint64(PRIME) - hashes.sums[i : i + 1])), hashes.down[i : i + 1])
        assert int(got[0]) == want


def test_alternations_differ():
    x, y = (np.frombuffer(w.encode(), np.uint8) for w in alternation(12))
    for seed in (1, 11, 12):
        a, b = (SpanHash(w, seed).spans(np.array([0]), np.array([len(w)])) for w in (x, y))
        assert a != b


def test_alternations_are_not_linked(spark, docs_of):
    x, y = alternation(10)
    rows = [(1, f"{x} tail"), (2, f"{y} tail"), (3, x), (4, y)]
    assert all(r.kept for r in minhash.near_duplicates(docs_of(rows), shingle=2).collect())


def test_words_piece_by_piece(monkeypatch):
    data = np.frombuffer(b"one two  three one " * 50 + b"x" * 300 + b" two", np.uint8)
    inside = data != 32
    edge = np.diff(np.concatenate([[0], inside, [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    whole = word_hashes(data, start, stop)
    monkeypatch.setattr("tesserae.llm.common.SLICE_BYTES", 64)
    assert (word_hashes(data, start, stop) == whole).all()
    assert whole[0] == whole[3] and whole[1] == whole[-1] and len(set(whole.tolist())) == 4
