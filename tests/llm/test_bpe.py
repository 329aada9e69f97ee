import hashlib
import random

import pytest

from tesserae.llm import bpe
from tests.llm.conftest import odd_rows

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(4)
    letters = "ab \n\t'sré漢字　\xa0\x1c😀12٣!<|>the"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)] + ["", "a" * 3000, "ab" * 64, "<|endoftext|>x<|endoftext|>", "don't  stop\n\n now "]


def test_round_trip_digests_equal_the_library(spark, docs_of, library):
    rows = list(enumerate(samples())) + [(i, t) for i, t in odd_rows() if i]
    got = [tuple(r) for r in bpe.round_trip(docs_of(rows), PATH).collect()]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(got) == sorted(want)


def test_encode_then_decode_gives_the_text(spark, docs_of, library):
    rows = list(enumerate(samples()))
    encoded = bpe.encode(docs_of(rows), PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    back = bpe.decode(encoded.drop("text"), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)


def test_lock_step_and_scalar_trees_agree():
    vocabulary = bpe.Vocabulary(PATH)
    rng = random.Random(5)
    for _ in range(50):
        raw = bytes(rng.choice(b"thein ng") for _ in range(rng.randrange(2, 60)))
        ids = vocabulary.byte_ids[list(raw)].tolist()
        width = 1 << (len(raw) - 1).bit_length()
        import numpy as np

        row = np.full((1, width), -1, np.int64)
        row[0, : len(ids)] = ids
        assert [i for i in bpe.merge_rows(vocabulary, row)[0].tolist() if i >= 0] == bpe.merge_long(vocabulary, ids)


def test_small_cache_changes_nothing(library):
    encoder = bpe.Encoder(bpe.Vocabulary(PATH), cache_words=10)
    texts = samples()
    assert [encoder.encode([t])[0] for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_table(spark, docs_of):
    assert bpe.round_trip(docs_of([]), PATH).count() == 0
