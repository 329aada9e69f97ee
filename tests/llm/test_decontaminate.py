import random
import re

from tesserae.llm import decontaminate
from tests.llm.conftest import odd_rows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def brute(docs, items):
    words = lambda t: WORD.findall((t or "").encode().translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, held = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    held |= found
        out.append((i, len(w), len(hit), sorted(held), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs_of, docs, items):
    found = decontaminate.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()), key=repr)


def test_against_brute_force(spark, docs_of):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 12, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "T1, t2! t3"), (53, items_text := text(40)), (54, items_text)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(30))]
        if rng.random() < 0.7:
            source = rng.choice(items)[1] or ""
            w = source.split()
            at = rng.randrange(max(1, len(w)))
            parts.append(" ".join(w[at : at + rng.randrange(8, 30)]).upper())
        docs.append((i, " -- ".join([*parts, text(rng.randrange(30))])))
    docs += odd_rows() + [(70, docs[0][1])]
    assert run(spark, docs_of, docs, items) == brute(docs, items)


def test_shuffled_join_gives_the_same(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(i, f"start {i} {passage} end") for i in range(30)]
    items = [(1, passage)]
    assert run(spark, docs_of, docs, items) == brute(docs, items)


def test_no_items_and_no_documents(spark, docs_of):
    assert all(not r[4] for r in run(spark, docs_of, [(1, "a b c")], [(1, None)]))
    assert run(spark, docs_of, [], [(1, "a b c")]) == []
