import hashlib
import random

from pyspark.sql import functions as F

from tesserae.llm import spotsigs
from tests.llm.conftest import odd_rows


def prose(rng, n):
    common, content = ["the", "of", "and", "to", "in"], [f"noun{i}" for i in range(300)]
    return " ".join(rng.choice(common if rng.random() < 0.4 else content) for _ in range(n))


def brute(text):
    anchors = {w for v in spotsigs.ANCHORS.values() for w in v.split()}
    w = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    found = set()
    for i, a in enumerate(w):
        chain = [x for x in w[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
        if a in anchors and len(chain) == spotsigs.CHAIN:
            found.add((a, *chain))
    return found or ({tuple(w)} if w else set())


def test_edited_texts_and_likeness_against_brute_force(spark, docs_of):
    rng = random.Random(2)
    rows = [(i * 700, prose(rng, rng.randrange(1, 200))) for i in range(60)] + [(5, ""), (6, None), (7, "the of")]
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs_of(rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = brute(t), brute(other)
            want = 1.0 if not a and not b else len(a & b) / len(a | b)
            assert abs(near - want) < 1e-9


def test_equal_texts_have_equal_fingerprints_and_odd_rows(spark, docs_of):
    got = spotsigs.edited_fingerprints(docs_of(odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert spotsigs.edited_fingerprints(docs_of([])).count() == 0
    only = spotsigs.edited_fingerprints(docs_of([(9, "the cat sat on the mat")])).collect()[0]
    assert only.near_next == 1.0


def test_near_duplicates_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    rows = []
    for b in base:
        for copy in range(4):
            w = b.split()
            for _ in range(copy * 2):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None)]
    members, pairs = spotsigs.near_duplicates(docs_of(rows))
    name = {r.doc_id: r.class_id for r in members.collect()}
    assert name[48] == 0 and 49 not in name
    got = {(r.a, r.b) for r in pairs.collect()}
    sets = {i: brute(t) for i, t in rows if t and name[i] == i}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == want and want


def test_only_dataframe_functions(spark, docs_of):
    plan = spotsigs.edited_fingerprints(docs_of([(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_runs_of_common_words_take_linear_time(spark):
    import time

    rows = [(1, "the of " * 100_000), (2, "the " * 200_000 + "cat sat"), (3, "cat " + "of the " * 50_000 + "dog " + "and " * 50_000 + "bird")]
    began = time.time()
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id int, text string").select("id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    assert time.time() - began < 20
    assert len(got[1]) == 1 and len(got[2]) == 1 and len(got[3]) == 2


def test_many_texts_have_many_fingerprints(spark):
    texts = spark.range(400_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    assert texts.select(spotsigs.name(spotsigs.signatures(F.col("text"))).alias("n")).distinct().count() == 400_000
