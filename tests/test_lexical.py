import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lexical

DOC = "id long, owner string, status string, tokens array<string>"


def brute(docs, queries, limit, per_shard, allowed=None, least=0.0):
    shards = {o for _, o, _, _ in docs}
    out = []
    stats = {o: [t for _, own, _, t in docs if own == o] for o in shards}
    for q, terms in queries:
        scored = []
        for i, o, _, tokens in docs:
            n, mean = len(stats[o]), sum(map(len, stats[o])) / len(stats[o])
            tf = Counter(tokens)
            raw = 0.0
            for term in set(terms) & set(tf):
                df = sum(term in t for t in stats[o])
                raw += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
            if set(terms) & set(tf) and (allowed is None or i in allowed) and round(1 - math.exp(-raw), 6) >= least:
                scored.append((o, i, raw))
        groups = {}
        for o, i, raw in scored:
            groups.setdefault(o if per_shard else None, []).append((-round(raw, 6), i, o, raw))
        for group in groups.values():
            out += [(q, o, i, round(round(1 - math.exp(-raw), 6), 5), k + 1) for k, (_, i, o, raw) in enumerate(sorted(group)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("per_shard", [True, False])
def test_blocks_give_what_scoring_everything_gives(spark, per_shard):
    rng = random.Random(11)
    common, rare = [f"c{k}" for k in range(6)], [f"r{k}" for k in range(80)]
    docs = [(i, rng.choice(["u", "u", "v"]), "active", [rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randrange(0, 40))]) for i in range(300)]
    docs += [(1000 + i, "u", "active", ["c1", "r1", "r2"]) for i in range(9)]
    queries = [(q, [rng.choice(common), rng.choice(common), *rng.sample(rare, rng.randrange(4))]) for q in range(15)] + [(90, ["nowhere"]), (91, []), (92, ["r1", "r2", "c0", "c1"])]
    df, asked = spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, "query long, terms array<string>")
    for limit, allowed, least in ((3, None, 0.0), (400, None, 0.0), (2, set(range(0, 1009, 2)), 0.5)):
        rows = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "doc long")
        want = brute(docs, queries, limit, per_shard, allowed, least)
        for search in (lexical.search, lexical.search_by_impact):
            got = search(lexical.postings(df), asked, lexical.corpus_stats(df), limit, per_shard, rows, least)
            assert sorted((r["query"], r.shard, r.doc, round(r.score, 5), r["rank"]) for r in got.collect()) == want


def test_postings_of_odd_rows(spark):
    docs = [(1, "u", "active", ["b", "a", "b"]), (2, "u", "active", []), (3, None, "active", ["a"]), (4, "u", "active", None)]
    got = lexical.postings(spark.createDataFrame(docs, DOC))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("u", 1, 3, "a", 1), ("u", 1, 3, "b", 2), (None, 3, 1, "a", 1)], key=repr)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_low_blocks_are_not_read(spark):
    rng = random.Random(12)
    docs = [(i, "u", "active", ["the"] * rng.randrange(1, 4) + ["x"] * rng.randrange(9) + ([f"rare{i % 4}"] * (1 + i % 3) if i % 20 < 4 else [])) for i in range(600)]
    df = spark.createDataFrame(docs, DOC)
    asked = spark.createDataFrame([(q, ["the", f"rare{q}"]) for q in range(4)], "query long, terms array<string>").select("query", F.explode("terms").alias("term"))
    blocks = lexical.blocks_of(lexical.impacts(lexical.postings(df), asked, lexical.corpus_stats(df)))
    read = lexical.blocks_to_read(blocks, asked, 5, ["query", "shard"]).collect()
    assert {r.term for r in read} == {f"rare{q}" for q in range(4)} and sum(r.n for r in read) < 200
    assert all(0 < r.missed < r.floor for r in read)


def test_documents_are_scored_whole_over_small_batches(spark):
    """Documents go on from batch to batch, copies are many, shards change within a part; what a part hands on stays small."""
    rng = random.Random(13)
    docs = [(i, rng.choice("uv"), "active", [f"t{rng.randrange(12)}" for _ in range(rng.randrange(0, 30))]) for i in range(200)]
    docs += [(1000 + i, "u", "active", ["t1", "t2", "t2", "t3"]) for i in range(300)]
    queries = [(q, rng.sample([f"t{k}" for k in range(12)], rng.randrange(1, 6))) for q in range(20)] + [(90, ["nowhere"]), (91, [""])]
    df, asked = spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, "query long, terms array<string>")
    posting, stats = lexical.asked_postings(df, asked.select(F.explode("terms").alias("term")))
    want_stats = lexical.corpus_stats(df).select("shard", "n_docs", "total_len")
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, want_stats.collect()))
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    assert sorted(map(tuple, posting.collect())) == sorted(map(tuple, lexical.postings(df).join(terms, "term", "left_semi").select(*posting.columns).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for per_shard in (True, False):
                got = lexical.search(posting, asked, stats, 4, per_shard, gathered=True)
                assert sorted((r["query"], r.shard, r.doc, round(r.score, 5), r["rank"]) for r in got.collect()) == brute(docs, queries, 4, per_shard)
        rated = posting.filter("shard = 'u'").withColumn("w", F.col("tf").cast("double")).coalesce(1).sortWithinPartitions("shard", "doc", "term")
        some = asked.select("query", F.explode("terms").alias("term"))
        handed = lexical.best_of_parts(rated, some, 4).groupBy("query").count().collect()
        assert handed and all(r["count"] < 12 for r in handed)  # of some 400 documents
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
