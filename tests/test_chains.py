import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import chains, prefix, store

ROW = "owner string, agent string, seq long, id string, key string, kind string, content string, confidence double, cardinality string, start long, at long, action string"
WORDS = "Rome Paris Oslo Quito Lagos".split()


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in as many ranges as there are shuffle partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _state(df):
    return {(r.owner, r.agent, r.key, r.content.lower()): (r.id, r.content, r.confidence, r.start, r.status, r.stop, r.supersedes, r.updated) for r in df.collect()}


def test_random_writes_equal_the_fold(spark):
    """Sure, unsure and told writes, of few contents in many orders, give the fold's rows."""
    draw = random.Random(5)
    rows = []
    for seq in range(900):
        key = draw.choice(["city", "job", "pet"])
        word = draw.choice(WORDS)
        start = draw.choice([None, draw.randrange(2000)])
        rows.append((draw.choice("uv"), draw.choice(["a", "b", "hot", "hot", "hot"]), seq, f"{seq:04}", key, "identity", f"{key}: {draw.choice([word, word.upper(), '  ' + word])}", draw.choice([0.1, 0.79, 0.8, 0.95]), "single", start, seq * 2, draw.choice([None, None, None, "SUPERSEDE", "ADD"])))
    told = spark.createDataFrame(rows, ROW)
    got = _state(chains.state(chains.writes(told.repartition(7))))
    want = _state(store.remember(told))
    assert got == want and len({v[4] for v in got.values()}) == 3


def test_short_chains_equal_the_fold(spark):
    """Every sequence of up to four writes of three contents, sure or not, in a scope of its own."""
    import itertools

    rows = []
    for n in range(1, 5):
        for i, told in enumerate(itertools.product([(w, c) for w in WORDS[:3] for c in (0.5, 0.9)], repeat=n)):
            if i % 5 == 0 or n < 4:
                rows += [(f"{n}/{i}", "a", seq, f"{seq}", "city", "identity", f"city: {w}", c, "single", None, 10 * seq, None) for seq, (w, c) in enumerate(told)]
    told = spark.createDataFrame(rows, ROW)
    assert _state(chains.state(chains.writes(told))) == _state(store.remember(told))


def test_a_hot_key_is_split(spark):
    """One key holds all rows: the ranges part it, and the result is that of one sequence."""
    rows = spark.range(20_000).select(F.lit("u").alias("owner"), F.lit("a").alias("agent"), F.lit("k").alias("key"), F.col("id").alias("seq"), "id",
                                      F.concat(F.lit("v "), (F.col("id") % 7).cast("string")).alias("content"), F.when(F.col("id") % 11 == 0, 0.9).otherwise(0.3).alias("confidence"), F.col("id").alias("at"))
    written = chains.writes(rows)
    last = max(i for i in range(20_000) if i % 11 == 0)
    got = {r.content: r for r in chains.state(written).collect()}
    assert [c for c, r in got.items() if r.status == "active"] == [f"v {last % 7}"] and sum(r.n_writes for r in got.values()) == 20_000
    ranged = prefix.by_ranges(rows, chains.BY, [F.col("seq")])
    assert ranged.groupBy(prefix.PART).count().agg(F.max("count")).first()[0] < 20_000 / 2


def test_odd_rows(spark):
    """Empty tables, nulls in any column, blank contents, long ones, repeated rows, ties and columns with clashing names."""
    schema = ROW + ", prior string, outcome string, same string, own string"
    assert chains.state(chains.writes(spark.createDataFrame([], schema))).collect() == []
    good = ("u", "a", 1, "1", "k", None, "k: x", None, None, None, None, None, "p", "o", "s", "w")
    rows = [good, good, *[tuple(None if i == j else v for j, v in enumerate(good)) for i in (0, 1, 2, 3, 4, 6)], (*good[:6], " \n ", *good[7:])]
    (row,) = chains.state(chains.writes(spark.createDataFrame(rows, schema))).collect()
    assert (row.id, row.status, row.confidence, row.start, row.updated, row.n_writes) == ("1", "active", 0.0, 0, 0, 2)
    tied = [(*good[:6], f"k: {w}", 0.9, *good[8:]) for w in ("b", "a", "c")] + [(*good[:2], 2, *good[3:6], "k: " + "d" * 50_000, 0.9, *good[8:])]
    a, b = ({(r.content, r.status, r.supersedes) for r in chains.state(chains.writes(spark.createDataFrame(part, schema))).collect()} for part in (tied, tied[::-1]))
    assert a == b and max(len(c) for c, _, _ in a) == 1000
