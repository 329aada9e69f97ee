import random
from fractions import Fraction

from tesserae.operators import prefix, stats


def pooled(points):
    """Blocks of one cohort by the plain form: cut where no mean before exceeds one behind."""
    sums = {}
    for s, y in points:
        p, n = sums.get(s, (0, 0))
        sums[s] = (p + y, n + 1)
    scores = sorted(sums)
    blocks = []
    for s in scores:
        blocks.append([s, s, *sums[s]])
        while len(blocks) > 1 and Fraction(blocks[-2][2], blocks[-2][3]) > Fraction(blocks[-1][2], blocks[-1][3]):
            low, high, p, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + p, blocks[-1][3] + n]
    return [tuple(b) for b in blocks]


def test_blocks_of_many_ranges(spark):
    random.seed(5)
    rows = []
    for cohort, rule in (
        ("up", lambda s: int(random.random() < s)), ("down", lambda s: int(random.random() > s)), ("flat", lambda s: random.randint(0, 1)),
        (None, lambda s: int(random.random() < s * s)), ("steps", lambda s: int(s * 10) % 2), ("one", lambda s: 1), ("", lambda s: int(s > 0.5)),
    ):
        rows += [(cohort, s, rule(s)) for s in (round(random.random(), 2 if cohort == "flat" else 4) for _ in range(400))]
    df = spark.createDataFrame([*rows, ("up", None, 1), ("up", 0.5, None)], "lang string, p double, y int")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = stats.isotonic_blocks(df, "lang", "p", "y").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    for cohort in {r[0] for r in rows}:
        mine = sorted((r.low, r.high, r.positive, r.total) for r in got if r.cohort == cohort)
        assert mine == pooled([(s, y) for c, s, y in rows if c == cohort]), cohort


def test_no_rows(spark):
    assert stats.isotonic_blocks(spark.createDataFrame([], "lang string, p double, y int"), "lang", "p", "y").count() == 0


def test_last_before_over_ranges(spark):
    random.seed(6)
    rows = [(random.choice("aab"), i, random.choice([None, None, i])) for i in range(300)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int")
    from pyspark.sql import functions as F

    got = {(r.k, r.at): r.before for r in prefix.last_before(prefix.by_ranges(df, ["k"], [F.col("at")]), ["k"], ["at"], {"before": F.col("v")}).collect()}
    held = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        assert got[k, at] == held.get(k)
        held[k] = at if v is not None else held.get(k)
    assert len(got) == len(rows)
