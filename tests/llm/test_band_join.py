import math
import random
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import band_join

LINES = T.StructType([T.StructField("sale_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("item_id", T.LongType()), T.StructField("quantity", T.IntegerType()), T.StructField("amount", T.DoubleType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("price", T.DoubleType())])


def brute(lines, items, absolute=10, per_mille=2, first=5):
    ready = []
    for sale, no, item, q, amount in lines:
        if None in (sale, item, q, amount) or q == 0 or not math.isfinite(amount):
            continue
        a = math.floor(100 * amount + 0.5)
        ready.append((sale, no, item, (2 * a + q) // (2 * q)))
    out = []
    for item, price in items:
        pairs = []
        if item is not None and price is not None and math.isfinite(price):
            p = math.floor(100 * price + 0.5)
            pairs = [(abs(u - p), u, s, n, i) for s, n, i, u in ready if i != item and (abs(u - p) <= absolute or 1000 * abs(u - p) <= per_mille * p)]
        crc = sum(zlib.crc32(f"{s},{'' if n is None else n},{i}".encode()) for _, _, s, n, i in pairs)
        tail = (len(pairs), sum(x[0] for x in pairs), crc)
        pairs.sort(key=lambda x: (*x[:3], x[3] is not None, x[3] or 0, x[4]))
        out += [(item, k + 1, *x, *tail) for k, x in enumerate(pairs[:first])] or [(item, 0, None, None, None, None, None, *tail)]
    return sorted(out, key=repr)


def run(spark, lines, items, **how):
    found = band_join.near_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame(items, ITEMS), **how)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    some = [0.03, 0.1, 2.99, 3.0, 3.05, 54.9, 55.0, 55.01, 55.1, 99.99, 100.0, 100.2, 100.21, 399.2, 400.0, 400.8, 400.81, 9000.0, 9018.0, 9018.05, -2.0]
    lines = [(rng.randrange(60), rng.choice([1, 2, 3, None]), rng.randrange(9), q := rng.randrange(1, 6), round(rng.choice(some) * q + rng.choice([0, 0, 0.01, -0.02, 0.004]), 3)) for _ in range(900)]
    lines += lines[:40]
    items = [(i, rng.choice(some)) for i in range(40)] + [(3, 3.0), (3, 3.0), (4, 55.0)]
    assert run(spark, lines, items) == brute(lines, items)


def test_one_item_holds_nearly_all_lines_of_a_price(spark):
    lines = [(k, 1, 7, 1, 5.0) for k in range(60)] + [(100 + k, 1, 8, 1, 5.01) for k in range(3)] + [(k, 2, 9, 1, 5.0) for k in range(50, 54)]
    items = [(7, 5.0), (8, 5.0), (9, 5.0), (1, 5.0), (2, 5.03), (5, 900.0)]
    assert run(spark, lines, items) == brute(lines, items)


def test_other_bands_and_hot_prices(spark):
    rng = random.Random(4)
    lines = [(k, 1, rng.randrange(30), rng.choice([1, 2, -1]), float(rng.randrange(1, 4000))) for k in range(500)]
    items = [(k, 1234.0) for k in range(300)] + [(300 + k, float(rng.randrange(4000))) for k in range(60)]
    for how in ({"absolute": 0, "per_mille": 50, "first": 2}, {"absolute": 3000, "per_mille": 0}, {"absolute": 5, "per_mille": 300, "first": 1}):
        assert run(spark, lines, items, **how) == brute(lines, items, **how)


def test_nulls_odd_numbers_and_no_rows(spark):
    lines = [(None, 1, 2, 1, 5.0), (1, None, 2, 1, 5.0), (1, 1, None, 1, 5.0), (1, 1, 2, None, 5.0), (1, 1, 2, 1, None), (1, 1, 2, 0, 5.0), (1, 1, 2, 1, math.nan), (1, 1, 2, 1, math.inf), (2, 1, 2, 1, 5.0), (2, 1, 2, 1, 5.0)]
    items = [(1, 5.0), (None, 5.0), (3, None), (4, math.nan), (2, 5.0), (6, 0.0)]
    assert run(spark, lines, items) == brute(lines, items)
    assert run(spark, [], items) == brute([], items)
    assert run(spark, lines, []) == []


def test_clashing_columns_and_only_dataframe_functions(spark):
    lines, items = [(1, 1, 2, 1, 5.0), (2, 1, 3, 1, 5.1)], [(2, 5.0), (3, 5.0)]
    extra = {c: F.lit("x") for c in ("u", "p", "gap", "n", "crc", "bucket", "near", "line", "rank", "n_items", "line_item_id")}
    found = band_join.near_lines(spark.createDataFrame(lines, LINES).withColumns(extra), spark.createDataFrame(items, ITEMS).withColumns(extra))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(lines, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
