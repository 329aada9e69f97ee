import random

from pyspark.sql import functions as F

from tesserae.llm import sharding
from tests.llm.conftest import odd_rows, words


def test_shards_are_balanced_gapless_and_whole(spark, docs_of):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(400)]
    rows = [(i, texts[i] if i % 3 else "the same text again") for i in range(400)]
    got = sharding.assign_shards(docs_of(rows), n_shards=7).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for k in range(7):
        own = [r for r in got if r.shard == k]
        assert abs(sum(r.size for r in own) - total / 7) <= 2 * largest
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_small_groups_stay_in_one_shard(spark, docs_of):
    rows = [(i, f"text {i // 2} " * 5) for i in range(200)] + [(1000, "long " * 400)]
    got = sharding.assign_shards(docs_of(rows), n_shards=5).collect()
    by_crc = {}
    for r in got:
        by_crc.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_crc.values())


def test_odd_rows_and_clashing_columns(spark, docs_of):
    df = docs_of(odd_rows()).withColumns({"size": F.lit("x"), "shard": F.lit("y"), "part": F.lit(1), "key": F.lit(2)})
    got = sharding.assign_shards(df, n_shards=3, keep=("lang",)).collect()
    assert len(got) == len(odd_rows())
    assert {r.size for r in got if r.doc_id in (1, 2)} == {16}
    assert {r.text_crc32 for r in got if r.doc_id == 1} == {0}
    assert sharding.assign_shards(docs_of([]), n_shards=3).count() == 0


def test_only_dataframe_functions(spark, docs_of):
    plan = sharding.assign_shards(docs_of([(1, "a"), (2, "b")]), n_shards=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_all_columns(spark, docs_of, tmp_path):
    rows = [(i, f"text number {i}") for i in range(40)]
    sharding.write_shards(docs_of(rows), str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in back.collect()} == set(rows)
    assert back.select("shard").distinct().count() == 4
