import pytest
from pyspark.sql import functions as F

from tesserae.operators import upkeep

ROW = "id long, arrived long, day string, fact string"


def build(members):
    return members.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fact").alias("facts"), *upkeep.digest("id", "fact"))


def run(spark, folder, rows, **limits):
    return upkeep.advance(spark, folder, spark.createDataFrame(rows, ROW), "id", "arrived", "day", build, slices=4, **limits)


def kept(spark, folder):
    return {(r.day, r.n, r.facts) for r in upkeep.artifacts(spark, folder, "day").collect()}


ROWS = [(i, 10 * i, f"d{i % 5}", f"f{i % 3}") for i in range(40)]
WHOLE = {(f"d{d}", 8, 3) for d in range(5)}


def test_only_touched_buckets_are_built(spark, tmp_path):
    folder = str(tmp_path)
    assert run(spark, folder, ROWS) == {"run": 0, "mark": "390", "rows_read": 40, "touched": 5, "members": 40, "rebuilt": 5, "waiting": 0}
    assert kept(spark, folder) == WHOLE
    late = [*ROWS, (40, 400, "d1", "new"), (41, 400, None, "no bucket"), (42, None, "d2", "never arrived")]
    # Read are the rows at the mark, too: d4's last row comes again and alters nothing.
    assert run(spark, folder, late) == {"run": 1, "mark": "400", "rows_read": 3, "touched": 2, "members": 17, "rebuilt": 1, "waiting": 0}
    assert kept(spark, folder) == WHOLE - {("d1", 8, 3)} | {("d1", 9, 4)}
    assert run(spark, folder, [*late, (43, 400, "d1", "at the mark")])["rebuilt"] == 1
    assert ("d1", 10, 5) in kept(spark, folder)
    assert run(spark, folder, [])["rows_read"] == 0
    assert upkeep.runs(spark, folder).count() == 3


def test_a_budget_makes_buckets_wait(spark, tmp_path):
    folder = str(tmp_path)
    first = run(spark, folder, ROWS, budget=2)
    assert (first["rebuilt"], first["waiting"]) == (2, 3)
    assert kept(spark, folder) == {("d0", 8, 3), ("d1", 8, 3)}
    while run(spark, folder, ROWS, budget=2)["waiting"]:
        pass
    assert kept(spark, folder) == WHOLE


def test_a_failed_run_is_written_over(spark, tmp_path):
    folder = str(tmp_path)
    run(spark, folder, ROWS[:20])

    def fails(members):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        upkeep.advance(spark, folder, spark.createDataFrame(ROWS[:30], ROW), "id", "arrived", "day", fails, slices=4)
    assert run(spark, folder, ROWS)["run"] == 1
    assert kept(spark, folder) == WHOLE


def test_no_rows_at_first(spark, tmp_path):
    assert run(spark, str(tmp_path), [])["rebuilt"] == 0
    assert run(spark, str(tmp_path), ROWS)["rebuilt"] == 5
    assert kept(spark, str(tmp_path)) == WHOLE


def test_idle_host_waits_for_the_cooldown():
    assert upkeep.due(None, 0, True) and not upkeep.due(None, 0, False)
    assert not upkeep.due(0, 599_999, True) and upkeep.due(0, 600_000, True)
