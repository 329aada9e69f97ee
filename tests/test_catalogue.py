from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae.plans import catalogue, planner, proofs
from tesserae.session import table
from tests.compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver tables aren't here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(proofs.ORACLE_SQL))
def test_operator_equals_its_sql(spark, name):
    assert compare(spark, name, proofs.QUERIES[name], proofs.ORACLE_SQL[name], SF) == ""


def test_planned_turns(spark):
    """Every user turn is planned as it is planned alone."""
    turns = {(r.conv_id, r.turn): r.text for r in table(spark, SF, "conversations").filter("role = 'user'").collect()}
    got = {(r.conv_id, r.turn): r for r in catalogue.QUERIES["planner_batch"](spark, SF).collect()}
    assert got.keys() == turns.keys() and got
    for key, text in turns.items():
        want = planner.plan_query(text, catalogue.NOW_MS)
        assert {k: got[key][k] for k in want} == {k: list(v) if isinstance(v, tuple) else v for k, v in want.items()}


def test_diverse_and_adaptive_pools(spark):
    """Chosen documents differ from each other, and are among those that the search finds."""
    words = {r.id: set(r.tokens) for r in catalogue._tokenised(spark, SF).select("id", "tokens").collect()}
    chosen = {}
    for r in catalogue.QUERIES["diverse_topk"](spark, SF).collect():
        chosen.setdefault(r["query"], []).append(r.id)
    assert chosen and all(1 <= len(ids) <= 5 for ids in chosen.values())
    for ids in chosen.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                assert len(words[a] & words[b]) <= 0.9 * len(words[a] | words[b])
    found = {}
    for r in catalogue._search(spark, SF, 100).collect():
        found.setdefault(r["query"], set()).add(r.doc)
    adaptive = {r["query"]: r.ids for r in catalogue.QUERIES["adaptive_topk"](spark, SF).collect()}
    assert adaptive and all(set(ids) <= found[q] for q, ids in adaptive.items())


def test_isotonic_blocks_rise(spark):
    rows = catalogue.QUERIES["isotonic_calibration"](spark, SF).orderBy("cohort", "low").collect()
    judged = catalogue._judged(spark, SF).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in judged} == {c: sum(r.n for r in rows if r.cohort == c) for c in {r.cohort for r in rows}}
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.cohort != b.cohort or (a.high < b.low and a.positive / a.total <= b.positive / b.total)


def test_queries_without_sql_are_known(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"planner_batch", "local_embeddings", "diverse_topk", "adaptive_topk", "extracted_facts"}
    assert catalogue.QUERIES["extracted_facts"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["retrieval_outcomes", "kept_up_rollup", "upkeep_runs"])
def test_clicks_are_parsed_once_for_all_batches(spark, monkeypatch, name):
    seen, plain = spark.sparkContext.accumulator(0), catalogue.table

    @F.udf("string")
    def counted(props):
        seen.add(1)
        return props

    monkeypatch.setattr(catalogue, "table", lambda *a: plain(*a).withColumn("props", counted("props")))
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    assert 0 < seen.value <= plain(spark, SF, "clicks").count()
