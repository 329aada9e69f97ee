"""Registered queries over all documents, and past the ten best: small tables where the first ranks are copies."""

import pytest

from tesserae.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Short near copies of an item's words rank first; the only document that holds the item word for word is long."""
    d = str(tmp_path_factory.mktemp("pools"))
    item = "red green blue white"
    docs = [(i, f"{item[::1].replace(' ', '  ')}", "en", "s") for i in range(12)]
    docs += [(20 + i, f"red green other{i} words{i} here{i} and{i} there{i}", "en", "s") for i in range(6)]
    docs += [(40, f"pre{item}post " + " ".join(f"w{i}" for i in range(300)) + " green", "en", "s")]
    spark.createDataFrame([(*r, len(r[1])) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in docs], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_a_relevant_document_beyond_the_pool_counts(spark, tables):
    got = {r.category: (r.n, r.recall) for r in catalogue.QUERIES["retrieval_metrics"](spark, tables).collect()}
    assert got["(all)"] == (1, 0.0)


def test_diverse_documents_behind_copies_are_found(spark, tables):
    got = sorted((r.position, r.id) for r in catalogue.QUERIES["diverse_topk"](spark, tables).collect())
    assert len(got) == 5 and got[0] == (1, 0) and len({i for _, i in got} & set(range(12))) == 1


def test_adaptive_selection_gets_the_candidate_budget(spark, tables, monkeypatch):
    seen = []
    adaptive_top = catalogue.ranking.adaptive_top
    monkeypatch.setattr(catalogue.ranking, "adaptive_top", lambda ranked, plans: seen.append(ranked) or adaptive_top(ranked, plans))
    catalogue.QUERIES["adaptive_topk"](spark, tables)
    assert seen[0].count() > 10


def test_every_document_is_embedded_in_the_default_dimensions(spark, tables):
    got = {r.doc_id: r.embedding for r in catalogue.QUERIES["local_embeddings"](spark, tables).collect()}
    assert sorted(got) == [*range(12), *range(20, 26), 40] and {len(e) for e in got.values()} == {384}
