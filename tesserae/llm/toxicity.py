"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tesserae.llm import nbsvm

FEATURES = nbsvm.Features(chars=(2, 3, 4))
#: Labelled rows that the fit takes at most.
SAMPLE_ROWS = 4000
THRESHOLD = 0.7


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> nbsvm.Model:
    """Fit to ``labels.toxic``; see nbsvm.train for nulls and repeats."""
    return nbsvm.train(docs, labels, "toxic", FEATURES, sample_rows=sample_rows)


def score(docs: DataFrame, model: nbsvm.Model, keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """doc_id, ``keep`` and ``out`` of every document (higher: more toxic)."""
    return nbsvm.score(docs, model, keep=keep, out=out)
