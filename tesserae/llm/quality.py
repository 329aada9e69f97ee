"""Quality classifier: naive Bayes support vectors over word and character n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tesserae.llm import nbsvm

#: Case stays: capitals tell some kinds of junk.
FEATURES = nbsvm.Features(chars=(2, 3), words=(1, 2), lower=False)
#: Labelled rows that the fit takes at most.
SAMPLE_ROWS = 4000
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> nbsvm.Model:
    """Fit to ``labels.quality``; see nbsvm.train for nulls and repeats."""
    return nbsvm.train(docs, labels, "quality", FEATURES, sample_rows=sample_rows, cost=5.0)


def score(docs: DataFrame, model: nbsvm.Model, keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """doc_id, ``keep`` and ``out`` of every document (higher: better)."""
    return nbsvm.score(docs, model, keep=keep, out=out)
