"""BM25 over DataFrames: postings, corpus statistics and ranked search for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.session import settled

K1, B = 1.2, 0.75
#: Impact levels of a term's postings, and the share of the floor that may be left unread.
LEVELS, UNREAD = 32, 0.5
#: What a sum may miss of a bound: scores are compared at 6 places.
SLACK = 2e-6
#: (document, query) scores that a task holds at a time.
CELLS = 1 << 20


def postings(docs: DataFrame, tokens: str = "tokens", doc: str = "id", shard: str = "owner") -> DataFrame:
    """shard, doc, term, tf, doc_len: one row for each distinct term of each document. Documents without terms have none.

    Terms are counted within their document's row, by the ends of runs of equal ones in the sorted array; nothing is shuffled.
    """
    ends = F.expr("filter(sequence(1, size(sorted_)), i -> i = size(sorted_) or sorted_[i - 1] <> sorted_[i])")
    counted = F.expr("transform(ends_, (e, i) -> struct(sorted_[e - 1] as term, cast(e - if(i = 0, 0, ends_[i - 1]) as bigint) as tf))")
    own = docs.select(F.col(shard).alias("shard"), F.col(doc).alias("doc"), F.size(tokens).alias("doc_len"), F.sort_array(tokens).alias("sorted_")).filter("doc_len > 0")
    return own.withColumn("ends_", ends).select("shard", "doc", "doc_len", F.inline(counted)).select("shard", "doc", "doc_len", "term", "tf")


def asked_postings(docs: DataFrame, terms: DataFrame, tokens: str = "tokens", doc: str = "id", shard: str = "owner") -> tuple[DataFrame, DataFrame]:
    """``postings`` of ``terms`` (term) alone, and n_docs and total_len of each shard's documents, from one pass over them.

    Tokens are cut to the terms before they are counted, so a document's other tokens are neither sorted nor shuffled.
    A mark, which is no token, stands for each document. A document's postings lie together in one part, in the order
    of (shard, doc), which searches need not make again (``gathered``).
    """
    marked = docs.select(F.col(shard).alias("shard"), F.col(doc).alias("doc"), F.size(tokens).alias("doc_len"), F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.col(tokens), F.array().cast("array<string>")))).alias("term"))
    known = terms.select("term").filter("term <> ''").unionByName(docs.sparkSession.sql("select '' as term")).distinct()
    held = marked.join(F.broadcast(known), "term", "left_semi").repartition("doc")  # a shard may be a constant, which optimising takes out of the keys
    counted = settled(held.groupBy("shard", "doc", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf")).sortWithinPartitions("shard", "doc", "term"))
    stats = counted.filter("term = ''").groupBy("shard").agg(F.sum("tf").alias("n_docs"), F.sum(F.col("doc_len") * F.col("tf")).alias("total_len"))
    return counted.filter("term <> ''").select("shard", "doc", "doc_len", "term", "tf"), stats


def corpus_stats(docs: DataFrame, tokens: str = "tokens", shard: str = "owner", active: str = "status = 'active'") -> DataFrame:
    """shard, n_docs, total_len, and the same of active documents only."""
    live = F.expr(active)
    n = F.size(tokens)
    return docs.groupBy(F.col(shard).alias("shard")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("total_len"), F.sum(F.when(live, 1).otherwise(0)).alias("active_docs"), F.sum(F.when(live, n).otherwise(0)).alias("active_len")
    )


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df"))


def search(posting: DataFrame, queries: DataFrame, stats: DataFrame, limit: int, per_shard: bool = True, allowed: DataFrame | None = None, min_score: float = 0.0, gathered: bool = False) -> DataFrame:
    """query, shard, doc, score (0 to 1), rank: the best documents for each query (query, terms as a distinct array).

    Postings are first cut to the terms that are asked for; each posting's weight then depends on its
    term alone and is summed for each (query, document) where the document lies (``best_of_parts``). Ties go by doc. ``allowed`` (doc) and ``min_score``
    narrow what is returned; the statistics stay those of all. Every posting of a query's terms is scored, which is
    the shortest way for long queries, whose floors are low; ``search_by_impact`` skips what cannot matter.
    """
    asked = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    hit = posting if gathered else settled(posting.join(asked.select("term").distinct(), "term", "left_semi"))  # also gives df
    n, length = F.col("n_docs").cast("double"), F.col("total_len") / F.greatest(F.lit(1), F.col("n_docs"))
    # A row for each term of a shard that is asked for, with what it weighs; only this small relation meets the statistics.
    terms = hit.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df")).join(stats.select(F.col("shard").alias("of_"), "n_docs", "total_len"), F.col("shard").eqNullSafe(F.col("of_")))
    terms = terms.select("shard", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), length.alias("mean_len"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    if allowed is not None:
        hit = hit.join(allowed.select("doc").distinct(), "doc", "left_semi")
    if not gathered:
        hit = settled(hit.repartition("shard", "doc").sortWithinPartitions("shard", "doc", "term"))  # under a join the order would be optimised away
    rated = hit.join(F.broadcast(terms), ["shard", "term"]).select("shard", "doc", "term", weight.alias("w"))
    scored = best_of_parts(rated, asked, limit).withColumn("score", F.round(1 - F.exp(-F.col("raw")), 6)).filter(F.col("score") >= min_score)
    keys = ["query", "shard"] if per_shard else ["query"]
    order = Window.partitionBy(*keys).orderBy(F.round(F.col("raw"), 6).desc(), F.col("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "shard", "doc", "score", "rank")


def best_of_parts(rated: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """query, shard, doc, raw: the sums of weights (shard, doc, term, w) for each query (query, term) that can be among its ``limit`` best.

    A document's postings lie together in the order of (shard, doc), each once, not once for each query that asks for its
    term. A task sums them for all queries and hands on only what its part's best leave in question. What is asked is told to all tasks.
    """
    of_term = {r.term: r.queries for r in asked.groupBy("term").agg(F.sort_array(F.collect_list("query")).alias("queries")).collect()}
    numbers = {q: k for k, q in enumerate(dict.fromkeys(q for some in of_term.values() for q in some))}
    queries = pa.array(list(numbers), to_arrow_type(asked.schema["query"].dataType))
    types = {n: df.schema[n].dataType.simpleString() for n, df in (("query", asked), ("shard", rated), ("doc", rated))}
    best = _best(limit, queries, {t: np.array([numbers[q] for q in some]) for t, some in of_term.items()})
    return rated.select("shard", "doc", "term", "w").mapInArrow(best, ", ".join(f"{n} {t}" for n, t in types.items()) + ", raw double")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where rows differ from the row before, from 0 on; columns without nulls."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.append(0, 1 + np.flatnonzero(new))


def _best(limit: int, queries: pa.Array, of_term: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (shard, doc, term, w) in the order of (shard, doc) as (query, shard, doc, raw), without sums that ``limit`` others of the part and shard exceed."""

    def run(batches):
        floor, shard, held = np.full(len(queries), -np.inf), None, None

        def best(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Of whole documents of one shard."""
            nonlocal floor
            coded = rows["term"].dictionary_encode()
            codes, lists = coded.indices.to_numpy(), [of_term[t] for t in coded.dictionary.to_pylist()]
            sizes = np.array([len(x) for x in lists])
            flat, begins = np.concatenate(lists), np.cumsum(sizes) - sizes
            starts, w = np.append(_starts(rows["doc"]), rows.num_rows), rows["w"].to_numpy()
            step = max(1, CELLS // len(queries))
            for k in range(0, len(starts) - 1, step):
                bounds = starts[k : k + step + 1]
                own = slice(bounds[0], bounds[-1])
                n, size = len(bounds) - 1, sizes[codes[own]]
                ends = np.cumsum(size)
                asks = flat[np.arange(ends[-1]) + np.repeat(begins[codes[own]] - (ends - size), size)]
                cell = np.repeat(np.repeat(np.arange(n), np.diff(bounds)), size) * len(queries) + asks
                sums = np.bincount(cell, np.repeat(w[own], size), n * len(queries)).reshape(n, len(queries))
                if n >= limit:
                    floor = np.maximum(floor, np.partition(sums, n - limit, axis=0)[n - limit])
                query, doc = np.nonzero(((sums != 0) & (sums >= floor - SLACK)).T)
                raw = sums[doc, query]
                order = np.lexsort((doc, -raw, query))
                query, doc, raw = query[order], doc[order], raw[order]
                # Of equal sums, as copies have, only the first documents can be among the best.
                kept = np.ones(len(raw), bool)
                kept[limit:] = (query[limit:] != query[:-limit]) | (raw[limit:] != raw[:-limit])
                query, doc, raw = query[kept], bounds[doc[kept]], raw[kept]
                if len(raw):
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), rows["shard"].take(pa.array(doc)), rows["doc"].take(pa.array(doc)), pa.array(raw)], ["query", "shard", "doc", "raw"])

        def of_shards(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal floor, shard
            starts = np.append(_starts(rows["shard"]), rows.num_rows)
            for a, b in zip(starts, starts[1:], strict=False):
                part = rows.slice(a, b - a)
                if part["shard"][0].as_py() != shard:
                    floor, shard = np.full(len(queries), -np.inf), part["shard"][0].as_py()
                yield from best(part)

        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if rows.num_rows:
                last = _starts(rows["shard"], rows["doc"])[-1]  # the next batch may go on with this document
                if last:
                    yield from of_shards(rows.slice(0, last))
                held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from of_shards(held)

    return run


def impacts(posting: DataFrame, terms: DataFrame, stats: DataFrame, allowed: DataFrame | None = None, gathered: bool = False) -> DataFrame:
    """shard, doc, term, w, level: the postings of ``terms`` (term) with their weights.

    A term's postings are ordered by impact in LEVELS levels, for a weight is its idf times a share of K1 + 1
    at most; the level needs no sort. Statistics are those of all postings; ``allowed`` (doc) then narrows them.
    """
    hit = posting if gathered else settled(posting.join(terms.select("term").distinct(), "term", "left_semi"))  # also gives df
    n, length = F.col("n_docs").cast("double"), F.col("total_len") / F.greatest(F.lit(1), F.col("n_docs"))
    # A row for each term of a shard that is asked for, with what it weighs; only this small relation meets the statistics.
    known = hit.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df")).join(stats.select(F.col("shard").alias("of_"), "n_docs", "total_len"), F.col("shard").eqNullSafe(F.col("of_")))
    known = settled(known.select("shard", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), length.alias("mean_len")))
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    if allowed is not None:
        hit = settled(hit.join(allowed.select("doc").distinct(), "doc", "left_semi"))
    return hit.join(known, ["shard", "term"]).select("shard", "doc", "term", (F.col("idf") * (K1 + 1) * share).alias("w"), F.least(F.floor(share * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level"))


def blocks_of(rated: DataFrame) -> DataFrame:
    """shard, term, blocks: of each term the blocks (level, least, most, n) from the lowest to the highest: their least and greatest weights and their postings."""
    blocks = rated.groupBy("shard", "term", "level").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("level", "least", "most", "n"))).alias("blocks"))  # LEVELS at most


def blocks_to_read(blocks: DataFrame, asked: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """query, shard, term, level, n, floor, missed: the blocks that each query (query, term) reads.

    floor is a score that the query's ``limit``-th best document reaches, told by the blocks alone: where the
    highest blocks of a term hold ``limit`` postings, so many documents have the least weight in them or
    more, and the best of the terms counts. Of each term the blocks whose weights are no more than an equal part
    of UNREAD times the floor are skipped. A document has one posting of a term, so what it can have in
    skipped blocks, missed, is the sum of the terms' greatest weights there, which is below the floor. Without a floor all are read.
    """
    higher = "aggregate(slice(blocks, i + 1, size(blocks)), 0L, (a, b) -> a + b.n)"
    reached = F.expr(f"filter(transform(blocks, (x, i) -> struct({higher} as held, x.least as least)), y -> y.held >= {limit})")
    known = blocks.withColumn("sure", F.array_max(F.transform(reached, lambda y: y["least"])))
    own = Window.partitionBy("query", "shard")
    met = asked.join(known, "term").withColumns({"floor": F.max("sure").over(Window.partitionBy(*keys)) - SLACK, "n_terms": F.count(F.lit(1)).over(own)})
    low = lambda b: F.coalesce(b["most"] * F.col("n_terms") <= UNREAD * F.col("floor"), F.lit(False))
    met = met.withColumn("missed", F.sum(F.coalesce(F.array_max(F.transform(F.filter("blocks", low), lambda b: b["most"])), F.lit(0.0))).over(own))
    return met.select("query", "shard", "term", "floor", "missed", F.inline(F.filter("blocks", lambda b: ~low(b)))).drop("least", "most")


def search_by_impact(posting: DataFrame, queries: DataFrame, stats: DataFrame, limit: int, per_shard: bool = True, allowed: DataFrame | None = None, min_score: float = 0.0, gathered: bool = False) -> DataFrame:
    """As ``search``, row for row, for short queries over long postings: blocks that cannot bring a document among the best aren't read.

    Postings are cut to the terms that are asked for and lie in blocks by impact (``impacts``). The blocks'
    bounds give a floor under the score of the ``limit``-th best document; blocks so low that all of them
    together stay below it are not read (``blocks_to_read``). What is read of a document bounds its score from both sides, and
    only those whose upper bound reaches the ``limit``-th best lower one are scored whole.
    """
    asked = settled(queries.select("query", F.explode(F.array_distinct("terms")).alias("term")))
    rated = impacts(posting, asked, stats, allowed, gathered)
    keys = ["query", "shard"] if per_shard else ["query"]
    wanted = blocks_to_read(settled(blocks_of(rated)), asked, limit, keys).drop("n")
    read = rated.join(wanted, ["shard", "term", "level"]).groupBy("query", "shard", "doc").agg(F.sum("w").alias("seen"), F.first("missed").alias("missed"), F.first("floor").alias("floor"))
    read = settled(read.filter(F.col("floor").isNull() | (F.col("seen") + F.col("missed") >= F.col("floor") - SLACK)).drop("floor"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seen").desc()))
    reached = read.select(*keys, "seen").withColumn("nth", best).filter(F.col("nth") <= limit).groupBy(*keys).agg(F.min("seen").alias("reached"))
    likely = read.join(reached, keys).filter(F.col("seen") + F.col("missed") >= F.col("reached") - SLACK)
    part = likely.filter("missed > 0").select("query", "shard", "doc")
    whole = part.join(rated.select("shard", "doc", "term", "w"), ["shard", "doc"]).join(asked, ["query", "term"]).groupBy("query", "shard", "doc").agg(F.sum("w").alias("raw"))
    scored = likely.filter("missed = 0").select("query", "shard", "doc", F.col("seen").alias("raw")).unionByName(whole)
    scored = scored.withColumn("score", F.round(1 - F.exp(-F.col("raw")), 6)).filter(F.col("score") >= min_score)
    order = Window.partitionBy(*keys).orderBy(F.round(F.col("raw"), 6).desc(), F.col("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "shard", "doc", "score", "rank")
