"""Ranked retrieval for many planned queries at once: features, routes, fusion, diversity, abstention and selection.

memories: id, owner, agent, kind, content, status, importance, confidence, access_count, created_at,
updated_at, valid_from, valid_to, supersedes, source_ids, share_policy, sensitivity and, if there is one,
embedding. Times are epoch milliseconds. Nothing is written: ``usage`` gives the log to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scoring, vector
from tesserae.functions import text as t
from tesserae.operators import filters, lexical, ranking
from tesserae.plans import planner
from tesserae.session import settled, spread

#: Least lexical and semantic scores (hashed embeddings, other models), least final score, and the bounds of seeds and neighbours.
MIN_LEXICAL, MIN_SEMANTIC, MIN_SEMANTIC_OTHER, SURE_SEMANTIC, MIN_SCORE = 0.08, 0.2, 0.32, 0.34, 0.12
SEEDS, NEIGHBOURS, POSTING_LIMIT = 12, 60, 500
#: Parts that the rows of a scope are dealt to before they meet its queries.
SALTS = 32


def plan(queries: DataFrame, now: int) -> DataFrame:
    """queries (query, text, owner, agent) with their plans; queries that need no memory are left out."""
    return planner.plan_queries(queries, "text", now).filter("intent <> 'external'")


def candidates(memories: DataFrame, plans: DataFrame, now: int, share_policies: list[str] | None = None, sensitivities: list[str] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(query, memory columns, plan columns, those of ``also`` from the plans) of rows in the query's scope that its time and the policy allow.

    A scope's rows are dealt to SALTS parts, each of which meets the scope's queries, so a large scope is no single task.
    """
    m = memories.filter(F.col("status").isin("active", "superseded")).filter(filters.recall_allowed(share_policies, sensitivities))
    p = plans.select("query", "text", "owner", "agent", "intent", "mode", F.col("as_of").alias("p_as_of"), F.col("valid_from").alias("p_from"), F.col("valid_to").alias("p_to"), F.col("concepts").alias("asked"), "routes", "rank_window", "candidate_budget", *also)
    at = F.coalesce("p_as_of", F.lit(now))
    valid = filters.valid_at(at, F.col("valid_from"), F.col("valid_to"))
    fits = (
        F.when(F.col("p_from").isNotNull(), filters.overlaps(F.col("p_from"), F.col("p_to"), F.col("valid_from"), F.col("valid_to")))
        .when(F.col("mode") == "current", (F.col("status") == "active") & valid)
        .when(F.col("p_as_of").isNotNull(), valid)
        .otherwise(True)
    )
    dealt, met = m.withColumn("salt_", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), p.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(met, ["owner", "agent", "salt_"]).filter(fits).drop("salt_")


def lexical_scores(memories: DataFrame, plans: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query, id, lexical): the best BM25 score over a query and its clauses; statistics are those of the scope's rows that its mode searches."""
    docs = memories.filter(F.col("status").isin("active", "superseded")).select("id", "status", F.concat_ws("\x00", "owner", "agent").alias("owner"), t.bm25_tokens(F.col("content")).alias("tokens"))
    docs = settled(docs)  # both modes take postings and statistics of it
    asked = plans.select("query", F.concat_ws("\x00", "owner", "agent").alias("shard"), "mode", "rank_window", F.posexplode(F.concat(F.array("text"), "sub_queries")).alias("part", "clause"))
    asked = asked.withColumn("ask", F.concat_ws("#", F.col("query").cast("string"), F.col("part").cast("string")))
    found = []
    for current in (True, False):
        some = docs.filter("status = 'active'") if current else docs
        of = asked.filter((F.col("mode") == "current") if current else (F.col("mode") != "current"))
        hits = lexical.search(lexical.postings(some), of.select(F.col("ask").alias("query"), t.bm25_tokens(F.col("clause")).alias("terms")), lexical.corpus_stats(some), 400)
        found.append(hits.withColumnRenamed("query", "ask").join(of.select("ask", "query", "shard"), ["ask", "shard"]).select("query", F.col("doc").alias("id"), "score"))
    both = found[0].unionByName(found[1]).groupBy("query", "id").agg(F.max("score").alias("lexical"))
    return both.join(allowed.select("query", "id"), ["query", "id"], "left_semi")


def posting_hits(memories: DataFrame, plans: DataFrame, allowed: DataFrame, limit: int = POSTING_LIMIT) -> DataFrame:
    """(query, id) of active rows that share a strong token with the query, where the token isn't common in the scope."""
    active = memories.filter("status = 'active'").select("owner", "agent", "id", F.explode(t.strong_tokens(F.col("content"))).alias("token"))
    asked = plans.select("query", "owner", "agent", F.explode(t.strong_tokens(F.col("text"))).alias("token"))
    hit = active.join(asked.select("owner", "agent", "token").distinct(), ["owner", "agent", "token"], "left_semi")
    rare = hit.groupBy("owner", "agent", "token").count().filter(F.col("count") <= limit).drop("count")
    return hit.join(rare, ["owner", "agent", "token"]).join(asked, ["owner", "agent", "token"]).select("query", "id").distinct().join(allowed.select("query", "id"), ["query", "id"], "left_semi")


def episode_neighbours(memories: DataFrame, plans: DataFrame, scored: DataFrame, postings: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query, id) of at most NEIGHBOURS active rows that share a source message with a seed, for queries that have the route."""
    wanted = plans.filter(F.array_contains("routes", "episode")).select("query", "owner", "agent")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("lexical").desc(), "id"))
    seeds = scored.filter(F.col("lexical") >= MIN_LEXICAL).withColumn("nth", nth).filter(F.col("nth") <= SEEDS).select("query", "id").unionByName(postings).distinct().join(wanted, "query")
    by_message = memories.select("id", "status", "owner", "agent", F.explode("source_ids").alias("message"))
    messages = seeds.join(by_message.select("id", "message"), "id").select("query", "owner", "agent", "message").distinct()
    found = messages.join(by_message.filter("status = 'active'").drop("status"), ["owner", "agent", "message"]).select("query", "id").distinct().join(allowed.select("query", "id"), ["query", "id"], "left_semi")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("id"))).filter(F.col("nth") <= NEIGHBOURS).select("query", "id")


def features(memories: DataFrame, plans: DataFrame, now: int, local_model: bool = True, **policy) -> DataFrame:
    """One row for each (query, allowed memory) with its scores and relevance flags."""
    # Scopes that no query asks are left out before anything is made of them.
    memories = memories.join(plans.select("owner", "agent").distinct(), ["owner", "agent"], "left_semi")
    memories = spread(memories)
    # Vectors of length one, as the hashed ones are made.
    memories = memories.withColumn("embedding", vector.unit(F.col("embedding")) if "embedding" in memories.columns else vector.local_embedding(F.col("content")))
    # What depends on the memory alone is made once for each, before it meets the queries of its scope.
    known = memories.withColumns(
        {
            "held": t.concepts(F.col("content")),
            "own_tokens": t.strong_tokens(F.col("content")),
            "importance": scoring.clamp(F.col("importance")),
            "confidence": scoring.clamp(F.col("confidence")),
            "recency": scoring.recency(F.col("kind"), F.col("updated_at"), F.lit(now)),
            "frequency": scoring.frequency(F.col("access_count")),
        }
    )
    asked = plans.withColumns({"asked_embedding": vector.local_embedding(F.col("text")), "asked_tokens": t.strong_tokens(F.col("text"))})
    rows = candidates(settled(known), settled(asked), now, also=("asked_embedding", "asked_tokens", "broad"), **policy)
    # Vectors meet here and go no further.
    near_by = F.when(F.size("asked_embedding") == F.size("embedding"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), vector.dot(F.col("asked_embedding"), F.col("embedding"))))).otherwise(0.0)
    rows = settled(rows.withColumns({"semantic": near_by, "overlap": F.arrays_overlap("own_tokens", "asked_tokens")}).drop("embedding", "asked_embedding", "own_tokens", "asked_tokens"))
    allowed = rows.select("query", "id")
    scored = settled(lexical_scores(memories, plans, allowed))  # also seeds of the episode route
    posted = posting_hits(memories, plans, allowed)
    near = episode_neighbours(memories, plans, scored, posted, allowed)
    flagged = lambda df, name: df.withColumn(name, F.lit(True))
    rows = rows.join(scored, ["query", "id"], "left").join(flagged(posted, "posted"), ["query", "id"], "left").join(flagged(near, "near"), ["query", "id"], "left")
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumns(
        {
            "lexical": F.coalesce("lexical", F.lit(0.0)),
            "posted": off("posted"),
            "near": off("near"),
            "temporal": F.when(F.col("mode") == "historical", scoring.temporal_alignment("historical", F.col("status"))).when(F.col("mode") == "current", scoring.temporal_alignment("current", F.col("status"))).otherwise(0.7),
        }
    )
    has = (F.size("asked") > 0) if local_model else F.lit(False)
    shared = F.size(F.array_intersect("asked", "held")) > 0
    least = MIN_SEMANTIC if local_model else MIN_SEMANTIC_OTHER
    structured = (
        F.when(has, scoring.concept_coverage(F.col("asked"), F.col("held"))).when(F.col("broad"), F.col("importance") * 0.6 + F.col("confidence") * 0.4).when(F.col("posted"), F.col("importance") * 0.1 + 0.45).otherwise(0.0)
    )
    semantic_ok = F.lit(True) if not local_model else (shared | (~has & (F.col("overlap") | (F.col("semantic") >= max(SURE_SEMANTIC, least)))))
    rows = rows.withColumns(
        {
            "structured": structured,
            "is_lexical": (F.col("lexical") >= MIN_LEXICAL) & F.col("overlap") & (~has | shared),
            "is_semantic": (F.col("semantic") >= least) & semantic_ok,
            "is_structured": F.when(has, structured > 0).otherwise(F.col("broad") | F.col("posted")),
            "is_episode": F.array_contains("routes", "episode") & F.col("near"),
        }
    )
    return rows.withColumn("relevant", F.col("is_lexical") | F.col("is_semantic") | F.col("is_structured") | F.col("is_episode") | (F.col("broad") & ~has))


def _route_scores() -> dict[str, tuple[Column, Column]]:
    """By route: whether a relevant row is in it, and its score there."""
    start = F.coalesce("valid_from", "created_at")
    distance = (
        F.when(F.col("p_from").isNotNull(), scoring.route_distance(start, F.col("p_from"), F.col("p_to"))).when(F.col("p_as_of").isNotNull(), scoring.route_distance(start, as_of=F.col("p_as_of")))
    )
    temporal = F.coalesce(F.col("temporal") * 0.7 + distance * 0.3, F.col("temporal"))
    version = F.when(F.col("status") == "conflicted", 1.0).when(F.col("supersedes").isNotNull(), 0.9).otherwise(0.75)
    return {
        "lexical": (F.col("is_lexical"), F.col("lexical")),
        "semantic": (F.col("is_semantic"), F.col("semantic")),
        "structured": (F.col("is_structured"), F.col("structured")),
        "temporal": (F.col("temporal") > 0, temporal),
        "correction": (F.col("status").isin("conflicted", "superseded") | F.col("supersedes").isNotNull(), version * 0.7 + F.col("lexical") * 0.2 + F.col("semantic") * 0.1),
        "episode": (F.col("is_episode"), F.lit(0.5) + F.col("lexical") * 0.3 + (F.col("importance") + F.col("confidence")) / 2 * 0.2),
    }


def rank(feature_rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """query, id, content, score, routes, route_ranks, rank: routes ranked and cut at the query's window, then fused."""
    rows = feature_rows.filter("relevant")
    routes = F.filter(
        F.array(*[F.when(inside & F.array_contains("routes", name), F.struct(F.lit(name).alias("route"), score.cast("double").alias("route_score"))) for name, (inside, score) in _route_scores().items()]), lambda r: r.isNotNull()
    )
    kept = ["query", "id", "content", "importance", "confidence", "temporal", "recency"]
    laid = rows.select(*kept, "rank_window", F.coalesce("valid_from", "created_at").alias("start"), F.explode(routes).alias("r")).select(*kept, "rank_window", "start", "r.*")
    # All windows and the aggregation are by query: one shuffle.
    whole = Window.partitionBy("query")
    order = Window.partitionBy("query", "route").orderBy(F.col("route_score").desc(), F.when(F.col("route") == "temporal", F.col("start")).desc(), "content", "id")
    ranked = laid.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("rank_window"))
    ranked = ranked.withColumn("n_routes", F.size(F.collect_set("route").over(whole)))
    fused = ranked.groupBy("query", "id").agg(
        F.sum(1.0 / (ranking.RANK_CONSTANT + F.col("place"))).alias("raw"),
        F.array_sort(F.collect_list("route")).alias("routes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "place")))).alias("route_ranks"),
        *[F.first(c).alias(c) for c in ("content", "importance", "confidence", "temporal", "recency", "n_routes")],
    )
    normalized, agreement = F.col("raw") / F.max("raw").over(whole), F.size("routes") / F.greatest(F.lit(1), F.col("n_routes"))
    score = scoring.fused_score(normalized, agreement, F.col("importance"), F.col("confidence"), F.col("temporal"), F.col("recency"))
    fused = fused.withColumn("score", F.round(score, 9)).filter(F.col("score") >= min_score)
    final = whole.orderBy(F.col("score").desc(), F.size("routes").desc(), "content", "id")
    return fused.withColumn("rank", F.row_number().over(final)).select("query", "id", "content", "score", "routes", "route_ranks", "rank")


def rank_linear(feature_rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The same by the weighted linear score: the fallback to fusion."""
    score = scoring.linear_score(*(F.col(c) for c in ("semantic", "lexical", "importance", "recency", "frequency", "temporal")))
    rows = feature_rows.filter("relevant").withColumn("score", F.round(score, 9)).filter(F.col("score") >= min_score)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "content", "id")
    return rows.withColumn("rank", F.row_number().over(order)).select("query", "id", "content", "score", "rank")


def _pool(memories: DataFrame, plans: DataFrame, now: int, fusion: str, **policy) -> DataFrame:
    """query, id, content, score, rank of at most 100 diverse rows of each query, computed once."""
    ranked = (rank if fusion == "rrf" else rank_linear)(features(memories, plans, now, **policy)).select("query", "id", "content", "score", "rank")
    ranked = settled(ranked.filter("rank <= 600"))  # routes of at most 100 rows each
    diverse = ranking.diverse_top(ranked.withColumn("tokens", t.bm25_tokens(F.col("content"))), 100)
    return settled(diverse.select("query", "id", "position").join(ranked.drop("rank"), ["query", "id"]).withColumnRenamed("position", "rank"))


def recall(memories: DataFrame, queries: DataFrame, now: int, top_k: int = 5, fusion: str = "rrf", **policy) -> DataFrame:
    """query, id, score, position of the first ``top_k`` (1 to 20) diverse rows of each query."""
    top_k = max(1, min(20, top_k))
    pool = _pool(memories, settled(plan(queries, now)), now, fusion, **policy)
    return pool.filter(F.col("rank") <= top_k).select("query", "id", "score", F.col("rank").alias("position"))


def recall_adaptive(memories: DataFrame, queries: DataFrame, now: int, **policy) -> tuple[DataFrame, DataFrame]:
    """(outcomes, injected): by query the stop reason, evaluated and batches; and the injected rows with citation and score."""
    plans = settled(plan(queries, now))
    pool = _pool(memories, plans, now, "rrf", **policy).join(plans.select("query", "candidate_budget"), "query").filter(F.col("rank") <= F.col("candidate_budget")).drop("candidate_budget")
    best = pool.groupBy("query").agg(F.max("score").alias("best"))
    judged = plans.join(best, "query", "left").withColumn("abstains", ranking.abstains(F.col("intent"), F.col("best")))
    answered = judged.filter("not abstains").select("query", "text", "initial", "continuation", "max_batches", "max_injected", "max_characters", F.lit(None).cast("string").alias("mode"))
    chosen = settled(ranking.adaptive_top(pool.select("query", "id", "content", "score", "rank"), answered))
    outcomes = judged.join(chosen, "query", "left").select(
        "query", "intent", "routes", "best",
        F.when(F.col("abstains"), "abstain-low-confidence").otherwise(F.coalesce("stop_reason", F.lit("no-candidates"))).alias("stop_reason"),
        F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce(F.size("ids"), F.lit(0)).alias("n_injected"),
    )
    injected = chosen.select("query", F.explode("ids").alias("id")).join(pool.select("query", "id", "score", "rank"), ["query", "id"])
    injected = injected.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).withColumn("citation", F.concat(F.lit("M"), F.col("position").cast("string")))
    return outcomes, injected


def usage(injected: DataFrame, now: int) -> DataFrame:
    """The log rows to append for injected memories; access counts are sums over the log."""
    return injected.select("id", F.lit(now).alias("accessed_at"), F.lit(1).alias("accesses"))


def version_group(memories: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query, id, other, hop): versions of the same key and the superseded row (one hop, at most 6), and their ancestors (two hops, at most 8)."""
    known = memories.filter(F.col("status").isin("active", "superseded", "conflicted")).select("id", "owner", "agent", "key", "supersedes")
    own = chosen.select("query", "id").join(known, "id")
    same = own.filter("key is not null").join(known.select(F.col("id").alias("other"), "owner", "agent", "key", F.col("supersedes").alias("next")), ["owner", "agent", "key"]).filter("other <> id").select("query", "id", "other", "next", F.lit(2).alias("via"))
    direct = own.filter("supersedes is not null").join(known.select(F.col("id").alias("other"), F.col("supersedes").alias("next")), F.col("supersedes") == F.col("other")).select("query", own["id"], "other", "next", F.lit(1).alias("via"))
    one = direct.unionByName(same).groupBy("query", "id", "other").agg(F.min("via").alias("via"), F.first("next").alias("next"))
    one = one.withColumn("nth", F.row_number().over(Window.partitionBy("query", "id").orderBy("via", "other"))).filter("nth <= 6")
    two = one.filter("next is not null").select("query", "id", F.col("next").alias("other")).join(known.select(F.col("id").alias("other")), "other", "left_semi").filter("other <> id")
    both = one.select("query", "id", "other", F.lit(1).alias("hop")).unionByName(two.select("query", "id", "other", F.lit(2).alias("hop"))).groupBy("query", "id", "other").agg(F.min("hop").alias("hop"))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("query", "id").orderBy("hop", "other"))).filter("nth <= 8").drop("nth")
