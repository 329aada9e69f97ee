"""Registered queries of the engine's own operators over the driver tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import scoring, vector
from tesserae.functions import text as t
from tesserae.operators import chains, filters, ingest, integrity, lexical, ranking, retrievals, rollups, state, stats, upkeep, vectors
from tesserae.plans import planner
from tesserae.session import checkpoint_folder, settled, spread, stored_once, table
from tesserae.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-02-01, the moment the queries take as now.
NOW_MS = 1_706_745_600_000


def query(sql: str | None = None):
    """Registers a query by its name, with the SQL for the same rows where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- relations over the driver tables ----


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fact rows: the source is the owner, the language the kind, labels give quality and status."""
    docs, labels = _texts(spark, sf_dir), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("owner"),
        F.col("lang").alias("kind"),
        F.col("text").alias("content"),
        F.when(F.col("toxic") == 1, "suppressed").otherwise("active").alias("status"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("importance"),
        "n_chars",
    )


_MEMORIES = """memories as (select d.doc_id as id, d.source as owner, d.lang as kind, d.text as content,
  case when l.toxic = 1 then 'suppressed' else 'active' end as status, coalesce(l.quality::double, 0.5) as importance, d.n_chars
  from documents d left join labels l using (doc_id))"""
_TOKENS = "list_transform(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda x: 'w:' || x)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt out to all cores where the table is one small file."""
    return spread(table(spark, sf_dir, "documents"))


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).withColumn("tokens", t.bm25_tokens(F.col("content")))


# ---- lexical retrieval ----


@query(
    f"""with {_MEMORIES}, tok as (select owner, status, len({_TOKENS}) as n from memories)
select owner as shard, count(*) as n_docs, sum(n)::bigint as total_len, sum(case when status = 'active' then 1 else 0 end)::bigint as active_docs,
 sum(case when status = 'active' then n else 0 end)::bigint as active_len from tok group by owner"""
)
def bm25_corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_tokenised(spark, sf_dir))


@query(
    f"""with {_MEMORIES}, tok as (select distinct owner, id, unnest({_TOKENS}) as term from memories)
select owner as shard, term, count(*) as df from tok group by owner, term"""
)
def bm25_document_frequency(spark, sf_dir):
    return lexical.document_frequency(lexical.postings(_tokenised(spark, sf_dir)))


@query(
    f"""with {_MEMORIES}, tok as (select id, unnest({_TOKENS}) as term from memories), tf as (select id, term, count(*) as tf from tok group by id, term)
select id, count(*) as n_terms, max(tf) as max_tf, sum(tf)::bigint as n_tokens from tf group by id"""
)
def term_frequency(spark, sf_dir):
    posting = lexical.postings(_tokenised(spark, sf_dir))
    return posting.groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("n_terms"), F.max("tf").alias("max_tf"), F.sum("tf").alias("n_tokens"))


def _holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query, id) of all docs (id, content) that hold an item (query, item) word for word.

    A document that holds an item has each of its words but perhaps the first and the last, which may be
    parts of longer ones; it is looked for by the rarest of these. Items without such a word meet all documents.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))
    items = items.withColumn("words", words("item"))
    asked = items.filter(F.size("words") > 2).select("query", F.explode(F.array_distinct(F.expr("slice(words, 2, size(words) - 2)"))).alias("term"))
    has = docs.select("id", F.explode(F.array_distinct(words("content"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = has.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(df, "term", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term"))
    by_word = has.join(rarest, "term").select("query", "id").join(items.select("query", "item"), "query").join(docs, "id")
    rest = docs.join(items.filter(F.size("words") <= 2).select("query", "item"), F.contains("content", "item"))
    return by_word.filter(F.contains("content", "item")).select("query", "id").unionByName(rest.select("query", "id"))


def _search(spark, sf_dir, limit, search=lexical.search):
    docs = memories(spark, sf_dir).filter("status = 'active'").select("id", F.lit("all").alias("owner"), "status", t.bm25_tokens(F.col("content")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), t.bm25_tokens(F.col("text")).alias("terms"))
    posting, known = lexical.asked_postings(docs, asked.select(F.explode("terms").alias("term")))
    return search(posting, asked, known, limit, gathered=True)


_BM25 = f"""{_MEMORIES}, live as (select id, content, len({_TOKENS}) as doc_len, {_TOKENS} as tokens from memories where status = 'active'),
stats as (select count(*)::double as n, sum(doc_len)::double / count(*) as avg_len from live),
tf as (select id, doc_len, term, count(*) as tf from (select id, doc_len, unnest(tokens) as term from live) group by id, doc_len, term),
df as (select term, count(*) as df from tf group by term),
asked as (select distinct item_id as query, 'w:' || unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
raw as (select query, id as doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) as raw
 from asked join tf using (term) join df using (term), stats group by query, id),
ranked as (select query, doc, round(1 - exp(-raw), 6) as score, row_number() over (partition by query order by round(raw, 6) desc, doc) as rank from raw)"""


@query(f"with {_BM25} select query, 'all' as shard, doc, score, rank from ranked where rank <= 10")
def bm25_topk(spark, sf_dir):
    """Ten best documents for every benchmark item."""
    return _search(spark, sf_dir, 10)


@query(f"with {_BM25} select query, 'all' as shard, doc, score, rank from ranked where rank <= 3")
def bm25_by_impact(spark, sf_dir):
    """Three best documents for every benchmark item, by blocks of postings in order of impact."""
    return _search(spark, sf_dir, 3, lexical.search_by_impact)


@query(
    f"""with {_BM25}, pool as (select query, doc as id, rank from ranked where rank <= 10),
rel as (select item_id as query, id from benchmark, live where contains(live.content, benchmark.text)),
total as (select query, count(*) as total from rel group by query),
found as (select pool.query, count(*) as found, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from pool join rel on rel.query = pool.query and rel.id = pool.id where rank <= 5 group by pool.query),
ideal as (select query, sum(1 / log2(i + 1)) as ideal from total, range(1, 6) r(i) where i <= least(total, 5) group by query),
per as (select total.query, 'part ' || (total.query % 2) as category, coalesce(found / total, 0) as recall, case when found > 0 then 1.0::double else 0 end as hit, case when first = 1 then 1.0::double else 0 end as top1,
 coalesce(1 / first, 0) as rr, coalesce(dcg / ideal, 0) as ndcg from total left join found using (query) join ideal using (query))
select coalesce(category, '(all)') as category, count(*) as n, round(avg(recall), 6) as recall, round(avg(hit), 6) as hit, round(avg(top1), 6) as top1, round(avg(rr), 6) as rr, round(avg(ndcg), 6) as ndcg
from per group by rollup(category)"""
)
def retrieval_metrics(spark, sf_dir):
    """How well the search ranks the active documents that hold a benchmark item, wherever they rank."""
    pool = _search(spark, sf_dir, 10).select("query", F.col("doc").alias("id"), "rank")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"))
    live = memories(spark, sf_dir).filter("status = 'active'").select("id", "content")
    per = stats.query_metrics(pool, _holders(live, items), 5)
    return stats.retrieval_metrics(per.withColumn("category", F.concat(F.lit("part "), (F.col("query") % 2).cast("string"))))


# ---- vectors and fusion ----


@query(
    """with q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 50 = 0),
s as (select query, vec_id as id, round(list_cosine_similarity(e, embedding::double[]), 6) as similarity from q join embeddings on vec_id <> query)
select query, id, similarity, rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from s) where rank <= 10"""
)
def cosine_topk(spark, sf_dir):
    """Ten nearest vectors for every stated query (ids divisible by 50), against all rows."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 10)


@query(
    """with s as (select a.vec_id as query, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select query, id, similarity, rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from s) where rank <= 5"""
)
def cosine_neighbours(spark, sf_dir):
    """Five nearest vectors of every row, by cells."""
    return vectors.nearest_by_cells(table(spark, sf_dir, "embeddings"), F.lit(True), 5)


_ROUTES = """o as (select o_custkey, count(*) as n, max(epoch_us(o_orderdate)) as last from orders group by o_custkey),
c as (select c_custkey as id, c_mktsegment as query, c_acctbal, coalesce(n, 0) as n, coalesce(last, 0) as last from customer left join o on o_custkey = c_custkey),
routes as (select query, id, 'balance' as route, row_number() over (partition by query order by c_acctbal desc, id) as rank from c
 union all select query, id, 'orders', row_number() over (partition by query order by n desc, id) from c
 union all select query, id, 'recent', row_number() over (partition by query order by last desc, id) from c),
ranked as (select * from routes where rank <= 100)"""


def _routes(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("last"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    scores = F.create_map(F.lit("balance"), F.col("c_acctbal"), F.lit("orders"), F.coalesce("n", F.lit(0)).cast("double"), F.lit("recent"), F.coalesce("last", F.lit(0)).cast("double"))
    routes = c.select(F.col("c_mktsegment").alias("query"), F.col("c_custkey").alias("id"), F.explode(scores).alias("route", "route_score"))
    return ranking.route_ranks(routes, 100, ties=("id",))


@query(
    f"""with {_ROUTES}, f as (select query, id, sum(1.0::double / (60 + rank)) as raw, count(*) as n_routes from ranked group by query, id)
select query, id, round(raw, 9) as raw, round(raw / max(raw) over (partition by query), 6) as normalized, n_routes, round(n_routes / 3.0::double, 6) as agreement from f"""
)
def rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion of three routes, each cut at 100, for every market segment."""
    fused = ranking.reciprocal_rank_fusion(_routes(spark, sf_dir))
    return fused.select("query", "id", F.round("raw", 9).alias("raw"), F.round("normalized", 6).alias("normalized"), F.size("routes").cast("long").alias("n_routes"), F.round("agreement", 6).alias("agreement"))


@query(f"with {_ROUTES} select query, route, count(*) as n from ranked group by query, route")
def route_candidate_counts(spark, sf_dir):
    return _routes(spark, sf_dir).groupBy("query", "route").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_MEMORIES} select id, round(greatest(0, least(1, importance * 0.4 + least(1, n_chars / 10000.0::double) * 0.2 + importance * 0.14
 + pow(0.5::double, greatest(0, ({NOW_MS} - (1704067200000 + id * 1000)) / 86400000.0::double) / 240.0) * 0.08 + least(1, ln(1 + (n_chars // 100)) / ln(21.0::double)) * 0.04
 + case when status = 'active' then 1.0 else 0.0 end * 0.14)), 6) as score from memories"""
)
def linear_fusion(spark, sf_dir):
    """The weighted linear score of every row."""
    m = memories(spark, sf_dir)
    updated = F.lit(1_704_067_200_000) + F.col("id") * 1000
    score = scoring.linear_score(
        F.col("importance"), F.least(F.lit(1.0), F.col("n_chars") / 10000.0), F.col("importance"), scoring.recency(F.col("kind"), updated, F.lit(NOW_MS)),
        scoring.frequency(F.floor(F.col("n_chars") / 100)), scoring.temporal_alignment("current", F.col("status")),
    )
    return m.select("id", F.round(score, 6).alias("score"))


# ---- the write path of single-valued keys ----

_CHAINS = """w as (select *, lower(content) as same from told),
p as (select *, row_number() over o as nth, last_value(case when sure then same end ignore nulls) over b as set_, first_value(same) over o as first_ from w
 window o as (partition by owner, key order by seq, id, same, begins, confidence, sure), b as (partition by owner, key order by seq, id, same, begins, confidence, sure rows between unbounded preceding and 1 preceding)),
q as (select *, case when nth = 1 then null when set_ is null then first_ else set_ end as prior from p),
r as (select *, case when prior is null then 'added' when prior = same then 'refreshed' when sure then 'replaced' else 'conflicted' end as outcome from q),
s as (select *, last_value(case when outcome <> 'conflicted' then begins end ignore nulls) over (partition by owner, key order by nth rows between unbounded preceding and 1 preceding) as since from r),
final as (select owner, key, arg_max(same, nth) as active from s where outcome <> 'conflicted' group by owner, key),
own as (select owner, key, same, arg_min(id, nth) as id, arg_min(content, nth) as content, max(confidence) as confidence, arg_max(begins, nth) as start, arg_max(outcome, nth) as outcome,
 arg_max(moment, nth) as written, arg_max(prior, nth) filter (where outcome = 'replaced') as ended, count(*) as n_writes from s group by owner, key, same),
ends as (select owner, key, prior as same, arg_max(greatest(begins, since + 1), nth) as stop, arg_max(moment, nth) as ended_at from s where outcome = 'replaced' group by owner, key, prior),
rows_ as (select own.*, stop, ended_at, case when own.same = active then 'active' when own.outcome = 'conflicted' then 'conflicted' else 'superseded' end as status
 from own join final using (owner, key) left join ends using (owner, key, same))
select r.owner, r.key, r.id, r.content, r.confidence, r.start, r.status, case when r.status <> 'active' then r.stop end as stop, e.id as supersedes,
 case when r.status = 'superseded' then r.ended_at else r.written end as updated, r.n_writes from rows_ r left join own e on e.owner = r.owner and e.key = r.key and e.same = r.ended"""


@query(
    f"""with told as (select client_id as owner, key, seq, change_id as id, key || ': ' || value as content, confidence, confidence >= 0.8 as sure, coalesce(epoch_ms(valid_at), 0) as moment, coalesce(epoch_ms(valid_at), 0) as begins
 from (select *, case source when 'crm' then 0.95 when 'store' then 0.9 when 'partner' then 0.7 else 0.5 end::double as confidence, unnest(['segment', 'city']) as key, unnest([segment, city]) as value from client_changes where op <> 'D')
 where value is not null and client_id is not null and seq is not null and change_id is not null), {_CHAINS}"""
)
def client_facts(spark, sf_dir):
    """What is held of each client's segment and city after all changes: a source that isn't sure doesn't replace what is held."""
    source = F.when(F.col("source") == "crm", 0.95).when(F.col("source") == "store", 0.9).when(F.col("source") == "partner", 0.7).otherwise(0.5)
    told = table(spark, sf_dir, "client_changes").filter("op <> 'D'").withColumn("confidence", source)
    told = told.select("client_id", "seq", "change_id", "valid_at", "confidence", F.explode(F.create_map(F.lit("segment"), "segment", F.lit("city"), "city")).alias("key", "value"))
    told = told.select(F.col("client_id").alias("owner"), F.lit("shop").alias("agent"), "key", "seq", F.col("change_id").alias("id"), F.concat("key", F.lit(": "), "value").alias("content"), "confidence", F.unix_millis(F.col("valid_at").cast("timestamp")).alias("at"))
    return chains.state(chains.writes(told)).drop("agent")


@query(
    f"""with told as (select o_custkey as owner, 'order status' as key, epoch_ms(o_orderdate) as seq, o_orderkey as id, 'order status: ' || o_orderstatus as content, case when o_orderpriority < '4' then 0.9 else 0.4 end::double as confidence,
 o_orderpriority < '4' as sure, epoch_ms(o_orderdate) as moment, epoch_ms(o_orderdate) as begins from orders where o_custkey is not null and o_orderstatus is not null and o_orderdate is not null and o_orderkey is not null), {_CHAINS}"""
)
def order_facts(spark, sf_dir):
    """What is held of each customer's order status: urgent to medium orders are sure."""
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    confidence = F.when(F.col("o_orderpriority") < "4", 0.9).otherwise(0.4)
    told = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.lit("shop").alias("agent"), F.lit("order status").alias("key"), at.alias("seq"), F.col("o_orderkey").alias("id"), F.concat(F.lit("order status: "), "o_orderstatus").alias("content"), confidence.alias("confidence"), at.alias("at"))
    return chains.state(chains.writes(told)).drop("agent")


# ---- duplicates ----


@query("""select lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as content, source as owner, min(doc_id) as canonical, count(*) as members from documents group by 1, 2 having count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    """Rows of one owner with equal squeezed, lower-case content."""
    docs = table(spark, sf_dir, "documents").select(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("content"), F.col("source").alias("owner"), "doc_id")
    return docs.groupBy("content", "owner").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("members")).filter("members > 1")


@query(
    """with c as (select kind, tokens, min(id) as id from (select lang as kind, doc_id as id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as tokens from documents) group by kind, tokens),
e as (select id, kind, unnest(tokens) as token from c), df as (select kind, token, count(*) as df from e group by kind, token having count(*) >= 2),
k as (select * from (select id, kind, token, row_number() over (partition by id order by df, token) as nth from e join df using (kind, token)) where nth <= 3),
p as (select distinct least(k.id, e.id) as a, greatest(k.id, e.id) as b from k join e on e.kind = k.kind and e.token = k.token and e.id <> k.id),
s as (select a, b, round(len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens))), 6) as similarity from p join c x on x.id = a join c y on y.id = b)
select * from s where similarity >= 0.5"""
)
def blocked_near_duplicates(spark, sf_dir):
    """Pairs of token sets of one kind that share a rare token and reach a similarity of one half."""
    docs = _texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.array_distinct(t.words(F.col("text"))).alias("tokens"))
    return rollups.blocked_near_duplicates(docs)


@query(
    """select source, lang, sha256(text) as hash, min(doc_id) as canonical, count(*) as members from documents group by 1, 2, 3 having count(*) > 1"""
)
def duplicate_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    return rollups.duplicate_groups(docs, ["source", "lang", "hash"], "doc_id", "doc_id")


# ---- versions and state ----

_VERSIONS = """v as (select o_custkey as key, o_orderkey as id, o_orderstatus as value, epoch_ms(o_orderdate) as start,
 lead(epoch_ms(o_orderdate)) over (partition by o_custkey order by o_orderdate, o_orderkey) as following from orders),
versions as (select key, id, value, start as valid_from, case when following is not null then greatest(following, start + 1) end as valid_to from v)"""


def _versions(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("start"))
    return state.close_versions(rows, ["key"], "start", ["id"]).select("key", "id", "value", "valid_from", "valid_to")


@query(f"with {_VERSIONS} select * from versions")
def scd2_validity(spark, sf_dir):
    return _versions(spark, sf_dir)


@query(
    f"""with {_VERSIONS}, one as (select key, valid_from, min(id) as id from versions group by key, valid_from),
p as (select event_id, user_id as key, epoch_us(ts) // 1000 - 157680000000 as moment from events)
select event_id, p.key, moment, v.id, v.value from p left join versions v on v.key = p.key and v.valid_from <= moment and (v.valid_to is null or moment < v.valid_to)
qualify row_number() over (partition by event_id order by v.valid_from desc, v.id desc) = 1"""
)
def asof_lookup(spark, sf_dir):
    """For every event the version of its key that was valid five years earlier."""
    probes = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_millis(F.col("ts").cast("timestamp")) - 157_680_000_000).alias("moment"))
    # Of versions that start together the one of the largest id is the last.
    return state.as_of(_versions(spark, sf_dir), probes, "key", "moment").select("event_id", "key", "moment", "id", "value")


@query(
    f"""with {_VERSIONS}, w as (select epoch_ms(make_timestamp(y, 1, 1, 0, 0, 0)) as low, epoch_ms(make_timestamp(y + 1, 1, 1, 0, 0, 0)) as high, y from range(1992, 2000) t(y))
select y::int as year, count(*) as n, count(distinct key) as keys from w join versions on valid_from < high and (valid_to is null or valid_to > low) group by y"""
)
def interval_overlap(spark, sf_dir):
    """How many versions overlap each year: years are laid out per version, so no row meets a year it doesn't touch."""
    v = _versions(spark, sf_dir)
    year = lambda ms: F.year(F.timestamp_millis(ms))
    last = F.when(F.col("valid_to").isNull(), 1999).otherwise(F.least(F.lit(1999), year(F.col("valid_to") - 1)))
    laid = v.withColumn("first_", F.greatest(F.lit(1992), year(F.col("valid_from")))).withColumn("last_", last).filter("first_ <= last_")
    return laid.select("key", F.explode(F.sequence("first_", "last_")).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query("""select o_custkey as key, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as id, max_by(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) as value
from orders group by o_custkey having max_by(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) <> 'F'""")
def current_state(spark, sf_dir):
    """The last order of each customer as its state; a finished one deletes it."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"), "o_orderdate")
    return state.latest(log, "key", ["o_orderdate", "id"], F.col("value") == "F").select("key", "id", "value")


@query(
    """select o_custkey as scope, o_orderkey as id, case o_orderstatus when 'O' then 'active' else 'superseded' end as status,
 row_number() over (partition by o_custkey order by (o_orderstatus = 'O') desc, o_orderdate desc, o_orderkey desc) <= 5 as keep from orders"""
)
def prune_capacity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("superseded").alias("status"), "o_orderdate")
    return state.prune(rows, ["scope"], 5, [F.col("o_orderdate").desc(), F.col("id").desc()]).select("scope", "id", "status", "keep")


@query(
    """select o_custkey as key, o_orderkey as id, (row_number() over w)::int as version, lead(o_orderdate) over w as closed_at, lead(1) over w is null as is_latest
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"""
)
def version_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return state.number_versions(rows, ["key"], ["o_orderdate", "id"]).select("key", "id", "version", "closed_at", "is_latest")


@query(
    f"""with {_MEMORIES} select id, case when status = 'active' and 1704067200000 + n_chars * 1000000 <= {NOW_MS} then 'expired' else status end as status from memories"""
)
def expiry(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("expires_at", F.lit(1_704_067_200_000) + F.col("n_chars") * 1_000_000)
    return m.select("id", filters.expired_status(F.lit(NOW_MS)).alias("status"))


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 3")
def last_turns(spark, sf_dir):
    return state.last_n(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3)


@query(
    """with c as (select conv_id, turn, left(text, 600) as cut, row_number() over (partition by conv_id order by turn desc) as n from conversations),
b as (select *, 2400 - coalesce(sum(length(cut)) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as room from c where n <= 6)
select conv_id, turn, left(cut, room::bigint) as context from b where room > 0"""
)
def recent_context(spark, sf_dir):
    return state.recent_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("select conv_id, count(*) as n from conversations where conv_id > 3 group by conv_id order by conv_id limit 50")
def keyset_page(spark, sf_dir):
    """A page of 50 conversations beyond a cursor."""
    return state.page(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id", 3, 50)


# ---- rollups, tiers, feedback ----


@query(
    """select strftime(ts, '%Y-%m-%d') as bucket, count(distinct event_id) as n_episodes, count(distinct json_extract_string(props, '$.k')) as n_facts,
 min(ts) as first_recorded, max(ts) as last_recorded from events group by 1"""
)
def day_rollup(spark, sf_dir):
    links = table(spark, sf_dir, "events").select(F.col("event_id").alias("episode"), F.get_json_object("props", "$.k").alias("fact"), F.col("ts").alias("recorded"))
    return rollups.bucket_rollup(links, F.date_format("recorded", "yyyy-MM-dd"))


@query("select conv_id as bucket, count(distinct turn) as n_episodes, count(distinct role) as n_facts, min(turn) as first_recorded, max(turn) as last_recorded from conversations group by 1")
def session_rollup(spark, sf_dir):
    links = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("episode"), F.col("role").alias("fact"), F.col("turn").alias("recorded"))
    return rollups.bucket_rollup(links, F.col("conv_id"))


@query(
    """select l_partkey as fact, count(distinct l_orderkey) as episodes, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen
from lineitem join orders on o_orderkey = l_orderkey where l_returnflag <> 'R' group by l_partkey"""
)
def evidence_membership(spark, sf_dir):
    """Active links from facts (parts) to episodes (orders), with the facts' span of time."""
    links = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_partkey").alias("fact"), F.col("l_orderkey").alias("o_orderkey"))
    episodes = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return links.join(episodes, "o_orderkey").groupBy("fact").agg(F.countDistinct("o_orderkey").alias("episodes"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


_FEEDBACK = """fb as (select json_extract_string(props, '$.k')::bigint as fact, sum((event_type = 'purchase')::int)::bigint as adopted, sum((event_type = 'signup')::int)::bigint as corrected,
 sum((event_type = 'error')::int)::bigint as denied from events where event_type in ('purchase', 'signup', 'error') group by 1)"""


def _feedback(spark, sf_dir) -> DataFrame:
    fact = F.get_json_object("props", "$.k").cast("long")
    kinds = {"adopted": "purchase", "corrected": "signup", "denied": "error"}
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin(list(kinds.values())))
    events = events.select(*[F.when(F.col("event_type") == e, F.array(fact)).otherwise(F.array().cast("array<bigint>")).alias(name) for name, e in kinds.items()])
    return rollups.feedback_counts(events, {name: name for name in kinds})


@query(f"with {_FEEDBACK} select * from fb")
def feedback_counts(spark, sf_dir):
    return _feedback(spark, sf_dir)


_UTILITY = f"""{_FEEDBACK}, g as (select p_brand, count(*) as size from part group by p_brand),
f as (select p_partkey as id, (p_size / 50.0::double) as importance, (p_retailprice / 2000.0::double) as evidence, coalesce(adopted, 0) as adopted, coalesce(corrected, 0) as corrected,
 coalesce(denied, 0) as denied, size, p_type like 'PROMO%' as confirmed from part left join fb on fact = p_partkey % 1000000007 join g using (p_brand)),
u as (select id, round(greatest(0, least(1, 0.30::double * least(1, importance) + 0.15::double * least(1, evidence) + 0.20::double * least(1, adopted * 0.25::double) + 0.15::double * pow(0.5::double, ({NOW_MS} - (1704067200000 + id * 3600000)) / 2592000000.0::double)
 + 0.10::double * case when size <= 1 then 1 else 0.4::double end + case when confirmed then 0.10::double else 0 end - least(0.5::double, denied * 0.2::double + corrected * 0.1::double))), 8) as utility, (confirmed or importance >= 0.85) as protected, denied from f)"""


def _utility(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sizes = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("size"))
    f = part.join(_feedback(spark, sf_dir).withColumnRenamed("fact", "p_partkey"), "p_partkey", "left").join(sizes, "p_brand")
    n = lambda c: F.coalesce(c, F.lit(0))
    importance, confirmed = F.col("p_size") / 50.0, F.col("p_type").startswith("PROMO")
    utility = scoring.tier_utility(
        importance, F.col("p_retailprice") / 2000.0, n("adopted"), F.lit(0), F.least(F.lit(NOW_MS), F.lit(1_704_067_200_000) + F.col("p_partkey") * 3_600_000), F.lit(NOW_MS), F.col("size"), confirmed, n("denied"), n("corrected")
    )
    return f.select(F.col("p_partkey").alias("id"), F.round(utility, 8).alias("utility"), (confirmed | (importance >= rollups.PROTECTED_IMPORTANCE)).alias("protected"), n("denied").alias("denied"))


_UTILITY = _UTILITY.replace("({NOW_MS} - (1704067200000 + id * 3600000))", "x").replace(
    f"pow(0.5::double, ({NOW_MS} - (1704067200000 + id * 3600000)) / 2592000000.0::double)", f"pow(0.5::double, greatest(0, {NOW_MS} - least({NOW_MS}, 1704067200000 + id * 3600000)) / 2592000000.0::double)"
)


@query(f"with {_UTILITY} select id, utility, protected, denied from u")
def tier_utility(spark, sf_dir):
    return _utility(spark, sf_dir)


@query(
    f"""with {_UTILITY}, a as (select *, denied >= 2 as quarantine from u), b as (select *, case when not quarantine and utility >= 0.65 then row_number() over (partition by not quarantine and utility >= 0.65 order by utility desc, id) end as h from a),
c as (select *, coalesce(h <= 500, false) as hot from b), d as (select *, sum((not quarantine and not hot and protected)::int) over () as guarded from c),
e as (select *, case when not quarantine and not hot and not protected and utility >= 0.35 then row_number() over (partition by not quarantine and not hot and not protected and utility >= 0.35 order by utility desc, id) end as w from d),
t as (select *, not quarantine and not hot and (protected or coalesce(w <= greatest(0, 2000 - guarded), false)) as warm from e),
z as (select *, case when not quarantine and not hot and not warm then row_number() over (partition by not quarantine and not hot and not warm order by utility desc, id) end as k from t)
select id, utility, protected, denied, case when quarantine then 'quarantine' when hot then 'hot' when warm then 'warm' else 'cold' end as tier, coalesce(k > 10000, false) as archive from z"""
)
def tier_assignment(spark, sf_dir):
    return rollups.assign_tiers(_utility(spark, sf_dir)).withColumn("archive", F.coalesce("archive", F.lit(False)))


@query(
    """with e as (select event_id, user_id, json_extract_string(props, '$.k') as k, event_type from events where event_type = 'error'),
v as (select event_id as view_id, user_id, json_extract_string(props, '$.k') as k from events where event_type = 'view')
select event_id, user_id, k, (select max(view_id) from v where v.user_id = e.user_id and v.k = e.k and view_id < event_id) as matched_view from e"""
)
def feedback_last_match(spark, sf_dir):
    """For every error the latest view of the same user and fact before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    asked = events.filter("event_type = 'error'").select("event_id", "user_id", "k")
    logged = events.filter("event_type = 'view'").select("user_id", "k", F.col("event_id").alias("view"), F.col("event_id").alias("seq"))
    return state.last_match(asked, logged, ["user_id", "k"], "event_id", "seq", "view")


@query(
    """with w as (select lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')) as token from documents), c as (select lang, token, count(*) as n from w group by 1, 2)
select lang, token, n, rank from (select *, row_number() over (partition by lang order by n desc, token) as rank from c) where rank <= 8"""
)
def topic_summary(spark, sf_dir):
    docs = _texts(spark, sf_dir).select("lang", t.topic_tokens(F.col("text")).alias("tokens"))
    return rollups.top_tokens(docs, "lang", "tokens", 8)


@query(
    f"""with {_MEMORIES} select owner, case max(case when status = 'suppressed' then 2 when importance < 0.5 then 1 else 0 end) when 2 then 'secret' when 1 then 'private' else 'normal' end as sensitivity from memories group by owner"""
)
def most_restrictive(spark, sf_dir):
    """The most sensitive level among each owner's rows."""
    levels = F.array(*map(F.lit, ("normal", "private", "secret")))
    rank = F.when(F.col("status") == "suppressed", 2).when(F.col("importance") < 0.5, 1).otherwise(0)
    return memories(spark, sf_dir).groupBy("owner").agg(F.element_at(levels, F.max(rank) + 1).alias("sensitivity"))


# ---- integrity ----


@query(
    """select 'line without order' as "check", count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'line without part', count(*) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'line without supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)
union all select 'order without customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'event without customer', count(*) from events where user_id not in (select c_custkey from customer)
union all select 'label without document', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'repeated order', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)
union all select 'discount outside', count(*) from lineitem where not l_discount between 0 and 0.05
union all select 'length differs', count(*) from documents where n_chars <> length(text)"""
)
def integrity_checks(spark, sf_dir):
    tb = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "customer", "events", "labels", "documents")}
    return integrity.violations(
        {
            "line without order": integrity.dangling(tb["lineitem"], "l_orderkey", tb["orders"], "o_orderkey"),
            "line without part": integrity.dangling(tb["lineitem"], "l_partkey", tb["part"], "p_partkey"),
            "line without supplier": integrity.dangling(tb["lineitem"], "l_suppkey", tb["supplier"], "s_suppkey"),
            "order without customer": integrity.dangling(tb["orders"], "o_custkey", tb["customer"], "c_custkey"),
            "event without customer": integrity.dangling(tb["events"], "user_id", tb["customer"], "c_custkey"),
            "label without document": integrity.dangling(tb["labels"], "doc_id", tb["documents"], "doc_id"),
            "repeated order": integrity.repeated(tb["orders"], "o_orderkey"),
            "discount outside": integrity.outside(tb["lineitem"], "l_discount", 0, 0.05),
            "length differs": tb["documents"].filter(F.col("n_chars") != F.length("text")),
        }
    )


@query(
    """with s as (select doc_id, lang, length(text) as size, 1 as here from documents), m as (select conv_id as doc_id, count(*) as copies, max(case role when 'user' then 'en' else 'fr' end) as lang, max(length(text)) as size from conversations where turn = 0 group by conv_id),
b as (select coalesce(s.doc_id, m.doc_id) as doc_id, here, copies, s.lang as a, m.lang as b, s.size as x, m.size as y from s full outer join m using (doc_id))
select doc_id, 'MISSING_FACT' as code from b where copies is null union all select doc_id, 'UNEXPECTED_ACTIVE_FACT' from b where here is null
union all select doc_id, 'DUPLICATE_FACT' from b where copies > 1 union all select doc_id, 'CONTENT_MISMATCH' from b where here = 1 and copies >= 1 and x is distinct from y
union all select doc_id, 'STATUS_MISMATCH' from b where here = 1 and copies >= 1 and a is distinct from b"""
)
def full_outer_audit(spark, sf_dir):
    """Differences between two stores: documents, and first turns of conversations of the same ids."""
    source = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("size"))
    mirror = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "en").otherwise("fr").alias("lang"), F.length("text").alias("size"))
    return integrity.diff(source, mirror, "doc_id", {"CONTENT_MISMATCH": "size", "STATUS_MISMATCH": "lang"})


@query(
    """select user_id, event_id, hash, coalesce(lag(hash) over (partition by user_id order by event_id), '') as previous_hash
from (select user_id, event_id, sha256(event_id || ':' || event_type || ':' || props) as hash from events)"""
)
def hash_chain(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    payload = F.concat_ws(":", F.col("event_id").cast("string"), "event_type", "props")
    return integrity.chained(events, F.col("user_id"), "event_id", payload).select("user_id", "event_id", "hash", "previous_hash")


# ---- statistics ----

_JUDGED = """judged as (select doc_id, lang, quality, toxic, least(1, n_chars / 5000.0::double) as p from documents join labels using (doc_id))"""


def _judged(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"))


@query(
    f"""with {_JUDGED}, s as (select lang, sum(quality)::bigint as k, count(*) as n from judged group by lang)
select lang, k, n, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n) * 1.96 / (1 + 1.96 * 1.96 / n)), 6) as low,
 round(least(1, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n) * 1.96 / (1 + 1.96 * 1.96 / n)), 6) as high from s"""
)
def wilson_intervals(spark, sf_dir):
    s = _judged(spark, sf_dir).groupBy("lang").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return s.select("lang", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    f"""with {_JUDGED}, q as (select greatest(1e-12, least(1 - 1e-12, p)) as p, quality as y from judged), b as (select least(9, floor(p * 10)) as bin, count(*) as n, avg(p) as mp, avg(y) as my from q group by 1)
select (select count(*) from q) as n, (select round(avg((p - y) * (p - y)), 6) from q) as brier, (select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) from q) as log_loss,
 round(sum(n * abs(mp - my)) / (select count(*) from q), 6) as ece, round(max(abs(mp - my)), 6) as mce from b"""
)
def calibration_errors(spark, sf_dir):
    return stats.calibration_errors(_judged(spark, sf_dir), "p", "quality")


@query(f"""with {_JUDGED}, q as (select greatest(1e-12, least(1 - 1e-12, p)) as p, quality as y from judged)
select least(9, floor(p * 10))::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y from q group by 1""")
def calibration_bins(spark, sf_dir):
    return stats.calibration_bins(_judged(spark, sf_dir), "p", "quality").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(
    f"""with {_JUDGED}, c as (select lang, sum((p >= 0.3 and quality = 1)::int)::bigint as tp, sum((p < 0.3 and quality = 0)::int)::bigint as tn, sum((p >= 0.3 and quality = 0)::int)::bigint as fp, sum((p < 0.3 and quality = 1)::int)::bigint as fn from judged group by lang)
select lang, tp, tn, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as specificity,
 round(coalesce(fp / nullif(tn + fp, 0), 0), 6) as fpr, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round((tp + fp) / (tp + tn + fp + fn), 6) as coverage from c"""
)
def confusion_by_group(spark, sf_dir):
    return stats.confusion(_judged(spark, sf_dir), F.col("p") >= 0.3, F.col("quality") == 1, ["lang"])


@query(
    f"""with {_JUDGED}, d as (select lang, p as t from judged group by 1, 2), o as (select lang, t from d union all select lang, max(t) + 1e-9 from d group by lang union all select lang, min(t) - 1e-9 from d group by lang),
e as (select o.lang, t, sum((p >= t and quality = 1)::int) as tp, sum((p < t and quality = 0)::int) as tn, sum((p >= t and quality = 0)::int) as fp, sum((p < t and quality = 1)::int) as fn from o join judged j on j.lang = o.lang group by 1, 2)
select lang, round(t, 9) as threshold, (fp * 2.0 + fn)::double as cost from e qualify row_number() over (partition by lang order by fp * 2.0 + fn, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) desc, t desc) = 1"""
)
def threshold_fit(spark, sf_dir):
    return stats.fit_threshold(_judged(spark, sf_dir), "p", "quality", "lang")


@query("select event_type, count(*) as n, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.5) as p50, max(value) as top from events group by event_type")
def nearest_rank_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), stats.nearest_rank("value", 0.95).alias("p95"), stats.nearest_rank("value", 0.5).alias("p50"), F.max("value").alias("top"))


@query(f"with {_JUDGED} select lang, round(least(count(*), sum(p) * sum(p) / sum(p * p)), 6) as n_eff from judged group by lang")
def effective_sample_count(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("lang").agg(F.round(stats.effective_count("p"), 6).alias("n_eff"))


# ---- text functions ----


@query(
    """select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n_strong,
 length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) as n_comparable, least(1000, length(trim(regexp_replace(text, '[\\s]+', ' ', 'g'))))::int as cost,
 sha256(concat(source, chr(0), lang)) as key from documents"""
)
def text_functions(spark, sf_dir):
    text = F.col("text")
    return _texts(spark, sf_dir).select(
        "doc_id", F.size(t.bm25_tokens(text)).alias("n_tokens"), F.size(t.strong_tokens(text)).alias("n_strong"), F.length(t.comparable(text)).alias("n_comparable"),
        t.character_cost(text).alias("cost"), t.stable_id(F.col("source"), F.col("lang")).alias("key"),
    )


@query(
    """with p as (select a.doc_id as a, b.doc_id as b, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')) as x, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) as y
 from documents a join documents b on b.doc_id = a.doc_id + 1)
select a, b, len(list_intersect(x, y)) as shared, round(case when len(x) + len(y) = 0 then 1 else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end, 6) as jaccard,
 round(case when least(len(x), len(y)) = 0 then 0 else len(list_intersect(x, y)) / least(len(x), len(y)) end, 6) as overlap from p"""
)
def set_similarity(spark, sf_dir):
    """Set operations on each document's words and the next one's."""
    docs = _texts(spark, sf_dir).select("doc_id", F.array_distinct(t.words(F.col("text"))).alias("x"))
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("x").alias("y")), "doc_id")
    x, y = F.col("x"), F.col("y")
    return both.select(F.col("doc_id").alias("a"), "b", F.size(F.array_intersect(x, y)).alias("shared"), F.round(t.jaccard(x, y), 6).alias("jaccard"), F.round(t.overlap(x, y), 6).alias("overlap"))


@query(
    f"""with {_MEMORIES} select id, status in ('active', 'superseded') and importance <> 0 as kept from memories where owner in ('src1', 'src2') and kind in ('en', 'fr')"""
)
def recall_policy(spark, sf_dir):
    """Policy and time predicates before any scoring."""
    m = memories(spark, sf_dir).withColumns({"share_policy": F.col("owner"), "sensitivity": F.col("kind"), "valid_from": F.lit(0), "valid_to": F.when(F.col("importance") == 0, 1)})
    allowed = m.filter(filters.recall_allowed(["src1", "src2"], ["en", "fr"]))
    return allowed.select("id", filters.temporal_candidate("historical", NOW_MS, as_of=NOW_MS).alias("kept"))


# ---- not for SQL: checked against brute force in the tests ----


@query()
def planner_batch(spark, sf_dir):
    """The plan of every user turn: intent, time, routes and budgets."""
    turns = spread(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")))
    return planner.plan_queries(turns, "query", NOW_MS).drop("query")


@query()
def local_embeddings(spark, sf_dir):
    """The hashed embedding of every document."""
    return _texts(spark, sf_dir).select("doc_id", vector.local_embedding(F.col("text")).alias("embedding"))


def _planned(spark, sf_dir) -> DataFrame:
    """The plan of every benchmark item."""
    return planner.plan_queries(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), "text", NOW_MS)


def _pool(spark, sf_dir, plans: DataFrame, size: str) -> DataFrame:
    """The best documents for every benchmark item, as many as its plan's column says: 10 at least, 100 at most."""
    hits = settled(_search(spark, sf_dir, 100).select("query", F.col("doc").alias("id"), "rank", "score"))
    return hits.join(plans.select("query", size), "query").filter(F.col("rank") <= F.greatest(F.lit(10), F.col(size))).drop(size)


@query()
def diverse_topk(spark, sf_dir):
    """Of the documents in every benchmark item's rank window the first 5 that differ."""
    hits = _pool(spark, sf_dir, _planned(spark, sf_dir), "rank_window").drop("score")
    # Only texts that were found are tokenised again.
    found = memories(spark, sf_dir).select("id", "content").join(hits.select("id").distinct(), "id", "left_semi")
    return ranking.diverse_top(hits.join(found.select("id", t.bm25_tokens(F.col("content")).alias("tokens")), "id"), 5)


@query()
def adaptive_topk(spark, sf_dir):
    """Adaptive selection among the candidates that every benchmark item's plan allows."""
    plans = _planned(spark, sf_dir)
    ranked = _pool(spark, sf_dir, plans, "candidate_budget").join(memories(spark, sf_dir).select("id", "content"), "id")
    plans = plans.select("query", "text", "initial", "continuation", "max_batches", "max_injected", "max_characters", F.lit(None).cast("string").alias("mode"))
    return ranking.adaptive_top(ranked, plans)


@query(
    f"""with {_JUDGED}, p as (select lang as cohort, p as s, sum(quality)::bigint as y, count(*)::bigint as n from judged where quality is not null and p is not null group by 1, 2),
c as (select *, row_number() over w as i, sum(y) over w as cy, sum(n) over w as cn from p window w as (partition by cohort order by s)),
l as (select b.cohort, b.i, max((b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)) as before from c b join c a on a.cohort = b.cohort and a.i <= b.i group by 1, 2),
r as (select b.cohort, b.i, min((a.cy - b.cy) / (a.cn - b.cn)) as behind from c b join c a on a.cohort = b.cohort and a.i > b.i group by 1, 2),
k as (select c.*, coalesce(sum((behind is null or before <= behind)::int) over (partition by c.cohort order by c.i rows between unbounded preceding and 1 preceding), 0) as block
 from c join l on l.cohort = c.cohort and l.i = c.i left join r on r.cohort = c.cohort and r.i = c.i)
select cohort, min(s) as low, max(s) as high, sum(y)::double as positive, sum(n)::double as total, sum(n)::bigint as n from k group by cohort, block"""
)
def isotonic_calibration(spark, sf_dir):
    """Blocks of a rising step function for each language: cut wherever no mean up to there exceeds a mean from there on."""
    return stats.isotonic_blocks(_judged(spark, sf_dir), "lang", "p", "quality")


@query()
def extracted_facts(spark, sf_dir):
    """Facts that the rules find in every user turn and in what each customer would say of themselves, with the verifier's action."""
    turns = spread(table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text"))
    said = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("My name is "), F.col("c_name"), F.lit(". I work as a "), F.lower("c_mktsegment"), F.lit(" buyer. I live in place "), F.col("c_nationkey").cast("string")).alias("text")
    )
    return ingest.verify(ingest.extract(turns.unionByName(said), "id", "text", NOW_MS))


# ---- streams ----


def _replayed(spark, sf_dir, columns: list[str], job) -> DataFrame:
    """What ``job`` emits while the events come in four micro-batches by time and a row of user -1 a year later ends them; at times as in UTC."""
    utc = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")).alias("ts")
    rows = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null").select("user_id", utc, *columns)
    return jobs.replayed(spark, rows, "ts", 4, job, f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}", {"user_id": -1})


@query(
    """with e as (select user_id, ts, value, coalesce(ts >= lag(ts) over w + interval 6 hours, true) as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, value, sum(fresh::int) over (partition by user_id order by ts) as session from e)
select user_id, epoch_us(min(ts)) // 1000 as start_ms, epoch_us(max(ts)) // 1000 as end_ms, count(*) as n, round(sum(value), 4) as total from s group by user_id, session"""
)
def user_sessions(spark, sf_dir):
    """Sessions of each user, six hours apart or more, by a stream with merging windows."""
    found = _replayed(spark, sf_dir, ["value"], lambda s: jobs.sessions(s, "user_id", "ts", "6 hours", value="value"))
    return found.filter("user_id >= 0").select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n", F.round("total", 4).alias("total"))


@query(
    """with e as (select user_id, ts, event_type, epoch_us(ts) // 1000 as ms, coalesce(epoch_us(ts) // 1000 > lag(epoch_us(ts) // 1000) over w + 86400000, true) as fresh from events window w as (partition by user_id order by ts, event_type)),
s as (select *, sum(fresh::int) over (partition by user_id order by ts, event_type) as run from e),
l as (select *, row_number() over (partition by user_id, run order by ts desc, event_type desc) as back, count(*) over (partition by user_id, run) as n from s)
select user_id, ms as last_ms, event_type, n, ms + 86400000 as expired_ms from l where back = 1"""
)
def user_expiries(spark, sf_dir):
    """Each time a user did nothing for a day, with the last event before; by a stream whose state has a time to live."""
    with jobs.rocksdb_state(spark):
        found = _replayed(spark, sf_dir, ["event_type"], lambda s: jobs.expiries(s, "user_id", "ts", "event_type", "1 day"))
    return found.filter("key <> '-1'").select(F.col("key").cast("long").alias("user_id"), "last_ms", F.col("value").alias("event_type"), "n", "expired_ms")


# ---- stores kept up by batches ----

#: Where the clicks are cut, by arrival, into the batches that a store gets.
CUTS = ["2024-01-20 00:00:00", "2024-03-01 12:00:00", None]
_SEEN = """seen as (select distinct click_id, ts, arrived_at, client_id, kind, case when json_valid(props) then json_extract_string(props, '$.k') end as k,
 case when json_valid(props) then list_sort(list_distinct(list_filter(json_extract_string(props, '$.items[*].sku'), lambda x: x is not null))) end as skus from clicks)"""


def _clicks(spark, sf_dir, kept: str) -> DataFrame:
    """The clicks that a condition keeps, with what their JSON tells of them (nothing where it is broken). It is parsed here, once for all batches that read them."""
    told = F.from_json("props", "k string, items array<struct<sku string>>").alias("told")
    parsed = stored_once(table(spark, sf_dir, "clicks").filter(kept).select("click_id", "ts", "arrived_at", "client_id", "kind", told), "clicks")
    return parsed.select("click_id", "ts", "arrived_at", "client_id", "kind", "told.k", F.col("told.items.sku").alias("skus"))


def _between(rows: DataFrame, low: str | None, high: str | None) -> DataFrame:
    at = F.col("arrived_at").cast("timestamp_ntz")
    kept = rows if low is None else rows.filter(at > F.lit(low).cast("timestamp_ntz"))
    return kept if high is None else kept.filter(at <= F.lit(high).cast("timestamp_ntz"))


@query(
    f"""with {_SEEN}, v as (select click_id, client_id, k, arrived_at, skus from seen where kind = 'view' and client_id is not null and k is not null),
r as (select click_id as report, client_id, k, arrived_at, kind, skus from seen where kind in ('purchase', 'signup', 'error') and client_id is not null and k is not null),
u as (select client_id, k, arrived_at, click_id as id, click_id as view_id from v union all select client_id, k, arrived_at, report, null from r),
f as (select id as report, arrived_at, last_value(view_id ignore nulls) over (partition by client_id, k order by arrived_at, id rows between unbounded preceding and current row) as event, view_id from u),
m as (select f.event, r.* from f join r on r.report = f.report where f.view_id is null and f.event is not null qualify row_number() over (partition by f.event order by r.arrived_at desc, r.report desc) = 1)
select v.click_id as id, v.client_id::varchar as scope, sha256(v.k) as query_hash, coalesce(array_to_string(v.skus, ','), '') as retrieved, m.report,
 coalesce(case when m.kind = 'purchase' then array_to_string(m.skus, ',') end, '') as adopted, coalesce(case when m.kind = 'signup' then array_to_string(m.skus, ',') end, '') as corrected,
 coalesce(case when m.kind = 'error' then array_to_string(m.skus, ',') end, '') as denied from v left join m on m.event = v.click_id"""
)
def retrieval_outcomes(spark, sf_dir):
    """Views as retrievals with what the last report on each says; in batches by arrival, the second one delivered twice and the third with rows of the second."""
    rows = _clicks(spark, sf_dir, "client_id is not null and kind in ('view', 'purchase', 'signup', 'error')").filter("k is not null")
    common = ["click_id as id", "cast(client_id as string) as scope", "arrived_at as at"]
    hashed = retrievals.query_hash(F.col("k")).alias("query_hash")
    views = lambda df: df.filter("kind = 'view'").select(*map(F.expr, common), hashed, retrievals.fact_set(F.col("skus")).alias("retrieved"))
    kinds = {"adopted": "purchase", "corrected": "signup", "denied": "error"}
    told = lambda df: df.filter(F.col("kind").isin(list(kinds.values()))).select(*map(F.expr, common), hashed, *[F.when(F.col("kind") == k, F.col("skus")).alias(o) for o, k in kinds.items()])
    folder = f"{checkpoint_folder(spark)}/retrievals-{uuid.uuid4().hex}"
    for number, low, high in ((0, None, CUTS[0]), (1, CUTS[0], CUTS[1]), (1, CUTS[0], CUTS[1]), (2, "2024-02-28 00:00:00", None)):
        part = _between(rows, low, high)
        retrievals.deliver(spark, folder, number, views(part), told(part), slices=16)
    joined = [F.array_join(c, ",").alias(c) for c in ("retrieved", *retrievals.OUTCOMES)]
    return retrievals.stored(spark, folder).select("id", "scope", "query_hash", "report", *joined)


def _kept_up(spark, sf_dir) -> str:
    """The folder of a rollup of clicks by day that three increments and a run without news have kept up."""
    rows = _clicks(spark, sf_dir, "ts is not null").select("click_id", "ts", "arrived_at", "k", F.date_format("ts", "yyyy-MM-dd").alias("bucket"))
    folder = f"{checkpoint_folder(spark)}/upkeep-{uuid.uuid4().hex}"
    build = lambda m: m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_episodes"), F.countDistinct("k").alias("n_facts"), F.min("ts").alias("first_recorded"), F.max("ts").alias("last_recorded"), *upkeep.digest("click_id"))
    for cut in [*CUTS, None]:
        upkeep.advance(spark, folder, _between(rows, None, cut), "click_id", "arrived_at", "bucket", build, slices=16)
    return folder


_RUNS = f"""runs as (select * from (values (0, timestamp '{CUTS[0]}'), (1, timestamp '{CUTS[1]}'), (2, timestamp '9999-01-01'), (3, timestamp '9999-01-01')) as t(run, cut)),
marks as (select run, cut, (select max(arrived_at) from clicks where ts is not null and arrived_at <= cut) as mark from runs),
spans as (select run, cut, coalesce(lag(mark) over (order by run), timestamp '1000-01-01') as low, mark from marks),
reads as (select run, click_id, strftime(ts, '%Y-%m-%d') as bucket from spans join clicks on ts is not null and arrived_at >= low and arrived_at <= mark),
firsts as (select click_id, bucket, min(run) as run from reads group by 1, 2)"""


@query(
    f"""with {_SEEN}, {_RUNS}, built as (select bucket, max(run)::int as run from firsts group by 1)
select strftime(ts, '%Y-%m-%d') as bucket, count(*) as n_episodes, count(distinct k) as n_facts, min(ts) as first_recorded, max(ts) as last_recorded, any_value(run) as run
from seen join built on bucket = strftime(ts, '%Y-%m-%d') where ts is not null group by 1"""
)
def kept_up_rollup(spark, sf_dir):
    """Clicks by day, kept up over four runs: late rows build an older day again; ``run`` is the one that built a day last."""
    return upkeep.artifacts(spark, _kept_up(spark, sf_dir), "bucket").drop("members_hash")


@query(
    f"""with {_RUNS}, t as (select distinct run, bucket from reads), b as (select distinct run, bucket from firsts)
select run::int as run, (select count(*) from reads r where r.run = s.run) as rows_read, (select count(*) from t where t.run = s.run) as touched,
 (select count(*) from firsts f join t on t.bucket = f.bucket and t.run = s.run where f.run <= s.run) as members, (select count(*) from b where b.run = s.run) as rebuilt, 0::bigint as waiting from spans s"""
)
def upkeep_runs(spark, sf_dir):
    """What each of the four runs read and built: later ones only the days that new rows touch, the last one none."""
    return upkeep.runs(spark, _kept_up(spark, sf_dir)).drop("mark")
