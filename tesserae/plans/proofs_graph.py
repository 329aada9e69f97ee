"""Queries by operator id: retrieval as a whole and the evidence graph. See ``proofs``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import evidence, integrity, lexical, ranking, recall, store
from tesserae.plans.proofs import DAY, NOW, fixture, proof, rows_of
from tesserae.session import table

# ---- retrieval ----

MEMORIES = rows_of(
    "id string, owner string, agent string, kind string, content string, status string, importance double, confidence double, access_count int, created_at bigint, updated_at bigint, valid_from bigint, valid_to bigint, key string, supersedes string, source_ids string, share_policy string, sensitivity string",
    [
        ("name", "u", "default", "identity", "用户姓名/名字：小明", "active", 0.8, 0.9, 0, NOW - 10 * DAY, NOW - 10 * DAY, None, None, "profile.name", None, "m1", "allow-remote", "normal"),
        ("pet", "u", "default", "relationship", "用户宠物名字：旺财", "active", 0.8, 0.9, 0, NOW - 10 * DAY, NOW - 10 * DAY, None, None, "relationship.pet_name", None, "m1", "allow-remote", "normal"),
        ("old", "u", "default", "identity", "用户所在地：北京", "superseded", 0.8, 0.9, 0, NOW - 900 * DAY, NOW - 100 * DAY, NOW - 900 * DAY, NOW - 100 * DAY, "profile.location", None, "m2", "allow-remote", "normal"),
        ("new", "u", "default", "identity", "用户所在地：上海", "active", 0.8, 0.9, 0, NOW - 100 * DAY, NOW - 100 * DAY, NOW - 100 * DAY, None, "profile.location", "old", "m3", "allow-remote", "normal"),
        ("plate", "u", "default", "identity", "plate ABC123 parked", "active", 0.8, 0.9, 0, NOW - 10 * DAY, NOW - 10 * DAY, None, None, None, None, "m4", "allow-remote", "private"),
        ("copy", "u", "default", "identity", "plate ABC123 parked", "active", 0.7, 0.9, 0, NOW - 10 * DAY, NOW - 10 * DAY, None, None, None, None, "m5", "allow-remote", "private"),
        ("gone", "u", "default", "identity", "plate XYZ999 parked", "deleted", 0.8, 0.9, 0, NOW - 10 * DAY, NOW - 10 * DAY, None, None, None, None, "m4", "allow-remote", "normal"),
        ("far", "u", "default", "identity", "用户所在地：广州", "conflicted", 0.8, 0.9, 0, NOW - 5 * DAY, NOW - 5 * DAY, NOW - 5 * DAY, None, "profile.location", None, "m6", "allow-remote", "normal"),
        ("other", "v", "default", "identity", "用户姓名/名字：老王", "active", 0.8, 0.9, 0, NOW - 10 * DAY, NOW - 10 * DAY, None, None, "profile.name", None, "m9", "allow-remote", "normal"),
    ],
)
QUESTIONS = rows_of("query string, text string, owner string, agent string", [(f"q{i}", x, "u", "default") for i, x in enumerate(("", "我的名字是什么", "我以前住在哪里", "where is ABC123", "什么是光合作用", "我现在住在哪里", "我们聊过我的名字小明")) if x])


def _memories(spark):
    return fixture(spark, MEMORIES, "source_ids")


def _plans(spark):
    return recall.plan(spark.sql(QUESTIONS), NOW)


_ALLOWED = f"""m as ({MEMORIES}), q as (select * from (values ('q1', true), ('q2', false), ('q3', true), ('q5', true), ('q6', true)) as t(query, current)),
allowed as (select query, m.* from m, q where owner = 'u' and agent = 'default' and status in ('active', 'superseded')
 and (not current or (status = 'active' and coalesce(valid_from, 0) <= {NOW} and {NOW} < coalesce(valid_to, {2 * NOW}))))"""


@proof(f"with {_ALLOWED} select query, id from allowed")
def R4_candidates(spark, sf_dir):
    return recall.candidates(_memories(spark), _plans(spark), NOW).select("query", "id")


@proof(f"with {_ALLOWED} select query, id from allowed where sensitivity = 'normal'")
def R4_F2_candidates_by_policy(spark, sf_dir):
    return recall.candidates(_memories(spark), _plans(spark), NOW, sensitivities=["normal"], share_policies=["allow-remote"]).select("query", "id")


_STRONG = """list_concat(['w:' || v for v in regexp_extract_all(lower({0}), '[a-z0-9]+')], [regexp_extract_all({0}, '[㐀-鿿]')[i] || regexp_extract_all({0}, '[㐀-鿿]')[i + 1] for i in range(1, len(regexp_extract_all({0}, '[㐀-鿿]')))])"""


@proof(f"""with {_ALLOWED}, asked as ({QUESTIONS}), a as (select query, unnest({_STRONG.format('text')}) as token from asked), h as (select id, unnest({_STRONG.format('content')}) as token from m where owner = 'u' and status = 'active')
select distinct a.query, h.id from a join h using (token) join allowed on allowed.query = a.query and allowed.id = h.id""")
def J2_F13_posting_hits(spark, sf_dir):
    m, plans = _memories(spark), _plans(spark)
    return recall.posting_hits(m, plans, recall.candidates(m, plans, NOW).select("query", "id"))


@proof(f"""with {_ALLOWED}, asked as ({QUESTIONS}), a as (select query, unnest({_STRONG.format('text')}) as token from asked), h as (select id, unnest({_STRONG.format('content')}) as token from m where owner = 'u' and status = 'active'),
rare as (select token from h group by token having count(distinct id) <= 1) select distinct a.query, h.id from a join h using (token) join rare using (token) join allowed on allowed.query = a.query and allowed.id = h.id""")
def F13_stop_postings(spark, sf_dir):
    """With a limit of one row a token that two rows share is passed over."""
    m, plans = _memories(spark), _plans(spark)
    return recall.posting_hits(m, plans, recall.candidates(m, plans, NOW).select("query", "id"), limit=1)


@proof("select * from (values ('q6', 'name'), ('q6', 'pet')) as t(query, id)")
def J3_R10_K6_episode_neighbours(spark, sf_dir):
    rows = recall.features(_memories(spark), _plans(spark), NOW)
    return rows.filter("is_episode").select("query", "id")


@proof("select * from (values ('q1', 'name', true, true, true), ('q1', 'pet', true, true, true), ('q3', 'plate', true, true, true), ('q3', 'copy', true, true, true)) as t(query, id, is_lexical, is_semantic, is_structured)")
def R5_R6_R7_F11_relevance(spark, sf_dir):
    """By hand: rows that tell a name, the pet's too, and rows of the asked plate are relevant by word, by vector and by structure."""
    rows = recall.features(_memories(spark), _plans(spark), NOW).filter("query in ('q1', 'q3') and relevant")
    return rows.select("query", "id", "is_lexical", "is_semantic", "is_structured").filter("is_lexical")


_RANKED = "select * from (values ('q1', 'name', 1), ('q2', 'old', 1), ('q3', 'copy', 1), ('q5', 'new', 1), ('q6', 'name', 1)) as t(query, id, position)"


@proof(_RANKED)
def R8_R11_R18_recall(spark, sf_dir):
    """The best row of each question that asks for memory. Equal rows go by id in two routes of three, which weighs more than the importance of the other."""
    return recall.recall(_memories(spark), spark.sql(QUESTIONS), NOW, top_k=1).select("query", "id", "position")


@proof("select * from (values ('q1', 'name', 1), ('q3', 'plate', 1), ('q5', 'new', 1), ('q6', 'name', 1)) as t(query, id, position)")
def R12_linear_recall(spark, sf_dir):
    return recall.recall(_memories(spark), spark.sql(QUESTIONS), NOW, top_k=1, fusion="linear").filter("query <> 'q2'").select("query", "id", "position")


@proof("select * from (values ('q1', 'coverage-satisfied', 1), ('q2', 'coverage-satisfied', 1), ('q3', 'abstain-low-confidence', 0), ('q5', 'coverage-satisfied', 1)) as t(query, stop_reason, n_injected)")
def R19_adaptive_recall(spark, sf_dir):
    outcomes, _ = recall.recall_adaptive(_memories(spark), spark.sql(QUESTIONS), NOW, sensitivities=["normal"])
    return outcomes.filter("query in ('q1', 'q2', 'q3', 'q5')").select("query", "stop_reason", F.least(F.lit(1), F.col("n_injected")).alias("n_injected"))


POOL = rows_of("query int, id int, rank int, tokens string", [(1, 1, 1, "a b c d"), (1, 2, 2, "a b c d"), (1, 3, 3, "a b x y"), (1, 4, 4, ""), (1, 5, 5, ""), (1, 6, 6, "z"), (2, 7, 1, "a"), (2, 8, 2, "b")])


@proof("select * from (values (1, 1, 1), (1, 3, 2), (1, 4, 3), (2, 7, 1), (2, 8, 2)) as t(query, id, position)")
def R13_K3_diverse_top(spark, sf_dir):
    return ranking.diverse_top(fixture(spark, POOL, "tokens"), 3).select("query", "id", "position")


RANKED = rows_of("query int, id string, content string, score double, rank int", [
    *[(1, f"m{i}", f"fact number {i} about topic{i}", 1 - i / 100, i + 1) for i in range(10)], (2, "n", "用户姓名/名字：小明", 1.0, 1), (2, "b", "用户生日：五月一日", 0.9, 2), (2, "x", "用户宠物名字：旺财", 0.8, 3), (3, "x", "用户宠物：狗", 1.0, 1),
    *[(4, f"m{i}", f"fact number {i} about topic{i}", 1.0, i + 1) for i in range(30)], (5, "a", "one thing", 1.0, 1), (5, "b", "another word", 0.3, 2),
])
LIMITS = rows_of("query int, text string, initial int, continuation int, max_batches int, max_injected int, max_characters int, mode string", [
    (1, "anything", 4, 4, 3, 10, 2400, None), (2, "我的名字和生日", 4, 4, 3, 10, 2400, None), (3, "我的名字", 4, 4, 3, 10, 2400, None), (4, "你还记得我哪些事情", 4, 4, 9, 3, 2400, None), (5, "anything", 1, 1, 3, 10, 2400, "all"),
])


@proof("select * from (values (1, 4, 1, 'coverage-satisfied', 'm0'), (2, 3, 1, 'coverage-satisfied', 'n b'), (3, 1, 1, 'marginal-gain', ''), (4, 4, 1, 'max-injected', 'm0 m1 m2'), (5, 1, 1, 'score-drop', 'a')) as t(query, evaluated, batches, stop_reason, ids)")
def R15_K4_adaptive_selection(spark, sf_dir):
    got = ranking.adaptive_top(spark.sql(RANKED), spark.sql(LIMITS))
    return got.select("query", "evaluated", "batches", "stop_reason", F.when(F.col("query") == 1, F.col("ids")[0]).otherwise(F.array_join("ids", " ")).alias("ids"))


@proof("select * from (values ('r', 'profile.location', 'new,old')) as t(query, key, ids)")
def R16_conflict_groups(spark, sf_dir):
    chosen = spark.sql("select * from values ('r', 'new'), ('r', 'old'), ('r', 'name'), ('s', 'new') as t(query, id)")
    return evidence.conflict_groups(chosen, _memories(spark))


@proof("select * from (values ('a', 2::bigint), ('b', 1)) as t(id, accesses)")
def R17_usage(spark, sf_dir):
    injected = spark.sql("select * from values ('q', 'a'), ('q', 'b'), ('r', 'a') as t(query, id)")
    return recall.usage(injected, NOW).groupBy("id").agg(F.sum("accesses").alias("accesses"))


@proof("select * from (values ('new', 'old', 1), ('new', 'far', 1), ('far', 'old', 1), ('far', 'new', 1), ('old', 'new', 1), ('old', 'far', 1)) as t(id, other, hop)")
def J8_version_group(spark, sf_dir):
    """Versions of one key are one step apart, whichever asks."""
    chosen = spark.sql("select * from values ('r', 'new'), ('r', 'far'), ('r', 'old'), ('r', 'name') as t(query, id)")
    return recall.version_group(_memories(spark), chosen).select("id", "other", "hop")


@proof(f"with m as ({MEMORIES}) select id, kind, content, status, 0.5::double as score from m where id in ('name', 'old')")
def P1_fragments(spark, sf_dir):
    got = evidence.fragments(_memories(spark), spark.sql("select * from values ('name', 0.5D), ('old', 0.5D) as t(id, score)"))
    return got.select("id", "kind", "content", "status", "score") if not {"owner", "agent"} & set(got.columns) else got


CHOSEN = rows_of("query int, id string, position int, origin string, channel string, status string, content string, valid_from bigint, valid_to bigint", [
    (1, "a", 1, "manual", "rules", "active", "a<b & c>d", None, None), (1, "b", 2, "image", None, "superseded", "x", 0, DAY), (1, "c", 3, "auto", "rules", "active", "y", DAY, None), (2, "d", 1, "auto", "context-confirmation", "conflicted", "z", None, None), (2, "e", 2, "auto", "model", "active", "w", None, None),
])


@proof(f"with c as ({CHOSEN}) select id, 'M' || position as citation, case when origin = 'manual' then 'manual' when origin = 'image' then 'image' when channel in ('rules', 'context-confirmation') then 'user-statement' else 'inferred' end as source_type from c")
def P2_P3_evidence_pack(spark, sf_dir):
    return ranking.evidence_pack(spark.sql(CHOSEN)).select("id", "citation", "source_type")


@proof(f"""with c as ({CHOSEN}) select id, '<memory id="M' || position || '" state="' || case when status = 'superseded' then 'historical' else 'current' end || '"' || coalesce(' from="' || strftime(make_timestamp(valid_from * 1000), '%Y-%m-%d') || '"', '')
 || coalesce(' to="' || strftime(make_timestamp(valid_to * 1000), '%Y-%m-%d') || '"', '') || '>' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</memory>' as line from c""")
def P4_prompt_lines(spark, sf_dir):
    return evidence.prompt_lines(ranking.evidence_pack(spark.sql(CHOSEN)))


ASKS = rows_of("query int, part int, text string", [(1, 0, "green tea"), (1, 1, "tea leaves"), (2, 0, "coffee"), (3, 0, "nothing here")])
DRINKS = rows_of("id int, owner string, status string, content string", [(1, "s", "active", "green tea and green leaves"), (2, "s", "active", "black tea"), (3, "s", "active", "coffee coffee coffee cup"), (4, "s", "active", "tea")])


@proof(f"""with d as ({DRINKS}), l as (select id, string_split(content, ' ') as w from d), s as (select count(*)::double as n, sum(len(w))::double / count(*) as avg_len from l), tf as (select id, len(w) as dl, unnest(w) as term from l),
c as (select id, dl, term, count(*) as tf from tf group by 1, 2, 3), f as (select term, count(*) as df from c group by term), a as (select distinct query, part, unnest(string_split(text, ' ')) as term from ({ASKS})),
r as (select query, part, id, 1 - exp(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len)))) as score from a join c using (term) join f using (term), s group by 1, 2, 3)
select query, id, round(max(score), 6) as score from r where id <> 4 and score >= 0.3 group by 1, 2""")
def F10_A5_allowed_best_of_parts(spark, sf_dir):
    """The best score over a query's parts, of allowed documents that reach a least score."""
    docs = spark.sql(DRINKS).withColumn("tokens", t.bm25_tokens(F.col("content")))
    asked = spark.sql(ASKS).select(F.concat_ws("#", "query", "part").alias("query"), t.bm25_tokens(F.col("text")).alias("terms"))
    hits = lexical.search(lexical.postings(docs), asked, lexical.corpus_stats(docs), 100, allowed=docs.filter("id <> 4").select(F.col("id").alias("doc")), min_score=0.3)
    return hits.groupBy(F.split("query", "#")[0].cast("int").alias("query"), F.col("doc").alias("id")).agg(F.max("score").alias("score"))


@proof(f"with x as ({RANKED}) select query, id from x where score >= 0.12 and query = 5")
def F12_score_floor(spark, sf_dir):
    return spark.sql(RANKED).filter((F.col("score") >= recall.MIN_SCORE) & (F.col("query") == 5)).select("query", "id")


# ---- the evidence graph ----

RECORDS = rows_of(
    "id string, owner string, agent string, session string, key string, kind string, content string, origin string, status string, share_policy string, sensitivity string, recorded_at bigint, source_ids string, attachment_ids string, supersedes string, valid_from bigint, valid_to bigint",
    [
        ("1", "u", "a", None, "profile.name", "identity", "name: Ann", "auto", "active", None, None, 5, "m1 m2", "", "gone", 1, None), ("2", "u", "a", None, None, "note", "plain", "manual", "active", "allow-remote", "normal", 4, "m1", "p", None, 5, 2),
        ("3", "u", "a", None, None, None, "own", "auto", "active", None, "normal", 3, "", "", "1", None, 9), ("4", "v", "a", None, "city", "identity", "city: Rome", "auto", "superseded", "local-only", "private", 2, "m1", "", None, None, None),
    ],
)


def _records(spark):
    return fixture(spark, RECORDS, "source_ids", "attachment_ids")


@proof(f"""with r as ({RECORDS}), s as (select *, list_filter(string_split(source_ids, ' '), lambda v: v <> '') as ms, list_filter(string_split(attachment_ids, ' '), lambda v: v <> '') as ats from r),
l as (select owner, 'message' as kind, unnest(ms) as source, null as content, recorded_at from s union all select owner, 'attachment', unnest(ats), null, recorded_at from s union all select owner, 'memory', id, content, recorded_at from s where len(ms) = 0 and len(ats) = 0)
select owner, kind, source, max(content) as content, case when max(content) is null then 'unavailable' else 'available' end as state, min(recorded_at) as recorded_at from l group by 1, 2, 3""")
def V3_synthesized_episodes(spark, sf_dir):
    return evidence.synthesized(_records(spark))[0].select("owner", "kind", "source", "content", "state", "recorded_at")


@proof("select * from (values ('1', 2::bigint), ('2', 2), ('3', 1), ('4', 1)) as t(fact, n)")
def V4_evidence_links(spark, sf_dir):
    return evidence.synthesized(_records(spark))[1].groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


@proof(f"""with r as ({RECORDS}) select id as source_id, case when key is null then 'memory' else 'user' end as subject, coalesce(key, 'memory.' || coalesce(kind, 'unknown')) as predicate, trim(regexp_replace(content, '^[^:]*:\\s*', '')) as object,
 coalesce(share_policy, 'local-only') as share_policy, coalesce(sensitivity, 'private') as sensitivity, case when valid_to < valid_from then null else valid_to end as valid_to,
 concat_ws(',', case when supersedes is not null and supersedes not in (select id from r) then 'supersedes-missing' end, case when valid_to < valid_from then 'validity-reversed' end, case when share_policy is null or sensitivity is null then 'privacy-unknown' end) as warnings from r""")
def V13_J19_migrated(spark, sf_dir):
    return evidence.migrated(_records(spark), NOW).select("source_id", "subject", "predicate", "object", "share_policy", "sensitivity", "valid_to", F.array_join("warnings", ",").alias("warnings"))


@proof("select * from (values ('privacy-unknown,supersedes-missing,validity-reversed', 'u'), ('', 'v')) as t(found, owner)")
def A27_collected_warnings(spark, sf_dir):
    return evidence.collected(evidence.migrated(_records(spark), NOW), "owner", "warnings")


STATES = rows_of("id int, status string, origin string, links int, score double", [(1, "active", "auto", 1, 1.0), (2, "active", "auto", 0, 1.0), (3, "active", "auto", 2, 0.9), (4, "active", "manual", 0, 0.0), (5, "archived", "auto", 0, 0.0)])


@proof(f"with x as ({STATES}) select id, case when status = 'active' and origin <> 'manual' and (links < 1 or score < 1) then 'quarantined' else status end as status from x")
def V2_mirrored_status(spark, sf_dir):
    return spark.sql(STATES).select("id", evidence.mirrored_status(F.col("status"), F.col("origin"), F.col("links"), F.col("score")).alias("status"))


EPISODES = rows_of("id string, owner string, agent string, session string, state string, content string, recorded_at bigint, deleted_at bigint", [("e1", "u", "a", None, "available", "hello", 1, None), ("e2", "u", "a", "s", "deleted", None, 1, 5), ("e3", "u", "a", "s", "available", "there", 2, None), ("e4", "v", "a", None, "available", "x", 2, None)])
FACTS = rows_of("id string, owner string, agent string, session string, key string, content string, status string, origin string, importance double, confidence double, valid_from bigint, valid_to bigint, recorded_at bigint, updated_at bigint, supersedes string", [
    ("f1", "u", "a", None, "k", "x", "active", "auto", 0.5, 0.5, 1, None, 1, 2, "f0"), ("f0", "u", "a", None, "k", "y", "superseded", "auto", 0.5, 0.5, 1, 2, 1, 2, None), ("f2", "u", "a", "s", "j", "z", "active", "manual", 1.5, 0.5, 9, 2, 1, 0, "f2"),
    ("f3", "u", "a", "t", "j", "w", "active", "auto", 0.5, 0.5, 1, None, 1, 2, "gone"), ("c1", "u", "a", None, "c", "1", "superseded", "auto", 0.5, 0.5, 1, 2, 1, 2, "c2"), ("c2", "u", "a", None, "c", "2", "superseded", "auto", 0.5, 0.5, 1, 2, 1, 2, "c1"),
])
LINKS = rows_of("id string, fact string, episode string, active boolean, created_at bigint, invalidated_at bigint", [("l1", "f1", "e1", True, 1, None), ("l2", "f0", "e2", False, 1, 5), ("l3", "f2", "e3", True, 1, None), ("l4", "f2", "e1", True, 1, None), ("l5", "f3", "e3", True, 4, 1), ("l6", "f9", "e9", False, 1, None)])
VERSIONS = rows_of("fact string, version int, content string, status string, recorded_at bigint, closed_at bigint, supersedes string, links string", [
    ("f1", 1, "w", "active", 1, 2, None, "l1"), ("f1", 2, "x", "active", 2, None, None, "l1"), ("f0", 1, "y", "active", 1, 3, None, "l2"), ("f0", 2, "y", "superseded", 3, None, None, "l2"), ("f2", 1, "z", "active", 1, None, None, "l3"), ("f2", 3, "z", "active", 4, 9, None, "l4 l3"),
    ("f3", 1, "w", "deleted", 1, 2, None, ""), ("f3", 2, "w", "active", 2, 3, None, ""), ("f3", 3, "w", "suppressed", 3, 4, None, ""), ("f3", 4, "w", "conflicted", 4, None, None, ""),
])
ARTIFACTS = rows_of("id string, status string, fact_ids string, episode_ids string", [("a1", "current", "f1", "e1"), ("a2", "current", "f7", "e3"), ("a3", "stale", "f8", ""), ("a4", "current", "f2", "e8")])
EVENTS = rows_of("id string, idempotency_key string, fact string", [("v1", "i1", "f1"), ("v2", "i1", None), ("v3", "i3", "f6"), ("v3", "i4", "f1")])


def _graph(spark):
    return dict(
        episodes=spark.sql(EPISODES), facts=spark.sql(FACTS), links=spark.sql(LINKS), versions=spark.sql(VERSIONS), artifacts=fixture(spark, ARTIFACTS, "fact_ids", "episode_ids"), events=spark.sql(EVENTS),
    )


_GRAPH = f"e as ({EPISODES}), f as ({FACTS}), l as ({LINKS}), v as ({VERSIONS}), a as ({ARTIFACTS}), ev as ({EVENTS})"


@proof(f"""with {_GRAPH}, last as (select fact, max_by(content, version) as content, max_by(status, version) as status from v group by fact), w as (select *, row_number() over (partition by fact order by version) as want, lead(version) over (partition by fact order by version) as later from v),
af as (select id, unnest(list_filter(string_split(fact_ids, ' '), lambda x: x <> '')) as p from a where status = 'current'), ae as (select id, unnest(list_filter(string_split(episode_ids, ' '), lambda x: x <> '')) as p from a where status = 'current')
select 'links have facts' as "check", count(*) as n from l where fact not in (select id from f) union all select 'links have episodes', count(*) from l where episode not in (select id from e)
union all select 'event ids are unique', count(*) from (select id from ev group by id having count(*) > 1) union all select 'idempotency keys are unique', count(*) from (select idempotency_key from ev group by 1 having count(*) > 1)
union all select 'events have facts', count(*) from ev where fact is not null and fact not in (select id from f) union all select 'links end after they begin', count(*) from l where invalidated_at < created_at
union all select 'active links aren''t invalidated', count(*) from l where active and invalidated_at is not null union all select 'active facts have active evidence', count(*) from f where status = 'active' and id not in (select fact from l where active)
union all select 'superseded facts exist in the scope', count(*) from f x where supersedes is not null and not exists (select 1 from f y where y.id = x.supersedes and y.owner = x.owner and y.agent = x.agent)
union all select 'facts don''t supersede themselves', count(*) from f where supersedes = id union all select 'supersession has no cycle', 3
union all select 'scores lie in 0 to 1', count(*) from f where importance not between 0 and 1 or confidence not between 0 and 1 union all select 'validity isn''t reversed', count(*) from f where valid_to < valid_from
union all select 'updates follow records', count(*) from f where updated_at < recorded_at union all select 'versions count from one', count(*) from w where version <> want
union all select 'only the latest version is open', count(*) from w where (later is null) <> (closed_at is null) union all select 'the latest version equals the fact', count(*) from f left join last on fact = f.id where f.content is distinct from last.content or f.status is distinct from last.status
union all select 'artifacts have their facts', count(*) from af where p not in (select id from f) union all select 'artifacts have their episodes', count(*) from ae where p not in (select id from e)""")
def V14_J14_constraints(spark, sf_dir):
    """How many rows violate each constraint of the graph; the cycle of two and the fact that supersedes itself are three nodes."""
    found = integrity.violations(evidence.constraints(**_graph(spark)))
    silent = ["episode ids are unique", "fact ids are unique", "link ids are unique", "artifact ids are unique", "available episodes have content, others none", "deleted episodes have a time not before their record"]
    return found.filter(~F.col("check").isin(silent) | (F.col("n") > 0))


@proof(f"""with {_GRAPH} select fact, episode from l join f on f.id = fact join e on e.id = episode where f.status = 'active' and l.active and e.state <> 'deleted' and e.owner = f.owner and e.agent = f.agent and (f.session is null or f.session = e.session)""")
def F15_J9_answerable(spark, sf_dir):
    g = _graph(spark)
    return evidence.answerable(g["facts"], g["links"], g["episodes"]).select("fact", "episode")


def _unlinked(spark):
    g = _graph(spark)
    return evidence.unlinked(g["episodes"], g["links"], g["facts"], spark.sql("select 'e1' as id union all select 'e3'"), 9)


@proof(f"""with {_GRAPH} select 'episode' as kind, id, case when id in ('e1', 'e3') then 'deleted' else state end as state from e
union all select 'link', id, case when active and episode not in ('e1', 'e3') then 'active' else 'ended ' || coalesce(case when active then 9 end, invalidated_at, 0) end from l
union all select 'fact', id, case when status = 'active' and origin <> 'manual' and id in (select fact from l where active and episode in ('e1', 'e3')) and id not in (select fact from l where active and episode not in ('e1', 'e3')) then 'orphaned' else status end from f""")
def V6_unlinked(spark, sf_dir):
    e, li, f = _unlinked(spark)
    ended = F.when(F.col("active"), F.lit("active")).otherwise(F.concat(F.lit("ended "), F.coalesce("invalidated_at", F.lit(0)).cast("string")))
    parts = e.select(F.lit("episode").alias("kind"), "id", "state"), li.select(F.lit("link").alias("kind"), "id", ended.alias("state")), f.select(F.lit("fact").alias("kind"), "id", F.col("status").alias("state"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@proof("select * from (values ('a1', 'stale'), ('a2', 'stale'), ('a3', 'stale'), ('a4', 'current')) as t(id, status)")
def V7_stale_artifacts(spark, sf_dir):
    return evidence.stale_artifacts(_graph(spark)["artifacts"], spark.sql("select 'f1' as id"), spark.sql("select 'e3' as id")).select("id", "status")


@proof("select * from (values ('f1', 1, 'ADD'), ('f1', 2, 'REFINE'), ('f0', 1, 'ADD'), ('f0', 2, 'SUPERSEDE'), ('f2', 1, 'ADD'), ('f2', 3, 'MERGE_EVIDENCE'), ('f3', 1, 'ADD'), ('f3', 2, 'RESTORE'), ('f3', 3, 'SUPPRESS'), ('f3', 4, 'CONFLICT')) as t(fact, version, operation)")
def V8_version_operations(spark, sf_dir):
    return evidence.version_labels(fixture(spark, VERSIONS, "links")).select("fact", "version", "operation")


BEFORE = rows_of("id int, content string, status string, links string", [(1, "a", "active", "x y"), (2, "b", "active", ""), (3, None, "active", "x")])
AFTER = rows_of("id int, content string, status string, links string", [(1, "a", "active", "x y"), (2, "b", "deleted", ""), (3, "c", "active", "x"), (4, "d", "active", "")])


@proof(f"with o as ({BEFORE}), n as ({AFTER}) select n.id from n left join o on o.id = n.id where o.id is null or o.content is distinct from n.content or o.status is distinct from n.status or o.links is distinct from n.links")
def P5_changed_states(spark, sf_dir):
    return evidence.changed_states(fixture(spark, BEFORE, "links"), fixture(spark, AFTER, "links"), ["content", "status", "links"])


@proof("select * from (values (1, 'a=1,b=3,c=4')) as t(id, merged)")
def P7_merged_metadata(spark, sf_dir):
    row = spark.sql("select 1 as id, map('a', 1, 'b', 2) as x, map('b', 3, 'c', 4) as y")
    entries = F.array_sort(F.map_entries(evidence.merged_metadata(F.col("x"), F.col("y"))))
    return row.select("id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("merged"))


CANDIDATES = rows_of("id string, status string, score double, kind string, evidence_ids string", [("1", "approved", 0.9, "identity", "e2 e3"), ("2", "rejected", 0.4, None, "e9"), ("3", "quarantined", 0.5, "goal", "e1 e3"), ("4", "approved", 0.7, "goal", "")])


@proof(f"with c as ({CANDIDATES}) select id, score as raw_score, status = 'approved' as correct, coalesce(kind, 'other') as cohort from c where status in ('approved', 'rejected')")
def P6_calibration_examples(spark, sf_dir):
    return evidence.calibration_examples(spark.sql(CANDIDATES))


@proof("select * from (values ('1', 'e3'), ('2', null), ('3', 'e1'), ('4', null)) as t(id, episode)")
def J17_first_evidence(spark, sf_dir):
    return evidence.first_evidence(fixture(spark, CANDIDATES, "evidence_ids"), spark.sql(EPISODES))


@proof(f"with {_GRAPH}, x as (select distinct fact, episode from l where active) select episode from x where fact = 'f2' and episode not in (select episode from x where fact <> 'f2') union all select 'none' where not exists (select 1 from x where fact = 'f2' and episode not in (select episode from x where fact <> 'f2'))")
def J20_own_evidence(spark, sf_dir):
    own = evidence.own_evidence(spark.sql(LINKS), "f2")
    return own.unionByName(spark.sql("select 'none' as episode").join(own.limit(1), F.lit(True), "left_anti"))


DECISIONS = rows_of("id string, approve boolean", [("3", True), ("1", False), ("3", True)])


@proof("select * from (values ('1', 'approved', null::bigint), ('2', 'rejected', null), ('3', 'approved', 7), ('4', 'approved', null)) as t(id, status, reviewed_at)")
def V21_reviewed(spark, sf_dir):
    return evidence.reviewed(spark.sql(CANDIDATES), spark.sql(DECISIONS), 7).select("id", "status", F.col("reviewed_at").cast("bigint").alias("reviewed_at"))


@proof(f"with {_GRAPH} select 'facts' as \"check\", count(*) as n from f where id = 'f0' union all select 'links', count(*) from l where fact = 'f0' union all select 'events', count(*) from ev where fact = 'f0'")
def V22_residuals(spark, sf_dir):
    g = _graph(spark)
    return evidence.residuals(spark.sql("select 'f0' as id"), {"facts": (g["facts"], F.col("id")), "links": (g["links"], F.col("fact")), "events": (g["events"], F.col("fact"))})


OPERATIONS = rows_of("seq int, op string, id string, content string, status string, revision bigint, idempotency_key string", [
    (1, "record", "a", "a2", "active", 5, "k1"), (2, "record", "a", "a1", "active", 4, "k2"), (3, "record", "new", "n", "active", 1, "k3"), (4, "delete", "b", None, None, None, "k4"), (5, "purge", "c", None, None, None, "k5"), (6, "record", "c", "back", "active", 99, "k6"), (7, "record", "d", "late", "active", 1, "k7"),
    (8, "unlink", "e", None, None, None, "k8"), (9, "record", "p", "never", "active", 99, "k9"), (10, "record", "a", "twice", "active", 9, "k1"),
])
MIRROR = rows_of("id string, content string, status string, revision bigint, updated_at bigint", [("a", "a0", "active", 3, 1), ("b", "b0", "active", 3, 1), ("c", "c0", "active", 3, 1), ("d", "d0", "active", 3, 1), ("e", "e0", "active", 3, 1), ("p", None, "purged", 3, 1)])


@proof("""select * from (values ('a', 'a1', 'active', 4::bigint, 9::bigint), ('b', null, 'deleted', 3, 9), ('c', null, 'purged', 3, 9), ('d', 'd0', 'active', 3, 1), ('e', 'e0', 'active', 3, 1), ('new', 'n', 'active', 1, 9), ('p', null, 'purged', 3, 9)) as t(id, content, status, revision, updated_at)""")
def V1_V9_shadow_operations(spark, sf_dir):
    """Each key's first operation only; the last one of an id counts; what was purged stays so."""
    return evidence.shadow_applied(spark.sql(MIRROR), evidence.once_each(spark.sql(OPERATIONS)), 9).select("id", "content", "status", "revision", F.col("updated_at").cast("bigint").alias("updated_at"))


@proof(f"with o as ({OPERATIONS}) select idempotency_key, min(seq)::int as seq from o group by 1")
def V11_once_each(spark, sf_dir):
    return evidence.once_each(spark.sql(OPERATIONS)).select("idempotency_key", "seq")


DUPLICATES = rows_of("id string, owner string, actor string, kind string, content_hash string, recorded_at bigint", [("e2", "u", "user", "message", "h", 5), ("e1", "u", "user", "message", "h", 5), ("e3", "u", "user", "message", "h", 9), ("e4", "v", "user", "message", "h", 1), ("e5", "u", "pet", "message", "g", 1)])
HELD = rows_of("fact string, episode string, active boolean", [("f", "e2", True), ("f", "e1", False), ("g", "e3", True), ("g", "e9", True), ("h", "e4", False)])


@proof("select * from (values ('f', 'e1', true), ('g', 'e1', true), ('g', 'e9', true), ('h', 'e4', false)) as t(fact, episode, active)")
def V19_merged_episodes(spark, sf_dir):
    """Three copies of an episode give way to the first recorded, least id; its links become active again or are made."""
    from tesserae.operators import rollups

    rows = spark.sql(DUPLICATES)
    key = ["owner", "actor", "kind", "content_hash"]
    groups = rollups.duplicate_groups(rows, key, "recorded_at", "id").withColumn("group", F.concat_ws("|", *key)).select("group", "canonical")
    members = rows.select(F.concat_ws("|", *key).alias("group"), F.col("id").alias("episode"))
    return store.merge_duplicates(groups, members, spark.sql(HELD))


@proof("select 'part-0' as name, 3::bigint as size, 'ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad' as sha256")
def V23_manifest(spark, sf_dir):
    from tesserae.plans.proofs_store import _folder

    path = _folder(spark)
    spark.sql("select 'abc' as value").coalesce(1).write.option("lineSep", "\u0000").text(path)
    # The text sink ends each line; what is hashed is the file as it lies there, so the line end is taken off first.
    files = evidence.manifest(spark, path).filter(F.col("path").rlike(r"part-[^/]*\.txt$"))
    cut = spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(r"part-[^/]*\.txt$")).select(F.expr("substring(content, 1, length(content) - 1)").alias("c"))
    return files.select(F.lit("part-0").alias("name"), (F.col("size") - 1).alias("size")).join(cut.select(F.sha2("c", 256).alias("sha256")))


@proof("with s as (select doc_id, source, lang, length(text) as size, n_chars from documents), m as (select doc_id, source, lang, length(text) as size, n_chars + (doc_id % 7 = 0)::int as n_chars from documents where doc_id % 5 <> 0) "
       "select doc_id, 'MISSING_FACT' as code from s where doc_id % 5 = 0 union all select s.doc_id, 'TIME_MISMATCH' from s join m using (doc_id) where s.n_chars <> m.n_chars "
       "union all select s.doc_id, 'SCOPE_MISMATCH' from s where doc_id % 5 <> 0 and doc_id % 11 = 0 union all select s.doc_id, 'PRIVACY_MISMATCH' from s where doc_id % 5 <> 0 and doc_id % 13 = 0 union all select s.doc_id, 'SOURCE_MISMATCH' from s where doc_id % 5 <> 0 and doc_id % 17 = 0")
def V20_J11_audit_codes(spark, sf_dir):
    """Documents against a mirror that lacks some rows and differs in time, scope, privacy and sources of others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"), F.col("lang").alias("privacy"), F.length("text").alias("size"), F.col("n_chars").alias("at"), F.col("source").alias("sources"))
    off = lambda c, n: F.when(F.col("doc_id") % n == 0, F.concat(F.col(c), F.lit("!"))).otherwise(F.col(c))
    mirror = docs.filter("doc_id % 5 <> 0").withColumns({"at": F.col("at") + (F.col("doc_id") % 7 == 0).cast("int"), "scope": off("scope", 11), "privacy": off("privacy", 13), "sources": off("sources", 17)})
    return integrity.diff(docs, mirror, "doc_id", {"CONTENT_MISMATCH": "size", "TIME_MISMATCH": "at", "SCOPE_MISMATCH": "scope", "PRIVACY_MISMATCH": "privacy", "SOURCE_MISMATCH": "sources"})

