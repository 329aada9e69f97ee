"""Queries by operator id: sources and sinks, state, writes, offline jobs, statistics and streams. See ``proofs``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.operators import embeddings, evidence, ingest, integrity, rollups, state, stats, store
from tesserae.plans.proofs import DAY, NOW, fixture, proof, rows_of
from tesserae.session import checkpoint_folder, table
from tesserae.sources import journal
from tesserae.streaming import jobs


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/proof-{uuid.uuid4().hex}"


# ---- sources and sinks ----

LOG = rows_of("seq bigint, op string, id string, v bigint", [(1, "U", "k", 1), (2, "D", "k", None), (3, "U", "k", 2), (4, "U", "m", 3), (4, "D", "m", None), (5, "U", "n", 9), (6, "U", "n", 10)])
SNAPSHOT = rows_of("id string, v bigint", [("k", 0), ("old", 5), ("n", 1)])
_REPLAY = f"""with log as ({LOG}), s as ({SNAPSHOT}), a as (select -1 as seq, 'U' as op, id, v from s union all select seq, op, id, v from log)
select id, v from (select *, row_number() over (partition by id order by seq desc, (op = 'D') desc) as n from a) where n = 1 and op <> 'D'"""


@proof("select * from (values ('a', 1), ('b', 2)) as t(id, v)")
def S1_snapshot_scan(spark, sf_dir):
    path = _folder(spark)
    spark.sql("""select '{"version": 1, "items": [{"id": "a", "v": 1}, {"id": "b", "v": 2}]}' as value""").write.text(path)
    items = journal.read_snapshot(spark, path, "version int, items array<struct<id: string, v: int>>")
    return items.select(F.inline("items"))


@proof(_REPLAY)
def S3_S6_replay(spark, sf_dir):
    return journal.replay(spark.sql(SNAPSHOT), spark.sql(LOG), "id")


@proof(_REPLAY)
def S7_compaction(spark, sf_dir):
    """A journal folded into a snapshot, which replays to the same with nothing after it."""
    path = _folder(spark)
    journal.replay(spark.sql(SNAPSHOT), spark.sql(LOG), "id").write.parquet(path)
    return journal.replay(spark.read.parquet(path), spark.sql(LOG).limit(0), "id")


@proof(LOG)
def S4_S12_sealed_rows(spark, sf_dir):
    """Rows sealed, written, read and opened again."""
    key, path = bytes(range(32)), _folder(spark)
    journal.sealed(spark.sql(LOG), key, ["op", "id", "v"]).write.parquet(path)
    return journal.opened(spark.read.parquet(path), key, "op string, id string, v bigint")


LINES = rows_of("seq bigint, line string", [(1, '{"seq":1,"op":"U","id":"a","v":1}'), (2, '{"seq":2,"op":"D","id":"a","v":null}'), (3, '{"seq":3,"op":"U","id":"b","v":7}'), (4, '{"seq":4,"op":"U","i')])


@proof(f"with x as ({LINES}) select seq, json_extract_string(line, '$.op') as op, json_extract_string(line, '$.id') as id, json_extract_string(line, '$.v')::bigint as v from x where json_valid(line)")
def S5_S8_torn_line(spark, sf_dir):
    return journal.recovered(spark.sql(LINES))


@proof("select * from (values ('k', 0), ('n', 1)) as t(id, v)")
def S9_scrubbed_backup(spark, sf_dir):
    live, copy = _folder(spark), _folder(spark)
    spark.sql(SNAPSHOT).write.parquet(live)
    journal.backup(spark, live, copy, purged=spark.sql("select 'old' as id"))
    return spark.read.parquet(copy)


@proof("select * from (values (1, 'a', true), (2, 'b', false), (3, 'c', false), (4, 'd', true)) as t(seq, payload, broken)")
def S13_chain(spark, sf_dir):
    """A chain in which entry 2 was changed afterwards and entry 3 points elsewhere."""
    path = _folder(spark)
    for low, high in ((1, 2), (3, 4)):
        journal.append(spark, path, spark.sql("select * from values (1L, 'a'), (2L, 'b'), (3L, 'c'), (4L, 'd') as t(seq, payload)").filter(F.col("seq").between(low, high)))
    rows = journal.verified(spark, path)
    changed = rows.withColumns({"hash": F.when(F.col("seq") == 1, "x").otherwise(F.col("hash")), "previous_hash": F.when(F.col("seq") == 2, F.lit("x")).when(F.col("seq") == 4, F.lit("y")).otherwise(F.col("previous_hash"))})
    bad = integrity.broken_links(changed, "journal", "seq", F.col("payload")).select("seq", F.lit(True).alias("broken"))
    return changed.select(F.col("seq").cast("int").alias("seq"), "payload").join(bad, "seq", "left").select("seq", "payload", F.coalesce("broken", F.lit(False)).alias("broken"))


@proof("select * from (values ('a', 2::bigint)) as t(id, v)")
def S14_transactional_versions(spark, sf_dir):
    """Of three versions the last breaks a constraint and so is never read."""
    path = _folder(spark)
    for v in (1, 2, -3):
        rows = spark.sql(f"select 'a' as id, cast({v} as bigint) as v")
        journal.publish(spark, path, rows, integrity.violations({"negative": rows.filter("v < 0")}))
    return journal.published(spark, path)


MEMOS = rows_of("id string, content string", [("a", "green tea"), ("b", "black tea"), ("c", "coffee"), ("d", "")])
INDEXED = rows_of("id string, content string", [("a", "green tea"), ("b", "white tea"), ("gone", "x")])


def _index(spark):
    return embeddings.put(None, spark.sql(INDEXED))


@proof(f"with m as ({MEMOS}), i as ({INDEXED}) select m.id, i.id is not null as ready from m left join i on i.id = m.id and i.content = m.content")
def S10_J4_side_index(spark, sf_dir):
    return embeddings.with_vectors(spark.sql(MEMOS), _index(spark)).select("id", F.col("vector").isNotNull().alias("ready"))


@proof(f"with m as ({MEMOS}), i as ({INDEXED}) select count(*) as total, count(i.id) as ready, count(*) - count(i.id) as pending from m left join i on i.id = m.id and i.content = m.content")
def A2_embedding_coverage(spark, sf_dir):
    return embeddings.coverage(spark.sql(MEMOS), _index(spark))


@proof(f"with m as ({MEMOS}) select id, sha256(content) as content_hash from m union all select 'gone', sha256('x')")
def U9_R20_prepared_vectors(spark, sf_dir):
    """After preparation each memory has one vector, of its present content."""
    return embeddings.prepared(spark.sql(MEMOS), _index(spark)).select("id", "content_hash")


@proof("select * from (values ('a'), ('b')) as t(id)")
def J13_orphan_vectors(spark, sf_dir):
    return embeddings.reconciled(_index(spark), spark.sql(MEMOS)).select("id")


# ---- state ----

CHAIN = rows_of("id string, owner string, key string, cardinality string, status string, start bigint, created_at bigint, updated_at bigint, valid_to bigint", [
    ("1", "u", "city", "single", "superseded", 10, 1, 90, None), ("2", "u", "city", "single", "superseded", 10, 2, 91, None), ("3", "u", "city", "single", "active", 30, 3, 92, None), ("4", "u", "likes", "multiple", "superseded", 5, 4, 93, None),
    ("5", "u", None, "single", "superseded", 5, 5, 94, None), ("6", "v", "city", "single", "superseded", 7, 6, 95, None), ("7", "u", "city", "single", "superseded", 1, 7, 96, 4), ("8", "v", "name", "single", "superseded", 200, 8, 97, None),
])


@proof(f"""with x as ({CHAIN}), c as (select id, lead(start) over (partition by owner, key order by start, created_at, id) as following from x where key is not null and cardinality = 'single')
select x.id, coalesce(valid_to, case when key is not null and cardinality = 'single' and status = 'superseded' then greatest(coalesce(following, updated_at), start + 1) end) as valid_to from x left join c using (id)""")
def W3_close_superseded(spark, sf_dir):
    return state.close_superseded(spark.sql(CHAIN), ["owner"]).select("id", "valid_to")


OLD = rows_of("key string, id string, value string, start bigint, stop bigint, status string", [("k", "1", "a", 10, None, "active"), ("m", "2", "x", 10, None, "active"), ("o", "6", "z", 10, None, "active"), ("p", "7", "q", 10, 20, "superseded")])
NEW = rows_of("key string, id string, value string, start bigint, confidence double, action string", [("k", "3", "b", 5, 0.9, None), ("m", "4", "y", 20, 0.5, None), ("n", "5", "z", 1, 0.1, None), ("o", "8", "z", 30, 0.9, None), ("p", "9", "r", 40, 0.1, "SUPERSEDE")])


@proof(f"""with o as ({OLD}), n as ({NEW}), j as (select o.*, n.start as ns, n.value <> o.value and o.status = 'active' as differs, n.action = 'SUPERSEDE' or (n.action is null and n.confidence >= 0.8) as sure from o left join n using (key)),
a as (select * from o where status = 'active'), f as (select n.*, a.id as old, n.action = 'SUPERSEDE' or (n.action is null and n.confidence >= 0.8) as sure from n left join a using (key) where a.id is null or a.value <> n.value)
select key, id, value, case when differs and sure then greatest(ns, start + 1) else stop end as stop, case when differs and sure then 'superseded' else status end as status, null as supersedes from j
union all select key, id, value, null, case when old is null or sure then 'active' else 'conflicted' end, case when sure then old end from f""")
def U2_supersede(spark, sf_dir):
    return state.supersede(spark.sql(OLD), spark.sql(NEW)).select("key", "id", "value", "stop", "status", "supersedes")


FACTS = rows_of("id string, owner string, agent string, session string, key string, cardinality string, content string, status string, origin string, importance double, expires_at bigint, valid_from bigint, valid_to bigint, updated_at bigint, source_ids string", [
    ("f1", "u", "a", None, "city", "single", "lives in Rome", "active", "auto", 0.5, 7, 1, None, 30, "m1 m2"), ("f2", "u", "a", None, "city", "single", "lives in Oslo", "superseded", "auto", 0.6, None, 1, 5, 20, "m1"),
    ("f3", "u", "a", None, "likes", "multiple", "tea", "active", "manual", 0.7, None, None, None, 40, "m1"), ("f4", "u", "a", "s", "city", "single", "lives in Bonn", "active", "auto", 0.9, 3, 2, None, 10, "m3"),
    ("f5", "v", "a", None, "city", "single", "lives in Rome", "active", "auto", 0.4, None, None, None, 50, "m1"), ("f6", "u", "a", None, None, "multiple", "note", "quarantined", "auto", 0.1, None, None, None, 60, ""),
])
PATCHES = rows_of("id string, seq int, content string, importance double, expires_at bigint, clear_expiry boolean, status string", [("f1", 1, "old", 0.1, None, None, None), ("f1", 2, None, 0.95, None, True, None), ("f3", 1, "green tea", None, 99, None, "suppressed")])


@proof(f"""with f as ({FACTS}), p as ({PATCHES}), l as (select * from p qualify row_number() over (partition by id order by seq desc) = 1)
select f.id, coalesce(l.content, f.content) as content, coalesce(l.importance, f.importance) as importance, coalesce(l.status, f.status) as status, case when coalesce(l.clear_expiry, false) then null else coalesce(l.expires_at, f.expires_at) end as expires_at
from f left join l using (id)""")
def U5_edited(spark, sf_dir):
    return evidence.edited(spark.sql(FACTS), spark.sql(PATCHES)).select("id", "content", "importance", "status", "expires_at")


@proof(f"""with f as ({FACTS}) select id, case when id = 'f2' then 'active' when owner = 'u' and agent = 'a' and key = 'city' and status = 'active' then 'superseded' else status end as status,
 case when id = 'f2' then null when owner = 'u' and agent = 'a' and key = 'city' and status = 'active' then greatest(50, coalesce(valid_from, 0) + 1) else valid_to end as valid_to from f""")
def U6_restored(spark, sf_dir):
    return evidence.restored(spark.sql(FACTS), spark.sql("select 'f2' as id"), 50).select("id", "status", "valid_to")


@proof(f"""with f as ({FACTS}), s as (select *, list_filter(string_split(source_ids, ' '), lambda v: v <> '') as had from f), l as (select *, list_filter(had, lambda v: v <> 'm1') as has from s)
select id, array_to_string(has, ' ') as source_ids, case when len(had) > 0 and len(has) = 0 and status = 'active' and origin <> 'manual' then 'orphaned' else status end as status from l""")
def U7_unlinked_sources(spark, sf_dir):
    return state.unlink_sources(fixture(spark, FACTS, "source_ids"), F.array(F.lit("m1"))).select("id", F.array_join("source_ids", " ").alias("source_ids"), "status")


@proof(f"with f as ({FACTS}) select id from f where id <> 'f3' and owner <> 'v'")
def U8_removed(spark, sf_dir):
    return state.removed(spark.sql(FACTS), spark.sql("select 'f3' as id"), F.col("owner") == "v").select("id")


@proof(f"with f as ({FACTS}) select id, updated_at from f where owner = 'u' order by updated_at desc, id limit 3")
def K1_list(spark, sf_dir):
    return state.newest(spark.sql(FACTS).filter("owner = 'u'"), "updated_at", 3).select("id", "updated_at")


@proof(f"with f as ({FACTS}) select id from f where status = 'quarantined' order by updated_at desc limit 1000")
def K7_review_queue(spark, sf_dir):
    return state.newest(spark.sql(FACTS).filter("status = 'quarantined'"), "updated_at", 5000).select("id")


INCOMING = rows_of("id string, owner string, agent string, session string, key string, content string", [("n1", "u", "a", None, "city", "lives in Paris"), ("n2", "u", "a", "s", "city", "LIVES in bonn"), ("n3", "v", "a", None, "city", "x"), ("n4", "u", "b", None, "city", "x"), ("n5", "u", "a", None, "likes", "coffee")])


@proof(f"with f as ({FACTS}), n as ({INCOMING}) select n.id as incoming, f.id as stored from n join f on f.owner = n.owner and f.agent = n.agent and f.session is not distinct from n.session and f.key = n.key and f.status = 'active' and lower(f.content) <> lower(n.content)")
def J5_conflicts(spark, sf_dir):
    return state.conflicting(spark.sql(INCOMING), spark.sql(FACTS))


# ---- writes ----

SAID = rows_of("owner string, agent string, seq bigint, id string, key string, kind string, content string, confidence double, cardinality string, start bigint, stop bigint, action string, matched string, sources string", [
    ("u", "a", 1, "1", "city", "identity", "city: Rome", 0.9, "single", 10, None, None, None, "m1"), ("u", "a", 2, "2", "city", "identity", "City:  Rome", 0.95, "single", 20, None, None, None, "m2"), ("u", "a", 3, "3", "city", "identity", "city: Paris", 0.9, "single", 30, None, None, None, "m3"),
    ("u", "a", 4, "4", "city", "identity", "city: Oslo", 0.5, "single", 40, None, None, None, "m4"), ("u", "a", 5, "5", None, "preference", "likes: green tea leaves", 0.9, "multiple", 50, None, None, None, "m5"), ("u", "a", 6, "6", None, "preference", "likes: green tea", 0.9, "multiple", 60, None, None, None, "m6"),
    ("u", "a", 7, "7", None, "preference", "dislike: green tea", 0.9, "multiple", 70, None, None, None, "m7"), ("u", "a", 8, "8", "city", "identity", "city: Bonn", 0.9, "single", 1, 5, None, None, "m8"), ("v", "a", 9, "9", "city", "identity", "city: Rome", 0.9, "single", 70, None, None, None, "m9"),
    ("v", "a", 10, "10", "city", "identity", "city: Rome Trastevere", 0.7, "single", 80, None, "REFINE", "9", "m1"), ("w", "a", 11, "11", "city", "identity", "city: Rome", 0.9, "single", 70, None, None, None, "m9"), ("w", "a", 12, "12", "city", "identity", "city: Oslo", 0.2, "single", 80, None, "SUPERSEDE", None, ""),
])


@proof("""select * from (values ('1', 'superseded', 0.95::double, 30, null, 'm1 m2'), ('3', 'active', 0.9, null, '1', 'm3'), ('4', 'conflicted', 0.5, null, null, 'm4'), ('5', 'active', 0.9, null, null, 'm5 m6'), ('7', 'active', 0.9, null, null, 'm7'),
 ('8', 'superseded', 0.9, 5, null, 'm8'), ('9', 'active', 0.9, null, null, 'm9 m1'), ('11', 'superseded', 0.9, 80, null, 'm9'), ('12', 'active', 0.2, null, '11', '')) as t(id, status, confidence, stop, supersedes, sources)""")
def U1_U3_U4_J6_J7_remember(spark, sf_dir):
    """The state after writing rows in order: merged, ended, put aside, kept as history, refined."""
    got = store.remember(fixture(spark, SAID, "sources").withColumn("at", F.col("seq") * 10))
    return got.select("id", "status", "confidence", F.col("stop").cast("int").alias("stop"), "supersedes", F.array_join("sources", " ").alias("sources"))


TOLD = [
    ("My name is Ann. I live in Oslo", ["User name：Ann", "User location：Oslo"]), ("我叫小明，我喜欢爬山", ["用户姓名/名字：小明", "用户喜好/偏好：爬山"]), ("我以前住在北京，现在住在上海", ["用户所在地：北京", "用户所在地：上海"]), ("我每周三去游泳", ["用户固定安排：每周三游泳"]),
    ("我对花生过敏", ["用户过敏信息：花生"]), ("如果我叫小红", []), ("记住：明天开会带电脑", ["用户明确希望记住：明天开会带电脑"]), ("我每月5号交房租", ["用户缴房租日期：每月5号"]), ("小明说我喜欢苹果", []), ("my password is x", []), ("花生会让我起疹子", ["用户过敏信息：花生"]),
    ("I work as a nurse. Call me Jo. My dog is Rex", ["User occupation：nurse", "Preferred form of address：Jo", "User pet name：Rex"]), ("周末我固定去爬山", ["用户固定安排：周末爬山"]), ("我的名字不是小红，而是小明", ["用户姓名/名字：小明"]), ("", []),
]
TOLD_SQL = rows_of("id int, text string", [(i, m) for i, (m, _) in enumerate(TOLD)])


@proof(rows_of("message int, content string", [(i, f) for i, (_, facts) in enumerate(TOLD) for f in facts]))
def U11_U12_U14_extracted_facts(spark, sf_dir):
    return ingest.extract(spark.sql(TOLD_SQL), "id", "text", NOW).select("message", "content")


@proof(rows_of("message int, content string, intent string, valid_from bigint, valid_to bigint", [(2, "用户所在地：北京", "historical", 1, NOW), (2, "用户所在地：上海", "correction", NOW, None), (13, "用户姓名/名字：小明", "correction", None, None)]))
def U12_corrections(spark, sf_dir):
    return ingest.extract(spark.sql(TOLD_SQL), "id", "text", NOW).filter("intent <> ''").select("message", "content", "intent", "valid_from", "valid_to")


TURNS = rows_of("conv int, turn int, role string, text string", [(1, 0, "assistant", "所以你喜欢爬山吗？"), (1, 1, "user", "是的"), (2, 0, "user", "yes"), (3, 0, "assistant", "Do you like tea?"), (3, 1, "assistant", "you prefer coffee?"), (3, 2, "user", "Correct."), (4, 0, "assistant", "hm"), (4, 1, "user", "对")])


@proof("select * from (values (1, 1, '用户喜好/偏好：爬山'), (3, 2, '用户喜好/偏好：coffee')) as t(conv, turn, content)")
def U13_confirmed(spark, sf_dir):
    return ingest.confirmed_preference(spark.sql(TURNS), "conv", "turn", "role", "text")


NORMAL = rows_of("id int, kind string, content string, key string, cardinality string, source string", [
    (1, "identity", "用户所在地：上海市", "city", "multiple", "当我出差时我住上海市"), (2, "preference", "用户不喜欢：香菜", None, "multiple", "朋友说我不喜欢香菜"), (3, "identity", "用户常用编程语言：TS", "profile.programming_language", "single", None),
    (4, "goal", "plan: run a marathon", " ", "set", "if it works"), (5, None, "note", None, None, "note"), (6, "health", "allergy: nuts", "Allergy", "multiple", "I like nuts but suppose not"),
])


@proof("""select * from (values (1, 'profile.location', '上海', 'unknown', 'asserted', '我出差', 'single'), (2, 'preference', '香菜', 'negative', 'reported', null, 'multiple'), (3, 'profile.programming_language', 'typescript', 'unknown', 'asserted', null, 'single'),
 (4, 'goal', 'run a marathon', 'unknown', 'hypothetical', null, 'set'), (5, 'memory.fact', 'note', 'unknown', 'asserted', null, 'multiple'), (6, 'health.allergy', 'nuts', 'unknown', 'hypothetical', null, 'set'))
 as t(id, predicate, normalized_value, polarity, modality, condition, set_cardinality)""")
def U16_normalized(spark, sf_dir):
    return ingest.normalized(spark.sql(NORMAL)).select("id", "predicate", "normalized_value", "polarity", "modality", "condition", "set_cardinality")


STORED = rows_of("scope string, content string, key string, status string", [("u", "User name：Ann", "profile.name", "active"), ("u", "User location：Oslo", "profile.location", "active"), ("u", "User preference：tea", None, "deleted"), ("v", "User name：Bea", "profile.name", "active")])
PROPOSED = rows_of("message string, scope string, text string", [("0", "u", "My name is Ann"), ("1", "u", "My name is Bob"), ("2", "u", "I live in Oslo East"), ("3", "u", "I like tea"), ("4", "v", "My name is Bea"), ("5", "w", "My name is Ann"), ("6", "u", "我的名字不是小红，而是小明"), ("7", "u", "我对花生过敏"), ("8", "u", "我以前住在北京，现在住在上海")])


@proof("""select * from (values ('0', 0, 'MERGE_EVIDENCE'), ('1', 0, 'CONFLICT'), ('2', 0, 'REFINE'), ('3', 0, 'NOOP'), ('4', 0, 'MERGE_EVIDENCE'), ('5', 0, 'ADD'), ('6', 0, 'SUPERSEDE'), ('7', 0, 'QUARANTINE'), ('8', 0, 'ADD'), ('8', 1, 'SUPERSEDE')) as t(message, pos, action)""")
def U17_U18_U19_write_path(spark, sf_dir):
    """From messages to actions against stored rows."""
    proposed = spark.sql(PROPOSED)
    facts = ingest.extract(proposed, "message", "text", NOW).join(proposed.select("message", "scope"), "message")
    return ingest.verify(facts, spark.sql(STORED)).select("message", "pos", "action")


_SENTENCE = "第一句话比较长一些。"


@proof(f"with n as (select r as i, case when r < 30 then '{_SENTENCE}' else repeat('x', 600) end as s from range(31) t(r)) select segment, length from (values (0, 252), (1, 76), (2, 256), (3, 256), (4, 88)) as t(segment, length)")
def T15_W11_U10_segments(spark, sf_dir):
    """30 sentences of 10 characters packed with blanks between, then 600 letters cut hard, the limit being 256."""
    text = spark.sql(f"select 'a' as id, concat(repeat('{_SENTENCE}', 30), repeat('x', 600)) as text, array('m') as sources")
    return ingest.captured(text, "id", "text", "sources", 1).select("segment", F.length("text").alias("length"))


EXPECTED = rows_of("case_id int, pos int, content string, outcome string, action string", [(1, 0, "用户姓名：小明", "active", "ADD"), (1, 1, "likes: tea.", "active", None), (2, 0, "a", "quarantined", None), (2, 1, "a", "active", "ADD"), (3, 0, "gone", "active", None)])
ACTUAL = rows_of("case_id int, pos int, content string, outcome string, action string", [(1, 0, "Likes: Tea", "active", "ADD"), (1, 1, "用户姓名： 小明", "active", "MERGE"), (2, 0, "a", "active", "ADD"), (2, 1, "A", "active", "ADD"), (2, 2, "a", "active", "ADD"), (4, 0, "new", "rejected", "NOOP")])


@proof("""select 4::bigint as tp, 2::bigint as fp, 1::bigint as fn, 0.666667::double as precision, 0.8::double as recall, 0.727273::double as f1, 0.75::double as outcome_accuracy, 0.5::double as operation_accuracy, 0.4::double as unsupported_rate""")
def A17_J18_write_metrics(spark, sf_dir):
    """By hand: four pairs, one wrong outcome, one of two actions; of five active ones the repeated a and the quarantined a have no support."""
    return stats.write_metrics(stats.matched_one_to_one(spark.sql(EXPECTED), spark.sql(ACTUAL)))


@proof("select coalesce(doc_id, conv_id) as id, case when conv_id is null then 'missing' else 'extra' end as problem from documents full outer join (select distinct conv_id from conversations) on doc_id = conv_id where doc_id is null or conv_id is null")
def J15_complete_labels(spark, sf_dir):
    return stats.incomplete(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct())


@proof("""with j as (select lang, quality, least(1, n_chars / 5000.0::double) as p from documents join labels using (doc_id)), c as (select lang, sum((p >= 0.3 and quality = 1)::int) as tp, sum((p < 0.3 and quality = 0)::int) as tn, sum((p >= 0.3 and quality = 0)::int) as fp,
 sum((p < 0.3 and quality = 1)::int) as fn from j group by lang), r as (select lang, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as specificity from c)
select lang, round((recall + specificity) / 2, 6) as balanced_accuracy from r""")
def A22_balanced_accuracy(spark, sf_dir):
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))
    return stats.balanced_accuracy(stats.confusion(judged, F.col("p") >= 0.3, F.col("quality") == 1, ["lang"])).select("lang", "balanced_accuracy")


# ---- offline jobs ----

LEFT = rows_of("id int, v string, w int", [(1, "x", 1), (2, "y", None), (3, "z", 3), (5, "same", 5)])
RIGHT = rows_of("id int, v string, w int", [(2, "y", 2), (3, "z", 3), (4, "w", 4), (5, "same", None)])


@proof(f"with a as ({LEFT}), b as ({RIGHT}) select coalesce(a.id, b.id) as id, case when a.id is null then 'tombstone' else 'upsert' end as action from a full outer join b on a.id = b.id where a.id is null or b.id is null or a.v is distinct from b.v or a.w is distinct from b.w")
def J12_V10_reconcile(spark, sf_dir):
    return store.reconcile(spark.sql(LEFT), spark.sql(RIGHT), "id", ["v", "w"])


BUCKETS = rows_of("bucket string, episodes string, facts string", [("d1", "e1", "f1"), ("d2", "e2", ""), ("d3", "e3", "g1 g2"), ("d4", "e4", "h"), ("d5", "e5", ""), ("d6", "e6", "i")])


@proof("select * from (values ('d1', 'skip'), ('d2', 'empty'), ('d3', 'rebuild'), ('d4', 'rebuild'), ('d5', 'prune'), ('d6', 'wait')) as t(bucket, action)")
def V15_V18_rollup_upkeep(spark, sf_dir):
    """d1 is as it was, d3 has another fact, d4 another builder, d5 lost its facts, d6 lies beyond the budget of three changes."""
    buckets = fixture(spark, BUCKETS, "episodes", "facts")
    digest = F.sha2(F.to_json(F.struct("episodes", "facts")).cast("binary"), 256)
    made = buckets.filter("bucket in ('d1', 'd3', 'd4', 'd5')").withColumn("facts", F.when(F.col("bucket") == "d3", F.array(F.lit("g1"))).otherwise(F.col("facts")))
    artifacts = made.select("bucket", digest.alias("members_hash"), F.when(F.col("bucket") == "d4", "v0").otherwise("v1").alias("builder"), F.lit("current").alias("status"))
    return store.rollup_changes(buckets, artifacts, "v1", budget=3).select("bucket", "action")


MEMBERS = rows_of("bucket string, key string, predicate string, content string", [("s1", "city", "p", "Rome"), ("s1", "city", "p", "Oslo"), ("s1", "city", "p", "Rome"), ("s1", None, "likes", "tea"), ("s2", "", "likes", "tea")])
SPANS = rows_of("bucket string, kind string, n_facts bigint, n_episodes bigint, first bigint, last bigint", [("s1", "session", 3, 2, 0, DAY), ("s2", "day", 1, 0, None, None)])


@proof(f"""with m as ({MEMBERS}), k as (select bucket, coalesce(nullif(key, ''), predicate) as k, content from m), a as (select bucket, k || '=' || string_agg(distinct content, ' | ' order by content) as anchor from k group by bucket, k), b as ({SPANS})
select b.bucket, '[' || case kind when 'session' then '会话 ' else '日期 ' end || b.bucket || '] 覆盖 ' || n_facts || ' 条事实、' || n_episodes || ' 条证据（' || case when first is null then '无记录时间' else '1970-01-01T00:00:00.000Z ~ 1970-01-02T00:00:00.000Z' end || '）。' || chr(10)
 || string_agg(anchor, chr(10) order by anchor) as summary from b join a on a.bucket = b.bucket group by b.bucket, kind, n_facts, n_episodes, first""")
def A9_V16_summaries(spark, sf_dir):
    return rollups.summaries(spark.sql(SPANS), rollups.anchors(spark.sql(MEMBERS)))


UTILITY = rows_of("id int, utility double, protected boolean, denied int", [(i, round(1 - i / 100, 4), i % 10 == 0, 3 if i == 7 else 0) for i in range(100)])


@proof(f"""with x as ({UTILITY}), e as (select *, row_number() over (order by utility desc, id) as n from x where denied < 2), h as (select *, n <= 5 and utility >= 0.65 as hot from e),
r as (select *, row_number() over (partition by hot, protected order by utility desc, id) as m from h), w as (select *, not hot and (protected or (utility >= 0.35 and m <= 20 - (select count(*) from h where not hot and protected))) as warm from r),
c as (select *, row_number() over (partition by hot, warm order by utility desc, id) as k from w)
select sum(hot::int)::bigint as hot, sum(warm::int)::bigint as warm, sum((not hot and not warm)::int)::bigint as cold, (select count(*) from x where denied >= 2) as quarantine, sum((not hot and not warm and k > 30)::int)::bigint as archive, (select count(*) from x where protected) as protected from c""")
def A12_W7_tier_counts(spark, sf_dir):
    return rollups.tier_counts(rollups.assign_tiers(spark.sql(UTILITY), hot=5, warm=20, cold=30))


AUDIT_SOURCE = rows_of("id int, status string, content string", [(1, "active", "a"), (2, "active", "b"), (3, "active", "c"), (4, "active", "d")])
AUDIT_MIRROR = rows_of("id int, status string, content string", [(1, "active", "a"), (2, "quarantined", "b"), (3, "active", "x"), (5, "deleted", None)])


@proof("select 4::bigint as source, 3::bigint as mirrored, 1::bigint as tombstones, 1::bigint as exact, 0.25::double as consistency")
def A14_audit_totals(spark, sf_dir):
    source, mirror = spark.sql(AUDIT_SOURCE), spark.sql(AUDIT_MIRROR)
    diffs = integrity.diff(source, mirror.filter("status <> 'deleted'"), "id", {"CONTENT_MISMATCH": "content", "STATUS_MISMATCH": "status"})
    return evidence.audited(diffs, source, mirror, "id")


ANSWERS = rows_of("query string, id string, citation string, content string, answer string, reply string, status string", [
    ("q", "a", "M1", "lives in rome", "", "that is wrong, rome", "superseded"), ("q", "b", "M2", "lives in oslo", "[m2]", "that is wrong, rome", "active"), ("r", "c", "M1", "likes tea", "ok [M1]", "thanks", "active"), ("r", "d", "M2", "likes milk", "ok [M1]", "thanks", "active"),
    ("s", "e", "M1", "cat is tom", "", "it should be max, the cat", "active"), ("t", "f", "M1", "red blue", "", "not red but green", "active"), ("t", "g", "M2", "red pink", "", "not red but green", "active"),
])


@proof("select * from (values ('q', 'a', 'denied'), ('q', 'b', 'adopted'), ('r', 'c', 'adopted'), ('r', 'd', 'ignored'), ('s', 'e', 'corrected'), ('t', 'f', 'ignored'), ('t', 'g', 'ignored')) as t(query, id, outcome)")
def R21_feedback(spark, sf_dir):
    answers = spark.sql(ANSWERS)
    return store.feedback_outcomes(answers.withColumn("kind", store.reply_kind(F.col("reply"))))


# ---- streams ----

STREAM = rows_of("key string, id string, rev bigint, v string, came string", [
    ("k1", "a", 1, "x", "2024-01-01 10:00:00"), ("k1", "a", 1, "x", "2024-01-01 10:00:01"), ("k2", "a", 3, "z", "2024-01-01 11:00:00"), ("k3", "a", 2, "late", "2024-01-01 11:01:00"), ("k4", "b", 1, None, "2024-01-02 11:02:00"), ("k5", "b", 2, "again", "2024-01-02 11:03:00"),
])


def _streamed(spark, transform, mode: str = "append"):
    """The rows that a stream over the fixture puts out, in a table."""
    source, sink, marks = _folder(spark), _folder(spark), _folder(spark)
    rows = spark.sql(STREAM).withColumn("t", F.to_timestamp("came"))
    rows.write.parquet(source)
    out = transform(spark.readStream.schema(rows.schema).parquet(source))
    run = out.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(sink)


@proof(f"with x as ({STREAM}) select key, min(rev)::bigint as rev from x group by key")
def ST3_once(spark, sf_dir):
    return _streamed(spark, lambda s: jobs.once(s, "key", "t")).select("key", "rev")


@proof("select * from (values ('a', 3::bigint, 'z'), ('b', 1, null)) as t(key, revision, value)")
def ST4_late_input(spark, sf_dir):
    """Of a the newest revision counts; b was purged first and stays so."""
    changes = _streamed(spark, lambda s: jobs.latest_state(s, "id", "rev", "v"))
    return changes.groupBy("key").agg(F.max("revision").alias("revision"), F.max_by("value", "revision").alias("value"))


@proof(f"with x as ({STREAM}) select left(came, 10) as day, id, count(*) as n from x group by 1, 2")
def ST6_day_buckets(spark, sf_dir):
    counts = _streamed(spark, lambda s: jobs.day_rollup(s, "t", "id"), "update")
    return counts.groupBy(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "id").agg(F.max("n").alias("n"))


@proof(f"with x as ({STREAM}) select count(*) as n, count(distinct key) as keys from x")
def ST1_ST2_ST7_micro_batches(spark, sf_dir):
    """Two runs over one checkpoint: the second finds nothing that the first has not written."""
    source, sink, marks = _folder(spark), _folder(spark), _folder(spark)
    rows = spark.sql(STREAM)
    rows.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(source)
        jobs.micro_batches(stream, lambda batch, n: batch.write.mode("append").parquet(sink), marks).awaitTermination()
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@proof(f"with x as ({STREAM}) select id, count(*) as n from x where v is not null and came < '2024-01-02' group by id")
def ST5_F6_expiry(spark, sf_dir):
    """Rows that expire a day after they came, as of the second of January."""
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    rows = spark.sql(STREAM).select("id", "v", F.lit("active").alias("status"), (F.to_timestamp("came") + F.expr("interval 1 day")).alias("expires_at")).filter("v is not null")
    from tesserae.operators import filters

    return rows.withColumn("status", filters.expired_status(now)).filter("status = 'expired'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))

