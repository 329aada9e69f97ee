"""The evidence graph: episodes, facts, links, versions and artifacts as relations, and the jobs over them.

episodes: id, owner, agent, session, actor, kind, state, content, content_hash, recorded_at, deleted_at
facts:    id, owner, agent, session, key, content, status, scores..., valid_from, valid_to, recorded_at, updated_at, supersedes, evidence_ids
links:    id, fact, episode, role, active, created_at, invalidated_at
versions: fact, version, operation, content, status, recorded_at, closed_at
artifacts: id, kind, status, fact_ids, episode_ids
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import integrity
from tesserae.operators.filters import contains_scope


def synthesized(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes, links) of memories (id, owner, agent, session, content, origin, recorded_at, source_ids, attachment_ids): one
    episode for each source message or attachment, and one of its own for a memory without sources. Ids are hashes of
    what they stand for, so a repeated run makes the same rows."""
    none = (F.size("source_ids") <= 0) & (F.size("attachment_ids") <= 0)
    sources = F.concat(
        F.transform("source_ids", lambda s: F.struct(F.lit("message").alias("kind"), s.alias("source"))),
        F.transform("attachment_ids", lambda s: F.struct(F.lit("attachment").alias("kind"), s.alias("source"))),
        F.when(none, F.array(F.struct(F.lit("memory").alias("kind"), F.col("id").alias("source")))).otherwise(F.array().cast("array<struct<kind:string,source:string>>")),
    )
    laid = memories.select("id", "owner", "agent", "session", "content", "origin", "recorded_at", F.explode(sources).alias("s"))
    laid = laid.withColumn("episode", t.stable_id(F.lit("episode"), F.col("owner"), F.col("agent"), F.col("s.kind"), F.col("s.source")))
    own = F.when(F.col("s.kind") == "memory", F.col("content"))
    episodes = laid.groupBy("episode").agg(
        F.first("owner").alias("owner"), F.first("agent").alias("agent"), F.min("session").alias("session"), F.first("s.kind").alias("kind"), F.first("s.source").alias("source"),
        F.max(own).alias("content"), F.min("recorded_at").alias("recorded_at"),
    )
    episodes = episodes.withColumn("state", F.when(F.col("content").isNull(), "unavailable").otherwise("available")).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256)).withColumnRenamed("episode", "id")
    links = laid.select(t.stable_id(F.lit("link"), F.col("id"), F.col("episode")).alias("link"), F.col("id").alias("fact"), "episode", F.lit(True).alias("active"), F.col("recorded_at").alias("created_at")).dropDuplicates(["link"]).withColumnRenamed("link", "id")
    return episodes, links


def mirrored_status(status: Column, origin: Column, n_links: Column, evidence_score: Column) -> Column:
    """What a memory's status is in the graph: an automatic active row needs direct evidence, else it waits for review."""
    return F.when((status == "active") & (origin != "manual") & ((n_links < 1) | (evidence_score < 1)), "quarantined").otherwise(status)


def migrated(memories: DataFrame, now: int) -> DataFrame:
    """Facts from memory rows: subject, predicate and value from the key or content, conservative privacy where it is
    unknown, and warnings (array) instead of dropped rows."""
    value = t.candidate_value(F.col("content"))
    subject = F.when(F.col("key").isNotNull(), F.lit("user")).otherwise(F.lit("memory"))
    predicate = F.coalesce("key", F.concat(F.lit("memory."), F.coalesce("kind", F.lit("unknown"))))
    missing = memories.filter("supersedes is not null").select("id", "supersedes").join(memories.select(F.col("id").alias("supersedes")), "supersedes", "left_anti").select("id", F.lit(True).alias("lost_"))
    rows = memories.join(missing, "id", "left")
    warnings = F.array(
        F.when(F.col("lost_"), F.lit("supersedes-missing")),
        F.when(F.col("valid_to") < F.col("valid_from"), F.lit("validity-reversed")),
        F.when(F.col("share_policy").isNull() | F.col("sensitivity").isNull(), F.lit("privacy-unknown")),
    )
    return rows.select(
        t.stable_id(F.lit("fact"), F.col("owner"), F.col("agent"), F.col("id")).alias("id"), F.col("id").alias("source_id"), "owner", "agent", subject.alias("subject"), predicate.alias("predicate"), value.alias("object"), "content",
        "status", F.coalesce("share_policy", F.lit("local-only")).alias("share_policy"), F.coalesce("sensitivity", F.lit("private")).alias("sensitivity"),
        "valid_from", F.when(F.col("valid_to") >= F.col("valid_from"), F.col("valid_to")).otherwise(F.when(F.col("valid_from").isNull(), F.col("valid_to"))).alias("valid_to"),
        F.lit(now).alias("migrated_at"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )


def version_operations(versions: DataFrame) -> DataFrame:
    """Adds operation to versions (fact, version, content, status): what changed since the version before."""
    w = Window.partitionBy("fact").orderBy("version")
    was, is_ = F.lag("status").over(w), F.col("status")
    label = (
        F.when(was.isNull(), "create")
        .when((was != is_) & (is_ == "superseded"), "supersede")
        .when((was != is_) & (is_ == "active"), "restore")
        .when((was != is_) & is_.isin("deleted", "archived", "suppressed", "expired", "orphaned", "conflicted", "quarantined"), F.concat(F.lit("status:"), is_))
        .when(~F.lag("content").over(w).eqNullSafe(F.col("content")), "refine")
        .otherwise("none")
    )
    return versions.withColumn("operation", label)


def unlinked(episodes: DataFrame, links: DataFrame, facts: DataFrame, removed: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes, links, facts) after sources (id) are gone: their plaintext is dropped, their links end, and automatic
    active facts whose last active link ends become orphaned."""
    gone = removed.select("id").distinct().withColumn("gone_", F.lit(True))
    e = episodes.join(gone, "id", "left")
    off = F.coalesce("gone_", F.lit(False))
    e = e.withColumns({"content": F.when(~off, F.col("content")), "state": F.when(off, "deleted").otherwise(F.col("state")), "deleted_at": F.when(off, F.lit(now)).otherwise(F.col("deleted_at"))}).drop("gone_")
    lk = links.join(gone.withColumnRenamed("id", "episode"), "episode", "left")
    ends = off & F.col("active")
    lk = lk.withColumns({"invalidated_at": F.when(ends, F.lit(now)).otherwise(F.col("invalidated_at")), "ended_": ends, "active": F.col("active") & ~off}).drop("gone_")
    state = lk.groupBy("fact").agg(F.bool_or("active").alias("held_"), F.bool_or("ended_").alias("lost_")).withColumnRenamed("fact", "id")
    orphan = F.coalesce(F.col("lost_") & ~F.col("held_"), F.lit(False)) & (F.col("status") == "active") & (F.col("origin") != "manual")
    f = facts.join(state, "id", "left").withColumn("status", F.when(orphan, "orphaned").otherwise(F.col("status"))).drop("held_", "lost_")
    return e, lk.drop("ended_").select(*links.columns), f.select(*facts.columns)


def stale_artifacts(artifacts: DataFrame, changed_facts: DataFrame, changed_episodes: DataFrame) -> DataFrame:
    """Artifacts with status stale where something they are made of has changed (id columns)."""
    laid = lambda column, changed: artifacts.select("id", F.explode(column).alias("part")).join(changed.select(F.col("id").alias("part")).distinct(), "part", "left_semi").select("id")
    hit = laid("fact_ids", changed_facts).unionByName(laid("episode_ids", changed_episodes)).distinct().withColumn("hit_", F.lit(True))
    return artifacts.join(hit, "id", "left").withColumn("status", F.when(F.coalesce("hit_", F.lit(False)) & (F.col("status") == "current"), "stale").otherwise(F.col("status"))).drop("hit_")


def answerable(facts: DataFrame, links: DataFrame, episodes: DataFrame) -> DataFrame:
    """(fact, episode) of active facts through active links to episodes that aren't deleted and whose session the fact's scope covers."""
    f = facts.filter("status = 'active'").select(F.col("id").alias("fact"), F.col("owner").alias("o"), F.col("agent").alias("a"), F.col("session").alias("fact_session"))
    e = episodes.filter("state <> 'deleted'").select(F.col("id").alias("episode"), "owner", "agent", "session", "recorded_at")
    both = links.filter("active").select("fact", "episode").join(f, "fact").join(e, "episode").filter((F.col("o") == F.col("owner")) & (F.col("a") == F.col("agent")))
    return both.filter(contains_scope(F.col("fact_session"), F.col("session"))).select("fact", "episode", "owner", "agent", "session", "recorded_at")


def constraints(episodes: DataFrame, facts: DataFrame, links: DataFrame, versions: DataFrame, artifacts: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """By name the rows that violate a constraint of the graph; a valid graph has none. events: id, idempotency_key, fact."""
    active = links.filter("active")
    supported = facts.filter("status = 'active'").join(active.select(F.col("fact").alias("id")), "id", "left_anti")
    w = Window.partitionBy("fact").orderBy("version")
    stepped = versions.withColumns({"want_": F.row_number().over(w), "later_": F.lead("version").over(w)})
    latest = versions.groupBy("fact").agg(F.max_by(F.struct("content", "status"), "version").alias("v"))
    head = facts.select(F.col("id").alias("fact"), "content", "status").join(latest, "fact", "left")
    lineage = lambda column, parents: artifacts.filter("status = 'current'").select("id", F.explode(column).alias("part")).join(parents.select(F.col("id").alias("part")), "part", "left_anti")
    related = facts.filter("supersedes is not null").select("id", "owner", "agent", F.col("supersedes").alias("to"))
    return {
        **{f"{name} ids are unique": integrity.repeated(df, "id") for name, df in (("episode", episodes), ("fact", facts), ("link", links), ("artifact", artifacts), ("event", events))},
        "available episodes have content, others none": episodes.filter((F.col("state") == "available") != F.col("content").isNotNull()),
        "deleted episodes have a time not before their record": episodes.filter(((F.col("state") == "deleted") != F.col("deleted_at").isNotNull()) | (F.col("deleted_at") < F.col("recorded_at"))),
        "links have facts": integrity.dangling(links, "fact", facts, "id"),
        "links have episodes": integrity.dangling(links, "episode", episodes, "id"),
        "active links aren't invalidated": links.filter(F.col("active") & F.col("invalidated_at").isNotNull()),
        "links end after they begin": links.filter(F.col("invalidated_at") < F.col("created_at")),
        "active facts have active evidence": supported,
        "superseded facts exist in the scope": related.join(facts.select(F.col("id").alias("to"), "owner", "agent"), ["to", "owner", "agent"], "left_anti"),
        "facts don't supersede themselves": facts.filter("supersedes = id"),
        "supersession has no cycle": integrity.cycles(facts.filter("supersedes is not null"), "id", "supersedes"),
        "scores lie in 0 to 1": facts.filter(~F.col("importance").between(0, 1) | ~F.col("confidence").between(0, 1)),
        "validity isn't reversed": facts.filter("valid_to < valid_from"),
        "updates follow records": facts.filter("updated_at < recorded_at"),
        "versions count from one": stepped.filter("version <> want_"),
        "only the latest version is open": stepped.filter((F.col("later_").isNull() & F.col("closed_at").isNotNull()) | (F.col("later_").isNotNull() & F.col("closed_at").isNull())),
        "the latest version equals the fact": head.filter(~F.struct("content", "status").eqNullSafe(F.col("v"))),
        "artifacts have their facts": lineage("fact_ids", facts),
        "artifacts have their episodes": lineage("episode_ids", episodes),
        "idempotency keys are unique": integrity.repeated(events, "idempotency_key"),
        "events have facts": integrity.dangling(events, "fact", facts, "id"),
    }


def residuals(purged: DataFrame, stores: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """check, n: rows of each store {name: (rows, id column)} that still name a purged id; all must be 0."""
    ids = purged.select(F.col("id").alias("purged_")).distinct()
    return integrity.violations({name: rows.withColumn("purged_", column).join(ids, "purged_", "left_semi") for name, (rows, column) in stores.items()})


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def reviewed(candidates: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """Candidates (id, status, ...) after decisions (id, approve): only those that wait can be decided, and once."""
    d = decisions.groupBy("id").agg(F.min("approve").alias("approve_"))
    waits = F.col("status") == "quarantined"
    done = F.when(waits & F.col("approve_"), "approved").when(waits & ~F.col("approve_"), "rejected").otherwise(F.col("status"))
    return candidates.join(d, "id", "left").withColumns({"reviewed_at": F.when(waits & F.col("approve_").isNotNull(), F.lit(now)), "status": F.coalesce(done, "status")}).drop("approve_")


def edited(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows after the last patch of each (id, seq, content, importance, expires_at, clear_expiry, status): null keeps a value."""
    last = patches.groupBy("id").agg(F.max_by(F.struct("content", "importance", "expires_at", "clear_expiry", "status"), "seq").alias("p_"))
    both = rows.join(last, "id", "left")
    patched = {c: F.coalesce(F.col(f"p_.{c}"), F.col(c)) for c in ("content", "importance", "status")}
    patched["expires_at"] = F.when(F.coalesce(F.col("p_.clear_expiry"), F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.col("p_.expires_at"), F.col("expires_at")))
    return both.withColumns(patched).drop("p_")


def restored(rows: DataFrame, chosen: DataFrame, now: int) -> DataFrame:
    """Rows after the chosen (id) became active again: other active rows of the same single-valued key are superseded."""
    back = rows.join(chosen.select("id").distinct(), "id", "left_semi")
    keys = back.filter("key is not null and cardinality = 'single'").select("owner", "agent", "key").distinct().withColumn("taken_", F.lit(True))
    marked = rows.join(chosen.select("id").distinct().withColumn("back_", F.lit(True)), "id", "left").join(keys, ["owner", "agent", "key"], "left")
    is_back = F.coalesce("back_", F.lit(False))
    loses = ~is_back & F.coalesce("taken_", F.lit(False)) & (F.col("status") == "active")
    return marked.withColumns(
        {
            "valid_to": F.when(is_back, F.lit(None)).when(loses, F.greatest(F.lit(now), F.coalesce("valid_from", F.lit(0)) + F.lit(1))).otherwise(F.col("valid_to")),
            "status": F.when(is_back, "active").when(loses, "superseded").otherwise(F.col("status")),
        }
    ).select(*rows.columns)


def prompt_lines(rows: DataFrame) -> DataFrame:
    """(id, line): facts for a prompt, with escaped text, their state, and their validity as ISO days."""
    state = F.when(F.col("status") == "superseded", "historical").otherwise("current")
    day = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    attributes = F.concat_ws(" ", F.concat(F.lit('id="'), "citation", F.lit('"')), F.concat(F.lit('state="'), state, F.lit('"')), F.concat(F.lit('from="'), day("valid_from"), F.lit('"')), F.concat(F.lit('to="'), day("valid_to"), F.lit('"')))
    return rows.select("id", F.concat(F.lit("<memory "), attributes, F.lit(">"), t.escaped(F.col("content")), F.lit("</memory>")).alias("line"))


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each message and content, compared in lower case: the last one wins, at the place of the first, with all channels."""
    last = F.max_by(F.struct("content", "kind", "confidence"), "seq")
    rows = candidates.groupBy("message", F.lower("content").alias("same_")).agg(last.alias("c"), F.min("seq").alias("seq"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channel"))
    return rows.select("message", "seq", "c.*", "channel")


def capped_union(rows: DataFrame, others: DataFrame, group: str, order: str, most: int = 8) -> DataFrame:
    """Rows of both, the first ``most`` of each group, with their place."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.unionByName(others).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


#: Operations of a version by the status it leads to.
STATUS_OPERATIONS = (("conflicted", "CONFLICT"), ("suppressed", "SUPPRESS"), ("deleted", "DELETE"))


def version_labels(versions: DataFrame) -> DataFrame:
    """Adds operation to versions (fact, version, content, status, supersedes, links: array): what led to each; the first is ADD."""
    w = Window.partitionBy("fact").orderBy("version")
    before = lambda c: F.lag(c).over(w)
    label = F.when(before("status").isNull(), "ADD").when((before("status") == "deleted") & (F.col("status") != "deleted"), "RESTORE")
    for status, name in STATUS_OPERATIONS:
        label = label.when(F.col("status") == status, name)
    label = label.when(F.col("supersedes").isNotNull() | (F.col("status") == "superseded"), "SUPERSEDE").when(before("content") != F.col("content"), "REFINE")
    return versions.withColumn("operation", label.when(F.array_sort(before("links")) != F.array_sort("links"), "MERGE_EVIDENCE").otherwise("NOOP"))


def changed_states(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Ids whose version state (the columns, arrays in order) isn't the same in both, or that only the new one has."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return new.select("id", digest.alias("n_")).join(old.select("id", digest.alias("o_")), "id", "left").filter(~F.col("n_").eqNullSafe(F.col("o_"))).select("id")


def merged_metadata(current: Column, incoming: Column) -> Column:
    """Two maps; a key of both takes the incoming value."""
    return F.map_concat(F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(incoming), k)), incoming)


def calibration_examples(candidates: DataFrame) -> DataFrame:
    """raw_score, correct, cohort of reviewed candidates (status, score, kind): approved ones were right, rejected ones wrong."""
    return candidates.filter(F.col("status").isin("approved", "rejected")).select("id", F.col("score").alias("raw_score"), (F.col("status") == "approved").alias("correct"), F.coalesce("kind", F.lit("other")).alias("cohort"))


def first_evidence(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """id and the first of its evidence_ids that names an episode with content (null without one)."""
    laid = candidates.select("id", F.posexplode_outer("evidence_ids").alias("pos", "episode"))
    usable = episodes.filter("state = 'available' and content is not null").select(F.col("id").alias("episode"), F.lit(True).alias("ok_"))
    return laid.join(usable, "episode", "left").groupBy("id").agg(F.min(F.when(F.col("ok_"), F.struct("pos", "episode")))["episode"].alias("episode"))


def own_evidence(links: DataFrame, fact: str) -> DataFrame:
    """Episodes of a fact's active links that no other fact has an active link to: what may go with the fact."""
    active = links.filter("active").select("fact", "episode").distinct()
    others = active.filter(F.col("fact") != fact).select("episode")
    return active.filter(F.col("fact") == fact).select("episode").join(others, "episode", "left_anti")


def audited(diffs: DataFrame, source: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """One row: source, mirrored and tombstone rows, exact ones (no difference), and consistency."""
    bad = diffs.select(key).distinct()
    counts = source.agg(F.count(F.lit(1)).alias("source")).join(mirror.agg(F.sum(F.when(F.col("status") != "deleted", 1).otherwise(0)).alias("mirrored"), F.sum(F.when(F.col("status") == "deleted", 1).otherwise(0)).alias("tombstones")))
    exact = source.join(bad, key, "left_anti").agg(F.count(F.lit(1)).alias("exact"))
    return counts.join(exact).withColumn("consistency", F.round(F.col("exact") / F.greatest(F.lit(1), F.col("source")), 6))  # one row each


def shadow_applied(facts: DataFrame, operations: DataFrame, now: int) -> DataFrame:
    """Facts (id, content, status, revision, updated_at) after operations (seq, op, id, content, status, revision), the last of each id.

    record sets content and status if its revision is newer, and never what was purged; delete leaves a
    tombstone without content; purge leaves nothing but the id; unlink and capture change no fact here.
    """
    last = operations.filter(F.col("op").isin("record", "delete", "purge")).groupBy("id").agg(F.max_by(F.struct("op", "content", "status", "revision"), F.struct(F.col("op") == "purge", "seq")).alias("n"))
    both = facts.join(last, "id", "full_outer")
    purged = F.col("status").eqNullSafe(F.lit("purged")) | F.col("n.op").eqNullSafe(F.lit("purge"))
    newer = (F.col("n.op") == "record") & (F.col("revision").isNull() | (F.col("n.revision") > F.col("revision")))
    kept = lambda c: F.when(purged, F.lit(None)).when(F.col("n.op") == "delete", F.lit(None)).when(newer, F.col(f"n.{c}")).otherwise(F.col(c))
    status = F.when(purged, "purged").when(F.col("n.op") == "delete", "deleted").when(newer, F.col("n.status")).otherwise(F.col("status"))
    touched = F.col("n").isNotNull() & (newer | F.col("n.op").isin("delete", "purge"))
    return both.select("id", kept("content").alias("content"), status.alias("status"), F.when(newer & ~purged, F.col("n.revision")).otherwise(F.col("revision")).alias("revision"), F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def once_each(operations: DataFrame, key: str = "idempotency_key", seq: str = "seq") -> DataFrame:
    """The first operation of each idempotency key."""
    w = Window.partitionBy(key).orderBy(seq)
    return operations.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")


def collected(rows: DataFrame, group: str, column: str) -> DataFrame:
    """group and the sorted distinct values of an array column in it, joined by commas (warnings, versions in use)."""
    return rows.select(group, F.explode_outer(column).alias("v_")).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("v_")), ",").alias("found"))


def conflict_groups(chosen: DataFrame, memories: DataFrame) -> DataFrame:
    """(query, key, ids): chosen rows of one key and scope that say different things, and so must be shown as a conflict."""
    own = chosen.select("query", "id").join(memories.filter("key is not null").select("id", "owner", "agent", "key", F.lower("content").alias("c_")), "id")
    groups = own.groupBy("query", "owner", "agent", "key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.countDistinct("c_").alias("n_"))
    return groups.filter("n_ > 1").select("query", "key", "ids")


def fragments(memories: DataFrame, scored: DataFrame) -> DataFrame:
    """What leaves the engine of chosen memories: no vector and no scope, with the score."""
    hidden = {"embedding", "vector", "owner", "agent", "session"}
    return memories.select(*[c for c in memories.columns if c not in hidden]).join(scored.select("id", "score"), "id")
