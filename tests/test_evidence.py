from pyspark.sql import functions as F

from tesserae.operators import evidence, integrity

EP = "id string, owner string, agent string, session string, state string, content string, recorded_at long, deleted_at long"
FA = "id string, owner string, agent string, session string, key string, content string, status string, origin string, importance double, confidence double, valid_from long, valid_to long, recorded_at long, updated_at long, supersedes string"
LI = "id string, fact string, episode string, active boolean, created_at long, invalidated_at long"


def graph(spark):
    return dict(
        episodes=spark.createDataFrame([("e1", "u", "a", None, "available", "hello", 1, None), ("e2", "u", "a", "s", "deleted", None, 1, 5)], EP),
        facts=spark.createDataFrame([("f1", "u", "a", None, "k", "x", "active", "auto", 0.5, 0.5, 1, None, 1, 2, "f0"), ("f0", "u", "a", None, "k", "y", "superseded", "auto", 0.5, 0.5, 1, 2, 1, 2, None)], FA),
        links=spark.createDataFrame([("l1", "f1", "e1", True, 1, None), ("l2", "f0", "e2", False, 1, 5)], LI),
        versions=spark.createDataFrame([("f1", 1, "w", "active", 1, 2), ("f1", 2, "x", "active", 2, None), ("f0", 1, "y", "superseded", 1, None)], "fact string, version int, content string, status string, recorded_at long, closed_at long"),
        artifacts=spark.createDataFrame([("a1", "current", ["f1"], ["e1"])], "id string, status string, fact_ids array<string>, episode_ids array<string>"),
        events=spark.createDataFrame([("v1", "i1", "f1"), ("v2", "i2", None)], "id string, idempotency_key string, fact string"),
    )


def broken(spark, **changed):
    g = graph(spark) | changed
    return {r.check for r in integrity.violations(evidence.constraints(**g)).filter("n > 0").collect()}


def test_a_valid_graph_and_single_faults(spark):
    g = graph(spark)
    assert broken(spark) == set()
    faults = broken(
        spark,
        episodes=g["episodes"].withColumn("content", F.lit("text")),
        links=g["links"].withColumn("active", F.lit(True)).unionByName(spark.createDataFrame([("l9", "f7", "e7", False, 9, 1)], LI)),
        versions=g["versions"].withColumn("closed_at", F.lit(3).cast("long")),
        events=g["events"].withColumn("idempotency_key", F.lit("same")),
    )
    assert faults == {
        "available episodes have content, others none", "active links aren't invalidated", "links have facts", "links have episodes", "links end after they begin",
        "only the latest version is open", "idempotency keys are unique",
    }
    f = g["facts"]
    assert broken(spark, facts=f.withColumn("supersedes", F.when(F.col("id") == "f1", "f0").otherwise("f1"))) == {"supersession has no cycle"}
    assert broken(spark, facts=f.withColumns({"importance": F.lit(2.0), "updated_at": F.lit(0).cast("long")})) == {"scores lie in 0 to 1", "updates follow records"}


def test_unlinking_a_source(spark):
    g = graph(spark)
    e, li, f = evidence.unlinked(g["episodes"], g["links"], g["facts"], spark.createDataFrame([("e1",)], "id string"), 9)
    assert {r.id: (r.state, r.content) for r in e.collect()}["e1"] == ("deleted", None)
    assert {r.id: (r.active, r.invalidated_at) for r in li.collect()} == {"l1": (False, 9), "l2": (False, 5)}
    assert {r.id: r.status for r in f.collect()} == {"f1": "orphaned", "f0": "superseded"}
    stale = evidence.stale_artifacts(g["artifacts"], f.filter("status = 'orphaned'"), e.limit(0))
    assert [r.status for r in stale.collect()] == ["stale"]


def test_synthesis_and_migration(spark):
    schema = "id string, owner string, agent string, session string, key string, kind string, content string, origin string, status string, share_policy string, sensitivity string, recorded_at long, source_ids array<string>, attachment_ids array<string>, supersedes string, valid_from long, valid_to long"
    rows = [("1", "u", "a", None, "profile.name", "identity", "name: Ann", "auto", "active", None, None, 5, ["m1", "m2"], [], "gone", 1, None), ("2", "u", "a", None, None, "note", "plain", "manual", "active", "allow-remote", "normal", 4, ["m1"], ["p"], None, 5, 2), ("3", "u", "a", None, None, None, "own", "auto", "active", None, "normal", 3, [], [], None, None, None)]
    m = spark.createDataFrame(rows, schema)
    episodes, links = evidence.synthesized(m)
    assert episodes.count() == 4 and links.count() == 5
    assert {r.source: (r.kind, r.content, r.state) for r in episodes.collect()}["3"] == ("memory", "own", "available")
    got = {r.source_id: r for r in evidence.migrated(m, 9).collect()}
    assert got["1"].object == "Ann" and got["1"].warnings == ["supersedes-missing", "privacy-unknown"] and got["1"].share_policy == "local-only"
    assert got["2"].warnings == ["validity-reversed"] and got["2"].valid_to is None and got["3"].predicate == "memory.unknown"


def test_edits_restore_review_and_prompt(spark):
    f = graph(spark)["facts"].withColumns({"cardinality": F.lit("single"), "expires_at": F.lit(7).cast("long"), "citation": F.concat(F.lit("M"), F.substring("id", 2, 1))})
    patches = spark.createDataFrame([("f1", 1, "old", None, None, None, None), ("f1", 2, None, 0.9, None, True, None)], "id string, seq int, content string, importance double, expires_at long, clear_expiry boolean, status string")
    got = {r.id: r for r in evidence.edited(f, patches).collect()}
    assert (got["f1"].content, got["f1"].importance, got["f1"].expires_at, got["f0"].expires_at) == ("x", 0.9, None, 7)
    back = {r.id: (r.status, r.valid_to) for r in evidence.restored(f, spark.createDataFrame([("f0",)], "id string"), 50).collect()}
    assert back == {"f0": ("active", None), "f1": ("superseded", 50)}
    c = spark.createDataFrame([("1", "quarantined"), ("2", "accepted"), ("3", "quarantined")], "id string, status string")
    d = spark.createDataFrame([("1", True), ("2", False), ("1", True)], "id string, approve boolean")
    assert {r.id: r.status for r in evidence.reviewed(c, d, 1).collect()} == {"1": "approved", "2": "accepted", "3": "quarantined"}
    line = {r.id: r.line for r in evidence.prompt_lines(f.withColumn("content", F.lit("a<b&c"))).collect()}
    assert line["f0"] == '<memory id="M0" state="historical" from="1970-01-01" to="1970-01-01">a&lt;b&amp;c</memory>'


def test_versions_residuals_and_candidates(spark):
    v = graph(spark)["versions"]
    assert {(r.fact, r.version): r.operation for r in evidence.version_operations(v).collect()} == {("f1", 1): "create", ("f1", 2): "refine", ("f0", 1): "create"}
    g = graph(spark)
    left = evidence.residuals(spark.createDataFrame([("f0",)], "id string"), {"facts": (g["facts"], F.col("id")), "events": (g["events"], F.col("fact"))})
    assert {r.check: r.n for r in left.collect()} == {"facts": 1, "events": 0}
    c = spark.createDataFrame([("m", 1, "A b", "k", 0.5, "rules"), ("m", 2, "a B", "k", 0.7, "model"), ("m", 3, "c", "k", 0.1, "rules")], "message string, seq int, content string, kind string, confidence double, channel string")
    assert {(r.content, r.seq, r.confidence, r.channel) for r in evidence.merged_candidates(c).collect()} == {("a B", 1, 0.7, "model+rules"), ("c", 3, 0.1, "rules")}
    assert evidence.answerable(g["facts"], g["links"], g["episodes"]).select("fact", "episode").collect() == [("f1", "e1")]


def test_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = evidence.manifest(spark, str(tmp_path)).first()
    assert row["size"] == 3 and row.sha256.startswith("ba7816bf")
