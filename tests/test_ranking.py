import random
from collections import Counter

from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions import vector
from tesserae.operators import integrity, lexical, prefix, ranking, recall, rollups, stats

NOW = 1_750_000_000_000


def test_fusion_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2), (1, "a", "y", 2), (1, "b", "y", 1), (1, "b", "z", 3)], "query int, route string, id string, rank int")
    got = {r.id: r for r in ranking.reciprocal_rank_fusion(ranked).collect()}
    assert abs(got["x"].raw - (1 / 61 + 1 / 62)) < 1e-12 and got["x"].normalized == 1 and got["z"].agreement == 0.5
    assert got["x"].route_ranks == {"a": 1, "b": 2}


def test_diversity_is_greedy(spark):
    rows = [(1, 1, 1, list("abcd")), (1, 2, 2, list("abcd")), (1, 3, 3, list("abxy")), (1, 4, 4, []), (1, 5, 5, [])]
    got = ranking.diverse_top(spark.createDataFrame(rows, "query int, id int, rank int, tokens array<string>"), 5)
    assert [r.id for r in got.orderBy("position").collect()] == [1, 3, 4]


def test_adaptive_selection_stops():
    c = lambda n, score=1.0: [(f"m{i}", f"fact number {i} about topic{i}", score - i * 0.01) for i in range(n)]
    assert ranking.select_adaptively("anything", []) == ([], 0, 0, "no-candidates")
    ids, seen, batches, why = ranking.select_adaptively("anything", c(10))
    assert (seen, batches, why) == (4, 1, "coverage-satisfied") and ids[0] == "m0"
    two = [("n", "用户姓名/名字：小明", 1.0), ("b", "用户生日：五月一日", 0.9), ("x", "用户宠物名字：旺财", 0.8)]
    assert ranking.select_adaptively("我的名字和生日", two)[::3] == (["n", "b"], "coverage-satisfied")
    assert ranking.select_adaptively("我的名字", [("x", "用户宠物：狗", 1.0)])[3] == "marginal-gain"
    assert ranking.select_adaptively("你还记得我哪些事情", c(30), max_injected=3)[3] == "max-injected"
    long = [(f"m{i}", f"t{i} " * 200 + str(i), 1.0) for i in range(9)]
    assert ranking.select_adaptively("你还记得我哪些事情", long, max_characters=1500)[3] == "character-budget"


def test_bm25_against_plain_python(spark):
    import math

    rng = random.Random(1)
    docs = [(i, "s", "active", [f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))]) for i in range(80)]
    df = spark.createDataFrame(docs, "id int, owner string, status string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["t1", "t2", "t2"]), (2, ["t9", "none"])], "query int, terms array<string>")
    got = {(r.query, r.doc): r.score for r in lexical.search(lexical.postings(df), asked, lexical.corpus_stats(df), 100).collect()}
    n, avg = len(docs), sum(len(d[3]) for d in docs) / len(docs)
    for q, terms in ((1, {"t1", "t2"}), (2, {"t9"})):
        for i, _, _, tokens in docs:
            raw = 0.0
            for term in terms:
                tf, dfreq = tokens.count(term), sum(term in d[3] for d in docs)
                if tf:
                    raw += math.log(1 + (n - dfreq + 0.5) / (dfreq + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / avg))
            assert (raw > 0) == ((q, i) in got) and abs(got.get((q, i), 0) - round(1 - math.exp(-raw), 6)) < 2e-6


def test_hashes_and_embeddings(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    row = spark.createDataFrame([("w:hello", "Hello 世界 music")], "a string, b string").select(vector.fnv1a(F.col("a")).alias("h"), vector.local_embedding(F.col("b")).alias("e"), t.bm25_tokens(F.col("b")).alias("t")).first()
    assert row.h == fnv("w:hello") and row.t == ["w:hello", "w:music", "c:世", "c:界", "b:世界"]
    tokens = ["w:hello", "w:music", "g:hel", "g:ell", "g:llo", "g:mus", "g:usi", "g:sic", "c:世", "c:界", "b:世界"] + ["s:preference.music"] * 5
    want = [0.0] * 384
    for token in tokens:
        want[fnv(token) % 384] += -1 if fnv(token) >> 31 else 1
    norm = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / norm) < 1e-9 for a, b in zip(row.e, want, strict=True))


def memories(spark):
    base = dict(owner="u", agent="default", status="active", importance=0.8, confidence=0.9, access_count=0, created_at=NOW - 10**9, updated_at=NOW - 10**9, valid_from=None, valid_to=None, supersedes=None, share_policy="allow-remote", sensitivity="normal")
    rows = [
        base | dict(id="name", kind="identity", content="用户姓名/名字：小明", source_ids=["m1"]),
        base | dict(id="pet", kind="relationship", content="用户宠物名字：旺财", source_ids=["m1"]),
        base | dict(id="old", kind="identity", content="用户所在地：北京", status="superseded", valid_from=NOW - 10**11, valid_to=NOW - 10**10, source_ids=["m2"]),
        base | dict(id="new", kind="identity", content="用户所在地：上海", valid_from=NOW - 10**10, supersedes="old", source_ids=["m3"]),
        base | dict(id="plate", kind="identity", content="plate ABC123 parked", sensitivity="private", source_ids=["m4"]),
        base | dict(id="other", kind="identity", content="用户姓名/名字：老王", owner="v", source_ids=["m9"]),
    ]
    schema = "id string, owner string, agent string, kind string, content string, status string, importance double, confidence double, access_count int, created_at long, updated_at long, valid_from long, valid_to long, supersedes string, source_ids array<string>, share_policy string, sensitivity string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_recall_end_to_end(spark):
    m = memories(spark).cache()
    asked = [("q1", "我的名字是什么"), ("q2", "我以前住在哪里"), ("q3", "where is ABC123"), ("q4", "什么是光合作用"), ("q5", "我现在住在哪里")]
    queries = spark.createDataFrame([(q, x, "u", "default") for q, x in asked], "query string, text string, owner string, agent string")
    got = {}
    for r in recall.recall(m, queries, NOW, top_k=3).orderBy("position").collect():
        got.setdefault(r["query"], []).append(r.id)
    assert got["q1"][0] == "name" and "other" not in sum(got.values(), []) and "q4" not in got
    assert got["q2"][0] == "old" and got["q3"] == ["plate"] and got["q5"] == ["new"]
    outcomes, injected = recall.recall_adaptive(m, queries, NOW, sensitivities=["normal"])
    why = {r["query"]: r.stop_reason for r in outcomes.collect()}
    assert why["q1"] == "coverage-satisfied" and why["q3"] == "abstain-low-confidence" and "q4" not in why
    assert {(r["query"], r.id, r.citation) for r in injected.collect() if r["query"] == "q1"} == {("q1", "name", "M1")}
    linear = recall.recall(m, queries, NOW, top_k=1, fusion="linear")
    assert {r["query"]: r.id for r in linear.collect()}["q1"] == "name"


def test_episode_neighbours_share_a_message(spark):
    queries = spark.createDataFrame([("q", "我们聊过我的名字小明", "u", "default")], "query string, text string, owner string, agent string")
    rows = recall.features(memories(spark), recall.plan(queries, NOW), NOW)
    assert {r.id for r in rows.filter("is_episode").collect()} == {"name", "pet"}


def test_isotonic_blocks(spark):
    rows = [("c", 0.1, 0), ("c", 0.2, 1), ("c", 0.3, 0), ("c", 0.4, 1), ("c", 0.4, 1), ("d", 0.5, 1)]
    got = stats.isotonic_blocks(spark.createDataFrame(rows, "cohort string, s double, y int"), "cohort", "s", "y").orderBy("cohort", "low").collect()
    assert [(r.cohort, r.low, r.high, r.positive, r.n) for r in got] == [("c", 0.1, 0.1, 0, 1), ("c", 0.2, 0.3, 1, 2), ("c", 0.4, 0.4, 2, 2), ("d", 0.5, 0.5, 1, 1)]


def test_tiers_keep_budgets(spark):
    rows = [(i, round(1 - i / 100, 4), i % 10 == 0, 3 if i == 7 else 0) for i in range(100)]
    got = {r.id: (r.tier, r.archive) for r in rollups.assign_tiers(spark.createDataFrame(rows, "id int, utility double, protected boolean, denied int"), hot=5, warm=20, cold=30).collect()}
    assert got[7] == ("quarantine", False) and [got[i][0] for i in range(6)] == ["hot"] * 5 + ["warm"]
    assert sum(x[0] == "warm" for x in got.values()) == 20 and got[90][0] == "warm" and got[99] == ("cold", True)
    assert sum(x == ("cold", False) for x in got.values()) == 30


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (6, 7), (9, 9)], "a int, b int")
    assert {r.node for r in integrity.cycles(edges, "a", "b").collect()} == {1, 2, 3, 9}


def test_near_duplicates_share_tokens_of_any_frequency(spark):
    rows = [(i, "k", ["the", f"p{i}", f"q{i}", f"r{i}"]) for i in range(600)] + [(700, "k", ["the"]), (701, "k", ["the", "x"]), (702, "other", ["the"])]
    got = rollups.blocked_near_duplicates(spark.createDataFrame(rows, "id int, kind string, tokens array<string>"))
    assert [tuple(r) for r in got.collect()] == [(700, 701, 0.5)]


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows, schema = [], "id int, kind string, tokens array<string>"
    for i in range(160):
        tokens = set(rng.sample([f"c{k}" for k in range(12)], rng.randrange(1, 9))) | {f"r{rng.randrange(90)}" for _ in range(rng.randrange(4))}
        rows += [(i, "xy"[i % 2], sorted(tokens)), (1000 + i, "x", sorted(tokens ^ set(rng.sample(["c1", "r1", "r2", "z"], 2))))]
    rows += [(3000, "x", []), (3001, "x", [f"alone{i}" for i in range(5)])]
    for threshold, block in ((0.0, 1), (0.3, 2), (0.5, 3), (2 / 3, 3), (0.8, 3), (1.0, 3)):
        classes = {}
        for i, kind, tokens in rows:
            classes[kind, tuple(tokens)] = min(i, classes.get((kind, tuple(tokens)), i))
        df = Counter((kind, t) for kind, tokens in classes for t in tokens)
        key = {(k, ts): set(sorted((t for t in ts if df[k, t] > 1), key=lambda t: (df[k, t], t))[:block]) for k, ts in classes}
        want = set()
        for (k, x), a in classes.items():
            for (other, y), b in classes.items():
                if k == other and a < b and (key[k, x] & set(y) or key[k, y] & set(x)):
                    similarity = round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
                    if similarity >= threshold:
                        want.add((a, b, similarity))
        got = [tuple(r) for r in rollups.blocked_near_duplicates(spark.createDataFrame(rows, schema), threshold, block).collect()]
        assert len(got) == len(want) and set(got) == want, threshold


def test_sets_that_cannot_be_near_do_not_meet(spark):
    """All share their rarest shared token, and no two of them more."""
    rows = [(i, "k", ["the", *[f"{i}-{k}" for k in range(5)]]) for i in range(300)] + [(900, "k", ["the", "0-0", "0-1", "0-2", "0-3"])]
    sets = rollups.ranked_sets(spark.createDataFrame(rows, "id int, kind string, tokens array<string>"))
    assert {tuple(r) for r in rollups.meeting_pairs(sets, 0.5, 3).collect()} == {(0, 900)}


def test_pairs_of_a_group_of_near_copies_are_not_dealt_out(spark, monkeypatch):
    """400 sets, all near each other: what is dealt out by key follows the sets, not their 79 800 pairs."""
    dealt, frame = [], type(spark.range(0))
    whole = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(self) or whole(self, *a))
    rows = [(i, "k", [*(f"c{k}" for k in range(10)), f"p{i % 20}", f"q{i // 20}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, kind string, tokens array<string>")
    assert rollups.blocked_near_duplicates(df).count() == 400 * 399 // 2
    assert dealt and max(x.count() for x in dealt) <= 20 * len(rows)
    monkeypatch.setattr(rollups, "MEETING", 64)
    assert rollups.blocked_near_duplicates(df).distinct().count() == 400 * 399 // 2


def test_near_duplicates_do_not_depend_on_what_is_told_to_all(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, "xy"[i % 2], sorted(rng.sample([f"c{k}" for k in range(14)], rng.randrange(1, 6)))) for i in range(120)]
    df = spark.createDataFrame([*rows, *rows[:9], *((500 + i, k, t) for i, k, t in rows[:40])], "id int, kind string, tokens array<string>")
    want = {tuple(r) for r in rollups.blocked_near_duplicates(df).collect()}
    for name, most in (("FREQUENT", 4), ("MOST_TOLD", 0), ("MEETING", 3), ("PAIRS_AT_ONCE", 5)):
        monkeypatch.setattr(rollups, name, most)
    got = [tuple(r) for r in rollups.blocked_near_duplicates(df).collect()]
    assert want and len(got) == len(want) and set(got) == want and max(max(a, b) for a, b, _ in got) < 120


def test_limits_are_held_within_their_bounds():
    rows = [(f"m{i}", f"fact number {i} about topic{i}", 1.0) for i in range(40)]
    ids, seen, batches, why = ranking.select_adaptively("你还记得我哪些事情", rows, initial=99, continuation=0, max_injected=99, max_batches=99)
    assert (len(ids), seen, batches, why) == (19, 19, 10, "max-batches")


def test_long_cycles(spark):
    ring = [(i, (i + 1) % 1000) for i in range(1000)]
    edges = spark.createDataFrame([*ring, *[(2000 + i, 2001 + i) for i in range(90)], (3000, 5), (5000, 5001)], "a int, b int")
    assert {r.node for r in integrity.cycles(edges, "a", "b").collect()} == set(range(1000))
    assert integrity.cycles(edges.filter("a >= 5000"), "a", "b").count() == 0


def test_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xxy"), rng.randrange(9), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int, w int")
    order = [F.col("v").desc(), F.col("i")]
    got = {r.i: r.s for r in prefix.sums_before(prefix.by_ranges(df, ["g"], order), ["g"], order, {"s": F.col("w")}).collect()}
    place = lambda r: (-r[1], r[2])
    assert got == {r[2]: sum(o[3] for o in rows if o[0] == r[0] and place(o) < place(r)) for r in rows}
