"""From messages to facts: what isn't told, what is, its normal form, and the verifier against stored rows."""

import re

import pytest
from pyspark.sql import functions as F

from tesserae.operators import ingest

NOW = 1_750_000_000_000


@pytest.mark.parametrize(
    "message",
    [
        "小明说我喜欢苹果", "翻译这句：我叫小明", "我喜欢今天的天气", "在小说中我叫李雷", "比如：我喜欢苹果", "我的名字不是小红", "我喜欢苹果吗？", "请问我叫什么", "要是我住在北京",
        "十年前我喜欢足球，后来转行", "他说我的名字是小红", "我喜欢刚才的回答", "临时我在做测试", "", None,
    ],
)
def test_nothing_is_told(message):
    assert ingest.facts_of(message, NOW) == []


@pytest.mark.parametrize(
    ("message", "facts"),
    [
        ("我每月5号交房租", [("用户缴房租日期：每月5号", "routine.rent_day", "single")]),
        ("我搬到上海已经三年，现在仍住在这里", [("用户所在地：上海已经三年", "profile.location", "single")]),
        ("我的名字不是小红，而是小明", [("用户姓名/名字：小明", "profile.name", "single")]),
        ("医生说我有高血压", [("用户健康信息：高血压", "health.condition", "multiple")]),
        ("我叫“小明”；我最喜欢爬山", [("用户姓名/名字：小明", "profile.name", "single"), ("用户喜好/偏好：爬山", None, "multiple")]),
        ("周末上午我固定去游泳", [("用户固定安排：周末游泳", "routine.weekend", "multiple")]),
        ("Remember that the door code changed", [("用户明确希望记住：the door code changed", None, "multiple")]),
    ],
)
def test_what_is_told(message, facts):
    assert [(f.content, f.key, f.cardinality) for f in ingest.facts_of(message, NOW)] == facts


def test_a_move_has_two_times():
    before, now = ingest.facts_of("我以前住在北京，现在住在上海", NOW)
    assert (before.content, before.intent, before.valid_from, before.valid_to) == ("用户所在地：北京", "historical", 1, NOW)
    assert (now.content, now.intent, now.valid_from, now.valid_to, now.confidence) == ("用户所在地：上海", "correction", NOW, None, 0.95)


def test_verifier_against_stored_rows(spark):
    store = [("u", "User name：Ann", "profile.name", "active"), ("u", "User location：Oslo", "profile.location", "active"), ("u", "User preference：tea", None, "deleted"), ("v", "User name：Bea", "profile.name", "active")]
    stored = spark.createDataFrame(store, "scope string, content string, key string, status string")
    said = [("u", "My name is Ann"), ("u", "My name is Bob"), ("u", "I live in Oslo East"), ("u", "I like tea"), ("v", "My name is Bea"), ("w", "My name is Ann"), ("u", "我的名字不是小红，而是小明")]
    messages = spark.createDataFrame([(str(i), text) for i, (_, text) in enumerate(said)], "id string, text string")
    scopes = spark.createDataFrame([(str(i), scope) for i, (scope, _) in enumerate(said)], "message string, scope string")
    got = ingest.verify(ingest.extract(messages, "id", "text", NOW).join(scopes, "message"), stored)
    assert {int(r.message): r.action for r in got.collect()} == {0: "MERGE_EVIDENCE", 1: "CONFLICT", 2: "REFINE", 3: "NOOP", 4: "MERGE_EVIDENCE", 5: "ADD", 6: "SUPERSEDE"}


def test_normal_forms(spark):
    rows = [
        ("identity", "用户所在地：上海市", "city", "multiple", "当我出差的时候我住上海市"),
        ("preference", "用户不喜欢：香菜", None, "multiple", "朋友说我不喜欢香菜"),
        ("identity", "用户常用编程语言：TS", "profile.programming_language", "single", None),
        ("goal", "plan: run a marathon", " ", "set", "if it works"),
    ]
    df = spark.createDataFrame(rows, "kind string, content string, key string, cardinality string, source string")
    got = [(r.predicate, r.normalized_value, r.polarity, r.modality, r.condition, r.set_cardinality) for r in ingest.normalized(df).collect()]
    assert got == [
        ("profile.location", "上海", "unknown", "asserted", "我出差的", "single"),
        ("preference", "香菜", "negative", "reported", None, "multiple"),
        ("profile.programming_language", "typescript", "unknown", "asserted", None, "single"),
        ("goal", "run a marathon", "unknown", "hypothetical", None, "set"),
    ]


def test_segments(spark):
    text = "。".join(f"第{i}句" + "话" * (i * 7 % 90) for i in range(60)) + "。" + "x" * 700 + "!end"
    df = spark.createDataFrame([("a", text, ["m1"]), ("b", "short\x01 one", ["m2"]), ("c", None, []), ("d", "", [])], "id string, text string, sources array<string>")
    rows = ingest.captured(df, "id", "text", "sources", 256).orderBy("id", "segment").collect()
    parts = [r.text for r in rows if r.id == "a"]
    assert all(len(p) <= 256 for p in parts) and re.sub(" ", "", "".join(parts)) == text and len({r.capture for r in rows}) == 2
    assert all(len(a) + 1 + len(re.split("(?<=[。!])", b.replace(" ", ""))[0][:256]) > 256 for a, b in zip(parts, parts[1:], strict=False))
    assert [r.text for r in rows if r.id == "b"] == ["short one"] and {r.id for r in rows} == {"a", "b"}
    assert df.select(ingest.segments(F.col("text"), 1).alias("s")).first().s == parts  # the limit is 256 at least
