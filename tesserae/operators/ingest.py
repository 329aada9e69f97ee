"""From messages to facts: clauses, rule extraction, normalised keys, and the verifier's decision."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scoring
from tesserae.functions import text as t
from tesserae.functions.regex import ascii_borders, held_by
from tesserae.operators import filters

#: Extraction rules as (kind, label, key, cardinality, pattern with one group). _V: a value up to the next punctuation.
_V = r"[^，。！？,.!?\n]"
_S = r"[^。！？.!?\n]"
RULES: tuple[tuple[str, str, str | None, str, str], ...] = (
    ("identity", "用户姓名/名字", "profile.name", "single", rf"(?:我叫|我的(?:名字|姓名)是)\s*({_V}{{1,40}})"),
    ("identity", "用户希望的称呼", "profile.preferred_name", "single", rf"(?:请)?(?:叫我|称呼我(?:为)?)\s*({_V}{{1,40}})"),
    ("identity", "用户生日", "profile.birthday", "single", rf"(?:我的生日是|我生日是)\s*({_S}{{1,80}})"),
    ("identity", "用户希望的称呼", "profile.preferred_name", "single", rf"(?:大家|朋友们?|同事们?|别人)(?:一般|平时|通常)?(?:都)?(?:叫|喊|称呼)我\s*({_V}{{1,40}})"),
    ("identity", "用户希望的称呼", "profile.preferred_name", "single", rf"(?:大伙|伙伴们?)(?:一般|平时|平常|通常)?(?:都)?(?:叫|喊|称呼)我\s*({_V}{{1,40}})"),
    ("identity", "用户希望的称呼", "profile.preferred_name", "single", rf"({_V}{{1,40}})是我(?:常用|平时用|习惯用)的?(?:昵称|称呼)"),
    ("preference", "用户喜好/偏好", None, "multiple", rf"我(?:最)?(?:喜欢|偏好)\s*({_S}{{1,200}})"),
    ("preference", "用户喜好/偏好", None, "multiple", rf"也(?:喜欢|偏好)\s*({_S}{{1,200}})"),
    ("preference", "用户不喜欢", None, "multiple", rf"我(?:不喜欢|讨厌)\s*({_S}{{1,200}})"),
    ("project", "用户当前项目", "project.current", "single", rf"我(?:正在|在)(?:做|开发|研究|进行)\s*({_S}{{1,200}})"),
    ("preference", "用户喜好/偏好", None, "multiple", rf"({_V}{{1,80}})是我的最爱"),
    ("preference", "用户喜好/偏好", None, "multiple", rf"比起{_V}{{1,80}}我(?:更爱|更喜欢|更偏好)\s*({_V}{{1,100}})"),
    ("health", "用户过敏信息", "health.allergy", "multiple", rf"我对\s*({_V}{{1,80}})\s*过敏"),
    ("health", "用户健康信息", "health.condition", "multiple", rf"医生说我(?:有|患有)\s*({_V}{{1,100}})"),
    ("relationship", "用户宠物名字", "relationship.pet_name", "multiple", rf"我家(?:的)?(?:猫咪|猫|狗狗|狗|宠物)(?:的)?(?:名字)?(?:叫|是)\s*({_V}{{1,60}})"),
    ("relationship", "用户宠物名字", "relationship.pet_name", "multiple", rf"我的(?:猫咪|猫|狗狗|狗|宠物)(?:的)?(?:名字)?(?:叫|是)\s*({_V}{{1,60}})"),
    ("identity", "用户所在地", "profile.location", "single", rf"我(?:现在|目前|现)?住在\s*({_V}{{1,100}})"),
    ("identity", "用户所在地", "profile.location", "single", rf"(?:我的)?(?:常住地|居住地|所在地)(?:是|在)\s*({_V}{{1,100}})"),
    ("identity", "用户所在地", "profile.location", "single", r"(?:我)?搬(?:来|到)\s*([^\W\d_]{1,30})(?=(?:已经|有|[，,])).{0,40}(?:现在|目前|如今)(?:仍|还)(?:住|生活)"),
    ("identity", "用户职业", "profile.occupation", "single", rf"我的职业是\s*({_V}{{1,80}})"),
    ("identity", "用户职业", "profile.occupation", "single", rf"职业方面[，,]?(?:我)?(?:是|做|从事)\s*({_V}{{1,80}})"),
    ("identity", "用户职业", "profile.occupation", "single", rf"^(?:白天|晚上|目前|现在)?(?:我)?在{_V}{{1,30}}(?:当|做)\s*({_V}{{1,80}})"),
    ("routine", "用户工作时间偏好", None, "multiple", rf"我通常\s*({_V}{{1,40}})(?:工作|办公)"),
    ("identity", "用户车牌", "profile.vehicle_plate", "multiple", r"我的车牌(?:号)?是\s*([^\W_](?:[^\W_]|-){3,19})"),
    ("relationship", "用户伴侣姓名", "relationship.partner_name", "single", rf"我的(?:妻子|丈夫|伴侣|爱人)叫\s*({_V}{{1,60}})"),
    ("goal", "用户目标", "goal.current", "multiple", rf"我(?:今年)?的目标是\s*({_V}{{1,160}})"),
    ("goal", "用户目标", "goal.current", "single", rf"(?:今年|明年|未来(?:一年)?)(?:的)?(?:打算|计划|目标)(?:是|为)?\s*({_V}{{1,160}})"),
    ("identity", "用户电脑设备", "profile.computer", "multiple", rf"我的电脑是\s*({_V}{{1,100}})"),
    ("contact", "用户联系电话", "profile.phone", "single", rf"我的(?:手机号|手机号码|电话号码|联系电话)是\s*({_V}{{5,40}})"),
    ("contact", "用户邮箱", "profile.email", "single", r"我的邮箱(?:地址)?是\s*([^，。！？,!?\n\s]+@[\w.-]+\.[a-z]{2,})"),
    ("preference", "用户常喝饮品", None, "multiple", rf"(?:饮料|饮品)(?:里|方面)?(?:我)?(?:通常|一般|平常)?(?:会)?(?:选|选择|喝)\s*({_V}{{1,100}})"),
    ("preference", "用户常喝饮品", None, "multiple", rf"(?:我)?(?:通常|一般|平常|经常)(?:会)?(?:喝|选择|选)\s*({_V}{{1,100}})"),
    ("preference", "用户不喜欢", None, "multiple", rf"(?:吃饭|点菜).{{0,20}}除了\s*({_V}{{1,50}})\s*以外(?:我)?都可以"),
    ("project", "用户当前项目", "project.current", "single", rf"(?:最近|目前|现在)(?:我)?(?:在|正|正在)?(?:筹备|准备|推进)\s*({_V}{{1,200}})"),
    ("relationship", "用户宠物名字", "relationship.pet_name", "multiple", rf"家里有(?:一)?只{_V}{{1,30}}[，,]\s*(?:名字)?叫\s*({_V}{{1,60}})"),
    ("relationship", "用户伴侣姓名", "relationship.partner_name", "single", rf"我(?:对象|另一半)叫\s*({_V}{{1,60}})"),
    ("health", "用户过敏信息", "health.allergy", "multiple", rf"^({_V}{{1,50}})(?:会|容易)(?:让|使)我.{{0,50}}(?:过敏|起疹子|呼吸困难|肿胀)"),
    ("preference", "用户回答偏好", "preference.response_style", "single", rf"(?:回答|回复)(?:请|要|应该|尽量)?(?:控制在|保持在)\s*({_V}{{1,80}}?)(?:以内|之内)"),
    ("preference", "用户回答偏好", "preference.response_style", "single", rf"(?:回答|回复)(?:时)?(?:请|要|应该)?先\s*({_V}{{1,80}})"),
    ("identity", "用户惯用手", "profile.handedness", "single", r"我是\s*(左撇子|右撇子)"),
    ("preference", "用户喜欢的颜色", "preference.color", "single", rf"(?:买衣服|选衣服|挑衣服)(?:时)?(?:我)?(?:会)?优先(?:选择|选)\s*({_V}{{1,60}})"),
    ("identity", "用户就读院校", "profile.education", "single", rf"(?:本科|硕士|博士)(?:阶段)?(?:就读|毕业)于\s*({_V}{{1,100}})"),
    ("identity", "用户常用编程语言", "profile.programming_language", "single", r"(?:日常|平时)(?:写代码|编程)(?:时)?(?:主要)?(?:会)?用\s*((?:[^\W_]|[+#.-]){1,40})"),
    ("identity", "用户常用编程语言", "profile.programming_language", "single", r"(?:我)?(?:日常|平时)(?:主要)?用\s*(Rust|Python|TypeScript|JavaScript|Java|C\+\+|C#|Go)(?=[，。！？,.!?\s]|$)"),
    ("identity", "User name", "profile.name", "single", r"\bmy name is\s+([^,.!?\n]{1,60})"),
    ("identity", "Preferred form of address", "profile.preferred_name", "single", r"\bcall me\s+([^,.!?\n]{1,60})"),
    ("preference", "User preference", None, "multiple", r"\bi (?:prefer|like)\s+([^.!?\n]{1,200})"),
    ("preference", "User dislikes", None, "multiple", r"\bi (?:dislike|hate)\s+([^.!?\n]{1,200})"),
    ("identity", "User location", "profile.location", "single", r"\bi (?:am based|live) in\s+([^,.!?\n]{1,100})"),
    ("identity", "User occupation", "profile.occupation", "single", r"\bi work as\s+(?:an?\s+)?([^,.!?\n]{1,80})"),
    ("relationship", "User pet name", "relationship.pet_name", "multiple", r"\bmy (?:dog|cat|pet)(?:'s name)? is\s+([^,.!?\n]{1,60})"),
    ("routine", "User weekend routine", "routine.weekend", "multiple", r"\bon weekends? i (?:usually|normally|often) (?:go )?([^.!?\n]{1,100})"),
    ("health", "User allergy", "health.allergy", "multiple", r"([^.!?\n]{1,80}) (?:give|gives) me (?:an? )?(?:serious )?allergic reaction"),
    ("preference", "User usual drink", None, "multiple", r"([^.!?\n]{1,80}) is my usual drink"),
    ("identity", "User location", "profile.location", "single", r"([^.!?\n]{1,80}) has been home for (?:the )?(?:last|past) [^.!?\n]{1,60}"),
)
#: Rules whose content is put together from several groups, as (kind, label, key, cardinality, pattern, form of the value).
COMPOSED: tuple[tuple[str, str, str, str, str, str], ...] = (
    ("routine", "用户固定安排", "routine.weekly", "multiple", rf"(?:我)?每周([一二三四五六日天1-7])(?:我)?(?:都会|会|通常)?(?:去)?\s*({_V}{{1,80}})", "每周{0}{1}"),
    ("routine", "用户固定安排", "routine.weekend", "multiple", rf"(?:我)?(周末|周[六日天])(?:早上|上午|下午|晚上)?(?:我)?(?:都会|会|通常)?固定(?:去)?\s*({_V}{{1,80}})", "{0}{1}"),
    ("routine", "用户缴房租日期", "routine.rent_day", "single", r"(?:我)?每个?月\s*([一二三四五六七八九十百〇零两\d]{1,4})\s*(?:日|号)(?:我)?(?:交|付|缴)(?:纳)?房租", "每月{0}号"),
)
#: An express wish that something be remembered.
EXPLICIT = r"(?:请记住|记住)[：:，,\s]*(?:这件事[：:，,\s]*)?([^。！？.!?\n]{2,300})|\bremember(?: that)?\s+([^.!?\n]{2,300})"
#: Corrections that are understood although they deny something: a name, a move, and a stay since a move.
RENAMED = r"(?:我的(?:名字|姓名))(?:不是)\s*[^，。！？,.!?]{1,40}[，,]\s*(?:而是|是)\s*([^，。！？,.!?]{1,40})"
MOVED = r"我(?:以前|过去|曾经)住(?:在)?\s*([^，。！？,.!?]{1,80})[，,]\s*(?:我)?(?:现在|目前|如今)住(?:在)?\s*([^，。！？,.!?]{1,80})"
SETTLED = r"(?:我)?搬(?:来|到)\s*([^\W\d_]{1,30})(?=(?:已经|有|[，,])).{0,60}(?:现在|目前|如今)(?:仍|还)(?:住|生活)(?:在)?(?:这里|当地|这儿)?"
#: What isn't told as a fact: suppositions, fiction, denials, the past against the present.
NON_FACTUAL = (
    r"^(?:如果|假如|假设|假定|要是)",
    r"(?:小说|电影|故事|角色|他说|她说|别人说|你(?:刚才)?说).{0,100}(?:我叫|我的(?:名字|姓名)|我喜欢|我住在)",
    r"(?:不是真的|并非事实|那是错的|说错了)",
    r"(?:以前|过去|曾经).{0,120}(?:现在|如今|目前)",
    r"(?:十年前|[一二三四五六七八九十百〇零两\d]+年前|以前|过去|曾经).{0,120}(?:后来|之后).{0,80}(?:转行|不再|已经不是|已经停止)",
)
#: Denials of a name, requests about a text, role play, and speech of others.
DENIED = r"(?:我不叫|我的(?:名字|姓名)不是|我并不叫)"
ABOUT_TEXT = (
    r"^(?:请)?(?:翻译|把.{0,100}翻译|举(?:个)?例(?:子)?|举例|例如|比如|示例)(?:这句|如下|是)?[：:，,\s]",
    r"^(?:角色扮演|扮演角色|假想场景|虚构设定|在(?:小说|故事|电影|游戏)中)",
    r"(?:^|[，。！？,.!?])(?!(?:我|医生)说)(?:他|她|他们|她们|别人|朋友|同事|[^\W_]{2,16})说[“\"'‘’]?(?:我|我的)",
)
#: What holds for the moment only, questions, and where clauses end.
TRANSIENT = (
    r"(?:我喜欢|我偏好)\s*(?:今天的天气|(?:你)?刚才的(?:回答|回复|结果|表现)|这次的(?:回答|回复|结果|体验))",
    r"(?:刚才|临时|暂时|这(?:两|几|\d+)(?:秒|分钟|小时)).{0,40}(?:我)?(?:在|正在)(?:做|进行|测试)",
)
ASKING = r"^(?:请问|能否|可否|为什么|怎么|怎样)"
QUESTION_END = r"(?:吗|么|呢)\s*[？?]?\Z|[？?]\s*\Z"
CLAUSE_END = r"[。！？!?;；\n]+"
CLAUSE_COMMA = r"[，,](?=\s*(?:我|我的|你|您|请问|请|记住|别忘了|每周|平时|通常|现在|也|而且|同时|I\b|My\b|Call\b|Remember\b))"


def _compiled(*patterns: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{ascii_borders(p)})" for p in patterns), re.I)


_UNSAFE, _SECRET = _compiled(*filters.INJECTION), _compiled(*filters.SECRET)
_IGNORED_TEXT, _IGNORED_UNLESS_CORRECTED = _compiled(*ABOUT_TEXT), _compiled(*NON_FACTUAL, DENIED)
_IGNORED_CLAUSE, _ASKED = _compiled(*NON_FACTUAL, *TRANSIENT, ASKING), _compiled(QUESTION_END)
_RENAMED, _MOVED, _SETTLED, _REMEMBER, _ENDS, _COMMAS = (re.compile(ascii_borders(p), re.I) for p in (RENAMED, MOVED, SETTLED, EXPLICIT, CLAUSE_END, CLAUSE_COMMA))
#: Each rule with texts of which every match of it holds one (in lower case), if any are known.
_COMPILED = [(kind, label, key, card, re.compile(ascii_borders(p), re.I), "{0}", held_by(p)) for kind, label, key, card, p in RULES]
_COMPILED += [(kind, label, key, card, re.compile(p), form, held_by(p)) for kind, label, key, card, p, form in COMPOSED]
#: Other forms of i and s, which a pattern that passes over case takes for them.
_FORMS = str.maketrans("İıſ", "iis")


def _clean(value: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value or "").strip().strip("“”\"'‘’")).strip()


def clauses_of(text: str) -> list[str]:
    """Clauses between terminators; a comma ends one only before a cue of the speaker."""
    return [c for c in (c.strip() for c in _COMMAS.sub("\n", _ENDS.sub("\n", text)).split("\n")) if c]


def is_ignored(text: str) -> bool:
    """Whether a message tells no facts of its sender: a text to work on, others' words, fiction, a denial, or questions only."""
    corrects = _RENAMED.search(text) or _MOVED.search(text)
    return bool(_IGNORED_TEXT.search(text) or (not corrects and _IGNORED_UNLESS_CORRECTED.search(text)) or all(_ASKED.search(c) for c in clauses_of(text)))


class Fact(NamedTuple):
    kind: str
    content: str
    key: str | None
    cardinality: str
    importance: float = 0.8
    confidence: float = 0.9
    intent: str = ""
    valid_from: int | None = None
    valid_to: int | None = None


def _corrections(text: str, now: int) -> Iterator[Fact]:
    """What a correction tells: the new name; the place of before, until now, and that of now, from now on."""
    if m := _RENAMED.search(text):
        yield Fact("identity", f"用户姓名/名字：{_clean(m[1])}", "profile.name", "single", 0.9, 0.95, "correction")
    if m := _SETTLED.search(text):
        yield Fact("identity", f"用户所在地：{_clean(m[1])}", "profile.location", "single", 0.9, 0.95, "correction")
    if m := _MOVED.search(text):
        yield Fact("identity", f"用户所在地：{_clean(m[1])}", "profile.location", "single", 0.8, 0.9, "historical", 1, now)
        yield Fact("identity", f"用户所在地：{_clean(m[2])}", "profile.location", "single", 0.9, 0.95, "correction", now, None)


def _told(clause: str) -> Iterator[Fact]:
    """What the rules find in a clause; where none does, what it expressly asks to remember."""
    hit, low = False, clause.translate(_FORMS).lower()
    for kind, label, key, card, pattern, form, held in _COMPILED:
        if (not held or any(h in low for h in held)) and (m := pattern.search(clause)):
            groups = [_clean(g) for g in m.groups()]
            if all(groups) and not _UNSAFE.search(groups[-1]):
                hit = True
                yield Fact(kind, f"{label}：{form.format(*groups)}", key, card)
    if not hit and (m := _REMEMBER.search(clause)) and (asked := _clean(m[1] or m[2])):
        yield Fact("explicit", f"用户明确希望记住：{asked}", None, "multiple", 0.95, 0.9)


def facts_of(message: str | None, now: int = 0) -> list[Fact]:
    """The facts that the rules find in a message; each content once, in the place of its first and with the values of its last."""
    text = re.sub(r"\s*[\x00-\x09\x0b-\x1f\x7f]+\s*", " ", unicodedata.normalize("NFKC", message or "")).strip()[:100_000]
    if not text or _UNSAFE.search(text) or _SECRET.search(text) or is_ignored(text):
        return []
    told = [*_corrections(text, now), *(f for c in clauses_of(text) if not _IGNORED_CLAUSE.search(c) for f in _told(c))]
    return list({f.content.lower(): f for f in told if f.content.split("：", 1)[1] and not _UNSAFE.search(f.content) and not _SECRET.search(f.content)}.values())


def extract(messages: DataFrame, id_col: str, text_col: str, now: int = 0) -> DataFrame:
    """message, pos and the columns of Fact: one row for each fact found. ``now`` is the moment of the write."""
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    columns = ["message", "pos", *Fact._fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, pos, *fact) for i, text in zip(batch[id_col], batch[text_col], strict=True) for pos, fact in enumerate(facts_of(text, now))]
            found = pd.DataFrame(rows, columns=columns)
            yield found.astype({"valid_from": "Int64", "valid_to": "Int64"})

    schema = f"message {kinds[id_col]}, pos int, kind string, content string, key string, cardinality string, importance double, confidence double, intent string, valid_from long, valid_to long"
    return messages.select(id_col, text_col).mapInPandas(run, schema)


def confirmed_preference(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Preferences that a user confirms with a bare yes: taken from the assistant's last message before."""
    from pyspark.sql import Window

    before = F.last(F.when(F.col(role) == "assistant", F.col(text)), ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    yes = F.col(text).rlike(r"(?i)^(?:是的|对(?:的)?|没错|确实|可以这么说|yes|correct|that's right)[。！!.\s]*\z")
    asked = F.regexp_extract("asked_", r"(?i)(?:(?:你|您)(?:是)?(?:喜欢|偏好)|(?:do you|you) (?:like|prefer))\s*([^，。！？,.!?吗]{1,100})", 1)
    return turns.withColumn("asked_", before).filter(F.col(role) == "user").filter(yes).withColumn("value", F.trim(asked)).filter("value <> ''").select(session, order, F.concat(F.lit("用户喜好/偏好："), "value").alias("content"))


#: How lasting facts of a kind are; facts of other kinds count as "other".
DURABILITY = {
    "explicit": 1.0, "identity": 0.95, "relationship": 0.92, "health": 0.92, "routine": 0.9, "preference": 0.82, "goal": 0.78, "project": 0.72, "contact": 0.85, "image": 0.65, "other": 0.55,
}
#: Wordings of a passing state, which projects and goals may have; and values that name nothing.
PASSING = r"(?:刚才|临时|暂时|这(?:两|几|\d+)(?:秒|分钟|小时))|(?:今天的天气|刚才的(?:回答|回复)|这次的(?:回答|回复|结果))|\b(?:just now|temporarily|for the next few (?:minutes|hours))\b"
VAGUE = r"^(?:这个|那个|它|这里|那里|这样|那样|某个|东西|事情|this|that|it|something)$"
HIGH_RISK = r"^(?:profile\.(?:phone|email|vehicle_plate)|health\..*|contact\..*)$"


def durability(kind: Column, importance: Column, transient: Column, expires: Column | None = None, now: Column | None = None) -> Column:
    """How lasting a fact is; a passing state costs 0.45, an end within a day 0.35 and within a week 0.2."""
    lasting = F.lit(DURABILITY["other"])
    for name, value in DURABILITY.items():
        lasting = F.when(kind == name, value).otherwise(lasting)
    soon = F.lit(0.0) if expires is None else F.when(expires - now <= scoring.DAY_MS, 0.35).when(expires - now <= 7 * scoring.DAY_MS, 0.2).otherwise(0.0)
    return scoring.clamp(importance * 0.55 + lasting * 0.45 - F.when(transient, 0.45).otherwise(0.0) - soon)


def is_passing(kind: Column, source: Column) -> Column:
    return F.coalesce(source.rlike("(?i)" + ascii_borders(PASSING)) & ~kind.isin("project", "goal"), F.lit(False))


def ambiguity(content: Column, key: Column, cardinality: Column) -> Column:
    """How many things about a fact are unclear: a value that names nothing, and a single value without a key."""
    value = F.trim(t.candidate_value(content))
    vague = F.coalesce((value == "") | value.rlike("(?i)" + VAGUE), F.lit(True))
    return vague.cast("int") + F.coalesce((cardinality == "single") & (F.coalesce(F.trim(key), F.lit("")) == ""), F.lit(False)).cast("int")


def evidence(channel: Column, content: Column, source: Column) -> Column:
    """How well the source supports the content: sure for rules, less for what only shares words with it."""
    value, told = t.comparable(t.candidate_value(content)), t.comparable(source)
    asked = t.semantic_tokens(value)
    shared = F.size(F.array_intersect(asked, t.semantic_tokens(told))) / F.greatest(F.lit(1), F.size(asked))
    words = F.when((F.coalesce(value, F.lit("")) == "") | (F.coalesce(told, F.lit("")) == ""), 0.0).when(F.contains(told, value), 1.0).when(F.size(asked) == 0, 0.0).otherwise(F.round(F.least(F.lit(0.85), F.lit(0.15) + shared * 0.7), 4))
    return F.when(channel == "image", 0.95).when(channel == "context-confirmation", 0.92).when(channel.isin("rules", "rules+model"), 0.98).otherwise(words)


def decide(extraction: Column, evidence_: Column, durability_: Column, flags: Column, key: Column, asserted: Column, matches: Column) -> Column:
    """The write action. matches: struct(exact_status, exact_only, key_value_same, key_exists, historical, refines, correction)."""
    verification = scoring.verification(extraction, evidence_, durability_, flags)
    m = lambda name: F.coalesce(matches[name], F.lit(False))
    return (
        F.when(~asserted, "NOOP")
        .when(durability_ < 0.45, "NOOP")
        .when((extraction < 0.55) | (evidence_ < 0.62) | (verification < 0.72) | (flags > 0), "QUARANTINE")
        .when(F.coalesce(key.rlike(HIGH_RISK), F.lit(False)), "QUARANTINE")
        .when(matches["exact_status"].isin("suppressed", "deleted"), "NOOP")
        .when((matches["exact_status"] == "active") & m("exact_only"), "MERGE_EVIDENCE")
        .when(m("key_value_same"), "MERGE_EVIDENCE")
        .when(m("key_exists") & m("historical"), "ADD")
        .when(m("key_exists") & m("refines") & (extraction >= 0.8) & (evidence_ >= 0.85), "REFINE")
        .when(m("key_exists") & m("correction"), "SUPERSEDE")
        .when(m("key_exists"), "CONFLICT")
        .otherwise("ADD")
    )


#: Other names of predicates, and predicates that hold one value or a set.
PREDICATE_ALIASES = {
    "name": "profile.name", "user.name": "profile.name", "nickname": "profile.preferred_name", "location": "profile.location", "city": "profile.location",
    "occupation": "profile.occupation", "job": "profile.occupation", "birthday": "profile.birthday", "allergy": "health.allergy", "project": "project.current", "pet": "relationship.pet_name",
}
SINGLE_PREDICATES = (
    "profile.name", "profile.preferred_name", "profile.location", "profile.occupation", "profile.birthday", "profile.handedness", "profile.email", "profile.phone",
    "relationship.partner_name", "project.current", "preference.response_style",
)
SET_PREDICATES = ("health.allergy", "health.condition", "preference.like", "preference.dislike")
#: Wordings of polarity, modality and condition.
NEGATIVE, POSITIVE = r"不喜欢|讨厌|不能吃|避免|过敏|\bdislike\b|\bhate\b", r"喜欢|偏爱|偏好|最爱|\bprefer\b|\blike\b"
HYPOTHETICAL = r"^(?:如果|假如|假设|要是)|\b(?:if|suppose|assuming)\b"
REPORTED = r"(?:他说|她说|朋友说|同事说)|\b(?:he|she|they) said\b"
PLANNED = r"(?:计划|打算|目标|准备)|\b(?:plan|intend|goal)\b"
CONDITION = r"(?:当|每当)([^，。！？,.!?]{1,80})(?:时|的时候)|([^，。！？,.!?]{1,80}时)(?:我)?"


def normalized(facts: DataFrame) -> DataFrame:
    """Adds predicate, normalized_value, polarity, modality, condition and set_cardinality to facts (kind, content, key, cardinality, source: the message).

    A key or kind under another name gets its proper one; some predicates hold one value, or a set, whatever was said.
    """
    told = lambda c, pattern: F.coalesce(c.rlike("(?i)" + ascii_borders(pattern)), F.lit(False))
    present = lambda c: F.when(F.trim(c) != "", F.trim(c))
    incoming = F.lower(F.coalesce(present(F.col("key")), present(F.col("kind")), F.lit("memory.fact")))
    aliases = F.create_map(*[F.lit(x) for pair in PREDICATE_ALIASES.items() for x in pair])
    source = F.coalesce("source", "content")
    condition = F.coalesce(*[F.when(F.regexp_extract("source", CONDITION, k) != "", F.trim(F.regexp_extract("source", CONDITION, k))) for k in (1, 2)])
    rows = facts.withColumn("predicate", F.coalesce(aliases[incoming], incoming))
    return rows.withColumns(
        {
            "normalized_value": t.normalized_value(F.trim(F.regexp_replace("content", r"^[^:：]{1,80}[:：]\s*", "")), F.col("predicate")),
            "polarity": F.when(told(F.col("content"), NEGATIVE), "negative").when(told(F.col("content"), POSITIVE), "positive").otherwise("unknown"),
            "modality": F.when(told(source, HYPOTHETICAL), "hypothetical").when(told(source, REPORTED), "reported").when(told(F.col("content"), PLANNED), "planned").otherwise("asserted"),
            "condition": condition,
            "set_cardinality": F.when(F.col("predicate").isin(*SINGLE_PREDICATES), "single")
            .when(F.col("predicate").isin(*SET_PREDICATES), "set")
            .when(F.col("cardinality").isin("single", "set"), F.col("cardinality"))
            .otherwise("multiple"),
        }
    )


def matched(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``matches`` for ``decide`` to facts (fact, scope, content, key, intent): what rows of the store (scope, content, key, status) they meet.

    Contents meet in lower case, keys among active rows of the scope; both joins are by equality.
    """
    value = lambda c: F.lower(t.candidate_value(c))
    exact = stored.groupBy("scope", F.lower("content").alias("same_")).agg(F.max_by("status", F.col("status") == "active").alias("exact_status"))
    rows = facts.withColumn("same_", F.lower("content")).join(exact, ["scope", "same_"], "left")
    old = stored.filter("status = 'active' and key is not null").select("scope", "key", F.col("content").alias("old_"))
    keyed = facts.select("fact", "scope", "key", "content").join(old, ["scope", "key"])
    a, b = value(F.col("content")), value(F.col("old_"))
    other = F.lower("content") != F.lower("old_")
    by_key = keyed.groupBy("fact").agg(F.bool_or(a == b).alias("same"), F.bool_or(t.refines(a, b)).alias("refines"), F.bool_or(other).alias("others"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(by_key, "fact", "left")
    off = lambda c: F.coalesce(c, F.lit(False))
    matches = F.struct(
        F.col("exact_status"), (~off(F.col("others"))).alias("exact_only"), off(F.col("same")).alias("key_value_same"), off(F.col("n") > 0).alias("key_exists"),
        off(F.col("intent") == "historical").alias("historical"), off(F.col("refines")).alias("refines"), off(F.col("intent") == "correction").alias("correction"),
    )
    return rows.select(*[F.col(c) for c in facts.columns], matches.alias("matches"))


def verify(facts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``facts`` of ``extract`` with durability, verification and action, against the ``stored`` rows (scope, content, key, status).

    With a store, facts have a scope. A fact whose action can't be told is put aside for review.
    """
    sure = F.lit(0.98)
    lasting = durability(F.col("kind"), F.col("importance"), F.lit(False))
    told = facts.withColumns({"durability": F.round(lasting, 6), "verification": F.round(scoring.verification(F.col("confidence"), sure, lasting, F.lit(0)), 6)})
    if stored is None:
        stored = facts.sparkSession.createDataFrame([], "scope string, content string, key string, status string")
        told = told.withColumn("scope", F.lit(""))
    rows = matched(told.withColumn("fact", F.concat_ws("#", F.col("message").cast("string"), F.col("pos").cast("string"))), stored)
    action = decide(F.col("confidence"), sure, F.col("durability"), F.lit(0), F.col("key"), F.lit(True), F.col("matches"))
    return rows.withColumn("action", F.coalesce(action, F.lit("QUARANTINE"))).select(*facts.columns, "durability", "verification", "action")


def segments(text: Column, limit: int = 1800) -> Column:
    """A long message in parts of at most ``limit`` characters (256 to 6000), cut at the ends of sentences; a longer sentence is cut hard."""
    limit = max(256, min(6000, limit))

    def pack(value: str | None) -> list[str]:
        value = re.sub(r"\s*[\x00-\x09\x0b-\x1f\x7f]+\s*", " ", unicodedata.normalize("NFKC", (value or "")[:100_000])).strip()
        if len(value) <= limit:
            return [value] if value else []
        sentences = [s.strip() for s in re.split(r"(?<=[。！？!?;；\n])", value)]
        out: list[str] = []
        for piece in (s[k : k + limit] for s in sentences for k in range(0, len(s), limit)):
            if out and len(out[-1]) + 1 + len(piece) <= limit:
                out[-1] += " " + piece
            else:
                out.append(piece)
        return out

    return F.pandas_udf(lambda texts: texts.map(pack), "array<string>")(text)


def captured(messages: DataFrame, id_col: str, text_col: str, sources_col: str, limit: int = 1800) -> DataFrame:
    """id, capture (an id that a repeated run makes again), segment, segments, text: one row for each part of a message."""
    laid = messages.select(id_col, t.stable_id(F.concat_ws("\x00", F.col(sources_col)), t.squeezed_lines(F.substring(F.col(text_col), 1, 100_000))).alias("capture"), segments(F.col(text_col), limit).alias("parts"))
    return laid.select(id_col, "capture", F.posexplode("parts").alias("segment", "text"), F.size("parts").alias("segments"))
