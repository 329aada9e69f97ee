"""Text functions as column expressions. Only NFKC needs Python, as an Arrow-batched UDF.

Functions named ``*_tokens`` return arrays in the order of the text. They expect NFKC text; pass
``nfkc(col)`` where input may not be normalised.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.regex import ascii_borders, lowered, shows

HAN = r"[㐀-鿿]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC of each value; ASCII texts are passed through."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s 　]+", " "))


def normalize_content(text: Column, already_nfkc: bool = False) -> Column:
    """NFKC, control characters and white space squeezed to one space, at most 1000 characters."""
    text = text if already_nfkc else nfkc(text)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "), r"[\s 　]+", " ")), 1, 1000)


#: Fixed value: white space beyond ASCII's, as in a class of a pattern.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def han(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({HAN})"), 1)


def _pairs(chars: Column) -> Column:
    return F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _with_han(text: Column, latin: Column, chars) -> Column:
    """``latin``, and after it ``chars(Han characters)`` where the text has any: other texts are spared the work."""
    found = F.transform(F.array(han(text)), lambda h: F.concat(latin, chars(h)))[0]  # the characters are taken out once
    return F.when(text.rlike(HAN), found).otherwise(latin)


def bm25_tokens(text: Column) -> Column:
    """w: Latin words, c: Han characters, b: pairs of Han characters that follow each other among the Han characters."""
    return _with_han(text, _tagged("w:", words(text)), lambda h: F.concat(_tagged("c:", h), _tagged("b:", _pairs(h))))


def strong_tokens(text: Column) -> Column:
    """Distinct words and Han pairs; single Han characters are weak."""
    return F.array_distinct(_with_han(text, _tagged("w:", words(text)), lambda h: _tagged("b:", _pairs(h))))


def semantic_tokens(text: Column) -> Column:
    """Distinct words and Han pairs; a lone Han character counts itself."""
    return F.array_distinct(_with_han(text, words(text), lambda h: F.when(F.size(h) == 1, h).otherwise(_pairs(h))))


def recall_tokens(text: Column) -> Column:
    """Distinct words, Han characters and concept names."""
    return F.array_distinct(F.concat(words(text), han(text), _tagged("concept:", concepts(text))))


def feedback_tokens(text: Column) -> Column:
    """Address-like words of two or more characters, and pairs within each run of Han characters."""
    runs = F.regexp_extract_all(text, F.lit(f"({HAN}{{2,}})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: _pairs(F.regexp_extract_all(r, F.lit("(.)"), 1))))
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9@._+-]{2,})"), 1), pairs))


def topic_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Latin runs of three or more letters or digits and Han runs of two to six characters, without stop words."""
    found = F.concat(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_-]{2,})"), 1), F.regexp_extract_all(text, F.lit(f"({HAN}{{2,6}})"), 1))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def comparable(text: Column) -> Column:
    """Letters and digits only, in lower case: equal for texts that differ in spacing and punctuation."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def character_cost(text: Column) -> Column:
    return F.least(F.lit(1000), F.length(squeezed(text)))


def fact_value(text: Column) -> Column:
    """What follows the last colon; without a colon what follows a predicate, else the text."""
    after = F.trim(F.regexp_extract(text, r"(?s)^.*[:：](.*)$", 1))
    predicate = F.trim(F.regexp_extract(text, r"(?:不喜欢|讨厌|喜欢|偏爱|偏好|姓名|名字|所在地|职业)\s*(.+)$", 1))
    return F.when(text.rlike("[:：]"), after).when(predicate != "", predicate).otherwise(text)


def candidate_value(text: Column) -> Column:
    """What follows the first colon; without one the text less a leading preference phrase."""
    after = F.regexp_extract(text, r"^[^:：]*[:：]\s*(.+)$", 1)
    return F.when(after != "", F.trim(after)).otherwise(F.trim(F.regexp_replace(text, r"(?i)^(?:用户|user)\s*(?:不喜欢|喜欢|偏好|likes?|dislikes?|prefers?)\s*", "")))


def polarity(text: Column) -> Column:
    """-1, 0 or 1; a negated preference is looked for first."""
    return F.when(text.rlike(ascii_borders(r"(?i)(?:不喜欢|讨厌|\bdislike\b|\bhate\b)")), -1).when(text.rlike(ascii_borders(r"(?i)(?:喜欢|偏爱|偏好|\bprefer\b|\blike\b)")), 1).otherwise(0)


def escaped(text: Column) -> Column:
    """For use within markup: & < > escaped, runs of control characters and white space as one space, at most 1000 characters."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return F.substring(F.trim(F.regexp_replace(text, f"[\\x00-\\x1f\\x7f{SPACES}]+", " ")), 1, 1000)


def citations(text: Column) -> Column:
    """The distinct labels M1 to M999 that the text cites as [M1]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[(M\d{1,3})\]"), 1), lambda c: F.upper(c)))


def squeezed_lines(text: Column) -> Column:
    """Control characters but line ends as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s*[\x00-\x09\x0b-\x1f\x7f]+\s*", " "))


def clauses(text: Column) -> Column:
    """Clauses between terminators; a comma ends one only before a cue of the speaker."""
    marked = F.regexp_replace(text, r"[。！？!?;；\n]+", "\n")
    marked = F.regexp_replace(marked, "(?i)" + ascii_borders(r"[，,](?=\s*(?:我|我的|你|您|请问|请|记住|别忘了|每周|平时|通常|现在|也|而且|同时|I\b|My\b|Call\b|Remember\b))"), "\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda c: F.trim(c)), lambda c: c != "")


#: Other names of programming languages.
LANGUAGE_ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "golang": "go", "c sharp": "c#"}


def normalized_value(text: Column, predicate: Column | None = None) -> Column:
    """Outer quotes and trailing punctuation dropped, white space squeezed, lower case; places lose 市 or 城区, languages get their usual name."""
    value = F.trim(F.regexp_replace(F.regexp_replace(text, "^[“”\"'‘’]+|[“”\"'‘’]+$", ""), r"[\s 　]+", " "))
    if predicate is not None:
        aliases = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
        value = F.when(predicate == "profile.location", F.regexp_replace(value, "(?:市|城区)$", "")).when(predicate == "profile.programming_language", F.coalesce(aliases[F.lower(value)], value)).otherwise(value)
    return F.trim(F.regexp_replace(F.lower(value), r"[，。！？,.!?]+$", ""))


def refines(a: Column, b: Column) -> Column:
    """Whether one value contains the other and adds no more than max(6, its length) characters."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) >= 2) & (a != b) & F.contains(long, short) & (F.length(long) - F.length(short) <= F.greatest(F.lit(6), F.length(short)))


def stable_id(*parts: Column) -> Column:
    """SHA-256 over parts joined by a zero character."""
    return F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256)


def clean_value(text: Column) -> Column:
    """Outer quotes dropped, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^[“”\"'‘’]+|[“”\"'‘’]+$", ""), r"[\s 　]+", " "))


def fact_key(text: Column) -> Column:
    """What two wordings of a fact are compared by: no white space, no punctuation, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[\s 　]+", ""), "[，。！？,.!?]", ""))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A JSON value with the keys of all objects in order and no white space."""
    return text.map(lambda v: None if v is None else json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def timestamp_ms(value: Column) -> Column:
    """Epoch milliseconds of a positive number or an ISO time; null for anything else."""
    number = value.try_cast("bigint")
    return F.when(number.isNotNull(), F.when(number > 0, number)).otherwise(F.unix_millis(value.try_cast("timestamp")))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) <= 0


def same_set(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(total == 0, 1.0).otherwise(shared / total)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements as a share of the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


#: Concept names and the wordings that show them.
CONCEPTS: tuple[tuple[str, str], ...] = (
    ("preference.any", r"偏好|喜欢|偏爱|爱听|爱看|不喜欢|讨厌|常喝|常吃|prefer|preference|like|dislike|favorite|favourite"),
    ("profile.name", r"姓名|名字|称呼|叫(?:我|你)|\bname\b|\bcall\b"),
    ("profile.location", r"所在地|住在|居住|常住|定居|落脚|哪座城市|哪里住|何处生活|(?:哪|什么|哪个).{0,4}城市.{0,6}(?:生活|居住|住过|待过)|based\s+in|live\s+in|has\s+been\s+home"),
    ("profile.native-language", r"母语|方言|家乡话|从小讲|native\s+language|dialect"),
    ("profile.shoe-size", r"鞋码|几码.{0,4}鞋|鞋.{0,6}(?:尺码|号码|大小)|shoe\s+size"),
    ("relationship.pet", r"宠物|毛孩子|猫咪|猫|狗狗|狗|兔子|兔|\bdog\b|\bcat\b|\bpet\b|\brabbit\b"),
    ("relationship.sibling", r"哥哥|姐姐|弟弟|妹妹|兄弟姐妹|手足|sibling|brother|sister"),
    ("preference.music", r"音乐|歌曲|爵士|爱听|耳机|\bmusic\b|\bsong\b|\bjazz\b"),
    (
        "health.allergy",
        r"过敏|必须避开|食材.{0,10}避开|药.{0,10}(?:不能用|禁用|避开)|(?:不能用|禁用).{0,10}药|allerg|(?:food|medicine|drug).{0,20}(?:avoid|cannot\s+use)|must\s+avoid",
    ),
    (
        "project.current",
        r"当前项目|项目|开发|手头.{0,12}(?:忙|软件|准备|筹备|做)|正在.{0,12}(?:做|准备|开发).{0,8}(?:产品|软件)?|做的产品|哪个软件|\bproject\b|develop|working\s+on",
    ),
    ("routine.exercise", r"固定安排|每周|锻炼|运动|徒步|游泳|瑜伽|\broutine\b|\bweekly\b|\bexercise\b"),
    ("profile.operating-system", r"电脑系统|操作系统|运行.{0,8}平台|windows|macos|linux|operating\s+system"),
    ("preference.response-style", r"回答偏好|回复|回答|篇幅|简洁|详细|\bresponse\b|\breply\b|\bconcise\b"),
    ("profile.programming-language", r"编程语言|哪门语言|写程序|写代码|技术栈|python|typescript|javascript|rust|c\+\+|programming\s+language|tech\s+stack"),
    ("preference.drink", r"饮品|喝什么|泡什么|乌龙茶|咖啡|饮料|\bdrink\b|\bbeverage\b|\btea\b|\bcoffee\b"),
    (
        "routine.work-time",
        r"工作习惯|工作时间|(?:什么时候|何时).{0,6}工作|平时.{0,8}工作|夜间|晚上工作|时段.{0,8}效率|效率最高|白天.{0,8}夜|办公|work.{0,12}(?:night|day)",
    ),
    ("profile.birthday", r"生日|出生日期|生日祝福|庆生|\bbirthday\b|celebrate.{0,8}birthday"),
    ("relationship.friend", r"好友|朋友|那位朋友|\bfriend\b"),
    (
        "preference.food",
        r"不喜欢.{0,12}(?:食物|吃)|不要(?:放|加)|吃饭|点菜|口味.{0,8}(?:禁忌|避讳)|忌口|不能吃|香菜|\bdislike\b|\bhate\b|cilantro|food.{0,12}(?:preference|restriction)",
    ),
    ("preference.interface-theme", r"界面.{0,8}(?:主题|模式)|深色主题|黑色主题|dark\s+mode|interface\s+theme"),
    ("plan.travel", r"旅行|目的地|去哪里玩|下一趟|京都|\btravel\b|\btrip\b|\bdestination\b"),
    ("preference.book", r"喜欢的书|小说|哪部.{0,8}心头好|三体|\bbook\b|\bnovel\b"),
    ("profile.education", r"毕业院校|高校毕业|大学|本科|硕士|博士|就读|在哪.{0,8}读|\buniversity\b|\bcollege\b|education"),
    ("preference.color", r"颜色|什么色|色系|衣服.{0,8}色|藏青|墨绿|\bcolor\b|\bcolour\b"),
    ("routine.rent", r"房租|房东.{0,12}收钱|每月.{0,6}号|\brent\b"),
    ("profile.occupation", r"职业|做什么工作|靠什么.{0,8}(?:工作|谋生)|谋生|任职|教师|occupation|work\s+as|make.{0,8}living|\bjob\b"),
    ("relationship.partner", r"妻子|丈夫|伴侣|爱人|对象|另一半|spouse|wife|husband|partner"),
    ("goal.current", r"目标|挑战|马拉松|\bgoal\b"),
    ("profile.device", r"电脑是|笔记本|thinkpad|\bdevice\b|\blaptop\b"),
)


def concepts(text: Column) -> Column:
    """The names of the concepts that the text shows, in the order of CONCEPTS."""
    return lowered(text, lambda low, han: F.filter(F.array(*[F.when(shows(low, p, han), F.lit(c)) for c, p in CONCEPTS]), lambda c: c.isNotNull()))
