"""Personal data: fixed rules, and a semi-Markov conditional random field that adds what they miss.

The rules (email, ip, card, phone) find leftmost non-overlapping spans of each kind. The field looks
at the surroundings of digits and at-signs only, as far as a candidate can reach from them. It scores whole candidate spans of up to MAX_TOKENS
tokens by features of the span (digits, groups, check sum, edges, what stands before it), and a
dynamic program over the tokens chooses boundaries and kinds together; tokens between spans count
nothing. Its weights maximise the conditional likelihood of a corpus that this module generates,
which the driver does once, in seconds; they are a few dozen numbers.

Spans that the field chooses are added where they touch no rule's span.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest span that the field considers; brackets and spaces are tokens too, and a generated address has up to 21.
MAX_TOKENS = 32
#: Log odds by which the best reading must beat the reading without a span for the span to be added.
MARGIN = 2.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the rules, in order of kind, then start; in code points."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:  # a match holds one at-sign; its local part is all that can stand before it
        local = text[free:at]
        size = len(local) - len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if size else None
        if m:
            found.append((0, at - size, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---- the field ----

FEATURES = ("span", "clean edges", "loose edge", "right digits", "odd digits", "check sum", "no check sum", "groups fit", "groups don't", "plus", "brackets", "cue before", "other word before", "tokens", "spaces", "letters")
_CUES = {
    0: re.compile(r"(?i)(?:e-?mail|mail|contact|write|to)\W{0,3}$"),
    1: re.compile(r"(?i)(?:ip|host|address|server|from)\W{0,3}$"),
    2: re.compile(r"(?i)(?:card|visa|mastercard|amex|pan)\W{0,3}$"),
    3: re.compile(r"(?i)(?:tel|telephone|phone|call|fax|mobile|fon|ring|sms)\W{0,3}$"),
}
_WORD_BEFORE = re.compile(r"(?i)(?:order|invoice|version|id|no|nr|isbn|key|ref|serial|sum|total|ticket|code|part)\W{0,3}$")
_NUMERIC = re.compile(r"[0-9.\-() +/]")
_MAILISH = re.compile(r"[A-Za-z0-9._%+\-@ \[\]()]")
_AT = re.compile(r"(?: ?[\[(] ?at ?[\])] ?| at )", re.I)
_DOT = re.compile(r"(?: ?[\[(] ?dot ?[\])] ?| dot )", re.I)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _features(kind: int, text: str, start: int, end: int, tokens: int) -> np.ndarray:
    span, before = text[start:end], text[max(0, start - 16) : start]
    digits = _digits(span)
    n = len(digits)
    groups = re.findall(r"[0-9]+", span)
    if kind == 0:
        fits = bool(_MAIL.fullmatch(span)) or bool(_MAIL.fullmatch(_DOT.sub(".", _AT.sub("@", span))) and _AT.search(span) and _DOT.search(span))
        right = True
    elif kind == 1:
        fits = len(groups) == 4 and ".".join(groups) == span and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        right = 4 <= n <= 12
    elif kind == 2:
        sizes = [len(g) for g in groups]
        fits = re.fullmatch(r"[0-9 -]+", span) is not None and (len(groups) == 1 or sizes[:-1] == [4] * (len(sizes) - 1) and 1 <= sizes[-1] <= 4 or sizes == [4, 6, 5])
        right = 13 <= n <= 19
    else:
        sizes = [len(g) for g in groups]
        fits = 2 <= len(groups) <= 6 and max(sizes) <= 4 and sizes[-1] >= 2 and span.count("(") == span.count(")") <= 1 and re.search(r"[^0-9() +][^0-9(]", span) is None
        right = 9 <= n <= 15
    edges = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    loose = bool(re.match(r"[.,/\-=_+#]\w", text[end : end + 2])) or (start > 0 and text[start - 1] in "./-=_+#@(")
    return np.array(
        [
            1.0,
            edges,
            loose,
            right,
            not right,
            kind == 2 and luhn(digits),
            kind == 2 and not luhn(digits),
            fits,
            not fits,
            span[0] == "+",
            "(" in span and ")" in span,
            bool(_CUES[kind].search(before)),
            bool(_WORD_BEFORE.search(before)),
            tokens / MAX_TOKENS,
            span.count(" ") / 4,
            bool(re.search("[A-Za-z]", span)),
        ],
        float,
    )


def candidates(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, int]], np.ndarray]:
    """Token starts (and the end) of text[low:high], candidate spans (kind, first token, token after the last) and their features."""
    places = [m.start() for m in _TOKEN.finditer(text, low, high)] + [high]
    spans, rows = [], []
    for i in range(len(places) - 1):
        head = text[places[i]]
        if not (head.isascii() and (head.isalnum() or head in "+(")):
            continue
        numeric, mailish, at = head in "+(" or head.isdigit(), head.isalnum(), False
        for j in range(i + 1, min(len(places) - 1, i + MAX_TOKENS) + 1):
            token = text[places[j - 1] : places[j]]
            numeric = numeric and _NUMERIC.match(token) is not None
            mailish = mailish and _MAILISH.match(token) is not None
            at = at or token == "@" or token.lower() == "at"
            if not numeric and not mailish:
                break
            if not (token[-1].isascii() and token[-1].isalnum()):
                continue
            end = places[j]
            if numeric and sum(map(str.isdigit, text[places[i] : end])) >= 4:
                kinds = [k for k in (1, 2, 3) if k != 2 or head.isdigit()]
            else:
                kinds = []
            if mailish and at and j - i >= 5:
                kinds.append(0)
            for kind in kinds:
                spans.append((kind, i, j))
                rows.append(_features(kind, text, places[i], end, j - i))
    return places, spans, np.array(rows).reshape(len(rows), len(FEATURES))


def _gradient(n: int, spans: list[tuple[int, int, int]], rows: np.ndarray, gold: set, weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of the ``gold`` spans among all readings of ``n`` tokens."""
    kinds = np.array([k for k, _, _ in spans], int)
    scores = (rows * weights[kinds]).sum(axis=1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, _, j) in enumerate(spans):
        ending[j].append(s)
    ahead = np.full(n + 1, -np.inf)
    ahead[0] = 0.0
    for j in range(1, n + 1):
        terms = [ahead[j - 1]] + [ahead[spans[s][1]] + scores[s] for s in ending[j]]
        ahead[j] = np.logaddexp.reduce(terms)
    behind = np.full(n + 1, -np.inf)
    behind[n] = 0.0
    for j in range(n, 0, -1):
        behind[j - 1] = np.logaddexp(behind[j - 1], behind[j])
        for s in ending[j]:
            i = spans[s][1]
            behind[i] = np.logaddexp(behind[i], behind[j] + scores[s])
    expected = np.exp(np.array([ahead[i] + scores[s] + behind[j] - ahead[n] for s, (_, i, j) in enumerate(spans)]))
    held = np.array([s in gold for s in spans], float)
    out = np.zeros_like(weights)
    np.add.at(out, kinds, (held - expected)[:, None] * rows)
    return out


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up line with personal data and look-alikes, and the spans of the former."""
    word = lambda: "".join(rng.choice(["ba", "ten", "or", "li", "us", "ne", "ar", "mo", "st"]) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        digits = rng.choice("3456") + number(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"00{number(2)} {a} {number(4)} {number(2)}", f"+1-{a}-{b}-{c}"])

    def mail() -> str:
        user, host = word() + rng.choice(["", "." + word(), number(2)]), word() + "." + rng.choice(["com", "org", "co.uk", "de"])
        return rng.choice([f"{user}@{host}", f"{user}@{host}", f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}(at){host.replace('.', '(dot)')}"])

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    decoys = [
        lambda: f"{number(4)}-{number(2)}-{number(2)}",
        lambda: f"{number(2)}.{number(2)}.{number(4)}",
        lambda: f"version {rng.randint(1, 9)}.{number(1)}.{number(2)}",
        lambda: f"v{number(1)}.{number(1)}.{number(1)}.{number(1)}",
        lambda: f"order {number(rng.randint(5, 12))}",
        lambda: f"id {number(4)}-{number(4)}-{number(4)}",
        lambda: f"{number(3)},{number(3)}.{number(2)}",
        lambda: number(rng.choice([8, 10, 12, 16, 20])),
        lambda: f"{word()}{number(6)}{word()}",
        lambda: f"{number(3)}.{number(3)}.{number(3)}.{number(3)}.{number(2)}",
        lambda: f"{rng.randint(256, 999)}.{number(3)}.{rng.randint(256, 999)}.{number(2)}",
        lambda: f"{number(2)}/{number(2)}/{number(4)} {number(2)}:{number(2)}",
        lambda: f"{word()} at {word()} {number(4)}",
        lambda: f"{number(3)} {number(3)} {number(3)} {number(3)} {number(3)} {number(3)}",
        lambda: f"@{word()} {number(4)}",
        lambda: f"{number(4)} {number(4)}",
        lambda: f"{number(3)}-{number(4)}",
        lambda: f"isbn {number(3)}-{number(1)}-{number(5)}-{number(3)}-{number(1)}",
    ]
    cues = {0: ["mail ", "write to "], 1: ["ip ", "host "], 2: ["card ", "visa: "], 3: ["tel. ", "call ", "phone: "]}
    text, spans = word(), []
    for _ in range(rng.randint(1, 3)):
        text += rng.choice([" ", ", ", ". ", "\n"]) + word() + " "
        if rng.random() < 0.5:
            kind = rng.randrange(4)
            text += rng.choice(["", "", rng.choice(cues[kind])])
            value = (mail, ip, card, phone)[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += rng.choice(decoys)()
    return text + rng.choice(["", ".", " " + word()]), spans


@functools.lru_cache(maxsize=1)
def trained_weights(sentences: int = 400, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights by kind and feature, by stochastic gradient ascent on generated lines."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, truth = _sentence(rng)
        places, spans, rows = candidates(text, 0, len(text))
        at = {p: k for k, p in enumerate(places)}
        gold = {(k, at[a], at[b]) for k, a, b in truth if a in at and b in at}
        if spans:
            data.append((len(places) - 1, spans, rows, gold & set(spans)))
    weights, squares = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-2)
    for _ in range(rounds):
        rng.shuffle(data)
        for n, spans, rows, gold in data:
            step = _gradient(n, spans, rows, gold, weights) - 1e-3 * weights
            squares += step * step
            weights = weights + 0.5 * step / np.sqrt(squares)
    return weights


def _reach(text: str, at: int, step: int) -> int:
    """The place MAX_TOKENS tokens before (step -1) or after (1) ``at``: no candidate that touches ``at`` goes beyond."""
    edge = lambda i: i - 1 if step < 0 else i  # noqa: E731  the character next to place i
    kind = lambda c: 1 if c.isascii() and c.isalpha() else 2 if c.isascii() and c.isdigit() else 0
    inside = lambda i: 0 <= edge(i) < len(text)
    for _ in range(MAX_TOKENS):
        if not inside(at):
            break
        first = kind(text[edge(at)])
        at += step
        while first and inside(at) and kind(text[edge(at)]) == first:
            at += step
    return at


def field_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best reading, region by region; spans that add less than ``margin`` are left out."""
    found: list[tuple[int, int, int]] = []
    regions: list[list[int]] = []
    marks = [(m.start(), m.end()) for m in _TRIGGER.finditer(text)] + [(m.start(), m.end()) for m in re.finditer(r"(?i)[\[(] ?at ?[\])]| at \w+ dot ", text)]
    for a, b in sorted(marks):
        a, b = _reach(text, a, -1), _reach(text, b, 1)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    for low, high in regions:
        places, spans, rows = candidates(text, low, high)
        if not spans:
            continue
        scores = (rows * weights[[k for k, _, _ in spans]]).sum(axis=1) - margin
        n = len(places) - 1
        best, came = [0.0] * (n + 1), [-1] * (n + 1)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, _, j) in enumerate(spans):
            if scores[s] > 0:
                ending[j].append(s)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for s in ending[j]:
                if (total := best[spans[s][1]] + scores[s]) > best[j]:
                    best[j], came[j] = total, s
        j, chosen = n, []
        while j > 0:
            if came[j] >= 0:
                k, i, _ = spans[came[j]]
                chosen.append((k, places[i], places[j]))
                j = i
            else:
                j -= 1
        found += chosen[::-1]
    return found


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(rule spans, all spans), each in order of kind, then start."""
    rules = rule_spans(text)
    added = []
    if _DIGIT.search(text) or "@" in text or " at " in text or re.search(r"(?i)[\[(] ?at ?[\])]", text):
        taken = sorted((a, b) for _, a, b in rules)
        starts = np.array([a for a, _ in taken], int)
        ends = np.maximum.accumulate(np.array([b for _, b in taken], int)) if taken else starts
        for kind, a, b in field_spans(text, weights):
            k = int(np.searchsorted(starts, b))
            if not (k and ends[k - 1] > a):
                added.append((kind, a, b))
    return rules, sorted([*rules, *added])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.BooleanType())])
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.bool_())]))


def find(df: DataFrame, text_col: str = "text", out: str = "pii", mask: bool = False) -> DataFrame:
    """All columns of ``df`` and ``out``: an array of (kind, start, end, rule) of each whole text, by kind, then start.

    Positions are code points, end exclusive; rule tells the rules' spans from those the field adds.
    With ``mask`` the text is returned with each span replaced by its kind in brackets (overlapping
    spans by one, named by the first). Null and empty texts have no spans; a null stays null.
    A column named ``out`` is replaced.
    """
    shipped = df.sparkSession.sparkContext.broadcast(trained_weights())
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shipped.value
        for part in slices(batches, text_col):
            texts, spans = part.column(text_col).to_pylist(), []
            for i, text in enumerate(texts):
                rules, found = all_spans(text or "", weights)
                own = set(rules)
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "rule": (k, a, b) in own} for k, a, b in found])
                if mask and found:
                    texts[i] = masked(text, found)
            columns = [pa.array(texts, part.schema.field(c).type) if c == text_col else part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPAN_ARROW)], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first, as in [EMAIL]."""
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            last = max(last, b)
        else:
            out += [text[at if last < 0 else last : a], f"[{KINDS[kind].upper()}]"]
            last = b
        at = last
    return "".join(out) + text[max(0, last) :]
