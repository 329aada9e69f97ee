"""Patterns with the word borders of ASCII, whatever the regex engine takes as a word."""

from __future__ import annotations

import functools
import operator
import re

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
_BORDER = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def ascii_borders(pattern: str) -> str:
    r"""``pattern`` with each ``\b`` spelled out for A-Z, a-z, 0-9 and _ only (valid for Java and Python)."""
    return pattern.replace(r"\b", _BORDER)


def alternatives(pattern: str) -> list[str]:
    """The parts of ``pattern`` between the bars outside all groups and classes."""
    parts, depth, in_class = [""], 0, False
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token == "|" and not depth and not in_class:
            parts.append("")
            continue
        in_class = token == "[" or (in_class and token != "]")
        depth += 0 if in_class else (token == "(") - (token == ")")
        parts[-1] += token
    return parts


def needed(part: str) -> str:
    """The longest text that every match of ``part``, which has no bar outside groups, holds; maybe an empty one."""
    runs, depth, in_class = [""], 0, False
    for token in re.findall(r"\\.|\{[^}]*\}|.", part, re.S):
        plain = not depth and not in_class and token not in "()[].^$+*?" and len(token) == 1
        if token in ("?", "*") or token.startswith("{"):  # what stands before may be missing
            runs[-1] = runs[-1][:-1]
        in_class = token == "[" or (in_class and token != "]")
        depth += 0 if in_class else (token == "(") - (token == ")")
        runs[-1:] = [runs[-1] + token] if plain else [runs[-1], ""]
    return max(runs, key=len)


_HAN = re.compile("[㐀-鿿]")


def held_by(part: str) -> list[str]:
    """Texts of which every match of ``part`` holds one; none where no such texts are known."""
    if held := needed(part):
        return [held]
    first = re.match(r"\(\?:([^()\[\]\\.^$+*?{}]+)\)(?![?*{])", part)  # a group of plain texts that must be there
    return first[1].split("|") if first and all(first[1].split("|")) else []


def quick(part: str) -> str:
    """``part`` with the borders of ASCII; a plain word between borders is looked for before its borders are."""
    word = re.fullmatch(r"\\b([a-z0-9_]+)\\b", part)
    return f"{word[1]}(?<!{_WORD}{word[1]})(?!{_WORD})" if word else ascii_borders(part)


def shows(text: Column, pattern: str, han: Column | None = None) -> Column:
    """Whether ``pattern`` (with the borders of ASCII) is found in ``text``: a part that is plain text is looked for as such,
    and another one only where the text has what all its matches hold. So most texts meet no pattern. ``han`` says whether the
    text has Han characters; without any, parts that need some are left out."""
    plain, with_han = [], []
    for part in filter(None, alternatives(pattern)):
        held = held_by(part)
        if held == [part]:
            test = text.contains(part)
        elif held:
            test = functools.reduce(operator.or_, map(text.contains, held)) & text.rlike(quick(part))
        else:
            test = text.rlike(quick(part))
        (with_han if held and all(map(_HAN.search, held)) else plain).append(test)
    if han is None or not with_han:
        return functools.reduce(operator.or_, plain + with_han)
    return functools.reduce(operator.or_, [*plain, han & functools.reduce(operator.or_, with_han)])


def lowered(text: Column, test: Callable[[Column, Column], Column]) -> Column:
    """``test(the text in lower case, whether it has Han characters)``; both are made once, however often the test names them."""
    both = F.struct(F.lower(text).alias("low"), text.rlike(_HAN.pattern).alias("han"))
    return F.get(F.transform(F.array(both), lambda b: test(b["low"], b["han"])), 0)


def finder(patterns: tuple[tuple[str, str], ...]) -> Callable[[str], list[str]]:
    """What gives the names of those ``patterns`` (name, pattern in lower case) that are found in a text in lower case, whatever case the pattern would
    have passed over: as in ``shows`` plain text is looked for as such, and other parts only where the text has what their matches hold."""
    rules = []
    for name, pattern in patterns:
        parts = [p for p in alternatives(pattern) if p]
        plain = [p for p in parts if needed(p) == p]
        rules.append((name, plain, [(needed(p), re.compile(ascii_borders(p))) for p in parts if p not in plain], re.compile(ascii_borders(pattern), re.I)))

    def found(text: str) -> list[str]:
        if "\u0131" in text or "\u017f" in text:  # other forms of i and s, which a pattern that passes over case takes for them
            return [name for name, _, _, whole in rules if whole.search(text)]
        return [name for name, plain, others, _ in rules if any(p in text for p in plain) or any(held in text and p.search(text) for held, p in others)]

    return found
