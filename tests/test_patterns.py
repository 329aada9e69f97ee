import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.functions import regex
from tesserae.functions import text as t


@pytest.mark.parametrize(
    ("pattern", "parts", "held"),
    [
        (r"tea|\bcat\b|", ["tea", r"\bcat\b", ""], ["tea", "cat", ""]),
        (r"(?:a|b).{0,4}city|c\+\+", [r"(?:a|b).{0,4}city", r"c\+\+"], ["city", "c"]),
        (r"colou?r|x{0,2}yz|[a|b]mn", ["colou?r", "x{0,2}yz", "[a|b]mn"], ["colo", "yz", "mn"]),
        (r"(?:food|drug).{0,20}(?:avoid|not)", [r"(?:food|drug).{0,20}(?:avoid|not)"], [""]),
    ],
)
def test_parts_and_what_they_need(pattern, parts, held):
    assert regex.alternatives(pattern) == parts and [regex.needed(p) for p in parts] == held


def test_shows_equals_the_whole_pattern(spark):
    """On texts dealt from the patterns' own pieces, all concepts are found as by the patterns as a whole; null stays null."""
    draw = random.Random(3)
    pieces = sorted({w for _, p in t.CONCEPTS for w in re.findall(r"[a-z+]{2,}|[㐀-鿿]+", p)}) + [" ", "  ", ", ", "_", "x", "\n", "9"]
    texts = ["", None, *["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 9))) for _ in range(3000)]]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    tested = F.lower("text")
    whole = F.filter(F.array(*[F.when(tested.rlike(regex.ascii_borders(p)), F.lit(c)) for c, p in t.CONCEPTS]), lambda c: c.isNotNull())
    seen = rows.select(t.concepts(F.col("text")).alias("got"), whole.alias("want")).collect()
    assert all(r.got == r.want for r in seen) and len({c for r in seen for c in r.want}) == len(t.CONCEPTS)


def test_escaped(spark):
    """Entities first, then white space and controls to one space, then the cut."""
    rows = spark.createDataFrame([(" a<b&\x00\x01 c>\n\n d ",), ("　x  y﻿",), (None,), ("",), ("&" * 400,), ("é" * 5000,)], "text string")
    assert [r[0] for r in rows.select(t.escaped(F.col("text"))).collect()] == ["a&lt;b&amp; c&gt; d", "x y", None, "", "&amp;" * 200, "é" * 1000]


def _wordings(patterns, n, seed):
    """Texts made of the patterns' own words, in whatever case, with Han characters or without."""
    import random

    rng = random.Random(seed)
    bits = [b for p in patterns for b in re.findall(r"\w+|[㐀-鿿]", p)] + [" ", " ", "_", "\n", "@", ".", "a@b.io", "13912345678", "1" * 18, "İ", "my", "12", "X"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 18))) for _ in range(n)]


def test_parts_are_tried_only_where_a_text_holds_what_they_need(spark):
    """concepts: Han parts are left out of texts without Han characters, plain words are found before their borders."""
    from tesserae.functions import regex
    from tesserae.functions import text as t

    assert regex.held_by(r"(?:food|drug).{0,20}avoid") == ["avoid"] and regex.held_by(r"(?:food|medicine|drug).{0,20}(?:avoid|cannot\s+use)") == ["food", "medicine", "drug"]
    assert regex.held_by(r"(?:a|b)?(?:c|d)") == [] and regex.quick(r"\bcat\b").startswith("cat")
    texts = _wordings([p for _, p in t.CONCEPTS], 500, 3)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", t.concepts(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.c == [n for n, p in t.CONCEPTS if re.search(regex.ascii_borders(p), texts[r.i].lower())], texts[r.i]


def test_privacy_wordings_are_tried_only_where_a_text_holds_what_they_need(spark):
    from tesserae.functions import regex
    from tesserae.operators import filters

    for patterns in (filters.PRIVATE, filters.SECRET, filters.INJECTION, (filters.IMAGE_MEMORY,)):
        whole = re.compile("|".join(regex.ascii_borders(p) for p in patterns), re.I | re.A)
        texts = _wordings(patterns, 300, 5)
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", filters._any(F.col("t"), patterns).alias("found"))
        assert "contains" in df._jdf.queryExecution().analyzed().toString().lower()
        for r in df.collect():
            assert r.found == bool(whole.search(texts[r.i])), (texts[r.i], patterns)


def test_rules_are_tried_only_where_a_clause_holds_what_they_need():
    from tesserae.operators import ingest

    for *_, pattern, form, held in ingest._COMPILED:
        for text in _wordings([pattern.pattern], 150, 7):
            if pattern.search(text):
                assert not held or any(h in text.translate(ingest._FORMS).lower() for h in held), (pattern.pattern, text)
    assert [f.content for f in ingest.facts_of("my name İs Zed. I work as a cook")] == ["User name：Zed", "User occupation：cook"]
