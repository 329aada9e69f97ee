"""SpotSigs document fingerprints, by DataFrame functions only.

A signature is a common word (the anchor) with the chain of the next CHAIN content words; other common
words between them are passed over. Chains start often in running prose and seldom in menus or
boilerplate, so the set of signatures stands for a document's prose. Sets are compared by Jaccard
similarity; two sets can only reach a threshold t if their sizes differ by no more than the factor t,
so sets are partitioned by length and compared within a partition and the next.

A text without any signature has one: its whole sequence of words. A text without words has none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 2
#: Common words of the languages at hand, which serve as anchors.
ANCHORS = {
    "en": "the of and to in is that for with as was on be by are this from an or it",
    "fr": "le la les de des du et en un une que qui dans pour par sur est avec au pas",
    "de": "der die das und den von zu mit dem des ein eine im ist nicht sich auf als für auch",
    "es": "el los las del que y se con por para una es al lo su como más no sus fue",
}
#: Ids that lie in one block of 2^BLOCK_BITS are put in order together.
BLOCK_BITS = 10


def _trie(words: list[str]) -> str:
    """A pattern that matches any of ``words`` with one look at each letter."""
    by_first: dict[str, list[str]] = {}
    for word in sorted({w for w in words if w}):
        by_first.setdefault(word[0], []).append(word[1:])
    tails = [first + _trie(rest) for first, rest in by_first.items()]
    pattern = "(?:" + "|".join(tails) + ")" if tails else ""
    return pattern + "?" if tails and "" in words else pattern


#: Between a content word and the common words before it, after both, and what stands for the end of a text.
_WITHIN, _AFTER, _END = "\u0001", "\u0002", "\u0003"


def signatures(text: Column, anchors: dict[str, str] = ANCHORS) -> Column:
    """The sorted distinct signature hashes (long) of a text; null and wordless texts have none.

    The words are cut into units of one content word with the run of common words before it. All common
    words of a run start the same chain, that of the unit's content word and the next ones, so each run is
    read once, however long it is. The ends are marked by content words of their own, which no chain takes.
    """
    anchor = _trie(sorted({w for words in anchors.values() for w in words.split()}))
    pattern = rf"((?:{anchor} )*+)([^ ]++) "

    def of_words(words: Column) -> Column:
        marked = F.regexp_replace(F.concat(words, F.lit(f"{_END} " * CHAIN)), pattern, f"$2{_WITHIN}$1{_AFTER}")
        return _bound(F.split(marked, _AFTER), lambda units: _bound(F.transform(units, lambda u: F.substring_index(u, _WITHIN, 1)), lambda content: of_units(words, units, content)))

    def of_units(words: Column, units: Column, content: Column) -> Column:
        last = F.size(units) - 1 - 2 * CHAIN  # the last unit that CHAIN content words begin with

        def chains(unit: Column, i: Column) -> Column:
            run = F.substring_index(unit, _WITHIN, -1)
            chain = [F.get(content, i + k) for k in range(CHAIN)]
            return F.when((i <= last) & (run != ""), F.transform(F.array_distinct(F.split(F.rtrim(run), " ")), lambda a: F.xxhash64(a, *chain))).otherwise(F.array().cast("array<bigint>"))

        return _bound(F.array_sort(F.array_distinct(F.flatten(F.transform(units, chains)))), lambda sigs: F.when(words == " ", F.array().cast("array<bigint>")).when(F.size(sigs) == 0, F.array(F.xxhash64(words))).otherwise(sigs))

    return _bound(F.concat(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?:[^\p{L}\p{N} ]| (?=[^\p{L}\p{N}]))[^\p{L}\p{N}]*+", " ")), F.lit(" ")), of_words)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def spelled(sigs: Column) -> Column:
    """A fingerprint as a string: its hashes joined by commas."""
    return F.array_join(sigs.cast("array<string>"), ",")


def name(sigs: Column) -> Column:
    """A digest that names a fingerprint: equal sets have equal names, and different ones different names but for a collision of 64-bit hashes."""
    return F.sha2(spelled(sigs).cast("binary"), 256)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 0 where their sizes alone rule out ``at_least``; 1 if both are empty."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < at_least * large), 0.0).otherwise(shared / (small + large - shared))


def with_next(df: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each {column: name}, the column's value of the next row by descending id; after the last row, of the first.

    Ids are put in order by blocks of adjacent ids; the last row of each block takes its values from the
    first row of the next block that has rows. Only block numbers, not rows, are put in one global order.
    Null ids come last; rows of equal ids follow each other in a fixed order of their values.
    """
    block = F.shiftright(F.coalesce(F.col(id_col), F.lit(-(1 << 62))), BLOCK_BITS)
    # All three uses of ``held`` below read the same columns, so the rows are dealt out once.
    order = Window.partitionBy("block_").orderBy(F.col(id_col).desc_nulls_last(), F.col("tie_").desc())
    dealt = df.withColumns({"block_": block, "tie_": F.xxhash64(*[F.col(c) for c in columns])})
    held = dealt.withColumns({"first_": F.lag(F.lit(True)).over(order).isNull(), "last_": F.lead(F.lit(True)).over(order).isNull(), **{f"after_{c}": F.lead(c).over(order) for c in columns}})

    blocks = df.select(block.alias("block_")).groupBy("block_").count().select("block_", F.shiftright("block_", BLOCK_BITS).alias("super_"))
    supers = blocks.groupBy("super_").agg(F.max("block_").alias("top_"))  # a row for each 2^(2 BLOCK_BITS) ids
    down = Window.orderBy(F.col("super_").desc())
    supers = supers.select("super_", F.coalesce(F.lead("top_").over(down), F.max("top_").over(Window.partitionBy())).alias("beyond_"))
    within = Window.partitionBy("super_").orderBy(F.col("block_").desc())
    follows = blocks.withColumn("next_", F.lead("block_").over(within)).join(supers, "super_").select("block_", F.coalesce("next_", "beyond_").alias("next_"))

    heads = held.filter("first_").select(F.col("block_").alias("next_"), F.struct(*columns).alias("head_")).join(follows, "next_").select("block_", "head_")
    rest = [F.col(c) for c in df.columns]
    inner = held.filter("not last_").select(*rest, *[F.col(f"after_{c}").alias(name) for c, name in columns.items()])
    tails = held.filter("last_").join(heads, "block_").select(*rest, *[F.col(f"head_.{c}").alias(name) for c, name in columns.items()])
    return inner.unionByName(tails)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Fingerprints are named by digests of their signatures; ``signatures`` gives the sets themselves.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document by descending id. A null text is empty; an empty table gives no rows; a single document is
    its own next. Other columns are dropped.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("sigs", signatures(F.col("text")))
    both = with_next(docs, "id", {"text": "next_text", "sigs": "next_sigs"})
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    both = both.select("id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "sigs", "next_sigs")
    both = both.withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        name(F.col("sigs")).alias("fingerprint"),
        name(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): id and class_id of each document with signatures; pairs (a < b) of classes with a similarity of ``threshold`` or more.

    Documents of equal sets form a class, named by its least id. Class sets are dealt by length into
    partitions of the factor 1/threshold; a set meets those of its own and the next partition, and only
    by its rarest signatures: two sets that reach the threshold share one of the first
    n - ceil(threshold * n) + 1 signatures in any common order. Null and wordless texts are in no class.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), signatures(F.col(f"`{text_col}`")).alias("sigs")).filter("size(sigs) > 0")
    docs = docs.withColumn("name", name(F.col("sigs")))
    classes = docs.groupBy("name").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs"))
    members = docs.select("id", "name").join(classes.select("name", "class_id"), "name").select(F.col("id").alias(id_col), "class_id")
    sigs = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy("class_id").orderBy("df", "sig")
    keys = (
        sigs.join(often, "sig")
        .withColumn("nth", F.row_number().over(rank))
        .filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        .withColumn("part", F.floor(F.log("n") / math.log(1 / threshold)).cast("int"))
    )
    a = keys.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    b = keys.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    meet = a.join(b, ["sig", "part"]).filter("a <> b and (own < part or a < b) and least(n_a, n_b) >= %s * greatest(n_a, n_b)" % threshold)
    meet = meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("sigs_a"))
    right = classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("sigs_b"))
    alike = meet.join(left, "a").join(right, "b").withColumn("similarity", likeness(F.col("sigs_a"), F.col("sigs_b"), threshold))
    return members, alike.filter(F.col("similarity") >= threshold).select("a", "b", "similarity")
