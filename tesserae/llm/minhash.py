"""MinHash near-duplicates by fast similarity sketching.

A document is the set of its word shingles. Its sketch has COORDINATES places, filled in rounds: in
each of the first COORDINATES rounds every shingle is hashed to one place with a value, lower rounds
and then lower values winning; a place that is still empty takes, in a round of its own, the least
value of all shingles. So every place is filled, large sets need about one round, and the share of
equal places of two sketches is concentrated around the Jaccard similarity.

BAND places in a row make one band. Documents with an equal band are candidates:

1. Documents of equal sets are one class from the start and go on as one.
2. In each bucket of an equal band, every class is paired with the bucket's least class (a star, not
   all pairs). Pairs whose sketches are too far apart are dropped: at similarity 0.8 the bound LEAST
   lies nearly five standard deviations away. Each class is confirmed against its likeliest partner first.
3. Confirmed links give components, and the other stars that join two of them are confirmed.
4. Only where a bucket still holds more than one component are others looked at: its members outside
   its largest component are compared with all its members, in blocks, by their sketches and then by
   their full sets. Only links come out of a block, one for each component that a member is linked to.

Every link is confirmed on the full sets: they are made once more from the texts, for the classes in
question, in their own scan, which a filter of fixed size narrows; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import checkpointed, filter_table, in_filter, lowered, mix, slices, text_bytes, top_bits, word_hashes, words_of, written
from tesserae.llm.components import components

COORDINATES = 96
BAND = 4
#: Equal places that two sketches must have to be compared in full, as a share of the similarity asked for.
LEAST = 0.76
#: Members of a bucket that are compared in one step with those outside its largest component.
BLOCK = 512

_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(batch: pa.RecordBatch, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one row after another, and where each row's begin (and end).

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A row of fewer than ``size``
    words has one shingle, all of them; a row without words has none.
    """
    data, offsets = text_bytes(batch.column(text))
    data = lowered(data)
    start, stop, first = words_of(data, offsets, _INSIDE)
    words = word_hashes(data, start, stop)
    n = np.diff(first)
    total = max(0, len(words) - size + 1)
    runs = np.full(total, size, np.uint64)
    for k in range(size):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + total])
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(total) + size <= np.repeat(first[1:], n)[:total] if total else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short.tolist()):
        acc = np.uint64(n[r])
        for w in words[first[r] : first[r + 1]]:
            acc = mix(np.array([acc]) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
        whole[i] = acc
    rows = np.concatenate([row[:total][inside], short])
    hashes = np.concatenate([runs[inside], whole])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[fresh], hashes[fresh]
    return hashes, np.searchsorted(rows, np.arange(len(n) + 1))


def sketches(hashes: np.ndarray, first: np.ndarray, places: int = COORDINATES) -> np.ndarray:
    """One sketch (a row of 64-bit keys: the round, then the value) for each set that isn't empty; others stay all ones."""
    n = len(first) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * places, none, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    live, left = hashes, owner
    for turn in range(places):
        mixed = mix(live + np.uint64((turn + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        key = (np.uint64(turn) << np.uint64(56)) | (mixed >> np.uint64(8))
        np.minimum.at(out, left * places + (mixed % np.uint64(places)).astype(np.int64), key)
        open_rows = (out.reshape(n, places) == none).any(axis=1)
        stay = open_rows[left]
        live, left = live[stay], left[stay]
        if not len(live):
            break
    grid = out.reshape(n, places)
    for place in np.flatnonzero((grid[np.diff(first) > 0] == none).any(axis=0)).tolist() if len(live) else ():
        turn = places + place
        key = (np.uint64(turn) << np.uint64(56)) | (mix(live + np.uint64((turn + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) >> np.uint64(8))
        least = np.full(n, none, np.uint64)
        np.minimum.at(least, left, key)
        grid[:, place] = np.minimum(grid[:, place], least)
    return grid


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """id, n_shingles, sig (of the whole set), bands and sketch of every row; the last three null without words."""
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("sig", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, first = shingle_sets(part, "text", size)
            n = np.diff(first)
            grid = sketches(hashes, first)
            bands = np.zeros((len(n), COORDINATES // BAND), np.uint64)
            for b in range(bands.shape[1]):
                acc = np.full(len(n), b + 1, np.uint64)
                for c in range(BAND):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + grid[:, b * BAND + c])
                bands[:, b] = acc
            low = mix(grid.ravel()).astype(np.uint8).reshape(grid.shape)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x1234567, 0x89ABCDEF01)]
            sig = np.stack([s[first[1:]] - s[first[:-1]] for s in sums] + [n.astype(np.uint64)], axis=1)
            some = (n > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array([s.tobytes() if k else None for s, k in zip(sig, some, strict=True)], pa.binary()),
                    pa.array([b if k else None for b, k in zip(bands.view(np.int64), some, strict=True)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() if k else None for s, k in zip(low, some, strict=True)], pa.binary()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def _alike(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sketches and set sizes allow the similarity, with the number of equal places."""
    sided = pairs.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    sided = sided.join(sketch.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    sided = sided.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("equal", T.IntegerType())])
    least = int(LEAST * percent / 100 * COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (text_bytes(batch.column(c))[0].reshape(-1, COORDINATES) for c in ("s_a", "s_b"))
            equal = (x == y).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal)], names=schema.names).filter(pa.array(equal >= least))

    return sided.mapInArrow(run, schema)


def _across(full: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket.

    full: (key, id) of buckets. Of a bucket of more than one component, the members outside its largest
    are sent to each block of its members, so a bucket of any size is dealt out over many tasks. There
    their sketches, and then their sets, are compared with the block's, and of each component in the
    block one link is reported for each of them: more would join nothing else.
    """
    held = full.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    sizes = held.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), F.max(F.struct("n", "part")).alias("top"))
    # In a bucket of two classes the star was the only pair.
    buckets = buckets.filter("parts > 1 and members > 2").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.col("top.part").alias("top"))
    held = checkpointed(held.join(buckets, "key"))
    sets = _members(held, docs, size)
    held = held.join(sets, "id").join(classes.select("id", "sketch", "bands"), "id")
    place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    columns = ["key", "id", "part", "members", "sketch", "bands"]
    members = held.select(*columns, F.lit(False).alias("asks"), place.alias("block"))
    asking = held.filter("part <> top").select(*columns, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    least = int(LEAST * percent / 100 * COORDINATES)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, asks, ids, part = table.column("key")[0].as_py(), table.column("asks").to_numpy(), table.column("id").to_numpy(), table.column("part").to_numpy()
        sketch = text_bytes(table.column("sketch"))[0].reshape(-1, COORDINATES)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES // BAND)
        raw, offsets = text_bytes(table.column("members"))
        shingle = np.unique(raw.view(np.uint64), return_inverse=True)[1]
        first = offsets // 8
        n = np.diff(first)
        others = np.flatnonzero(~asks)
        marked = np.zeros(len(shingle) + 1, bool)
        rows = []
        for i in np.flatnonzero(asks).tolist():
            fit = others[(part[others] != part[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            fit = fit[(sketch[fit] == sketch[i]).sum(axis=1) >= least]
            fit = fit[bands[i][(bands[fit] == bands[i]).argmax(axis=1)] == key]  # each pair in the first bucket that it shares only
            if not len(fit):
                continue
            own = shingle[first[i] : first[i + 1]]
            marked[own] = True
            shared = np.array([marked[shingle[first[j] : first[j + 1]]].sum() for j in fit])
            marked[own] = False
            fit = fit[100 * shared >= percent * (n[fit] + n[i] - shared)]
            fit = fit[np.unique(part[fit], return_index=True)[1]]
            rows += [(int(ids[i]), int(ids[j])) for j in fit]
        return pa.table([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], names=["a", "b"])

    return members.unionByName(asking).groupBy("key", "block").applyInArrow(compare, "a long, b long").distinct()


def _members(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, members): the full sets of the documents named by ``ids``, made anew from the texts."""
    needed = ids.select("id").distinct()
    place = top_bits(F.xxhash64("id"))
    shipped = filter_table(needed, place)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("members", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value.view(np.uint64)

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_filter(batch.column("place").to_numpy().view(np.uint64), table)
                if hit.any():
                    yield batch.filter(pa.array(hit))

        for part in slices(wanted(), "text"):
            hashes, first = shingle_sets(part, "text", size)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=schema.names)

    found = docs.filter("id is not null").withColumn("place", place).mapInArrow(sets, schema).join(needed, "id", "left_semi").groupBy("id").agg(F.min("members").alias("members"))
    return written(found, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of ids those whose full sets have 100 * intersection >= percent * union."""
    sided = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("m_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("m_b")), "b")
    linked = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("m_a"), batch.column("m_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=linked.names).filter(pa.array(keep, pa.bool_()))

    return sided.mapInArrow(compare, linked)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach), kept (the id is its own component).

    Two rows are linked if 100 * intersection >= percent * union of their shingle sets. Null, empty and
    wordless texts have no shingles, no links and a component of their own. Rows with a null id are kept
    and in no component (null). Repeated rows of one id and text get equal results. An id stands for one
    text; where several share one, each finds candidates, and links are judged by the set whose bytes are
    least. Other columns, whatever their names, are dropped. Bands and their number are made for 0.8 and
    above: below 80 percent links would be missed, and so it is an error.
    """
    if percent < 80:
        raise ValueError("percent must be at least 80")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scanned = written(_scan(docs, shingle), "sketches")
    named = scanned.filter("sig is not null and id is not null")
    classes = written(named.groupBy("sig").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    keys = classes.select("id", F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    full = checkpointed(keys.join(pivots, "key"))  # buckets of more than one class
    sketch = classes.select("id", "n", "sketch")
    stars = full.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = checkpointed(_alike(stars, sketch, percent))
    best = stars.groupBy("b").agg(F.max(F.struct("equal", F.negative("a").alias("a"))).alias("best")).select(F.negative("best.a").alias("a"), "b")
    sets = _members(stars.select(F.explode(F.array("a", "b")).alias("id")), docs, shingle)
    links = checkpointed(_confirmed(checkpointed(best), sets, percent))
    found = components(links).hint("merge")  # as many rows as linked documents: never broadcast

    apart = stars.join(best, ["a", "b"], "left_anti").select("a", "b")
    for side in ("a", "b"):
        apart = apart.join(found.select(F.col("id").alias(side), F.col("component").alias(f"part_{side}")), side, "left").withColumn(f"part_{side}", F.coalesce(f"part_{side}", side))
    for step in ("stars", "blocks"):
        more = _confirmed(apart.filter("part_a <> part_b"), sets, percent) if step == "stars" else _across(full, found, classes, docs, shingle, percent)
        more = checkpointed(more)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links).hint("merge")
    placed = classes.select("sig", "id").join(found, "id", "left").select("sig", F.coalesce("component", "id").alias("component"))
    return scanned.select("id", "n_shingles", "sig").join(placed, "sig", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
