"""What the operators share: durable intermediate tables and byte-level views of Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; its working arrays take about 60 times as much.
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset an own one is made on a local master, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tesserae-"))
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is over: the folder's owner clears it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Its size is that of its files. A checkpoint keeps an estimate, and that of a join is the product of its sides'; where a
    round of a loop joins what the one before made, the digits of this number double each round and fill the driver's memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a filter of hashes: 2 MB at any size of the input.
FILTER_BITS = 24


def unused(columns: list[str], stem: str) -> str:
    """A name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def filter_table(df: DataFrame, place: Column):
    """A broadcast table with the bits of ``place`` (0 to 2^FILTER_BITS - 1) of all rows set."""
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    slots = df.select(place.alias("place")).selectExpr("shiftright(place, 6) as slot", "shiftleft(1L, cast(place & 63 as int)) as bit")
    for row in slots.groupBy("slot").agg(F.bit_or("bit").alias("mask")).collect():  # at most 2^(FILTER_BITS - 6) rows
        table[row.slot] = row.mask
    return df.sparkSession.sparkContext.broadcast(table)


#: Most bits of a filter that follows the number of its hashes: 64 MB.
MOST_BITS = 29


def sized_filter(hashes: DataFrame, column: str):
    """(broadcast table, bits): as ``filter_table`` over the top bits of ``column``, with some 32 bits for each row, 2^MOST_BITS at most.

    ``hashes`` is read twice. Beyond a bit for each hash more pass by chance; what stands behind the filter decides.
    """
    n = hashes.count()
    bits = min(MOST_BITS, max(16, (32 * n).bit_length()))
    places = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("place")).selectExpr("shiftright(place, 6) as slot", "shiftleft(1L, cast(place & 63 as int)) as bit")
    masks = places.groupBy("slot").agg(F.bit_or("bit").alias("mask")).toArrow()  # at most 2^(bits - 6) rows of two longs
    table = np.zeros(1 << (bits - 6), np.int64)
    table[masks.column("slot").to_numpy()] = masks.column("mask").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table), bits


def in_filter(place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which places (uint64) have their bit set."""
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def top_bits(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - FILTER_BITS)


def parted(df: DataFrame, hashed: Column, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be wanted, all other rows) of ``df`` by a 64-bit hash, against those in ``wanted``'s ``column``.

    Rows meet a broadcast filter of fixed size as they are read, by DataFrame functions alone, so only the
    first part has to meet ``wanted`` in a join; where few are wanted the other part, which is nearly all,
    is never shuffled.
    """
    slot, mask, hit = (unused(df.columns, name) for name in ("slot", "mask", "hit"))
    place = top_bits(F.col(column))
    bits = wanted.select(place.alias("place")).selectExpr("shiftright(place, 6) as slot", "shiftleft(1L, cast(place & 63 as int)) as bit")
    bits = checkpointed(bits.groupBy("slot").agg(F.bit_or("bit").alias("mask")))  # at most 2^(FILTER_BITS - 6) rows
    own = top_bits(hashed)
    marked = df.withColumn(slot, F.shiftright(own, 6)).join(F.broadcast(bits.select(F.col("slot").alias(slot), F.col("mask").alias(mask))), slot, "left")
    marked = marked.withColumn(hit, F.coalesce(F.call_function("shiftright", F.col(mask), own.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return tuple(marked.filter(F.col(hit) if side else ~F.col(hit)).select(*df.columns) for side in (True, False))


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key, of one column or more) where it has the key, null elsewhere.

    ``weight`` says how many rows of ``left`` have the key. Keys that would fill a tenth of a shuffle
    partition are met where the rows lie, by a broadcast of no more than ten rows a partition; all others are
    shuffled, and none of them is hot. ``weight`` is dropped.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(weight).alias("n")).first().n or 0
    hot = right.filter(F.col(weight) * (10 * parts) > F.lit(total)).drop(weight)
    met = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(right.drop(weight).hint("merge"), key, "left")
    return met.unionByName(rest)


#: Rows of one Arrow batch between the JVM and Python. Documents are long rows: ten thousand, the usual number, are 20 MB
#: and more, held several times on either side.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, unless it has been given a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as (bytes, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of at most ``limit`` text bytes; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (in place on a copy): every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class RollingHash:
    """64-bit polynomial hashes of any byte spans of one slice, from prefix sums modulo 2^64.

    Cheap, for features and for the order of samples, where a collision decides nothing: texts made for it
    (long alternations of two patterns) collide under every base. ``SpanHash`` names texts.

    hash(i, j) = sum of code[b_t] * B^(t - i) over i <= t < j, finalised together with the length.
    B is odd and so has an inverse, by which a difference of prefix sums is moved to position 0.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        self.base = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.seed = seed
        up, self.down = self._tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes(seed)[data] * up[: len(data)], out=self.sums[1:])

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = self._powers.get(self.seed)
        if known is None or len(known[0]) < n:
            size = max(SLICE_BYTES + 1, n)
            both = []
            for factor in (self.base, pow(self.base, -1, 1 << 64)):
                table = np.full(size, factor, np.uint64)
                table[0] = 1
                both.append(np.cumprod(table, dtype=np.uint64))
            known = (both[0], both[1])
            if size <= 4 * SLICE_BYTES:
                self._powers[self.seed] = known
        return known

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.down[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: The modulus of ``SpanHash``, a prime.
PRIME = (1 << 61) - 1
_P, _61, _32, _31, _30, _29 = (np.uint64(v) for v in (PRIME, 61, 32, 31, 30, 29))
_LOW32, _LOW31, _LOW30, _LOW29 = (np.uint64((1 << k) - 1) for k in (32, 31, 30, 29))
#: Bytes whose terms are summed before they are reduced: their arrays stay in a core's cache, and their sums below 2^63.
_BLOCK = 1 << 15


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2^64 modulo PRIME."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of values below PRIME, by halves of 31 bits: 2^62 is 2 and 2^61 is 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def _powers(factor: int, n: int) -> np.ndarray:
    table = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        table[done : done + more] = _times(table[:more], np.uint64(pow(factor, done, PRIME)))
        done += more
    return table


class SpanHash:
    """64-bit hashes of any byte spans of one slice, from prefix sums of a polynomial modulo a prime.

    hash(i, j) = sum of (b_t + 1) * B^(t - i) over i <= t < j modulo 2^61 - 1, finalised together with the
    length. Two different spans of n bytes agree for at most n of the 2^61 bases; two seeds have
    independent bases.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        low, high, self.down = self._powers_of(seed, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        carry = np.uint64(0)
        for at in range(0, len(data), _BLOCK):
            code = data[at : at + _BLOCK].astype(np.uint64) + np.uint64(1)
            small = np.cumsum(code * low[at : at + len(code)], dtype=np.uint64)
            large = np.cumsum(code * high[at : at + len(code)], dtype=np.uint64)
            part = _reduced((small & _P) + (small >> _61) + (large >> _29) + ((large & _LOW29) << _32) + carry)
            self.sums[at + 1 : at + 1 + len(code)] = part
            carry = part[-1]

    @classmethod
    def _powers_of(cls, seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Low and high halves of the base's powers, and the powers of its inverse."""
        known = cls._tables.get(seed)
        if known is None or len(known[0]) < n:
            size = max(SLICE_BYTES + 1, n)
            base = int(mix(np.array([seed], np.uint64))[0]) % (PRIME - 512) + 512
            up = _powers(base, size)
            known = (up & _LOW32, up >> _32, _powers(pow(base, -1, PRIME), size))
            if size <= 4 * SLICE_BYTES:
                cls._tables[seed] = known
        return known

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = _times(_reduced(self.sums[stop] + (_P - self.sums[start])), self.down[start])
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 1) -> np.ndarray:
    """``SpanHash`` of each word (spans in order that don't overlap), made piece by piece: of a long text only a piece is expanded at once."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(stop, start[at] + SLICE_BYTES, side="right")))
        base = start[at]
        out[at:end] = SpanHash(data[base : stop[end - 1]], seed).spans(start[at:end] - base, stop[at:end] - base)
        at = end
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes whose ``inside`` entry is true, not crossing documents.

    Returns each word's start and stop, and for each document the index of its first word (one more at the end).
    """
    on = inside[data]
    edge = np.zeros(len(data) + 1, bool)  # a word can begin where the byte before is outside or of another document
    edge[offsets] = True
    first = on.copy()
    first[1:] &= ~on[:-1] | edge[1:-1]
    last = on.copy()
    last[:-1] &= ~on[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
