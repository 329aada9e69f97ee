"""Nearest vectors for a stated set of queries, in blocks or in cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import settled

BLOCK_ROWS = 4096
#: Queries that a task multiplies at a time, and rows of (query, cell, vector) that it hands on at once; they bound a task's memory, not the result.
STEP = 256

def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(rows), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, id, similarity (cosine, 6 places), rank: the k rows nearest to each query row, itself left out.

    Rows and queries are dealt into blocks of about ``block_rows``; each pair of blocks is one matrix
    product, from which only k rows a query go on. Vectors have one length; rows without one are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).filter(F.size("v") > 0)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("m")).first()
    n_blocks, q_blocks = -(-(counts.n or 0) // block_rows) or 1, -(-(counts.m or 0) // block_rows) or 1
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    held = rows.select("id", "v", F.lit(False).alias("asks"), spread(n_blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("q_block"))
    asked = rows.filter("q").select("id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), spread(q_blocks).alias("q_block"))

    def product(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        q, r = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out: list[tuple[int, int, float]] = []
        if q.num_rows and r.num_rows:
            ids, q_ids = r.column("id").to_numpy(), q.column("id").to_numpy()
            asked_units, held_units = _matrix(q.column("v")), _matrix(r.column("v"))
            for first in range(0, len(q_ids), STEP):
                similar = np.round(asked_units[first : first + STEP] @ held_units.T, 6)
                for i, own in enumerate(q_ids[first : first + STEP].tolist()):
                    order = np.lexsort((ids, -similar[i]))
                    order = order[ids[order] != own][:k]
                    out += [(own, int(ids[j]), float(similar[i, j])) for j in order]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query", "id", "similarity"])

    best = held.unionByName(asked).groupBy("block", "q_block").applyInArrow(product, "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Cells at most, however many rows there are; pivots are collected and sent to all tasks.
MOST_CELLS = 512
#: Queries of one partition, about, and shares in which each partition is shown all rows.
QUERY_ROWS, SHARES = 2048, 2
#: What a similarity of 6 places may miss of its bound.
_SLACK = 2e-6


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _matrix(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of STEP rows at most, an empty one as it is."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), STEP):
            yield batch.slice(at, STEP)


def in_cells(vectors: DataFrame, vector_col: str = "v", cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(rows with cell and far, pivots): each row in the cell of its nearest pivot, far away from it (Euclidean, of unit vectors).

    Pivots are the rows whose vectors have the least hashes, about the square root of the rows and MOST_CELLS at
    most: a bounded sample, on which no result depends. Zero vectors are in cell -1. The rows are computed once.
    """
    n = vectors.count()
    wanted = cells or int(np.clip(np.sqrt(n), 1, MOST_CELLS))
    chosen = vectors.select(vector_col, F.xxhash64(vector_col).alias("hash")).orderBy("hash").limit(wanted).toArrow()
    units = _units(chosen.column(vector_col)) if chosen.num_rows else np.zeros((0, 1))
    pivots = units[(units != 0).any(axis=1)]
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            unit = _units(batch.column(vector_col)) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            cell, far = np.full(len(unit), -1, np.int32), np.zeros(len(unit))
            some = (unit != 0).any(axis=1)
            if some.any():
                away = np.sqrt(np.maximum(0, 2 - 2 * unit[some] @ pivots.T))
                cell[some], far[some] = away.argmin(axis=1), away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=schema.names)

    return settled(vectors.mapInArrow(assign, schema)), pivots


def _first(similar: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's ``k`` greatest values, the greatest first, of equals the first: only what reaches the k-th is sorted."""
    n = similar.shape[1]
    if n <= 4 * k:
        return np.argsort(-similar, axis=1, kind="stable")[:, :k]
    least = np.partition(similar, n - k, axis=1)[:, n - k]
    row, place = np.nonzero(similar >= least[:, None])
    order = np.lexsort((place, -similar[row, place], row))
    starts = np.searchsorted(row, np.arange(len(similar)))
    return place[order][starts[:, None] + np.arange(k)]


def _bounds(unit: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The greatest similarity that a row of each cell (columns) can have with each unit vector (rows), by the triangle of it, the pivot and the row."""
    away = np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots.T))
    least = np.maximum(0, np.maximum(away - far, near - away))
    return np.where((unit != 0).any(axis=1)[:, None], 1 - least**2 / 2, 0.0)


def in_blocks(held: DataFrame, sizes: list, pivots: np.ndarray, k: int, block_rows: int) -> DataFrame:
    """cell, block, ids, v, floors, reads: the rows (id, v, asks, cell) of a cell in blocks of about ``block_rows``, a block in one row.

    ids ascend. floors has what the ``k``-th best row of a query's own block reaches (-2 where it holds fewer), null for rows
    that don't ask; reads the cells that one of the block's queries must read, its own among them.
    """
    cells = np.array([r.cell for r in sizes if r.cell >= 0], int)
    near, far = (np.array([r[c] for r in sizes if r.cell >= 0]) for c in ("near", "far"))
    zero = any(r.cell < 0 for r in sizes)
    total = sum(r.n for r in sizes)
    if not sizes:
        sizes = [Row(cell=-1, n=0)]
    of = F.create_map(*[F.lit(x) for r in sizes for x in (r.cell, -(-r.n // block_rows) or 1)])  # an entry for each cell
    dealt = held.select("id", "v", "asks", "cell", F.pmod(F.xxhash64("id"), of[F.col("cell")]).alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        cell, asks = table.column("cell")[0].as_py(), table.column("asks").to_numpy()
        unit = _matrix(table.column("v"))
        floors, reads = np.full(len(unit), np.nan), np.zeros(len(cells) + zero, bool)
        for at in range(0, len(unit), STEP):
            own = np.flatnonzero(asks[at : at + STEP]) + at
            floors[own] = np.partition(np.round(unit[own] @ unit.T, 6), len(unit) - k, axis=1)[:, len(unit) - k] if len(unit) >= k else -2.0
            bound = _bounds(unit[own], pivots[cells], near, far) if len(cells) else np.zeros((len(own), 0))
            reads |= (np.hstack([bound, np.zeros((len(own), int(zero)))]) >= floors[own][:, None] - _SLACK).any(axis=0)
        found = {*np.append(cells, [-1] * zero)[reads].tolist(), *([cell] if asks.any() else [])}
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        one = {"cell": cell, "block": table.column("block")[0].as_py(), "ids": table.column("id").to_numpy().tobytes(), "v": flat.astype(kind).tobytes(), "floors": floors.tobytes(), "reads": sorted(found)}
        return pa.Table.from_pylist([one], pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("floors", pa.binary()), ("reads", pa.list_(pa.int32()))]))

    kind = _kind(held)
    packed = dealt.repartition(-(-total // QUERY_ROWS) or 1, "cell", "block").groupBy("cell", "block").applyInArrow(pack, "cell int, block long, ids binary, v binary, floors binary, reads array<int>")
    return settled(packed)


def _kind(rows: DataFrame) -> type:
    """The numpy type that holds the elements of ``v`` exactly."""
    return np.float32 if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else np.float64


class _Best:
    """The ``k`` best rows seen so far of each query of a block; what is below ``floors`` can't be among a query's best of all."""

    def __init__(self, ids: bytes, v: bytes, floors: bytes, kind: type, k: int) -> None:
        floors = np.frombuffer(floors, np.float64)
        asks = ~np.isnan(floors)
        self.ids, self.floors, self.k = np.frombuffer(ids, np.int64)[asks], floors[asks], k
        self.unit = unpacked(v, kind, len(floors))[asks]
        self.similar = np.full((len(self.ids), k), -3.0)
        self.found = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, unit: np.ndarray, rows: np.ndarray) -> None:
        """Compares the queries ``rows`` with a block of rows, whose ids ascend."""
        for at in range(0, len(rows), STEP):
            of = rows[at : at + STEP]
            s = self.unit[of] @ unit.T
            hit = np.flatnonzero(s >= self.floors[of][:, None] - _SLACK)
            if len(hit) > 4 * self.k * len(of):
                s = np.round(s, 6)
                place = _first(s, self.k)
                row, value = np.repeat(of, place.shape[1]), np.take_along_axis(s, place, 1).ravel()
                place = place.ravel()
            else:
                row, place = np.divmod(hit, s.shape[1])
                value = np.round(s[row, place], 6)
                row = of[row]
            if not len(row):
                continue
            touched = np.unique(row)
            owner = np.concatenate([np.repeat(touched, self.k), row])
            value = np.concatenate([self.similar[touched].ravel(), value])
            name = np.concatenate([self.found[touched].ravel(), ids[place]])
            order = np.lexsort((name, -value, owner))
            best = order[np.searchsorted(owner[order], touched)[:, None] + np.arange(self.k)]
            self.similar[touched], self.found[touched] = value[best], name[best]
            self.floors[touched] = np.maximum(self.floors[touched], self.similar[touched, -1])


def unpacked(v: bytes, kind: type, n: int) -> np.ndarray:
    m = np.frombuffer(v, kind).astype(np.float64).reshape(n, -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best_of_blocks(blocks: DataFrame, sizes: list, pivots: np.ndarray, k: int, kind: type) -> DataFrame:
    """query, id, similarity: of each query (``in_blocks``) its ``k`` best rows in each of SHARES shares of the blocks, perhaps without such as others surpass.

    A task has the queries of one partition and is shown the blocks of one share, one after another; all are read where they
    are stored. Nothing is shuffled but the rows found, which are SHARES times ``k`` for a query at most.
    """
    by_cell = {r.cell: (r.near, r.far) for r in sizes}
    shown = blocks.select("cell", "block", "ids", "v").coalesce(SHARES)
    asking = blocks.filter(F.size("reads") > 0).select("reads", *(F.col(c).alias(f"q_{c}") for c in ("cell", "block", "ids", "v", "floors")))
    pairs = shown.hint("shuffle_replicate_nl").join(asking, F.array_contains("reads", F.col("cell"))).drop("reads")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[tuple, _Best] = {}
        last, ids, unit = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                cell, block, q_cell, q_block = (batch.column(c)[i].as_py() for c in ("cell", "block", "q_cell", "q_block"))
                if (cell, block) != last:
                    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    last, unit = (cell, block), unpacked(batch.column("v")[i].as_buffer(), kind, len(ids))
                best = queries.get((q_cell, q_block))
                if best is None:
                    best = queries[q_cell, q_block] = _Best(*(batch.column(c)[i].as_py() for c in ("q_ids", "q_v", "q_floors")), kind, k)
                reads = np.ones(len(best.ids), bool)
                if cell != q_cell:
                    near, far = by_cell[cell]
                    bound = _bounds(best.unit, pivots[[cell]], near, far)[:, 0] if cell >= 0 else np.zeros(len(reads))
                    reads = bound >= best.floors - _SLACK
                best.meet(ids, unit, np.flatnonzero(reads))
        for best in queries.values():
            some = best.similar.ravel() > -3
            for at in range(0, len(some), 16 * STEP):
                part = slice(at, at + 16 * STEP)
                columns = (np.repeat(best.ids, k)[part], best.found.ravel()[part], best.similar.ravel()[part])
                yield pa.RecordBatch.from_arrays([pa.array(c[some[part]]) for c in columns], names=["query", "id", "similarity"])

    return pairs.mapInArrow(meet, "query long, id long, similarity double")


def cells_to_read(asked: DataFrame, floors: DataFrame, sizes: list, pivots: np.ndarray) -> DataFrame:
    """query, v, cell: the cells other than its own that a query must read.

    A row of a cell is at least as far from the query as the pivot is, less the cell's radius; where that is too
    far for the similarity that the query's own cell gives (floor, none where it holds too few), the cell is skipped.
    ``sizes`` has cell, near and far (least and greatest distance from the pivot) of each cell.
    """
    cells = sorted(r.cell for r in sizes if r.cell >= 0)
    near, far = ({r.cell: r[c] for r in sizes} for c in ("near", "far"))
    inner, outer = np.array([near[c] for c in cells]), np.array([far[c] for c in cells])
    zero = any(r.cell < 0 for r in sizes)
    schema = T.StructType([T.StructField("query", T.LongType()), asked.schema["v"], T.StructField("cell", T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            if not batch.num_rows:
                continue
            unit = _units(batch.column("v"))
            floor = batch.column("floor").fill_null(-2.0).to_numpy(zero_copy_only=False)
            bound = _bounds(unit, pivots[cells], inner, outer) if cells else np.zeros((len(unit), 0))
            if zero:
                bound = np.hstack([bound, np.zeros((len(unit), 1))])
            names = np.array([*cells, *([-1] if zero else [])], np.int32)
            reads = (bound >= floor[:, None] - _SLACK) & (names != batch.column("cell").to_numpy()[:, None])
            row, which = np.nonzero(reads)
            for at in range(0, len(row), 16 * STEP):  # a query may read all cells, each time with its vector
                of = pa.array(row[at : at + 16 * STEP])
                yield pa.RecordBatch.from_arrays([batch.column("query").take(of), batch.column("v").take(of), pa.array(names[which[at : at + 16 * STEP]])], names=schema.names)

    return asked.join(floors, "query", "left").select("query", "v", "cell", "floor").mapInArrow(choose, schema)


def nearest_by_cells(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``nearest``, exact too, for very many queries: a query reads only the cells that can hold one of its ``k`` nearest.

    Equal vectors are searched once, by the least of their ids, and each gives its k + 1 least ids; so a vector
    that a third of the rows has is one row of its cell. A query's own block is read first. Cells are held in blocks of
    ``block_rows``, which meet where they are stored: neither rows nor queries are shuffled once for each cell. Rows with a null id
    or without a vector are left out; ids are distinct.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).filter((F.size("v") > 0) & F.col("id").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("r"), F.bool_or("q").alias("asks"))
    held, pivots = in_cells(classes.select(F.col("r.id").alias("id"), F.col("r.v").alias("v"), "asks", "h1", "h2"), cells=cells)
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()  # a row for each cell
    best = lambda df, n: df.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))).filter(F.col("nth") <= n)
    blocks = in_blocks(held, sizes, pivots, k + 1, block_rows)
    found = best(settled(best_of_blocks(blocks, sizes, pivots, k + 1, _kind(held))), k + 1).drop("nth")

    names = held.select(F.col("id").alias("least"), "h1", "h2")
    members = rows.join(names, ["h1", "h2"]).select("least", "id", "q")
    firsts = members.select(F.col("least").alias("id"), F.col("id").alias("member")).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("member"))).filter(F.col("nth") <= k + 1).drop("nth")
    listed = best(found.join(firsts, "id").select("query", F.col("member").alias("id"), "similarity"), k + 1).drop("nth")
    held_lists = listed.groupBy(F.col("query").alias("least")).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "id"))).alias("near"))  # k + 1 at most
    each = members.filter("q").join(held_lists, "least").select(F.col("id").alias("query"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return each.select("query", F.posexplode("near").alias("at", "x")).select("query", "x.id", (-F.col("x.less")).alias("similarity"), (F.col("at") + 1).alias("rank"))
