"""Exact top-k inner products over a bit-sliced index.

Rows are packed into blocks. A block holds, for every dimension, its quantised
values as bit slices: one bitmap over the block's rows for each bit. A query's
scores are added up slice by slice with bitmap arithmetic (carry-save adders),
and the best rows are selected from the most significant score slice downward.
Rows tied at the boundary are resolved exactly, by the smaller identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import work_dir, written

#: Rows of one block (bitmaps of an eighth as many bytes), and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 16, 1 << 12
#: Rows and queries of one cell at most: cells are as wide as they may be, and there are as many along the queries as keep all tasks busy.
CELL_ROWS, CELL_QUERIES = 1 << 17, 1 << 12


def quantised(vectors: np.ndarray, factor: float) -> np.ndarray:
    return np.floor(vectors * factor).astype(np.int64)


def packed_values(values: np.ndarray) -> bytes:
    """The values behind a byte that says how wide they are."""
    small = not values.size or -(1 << 15) <= values.min() and values.max() < 1 << 15
    return (b"\x02" if small else b"\x08") + values.astype("<i2" if small else "<i8").tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[0] == 2 else "<i8", offset=1).astype(np.int64).reshape(-1, dim)


def slices_of(values: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps [dimension, bit, word] of non-negative values [row, dimension]; rows are padded to whole words."""
    n, d = values.shape
    padded = np.zeros((-(-n // 64) * 64, d), np.int64)
    padded[:n] = values
    out = np.empty((d, width, len(padded) // 64), np.uint64)
    for b in range(width):
        bits = ((padded >> b) & 1).astype(np.uint8).T
        out[:, b] = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)
    return out


def added(pending: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of the sum of bitmaps, where pending[w] holds bitmaps of weight 2^w."""
    w = 0
    while w < len(pending):
        row = pending[w]
        while len(row) > 2:
            a, b, c = row.pop(), row.pop(), row.pop()
            half = a ^ b
            row.append(half ^ c)
            if w + 1 == len(pending):
                pending.append([])
            pending[w + 1].append((a & b) | (half & c))
        if len(row) == 2:
            a, b = row.pop(), row.pop()
            row.append(a ^ b)
            if w + 1 == len(pending):
                pending.append([])
            pending[w + 1].append(a & b)
        w += 1
    return [row[0] if row else None for row in pending]


def score_slices(index: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of sum_d |q_d| * (x_d, or its complement where q_d < 0), and what to add to get the inner product with x."""
    width = index.shape[1]
    pending: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
    shift = 0
    for d in np.flatnonzero(query).tolist():
        q = int(query[d])
        rows = index[d] if q > 0 else ~index[d]
        if q < 0:
            shift += q * ((1 << width) - 1)
            q = -q
        for b in range(q.bit_length()):
            if q >> b & 1:
                while len(pending) < b + width:
                    pending.append([])
                for w in range(width):
                    pending[b + w].append(rows[w])
    return added(pending), shift


def best(slices: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Numbers of rows that hold every score among the k highest: all above the boundary, and all tied at it."""
    sure, open_ = np.zeros_like(live), live
    for bits in reversed(slices):
        if bits is None:
            continue
        some = open_ & bits
        n = int(np.bitwise_count(sure | some).sum())
        if n >= k:
            open_ = some
        else:
            sure, open_ = sure | some, open_ & ~bits
    return np.flatnonzero(np.unpackbits((sure | open_).view(np.uint8), bitorder="little"))


def _packed(rows: DataFrame, most: int, factor: float) -> DataFrame:
    """dim, ids, places, values: the rows (id, place, v) in blocks of at most `most`, of one dimension each."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("values", pa.binary())])

    def block(dim: int, parts: list) -> pa.RecordBatch:
        ids, places, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids.tobytes(), "places": places.tobytes(), "values": packed_values(quantised(values, factor))}], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, places, lists = np.asarray(batch.column("id"), np.int64), np.asarray(batch.column("place"), np.int64), batch.column("v")
            length = np.asarray(lists.value_lengths(), np.int64)
            flat = np.asarray(lists.flatten(), np.float64)
            start = np.cumsum(length) - length
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                while len(at):
                    kept = held.setdefault(dim, [])
                    room = most - sum(len(p[0]) for p in kept)
                    now, at = at[:room], at[room:]
                    kept.append((ids[now], places[now], flat[start[now][:, None] + np.arange(dim)]))
                    if len(now) == room:
                        yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            yield block(dim, parts)

    return rows.mapInArrow(pack, "dim int, ids binary, places binary, values binary")


class Block:
    """Rows with their bit slices."""

    def __init__(self, ids: bytes, places: bytes, values: bytes, dim: int):
        self.ids, self.places, self.dim = np.frombuffer(ids, np.int64), np.frombuffer(places, np.int64), dim
        rows = unpacked(values, dim)
        self.low = int(rows.min())
        self.index = slices_of(rows - self.low, max(1, int(rows.max() - self.low).bit_length()))
        live = np.zeros(self.index.shape[2] * 64, np.uint8)
        live[: len(self.ids)] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def best(self, place: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best rows, ties to the smaller id; the row at `place` is no candidate."""
        able, own = self.live, np.flatnonzero(self.places == place)
        if len(own):
            able = able.copy()
            able[own >> 6] &= ~(np.uint64(1) << (own & 63).astype(np.uint64))
        slices, shift = score_slices(self.index, query)
        at = best(slices, able, k)
        score = np.zeros(len(at), np.int64)
        for w, bits in enumerate(slices):
            if bits is not None:
                score += ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        score += shift + self.low * int(query.sum())
        first = np.lexsort((self.ids[at], -score))[:k]
        return at[first], score[first]


def top_k(vectors: DataFrame, is_query: F.Column, k: int, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows (all, if fewer) by the inner product of quantised vectors.

    A component x becomes floor(factor * x), x as double. Vectors that are null, empty, or hold
    null or non-finite components take no part, neither as query nor as candidate; vectors of
    another length than the query's aren't candidates of it. A row is no candidate of itself; another row with its
    identifier is, and two queries with one identifier have k rows each. Ties go to the smaller identifier, then equal rows are
    interchangeable. Null identifiers take no part. An empty table gives no rows.

    The stated queries meet all rows in cells: a number of query blocks with a number of row blocks. Every task has one cell's
    blocks (CELL_QUERIES and CELL_ROWS at most) and a row block's slices; only k rows for each query leave it.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = vectors.select(vectors[id_col].cast("long").alias("id"), F.transform(vectors[vector_col], lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = sound.where(F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))))
    sound = written(sound.withColumn("place", F.monotonically_increasing_id()), work_dir(spark, "vectors"))  # a row keeps its place from here on
    n = sound.agg(F.count("*").alias("rows"), F.count(F.when(F.col("q"), 1)).alias("queries")).first()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-n["rows"] // CELL_ROWS))
    across = max(1, -(-n["queries"] // CELL_QUERIES), min(n["queries"], -(-parallel // down)))
    rows = _packed(sound.repartition(down, "place").select("id", "place", "v"), BLOCK_ROWS, factor)
    rows = written(rows.withColumn("down", F.spark_partition_id()), work_dir(spark, "bit-slices"))
    asked = _packed(sound.where("q").repartition(across, "place").select("id", "place", "v"), BLOCK_QUERIES, factor)
    asked = written(asked.withColumn("across", F.spark_partition_id()), work_dir(spark, "queries"))

    def numbers(upto: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))

    def search(cell: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        wanted = [(dim, np.frombuffer(ids, np.int64), np.frombuffer(places, np.int64), unpacked(values, dim)) for dim, ids, places, values in zip(*(queries.column(c).to_pylist() for c in ("dim", "ids", "places", "values")), strict=True)]
        for dim, ids, places, values in zip(*(cell.column(c).to_pylist() for c in ("dim", "ids", "places", "values")), strict=True):
            block = Block(ids, places, values, dim)
            for q_dim, q_ids, q_places, q_values in wanted:
                if q_dim != dim:
                    continue
                for q, place, query in zip(q_ids.tolist(), q_places.tolist(), q_values, strict=True):
                    at, score = block.best(place, query, k)
                    found.append((np.full(len(at), q), np.full(len(at), place), block.ids[at], score))
        names = ["query_id", "place", "vec_id", "score"]
        if not found:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    left, right = rows.withColumn("across", numbers(across)), asked.withColumn("down", numbers(down))
    near = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(search, "query_id long, place long, vec_id long, score long")
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT place, vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM v),
s AS (
  SELECT a.place AS query_place, b.place, a.vec_id AS query_id, b.vec_id AS vec_id, sum(a.x * b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.d = b.d AND a.place <> b.place WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""
