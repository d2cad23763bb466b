"""Lexical and dense retrieval over tables of texts and vectors; queries are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

K1, B, RRF = 1.5, 0.75, 60
#: Scores are rounded to six digits, so what is this close to a query's k-th best can still come before it.
NEAR = 1e-5


def postings(tokens: DataFrame) -> DataFrame:
    """id, term, tf, length from rows (id, w: array of terms). Terms of one row are counted on the map side."""
    return tokens.select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).where("term IS NOT NULL").groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(tokens: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, rank, id, score of the top_k rows by BM25; queries are rows (query_id, term), where a term that repeats adds again.

    Terms that no query has are dropped before the postings are shuffled; document frequencies come from what is left.
    """
    totals = tokens.agg(F.count("*").alias("n_docs"), F.sum(F.size("w")).alias("n_terms"))
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    vocabulary = asked.select("term").distinct()
    words = tokens.select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).join(vocabulary, "term")
    own = words.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    frequency = own.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = own.join(frequency, "term").crossJoin(F.broadcast(totals))  # one row of totals
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (F.col("n_terms") / F.col("n_docs"))))
    scored = rows.select("id", "term", weight.alias("weight")).join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))
    return top(scored.withColumn("score", F.round("score", 6)).where("score > 0"), top_k)


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows of each query, ties to the smaller id; the window keeps k rows on the map side."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dense(corpus: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, rank, id, score by inner product of unit vectors; corpus (id, v) against the stated queries (query_id, q)."""
    left, right = corpus.select("id", unit("v").alias("v")), queries.select("query_id", unit("q").alias("q"))
    both = every_pair(left, right, "id").where(F.col("id") != F.col("query_id"))
    return top(both.select("query_id", "id", F.round(dot("v", "q"), 6).alias("score")), top_k)


def every_pair(rows: DataFrame, queries: DataFrame, key: str, rows_mb: int = 64) -> DataFrame:
    """The stated queries against all rows, in blocks: each block of rows (by hash of key) gets the queries once, by a join on its number. Nothing is broadcast."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(n for n in (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if n < 1 << 60)
    blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (rows_mb << 20)))
    left = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    right = queries.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(right, F.col("_block") == F.col("_of")).drop("_block", "_of")


def in_place(rows: DataFrame, query_ids: list[int], score: Callable[[pa.Array], np.ndarray], top_k: int, at_once: int = 1024) -> DataFrame:
    """query_id, rank, id, score: the top_k rows (id, and a column that score takes) of each of a few queries, which go to every task.

    score gives a matrix of rows and queries; -inf takes no part. Rows aren't shuffled: a task sends on what its k best so far don't exclude.
    """
    ids, column = np.asarray(query_ids, np.int64), next(c for c in rows.columns if c != "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((top_k, len(ids)), -np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                s = score(part.column(column))
                best = np.partition(np.concatenate([best, s]), len(s), axis=0)[len(s) :]
                row, q = np.nonzero((s >= best.min(axis=0) - NEAR) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), part.column("id").take(pa.array(row)), pa.array(s[row, q])], names=["query_id", "id", "score"])

    schema = StructType([*StructType.fromDDL("query_id long").fields, rows.schema["id"], *StructType.fromDDL("score double").fields])
    found = rows.select("id", column).mapInArrow(run, schema)
    return top(found.withColumn("score", F.round("score", 6)), top_k)


def dense_in_place(vectors: DataFrame, queries: dict[int, list[float]], top_k: int) -> DataFrame:
    """query_id, rank, id, score of the top_k rows (id, v) by inner product with a few queries."""
    q = np.array(list(queries.values()), np.float64).T
    score = lambda v: np.asarray(v.flatten(), np.float64).reshape(len(v), len(q)) @ q
    return in_place(vectors.select("id", "v").where("v is not null"), list(queries), score, top_k)


def bm25_in_place(tokens: DataFrame, queries: dict[int, list[str]], top_k: int) -> DataFrame:
    """bm25() for a few queries (their terms by query_id) over rows (id, w) whose ids are distinct: terms are counted and scored where the rows are."""
    words = sorted({t for terms in queries.values() for t in terms})
    n_words, vocabulary = len(words), pa.array(words, pa.string())
    number = {t: i for i, t in enumerate(words)}
    times = np.zeros((n_words, len(queries)))
    for q, terms in enumerate(queries.values()):
        for t in terms:
            times[number[t], q] += 1

    def counted(w: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How often each row has each term of the queries, and its length."""
        length = np.asarray(pc.fill_null(pc.list_value_length(w), 0), np.int64)
        code = np.asarray(pc.fill_null(pc.index_in(w.flatten().cast(pa.string()), value_set=vocabulary), -1), np.int64)
        at = (np.repeat(np.arange(len(w)), length) * n_words + code)[code >= 0]
        return np.bincount(at, minlength=len(w) * n_words).reshape(len(w), n_words), length

    at_once = max(16, min(1024, (1 << 21) // max(1, n_words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_words + 2, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                tf, length = counted(batch.slice(lo, at_once).column("w"))
                seen += np.append((tf > 0).sum(axis=0), [len(length), length.sum()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_words + 2, dtype=np.int32)), pa.array(seen)], names=["term", "n"])

    seen = np.zeros(n_words + 2)
    for r in tokens.select("w").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[r["term"]] = r["n"]
    n_rows, n_terms = seen[-2:]
    idf = np.log(1 + (n_rows - seen[:-2] + 0.5) / (seen[:-2] + 0.5))
    mean = n_terms / n_rows if n_terms else 1.0

    def score(w: pa.Array) -> np.ndarray:
        tf, length = counted(w)
        row, term = np.nonzero(tf)
        n = tf[row, term]
        weight = np.zeros(tf.shape)
        weight[row, term] = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[row] / mean))
        s = weight @ times
        return np.where(np.round(s, 6) > 0, s, -np.inf)

    return in_place(tokens.select("id", "w"), list(queries), score, top_k, at_once)


def fused(ranked: list[DataFrame], top_k: int) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, rank, id)."""
    rows = ranked[0].select("query_id", "rank", "id")
    for r in ranked[1:]:
        rows = rows.union(r.select("query_id", "rank", "id"))
    scored = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(RRF) + F.col("rank"))), 9).alias("score"))
    return top(scored, top_k)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg at k: ranked (query_id, rank, source) against relevant (query_id, source). A source counts at its first rank only."""
    first = ranked.where(F.col("rank") <= k).groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    hits = first.join(relevant, ["query_id", "source"]).groupBy("query_id").agg(F.count("*").alias("n_hits"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return wanted.join(hits, "query_id", "left").select("query_id", F.round(zero("n_hits") / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(zero("dcg") / ideal, 6).alias("ndcg"))


def within_budget(items: str, budget: int, extra: int = 32) -> Column:
    """Of an array of structs (rank, id, cost) in rank order, those that fit, skipping what doesn't and going on."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<long>").alias("ids"))
    step = lambda s, x: F.when(x["cost"] + extra <= s["left"], F.struct((s["left"] - x["cost"] - extra).alias("left"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s)
    return F.aggregate(items, start, step, lambda s: s["ids"])


def hash_embedding(words: DataFrame, dim: int) -> DataFrame:
    """id, v from rows (id, w): each word adds 1 or -1 at a place, both from its sha256; unit length; no words give the first axis."""
    h = F.sha2("word", 256)
    place = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = words.select("id", F.explode_outer("w").alias("word")).where("word IS NOT NULL").groupBy("id", place.alias("place")).agg(F.sum(sign).alias("x"))
    packed = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.coalesce(F.col("norm"), F.lit(0.0)) == 0, F.when(i == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")))
    return words.select("id").join(packed, "id", "left").select("id", value.alias("v"))


def hit_rate(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """n_queries, hit_rate: the share of queries (query_id, source) with a relevant source among the first k of ranked (query_id, rank, source)."""
    hit = ranked.where(F.col("rank") <= k).select("query_id", "source").distinct().join(relevant, ["query_id", "source"]).select("query_id").distinct().withColumn("hit", F.lit(1.0))
    queries = relevant.select("query_id").distinct()
    return queries.join(hit, "query_id", "left").agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"))


def checked(citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """citations (cited, said: an address) with a verdict from the manifest (source, address)."""
    met = citations.join(manifest, F.col("cited") == F.col("source"), "left")
    verdict = F.when(F.col("source").isNull(), "unknown_source").when(~F.col("address").eqNullSafe(F.col("said")), "other_address").otherwise("correct")
    return met.withColumn("verdict", verdict)
