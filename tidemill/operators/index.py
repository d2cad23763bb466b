"""An index of chunks: built from documents, searched by words and vectors, cited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation as C
from tidemill.operators import dedup as D
from tidemill.operators import providers as P
from tidemill.operators import retrieval as R
from tidemill.sources import files as S

#: So many queries at most, and so many of their distinct terms times queries, go to every task; more of them meet the chunks by joins.
FEW, CELLS = 4096, 1 << 22


def built(documents: DataFrame, encoder: Callable[[], P.Encoder], dim: int, size: int = 700, overlap: int = 100) -> dict[str, DataFrame]:
    """chunks (id, doc_id, ordinal, section, text), vectors (id, v) and a manifest row of documents (doc_id, text).

    Texts are normalised, empty ones dropped; of equal texts the first document's stays, and of equal chunks the first.
    """
    rows = documents.select("doc_id", T.normalize(T.nfkc(F.col("text"))).alias("text"))
    # equal texts have equal chunks, of which the first document's stay, too: only hashes of texts are shuffled
    once = D.keep_first(rows.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("hash")), ["hash"], ["doc_id"])
    parts = S.normalized_chunks(documents, "doc_id", "text", size, overlap)
    named = parts.select(F.col("chunk_id").alias("id"), F.col("id").alias("doc_id"), "ordinal", "section", F.col("chunk").alias("text"), "hash")
    chunks = D.keep_first(named, ["hash"], ["doc_id", "ordinal"]).drop("hash")
    vectors = chunks.select("id", P.embedded(F.col("text"), encoder, dim).alias("v"))
    corpus = D.digests(once.select(F.lit("corpus").alias("of"), "hash", F.concat_ws("|", F.col("doc_id").cast("string"), "hash").alias("line")), "of", "hash", "line")
    counts = documents.agg(F.count("*").alias("n_documents")).join(once.agg(F.count("*").alias("n_unique")))
    manifest = counts.join(corpus.select(F.col("digest").alias("corpus_hash"))).select("n_documents", "n_unique", "corpus_hash", F.lit(dim).alias("dim"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"))
    return {"chunks": chunks, "vectors": vectors, "manifest": manifest}


def retrieved(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, encoder: Callable[[], P.Encoder], dim: int, dense_k: int = 30, sparse_k: int = 30, fused_k: int = 20, k: int = 4, reranker: Callable[[], P.Scorer] | None = None) -> DataFrame:
    """topic, rank, id, score: for rows of queries (topic, query) the k best chunks.

    Blank queries are dropped. Each query has a list by vectors and one by words; a topic's lists are
    fused, and its candidates reranked against its queries, one a line (by the fused score without a reranker).
    """
    asked = queries.where(F.trim("query") != "").select("topic", F.trim("query").alias("query")).distinct().withColumn("query_id", F.xxhash64("topic", "query"))
    words, v = chunks.select("id", T.tokens(F.col("text")).alias("w")), P.embedded(F.col("query"), encoder, dim)
    few = asked.select("query_id", v.alias("q"), T.tokens(F.col("query")).alias("w")).limit(FEW + 1).collect()
    if len(few) <= FEW and len(few) * len({t for r in few for t in r["w"]}) <= CELLS:
        by_vector = R.dense_in_place(vectors, {r["query_id"]: r["q"] for r in few}, dense_k)
        by_words = R.bm25_in_place(words, {r["query_id"]: r["w"] for r in few}, sparse_k)
    else:
        by_vector = R.top(R.every_pair(vectors.select("id", "v"), asked.select("query_id", v.alias("q")), "id").select("query_id", "id", F.round(R.dot("v", "q"), 6).alias("score")), dense_k)
        by_words = R.bm25(words, asked.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")), sparse_k)
    lists = by_vector.select("query_id", "rank", "id").union(by_words.select("query_id", "rank", "id")).join(asked.select("query_id", "topic"), "query_id")
    fused = R.fused([lists.select(F.col("topic").alias("query_id"), "rank", "id")], fused_k)
    if reranker is not None:
        lines = asked.groupBy(F.col("topic").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_list("query")), "\n").alias("query"))
        # written, its size is known: where it is small, the chunks' texts aren't shuffled for it
        fused = C.kept(fused, "fused").join(chunks.select("id", "text"), "id").join(lines, "query_id")
    return P.reranked(fused, k, reranker).select(F.col("query_id").alias("topic"), "rank", "id", "score")


def cited(found: DataFrame, texts: DataFrame, most: int = 280) -> DataFrame:
    """found (topic, rank, id) with citation_id (S1, S2, ... by rank), the columns of texts (id, text and its provenance), and a snippet."""
    return found.join(texts, "id").withColumn("citation_id", F.concat(F.lit("S"), F.col("rank").cast("string"))).withColumn("snippet", T.snippet(F.col("text"), most))


def context(cited_rows: DataFrame, source: Column, body: Column) -> DataFrame:
    """topic and one text of its sources as numbered blocks, by rank: what a prompt is grounded in."""
    block = F.concat(F.lit("["), F.col("citation_id"), F.lit("] "), source, F.lit("\n"), body)
    lists = cited_rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))  # k blocks
    return lists.select("topic", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))
