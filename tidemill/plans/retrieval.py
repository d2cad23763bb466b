"""Retrieval queries: documents as corpus, benchmark texts as queries; embeddings with their labels as relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation as C
from tidemill.operators import index as I
from tidemill.operators import providers as P
from tidemill.operators import retrieval as R
from tidemill.plans.registry import query
from tidemill.plans.text import SQUEEZE, TOKENS
from tidemill.sources.tables import table


def tokens(spark, d, name="documents", id_col="doc_id"):
    return table(spark, d, name).select(F.col(id_col).alias("id"), T.tokens(F.col("text")).alias("w"))


def asked(spark, d):
    return tokens(spark, d, "benchmark", "item_id").select(F.col("id").alias("query_id"), F.explode_outer("w").alias("term"))


@query("term_document_frequency", f"WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_document_frequency(spark, d):
    return R.postings(tokens(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query("corpus_statistics", f"SELECT count(*) AS n_docs, sum(len({TOKENS}))::BIGINT AS n_terms, round(avg(len({TOKENS})), 6) AS mean_length FROM documents")
def corpus_statistics(spark, d):
    n = tokens(spark, d).select(F.size("w").alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms"), F.round(F.avg("n"), 6).alias("mean_length"))


def bm25_sql(k: int) -> str:
    return f"""
t AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::DOUBLE / count(*) AS avgdl FROM t),
p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


@query("bm25_top_documents", f"WITH {bm25_sql(5)} SELECT query_id AS item_id, rank, id AS doc_id, score FROM bm")
def bm25_top_documents(spark, d):
    return R.bm25(tokens(spark, d), asked(spark, d), 5).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query("bm25_multi_query", f"""WITH {bm25_sql(30)},
u AS (SELECT query_id % 5 AS topic, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM bm GROUP BY 1, 2)
SELECT topic, rank, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id)::INTEGER AS rank FROM u) WHERE rank <= 4""")
def bm25_multi_query(spark, d):
    lists = R.bm25(tokens(spark, d), asked(spark, d), 30)
    return R.fused([lists.withColumn("query_id", F.col("query_id") % 5)], 4).select(F.col("query_id").alias("topic"), "rank", F.col("id").alias("doc_id"), "score")


NORM = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
DENSE = f"""n AS (SELECT vec_id, label, {NORM} AS v FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.v, q.v), 6) AS score FROM n q JOIN n e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ds) WHERE rank <= 10)"""


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.dense(corpus, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("dense_top_k", f"WITH {DENSE} SELECT query_id, rank, id AS vec_id, score FROM de")
def dense_top_k(spark, d):
    return vectors(spark, d).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("hybrid_rrf", f"""WITH {DENSE}, {bm25_sql(10)},
u AS (SELECT query_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM de UNION ALL SELECT query_id, id, rank FROM bm) GROUP BY 1, 2)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM u) WHERE rank <= 5""")
def hybrid_rrf(spark, d):
    sparse = R.bm25(tokens(spark, d), asked(spark, d), 10)
    return R.fused([vectors(spark, d), sparse], 5).select("query_id", "rank", "id", "score")


@query("ranking_metrics", f"""WITH {DENSE},
fr AS (SELECT de.query_id, e.label AS source, min(de.rank) AS rank FROM de JOIN n e ON e.vec_id = de.id GROUP BY 1, 2),
rel AS (SELECT DISTINCT q.vec_id AS query_id, q.label AS source FROM n q WHERE q.vec_id % 100 = 0 UNION SELECT q.vec_id, (q.label + 1) % 10 FROM n q WHERE q.vec_id % 100 = 0),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS best, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM fr JOIN rel USING (query_id, source) GROUP BY query_id)
SELECT r.query_id, round(coalesce(hits, 0) / 2.0::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / best, 0), 6) AS mrr, round(coalesce(dcg, 0) / (1 + 1 / log2(3.0::DOUBLE)), 6) AS ndcg
FROM (SELECT DISTINCT query_id FROM rel) r LEFT JOIN h USING (query_id)""")
def ranking_metrics(spark, d):
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"))
    own = label.where("id % 100 = 0").select(F.col("id").alias("query_id"), "source")
    relevant = own.union(own.select("query_id", (F.col("source") + 1) % 10)).distinct()
    return R.ranking_metrics(vectors(spark, d).join(label, "id"), relevant, 10)


@query("citations_numbered", f"""WITH {bm25_sql(3)}
SELECT query_id AS item_id, 'S' || rank AS citation_id, id AS doc_id, d.source, CASE WHEN length(d.text) <= 100 THEN d.text ELSE substr(d.text, 1, 99) || '…' END AS snippet FROM bm JOIN documents d ON d.doc_id = bm.id""")
def citations_numbered(spark, d):
    best = R.bm25(tokens(spark, d), asked(spark, d), 3)
    texts = table(spark, d, "documents").select("doc_id", "source", F.when(F.length("text") <= 100, F.col("text")).otherwise(F.concat(F.substring("text", 1, 99), F.lit("…"))).alias("snippet"))
    return best.join(texts, F.col("id") == F.col("doc_id")).select(F.col("query_id").alias("item_id"), F.concat(F.lit("S"), F.col("rank").cast("string")).alias("citation_id"), "doc_id", "source", "snippet")


@query("top_source_agrees", f"""WITH {bm25_sql(1)} SELECT query_id AS item_id, id AS doc_id, contains(d.text, b.text) AS agrees FROM bm JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id""")
def top_source_agrees(spark, d):
    best = R.bm25(tokens(spark, d), asked(spark, d), 1)
    both = best.join(table(spark, d, "documents").select("doc_id", "text"), F.col("id") == F.col("doc_id")).join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("probe")), F.col("query_id") == F.col("item_id"))
    return both.select("item_id", "doc_id", F.expr("contains(text, probe)").alias("agrees"))


@query("review_gate", "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND source <> '' AND n_chars > 500 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def review_gate(spark, d):
    reviewed = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").where(F.col("lang").isin("en", "fr") & (F.col("source") != "") & (F.col("n_chars") > 500)).join(reviewed, "doc_id", "left_semi").select("doc_id", "source")


@query("chunk_budget_select", f"""
WITH RECURSIVE {bm25_sql(10)},
r AS (SELECT query_id, rank AS k, doc_id, greatest(1, (length(text) + 2) // 3) AS cost FROM bm JOIN documents ON doc_id = id),
g(query_id, k, left_over, ids) AS (
  SELECT DISTINCT query_id, 0, 3072::BIGINT, []::BIGINT[] FROM r
  UNION ALL SELECT g.query_id, r.k, CASE WHEN r.cost + 32 <= g.left_over THEN g.left_over - r.cost - 32 ELSE g.left_over END, CASE WHEN r.cost + 32 <= g.left_over THEN list_append(g.ids, r.doc_id) ELSE g.ids END
  FROM g JOIN r ON r.query_id = g.query_id AND r.k = g.k + 1)
SELECT query_id AS item_id, array_to_string(arg_max(ids, k), ',') AS ids FROM g GROUP BY query_id""")
def chunk_budget_select(spark, d):
    """Of each query's ten best documents those that fit a context of 3072 tokens."""
    best = R.bm25(tokens(spark, d), asked(spark, d), 10)
    cost = table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("cost"))
    lists = best.join(cost, F.col("id") == F.col("doc_id")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("items"))
    return lists.select(F.col("query_id").alias("item_id"), F.array_join(R.within_budget("items", 3072).cast("array<string>"), ",").alias("ids"))


@query("hash_embedding", f"""
WITH t AS (SELECT item_id AS id, unnest({TOKENS}) AS word FROM benchmark),
s AS (SELECT id, (('0x' || substr(sha256(word), 1, 8))::BIGINT % 16)::INTEGER AS place, sum(CASE WHEN ('0x' || substr(sha256(word), 9, 2))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM t GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM s GROUP BY id)
SELECT id AS item_id, place, round(x / norm, 9) AS x FROM s JOIN n USING (id) WHERE x <> 0""")
def hash_embedding(spark, d):
    v = R.hash_embedding(tokens(spark, d, "benchmark", "item_id"), 16)
    return v.select(F.col("id").alias("item_id"), F.posexplode("v").alias("place", "x")).where("x <> 0").withColumn("x", F.round("x", 9))


@query("keyword_lookup", """
WITH k(topic, word) AS (VALUES ('article', 'the'), ('article', 'der'), ('link', 'and'), ('link', 'und'), ('rare', 'zzz')),
m AS (SELECT DISTINCT item_id, topic FROM benchmark JOIN k ON contains(lower(text), word))
SELECT item_id, topic FROM m UNION ALL SELECT item_id, t FROM benchmark, (VALUES ('article'), ('link')) f(t) WHERE item_id NOT IN (SELECT item_id FROM m)""")
def keyword_lookup(spark, d):
    """Topics of which a keyword is contained; the first two topics where none is."""
    topics = spark.createDataFrame([("article", ["the", "der"]), ("link", ["and", "und"]), ("rare", ["zzz"])], "topic string, words array<string>")
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"))
    found = items.join(F.broadcast(topics), F.exists("words", lambda w: F.contains(F.col("t"), w))).select("item_id", "topic")
    return found.union(items.join(found, "item_id", "left_anti").select("item_id", F.explode(F.array(F.lit("article"), F.lit("link")))))


@query("sample_retrieval", """
WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 3))) AS w FROM benchmark),
s AS (SELECT item_id, conv_id, sum(2)::BIGINT AS score FROM q JOIN (SELECT conv_id, lower(text) AS t FROM conversations WHERE turn = 0) c ON contains(c.t, q.w) GROUP BY 1, 2)
SELECT item_id, conv_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id) AS k FROM s) WHERE k <= 2""")
def sample_retrieval(spark, d):
    """Two conversations for each query by words (3 letters or more) that their openings contain: the stated queries against all openings."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 3))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words"))
    c = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.lower("text").alias("t"))
    score = 2 * F.size(F.filter("words", lambda w: F.contains(F.col("t"), w)))
    both = R.every_pair(c, q, "id").select("query_id", "id", score.cast("long").alias("score")).where("score > 0")
    return R.top(both, 2).select(F.col("query_id").alias("item_id"), F.col("id").alias("conv_id"), "score")


@query("catalog_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') AND p_brand NOT IN ('Brand#2', 'Brand#17') AND p_size < 30")
def catalog_search(spark, d):
    words = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").where(F.contains(T.fold(words), F.lit("ring")) & ~F.col("p_brand").isin("Brand#2", "Brand#17") & (F.col("p_size") < 30)).select("p_partkey", "p_name")


@query("mutual_containment", """
SELECT DISTINCT p_partkey FROM part JOIN (SELECT DISTINCT lower(p_type) AS q FROM part WHERE p_size = 1) l ON contains(lower(p_type), l.q) OR contains(l.q, lower(p_type))""")
def mutual_containment(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("name"), "p_size")
    listed = p.where("p_size = 1").select(F.col("name").alias("q")).distinct()
    names = p.select(F.col("name").alias("of")).distinct()
    found = R.every_pair(names, listed, "of").where(F.contains("of", F.col("q")) | F.contains("q", F.col("of"))).select("of").distinct()
    return p.join(found, F.col("name") == F.col("of"), "left_semi").select("p_partkey")


@query("provider_embedding", f"""
WITH t AS (SELECT item_id AS id, unnest({TOKENS}) AS word FROM benchmark),
s AS (SELECT id, (('0x' || substr(sha256(word), 1, 8))::BIGINT % 16)::INTEGER AS place, sum(CASE WHEN ('0x' || substr(sha256(word), 9, 2))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM t GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM s GROUP BY id)
SELECT id AS item_id, place, round(x / norm, 9) AS x FROM s JOIN n USING (id) WHERE x <> 0""")
def provider_embedding(spark, d):
    """Texts through the place for an embedding model, with the hash embedding as the model."""
    v = table(spark, d, "benchmark").select("item_id", P.embedded(F.col("text"), P.hashed_words(16), 16).alias("v"))
    return v.select("item_id", F.posexplode("v").alias("place", "x")).where("x <> 0").withColumn("x", F.round("x", 9))


@query("score_rerank", f"""WITH {bm25_sql(20)}
SELECT query_id AS item_id, rank, id AS doc_id, score FROM bm WHERE rank <= 4""")
def score_rerank(spark, d):
    """Candidates by the score they come with, ties to the smaller id: what stands where no model is."""
    found = R.bm25(tokens(spark, d), asked(spark, d), 20)
    return P.reranked(found, 4).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


PAIRED = f"""pr AS (SELECT bm.query_id, bm.id, round(len(list_intersect(list_distinct({TOKENS.replace("text", "b.text")}), list_distinct({TOKENS.replace("text", "d.text")}))) / len(list_distinct({TOKENS.replace("text", "b.text")}))::DOUBLE, 6) AS score
  FROM bm JOIN benchmark b ON b.item_id = bm.query_id JOIN documents d ON d.doc_id = bm.id),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM pr) WHERE rank <= 3)"""


def pair_reranked(spark, d):
    found = R.bm25(tokens(spark, d), asked(spark, d), 10)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    pairs = found.select("query_id", "id").join(texts, "id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return P.reranked(pairs, 3, P.shared_words)


@query("pair_rerank", f"WITH {bm25_sql(10)}, {PAIRED} SELECT query_id AS item_id, rank, id AS doc_id, score FROM rr")
def pair_rerank(spark, d):
    """Candidates by a model's score of query and text (here the share of the query's words that the text has)."""
    return pair_reranked(spark, d).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SNIPPET = SQUEEZE.format("d.text")


@query("grounded_context", f"""WITH {bm25_sql(10)}, {PAIRED},
gc AS (SELECT query_id, rank, '[S' || rank || '] ' || d.source || chr(10) || CASE WHEN length({SNIPPET}) <= 280 THEN {SNIPPET} ELSE regexp_replace(substr({SNIPPET}, 1, 279), ' [^ ]*$', '') || '…' END AS block FROM rr JOIN documents d ON d.doc_id = rr.id)
SELECT query_id AS item_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM gc GROUP BY query_id""")
def grounded_context(spark, d):
    """From queries to what a prompt is grounded in: candidates by words, reranked, cited, as numbered blocks."""
    best = pair_reranked(spark, d).select(F.col("query_id").alias("topic"), "rank", "id")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return I.context(I.cited(best, texts), F.col("source"), F.col("snippet")).select(F.col("topic").alias("item_id"), "context")


@query("chunk_retrieval")
def chunk_retrieval(spark, d):
    """The chain over chunks: documents become an index, queries a list by vectors and one by words, fused, reranked and cited."""
    made = I.built(table(spark, d, "documents").select("doc_id", "text"), P.hashed_words(64), 64)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.col("text").alias("query"))
    chunks = C.kept(made["chunks"], "chunks")
    vectors = chunks.select("id", P.embedded(F.col("text"), P.hashed_words(64), 64).alias("v"))
    found = C.kept(I.retrieved(chunks, vectors, queries, P.hashed_words(64), 64, reranker=P.shared_words), "found")
    return I.cited(found, chunks.select("id", "doc_id", "section", "text")).select(F.col("topic").alias("item_id"), "citation_id", "doc_id", "section", F.col("id").alias("chunk_id"), "score", "snippet")


@query("retrieval_hit_rate", f"""WITH {DENSE},
h AS (SELECT de.query_id, max(CASE WHEN e.label = q.label THEN 1 ELSE 0 END) AS hit FROM de JOIN n e ON e.vec_id = de.id JOIN n q ON q.vec_id = de.query_id GROUP BY de.query_id)
SELECT (SELECT count(*) FROM n WHERE vec_id % 100 = 0) AS n_queries, round((SELECT sum(hit) FROM h) / (SELECT count(*) FROM n WHERE vec_id % 100 = 0)::DOUBLE, 6) AS hit_rate""")
def retrieval_hit_rate(spark, d):
    """The share of queries with a relevant row among their best."""
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"))
    own = label.where("id % 100 = 0").select(F.col("id").alias("query_id"), "source")
    return R.hit_rate(vectors(spark, d).join(label, "id"), own, 10)


@query("citation_sources", """WITH c AS (SELECT p.page_id, 'p' || (p.page_id + p.page_id % 2) AS cited, CASE WHEN p.page_id % 3 = 0 THEN p.url || '#x' ELSE p.url END AS url FROM pages p)
SELECT c.page_id, CASE WHEN s.page_id IS NULL THEN 'unknown_source' WHEN s.url <> c.url THEN 'other_address' ELSE 'correct' END AS verdict FROM c LEFT JOIN pages s ON 'p' || s.page_id = c.cited""")
def citation_sources(spark, d):
    """Citations against the manifest of sources: one that isn't there, one at another address, or correct."""
    pages = table(spark, d, "pages").select("page_id", "url")
    cited = pages.select("page_id", F.concat(F.lit("p"), (F.col("page_id") + F.col("page_id") % 2).cast("string")).alias("cited"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("#x"))).otherwise(F.col("url")).alias("said"))
    manifest = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), F.col("url").alias("address"))
    return R.checked(cited, manifest).select("page_id", "verdict")
