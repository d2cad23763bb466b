"""Duplicate and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import dedup as D
from tidemill.plans.registry import query
from tidemill.plans.text import TOKENS
from tidemill.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def hashed(spark, d):
    return docs(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("hash"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return hashed(spark, d).select("doc_id", "hash")


@query("exact_dedup_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY sha256(text)")
def exact_dedup_keep_first(spark, d):
    return D.keep_first(hashed(spark, d), ["hash"], ["doc_id"]).select("doc_id", "hash")


@query("exact_duplicate_of", "SELECT doc_id, first_id AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) WHERE doc_id <> first_id")
def exact_duplicate_of(spark, d):
    return D.first_of(hashed(spark, d), "hash", "doc_id").where("doc_id <> first_id").select("doc_id", F.col("first_id").alias("duplicate_of"))


@query("dedup_counters", "SELECT source, count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_unique, count(*) - count(DISTINCT sha256(text)) AS n_duplicates FROM documents GROUP BY source")
def dedup_counters(spark, d):
    n = F.countDistinct("hash")
    return hashed(spark, d).groupBy("source").agg(F.count("*").alias("n_rows"), n.alias("n_unique"), (F.count("*") - n).alias("n_duplicates"))


@query("record_dedup", "SELECT min(doc_id) AS doc_id, lang, source, sha256(text) AS hash FROM documents GROUP BY lang, source, sha256(text)")
def record_dedup(spark, d):
    return docs(spark, d).groupBy("lang", "source", F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))


@query("hash_split_validation", "SELECT doc_id, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.1 AS is_validation FROM documents")
def hash_split_validation(spark, d):
    return docs(spark, d).select("doc_id", (T.hash_fraction("42", F.col("doc_id").cast("string")) < 0.1).alias("is_validation"))


@query("hash_split_holdout", "SELECT doc_id, CASE WHEN ('0x' || substr(sha256(lang || ':' || source), 1, 8))::BIGINT / 4294967295.0::DOUBLE >= 0.8 THEN 'holdout' ELSE 'dev' END AS split FROM documents")
def hash_split_holdout(spark, d):
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "lang", "source"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295)
    return docs(spark, d).select("doc_id", F.when(part >= 0.8, "holdout").otherwise("dev").alias("split"))


@query("corpus_digest", f"""
WITH l AS (SELECT source, sha256(text) AS h, doc_id || '|' || lang || '|' || sha256(text) AS line FROM documents),
p AS (SELECT source, substr(h, 1, {D.LEAF}) AS part, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM l GROUP BY 1, 2)
SELECT source, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)) AS digest FROM p GROUP BY source""")
def corpus_digest(spark, d):
    """A digest of each source's lines, over digests of their parts."""
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "hash")
    rows = docs(spark, d).select("source", "doc_id", "lang", F.sha2("text", 256).alias("hash"))
    return D.digests(rows.select("source", "hash", line.alias("line")), "source", "hash", "line")


SHINGLES = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w)"""


def runs(spark, d):
    # texts without words go here: a filter on what follows would be pushed below it, and compute it for each element
    return docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") > 0).select("doc_id", D.shingles(F.col("w")).alias("runs"))


@query("shingle_counts", f"WITH {SHINGLES} SELECT doc_id, count(*)::INTEGER AS n_shingles, min(md5(s)) AS least FROM sh GROUP BY doc_id")
def shingle_counts(spark, d):
    return runs(spark, d).select("doc_id", F.size("runs").alias("n_shingles"), F.array_min(F.transform("runs", lambda s: F.md5(s))).alias("least"))


COEFFICIENTS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(D.coefficients()))
SIGNATURES = f"""{SHINGLES}, c(i, a, b) AS (VALUES {COEFFICIENTS}),
x AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS x FROM sh),
m AS (SELECT doc_id, i, min(((x * a + b) % {D.PRIME}) & {D.KEPT}) AS m FROM x CROSS JOIN c GROUP BY doc_id, i),
sig AS (SELECT doc_id, list(m ORDER BY i) AS sig FROM m GROUP BY doc_id)"""


def signatures(spark, d):
    return docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", D.signature(F.col("w")).alias("sig")).where("sig IS NOT NULL")


@query("minhash_signatures", f"WITH {SIGNATURES} SELECT doc_id, md5(array_to_string(sig, ',')) AS digest FROM sig")
def minhash_signatures(spark, d):
    return signatures(spark, d).select("doc_id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("digest"))


PAIRS = f"""{SIGNATURES},
k AS (SELECT doc_id, g.i AS band, md5(array_to_string(sig[g.i*4+1 : g.i*4+4], ',')) AS bucket FROM sig CROSS JOIN range(16) g(i)),
an AS (SELECT band, bucket, min(doc_id) AS a FROM k GROUP BY band, bucket),
pr AS (SELECT DISTINCT a, doc_id AS b FROM k JOIN an USING (band, bucket) WHERE doc_id > a),
sim AS (SELECT a, b, len(list_filter(range(1, 65), lambda i: p.sig[i] = q.sig[i])) / 64.0::DOUBLE AS similarity FROM pr JOIN sig p ON p.doc_id = a JOIN sig q ON q.doc_id = b)"""


@query("lsh_near_dups", f"WITH {PAIRS} SELECT a, b, similarity FROM sim WHERE similarity >= 0.7")
def lsh_near_dups(spark, d):
    return D.anchored_pairs(signatures(spark, d), 0.7)


@query(
    "near_dup_clusters",
    f"""WITH RECURSIVE {PAIRS},
e AS (SELECT a, b FROM sim WHERE similarity >= 0.7 UNION SELECT b, a FROM sim WHERE similarity >= 0.7),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""",
)
def near_dup_clusters(spark, d):
    return D.clusters(D.anchored_pairs(signatures(spark, d), 0.7))


@query("estimated_similarity", f"WITH {PAIRS} SELECT round(similarity, 1) AS band, count(*) AS n FROM sim GROUP BY 1")
def estimated_similarity(spark, d):
    return D.anchored_pairs(signatures(spark, d), 0.0).groupBy(F.round("similarity", 1).alias("band")).agg(F.count("*").alias("n"))


@query("contamination_exact", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_exact(spark, d):
    """Documents that contain a benchmark text: see contained()."""
    probes = table(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), F.col("text").alias("probe"))
    return D.contained(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), probes).select(F.col("id").alias("doc_id"), F.col("probe_id").alias("item_id"))


@query("contamination_shingle", f"""
WITH {SHINGLES}, bw AS (SELECT item_id, {TOKENS} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM bw),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT item_id, doc_id, count(*)::INTEGER AS shared FROM bs JOIN sh USING (s) JOIN bn USING (item_id) GROUP BY item_id, doc_id, n HAVING count(*) >= least(5, n)""")
def contamination_shingle(spark, d):
    """Documents that share five shingles with a benchmark text, or all where it has fewer (a text of fewer than five words is one). Shingles meet as hashes."""
    words = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    probe = words.select("item_id", D.shingles(F.col("w")).alias("r")).select("item_id", F.size("r").alias("n"), F.explode_outer("r").alias("s")).select("item_id", "n", F.xxhash64("s").alias("h"), "s")
    own = runs(spark, d).select("doc_id", F.explode_outer("runs").alias("t")).select("doc_id", F.xxhash64("t").alias("h"), "t")
    return own.join(probe, "h").where("s = t").groupBy("item_id", "doc_id", "n").agg(F.count("*").cast("int").alias("shared")).where("shared >= least(5, n)").select("item_id", "doc_id", "shared")


@query("opening_text_blocked", """
WITH f AS (SELECT conv_id, substr(md5(conv_id::VARCHAR), 1, 1) IN ('0', '1', '2') AS is_test, arg_min(lower(trim(text)), turn) AS opening FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id FROM f WHERE NOT is_test AND opening NOT IN (SELECT opening FROM f WHERE is_test)""")
def opening_text_blocked(spark, d):
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.lower(F.trim("text")), "turn").alias("opening"))
    is_test = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 1).isin("0", "1", "2")
    return first.where(~is_test).join(first.where(is_test).select("opening"), "opening", "left_anti").select("conv_id")


@query("resume_left", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_left(spark, d):
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("audited_rows", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'rejected' ELSE 'kept' END AS decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def audited_rows(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("kept_id"))
    return docs(spark, d).select("doc_id").join(good, F.col("doc_id") == F.col("kept_id"), "left").select("doc_id", F.when(F.col("kept_id").isNull(), "rejected").otherwise("kept").alias("decision"))
