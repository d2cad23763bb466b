"""Queries over raw pages, JSON, chunks and plain scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import dedup as D
from tidemill.plans.registry import query
from tidemill.sources import files as S
from tidemill.sources.tables import table


@query("html_extract")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", S.html_text(F.col("html")).alias("p")).select("page_id", "p.title", F.md5("p.text").alias("text_hash"), F.size(F.filter(F.split("p.text", "\n\n"), lambda x: x != "")).alias("n_blocks"))


ENTITIES = {"&quot;": '"', "&#39;": "''", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&amp": "&"}


def decoded(x: str) -> str:
    for entity, plain in ENTITIES.items():
        x = f"replace({x}, '{entity}', '{plain}')"
    return x


@query("html_titles", f"SELECT page_id, trim({decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM pages")
def html_titles(spark, d):
    """The titles of all pages, with their entities decoded."""
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.trim(S.unescaped(raw)).alias("title"))


def chunked(spark, d):
    return S.chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("chunk_documents")
def chunk_documents(spark, d):
    return chunked(spark, d).select(F.col("id").alias("doc_id"), "ordinal", "section", "chunk_id", F.length("chunk").alias("n_chars"))


@query("chunk_dedup")
def chunk_dedup(spark, d):
    """The first of equal chunks, and how many there are."""
    rows = chunked(spark, d).select("id", "ordinal", F.sha2("chunk", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min(F.struct("id", "ordinal")).alias("first"), F.count("*").alias("copies")).select("hash", "first.id", "first.ordinal", "copies")


@query("json_records", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, (props::JSON ->> 'missing') AS missing FROM events")
def json_records(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long, missing string").alias("p")).select("event_id", "p.k", "p.missing")


@query("latest_rows", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_rows(spark, d):
    """The twenty latest events (the limit is the feature)."""
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "ts", "user_id").limit(20)


@query("load_counters", "SELECT count(*) AS seen, count(*) FILTER (length(text) >= 200) AS valid, count(*) FILTER (length(text) < 200) AS invalid, count(*) - count(DISTINCT sha256(text)) AS duplicates, count(DISTINCT lang) AS languages FROM documents")
def load_counters(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    long = F.length("text") >= 200
    return table(spark, d, "documents").agg(F.count("*").alias("seen"), n(long).alias("valid"), n(~long).alias("invalid"), (F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("duplicates"), F.countDistinct("lang").alias("languages"))


@query("validated_rows", "SELECT doc_id, list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang' END, CASE WHEN n_chars <> length(text) THEN 'n_chars' END, CASE WHEN n_chars > 5000 THEN 'long' END], lambda x: x IS NOT NULL) AS reasons FROM documents")
def validated_rows(spark, d):
    checks = {"empty": F.col("text") == "", "lang": ~F.col("lang").isin("en", "fr", "de"), "n_chars": F.col("n_chars") != F.length("text"), "long": F.col("n_chars") > 5000}
    return table(spark, d, "documents").select("doc_id", F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()])).alias("reasons"))


@query("unique_keys", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def unique_keys(spark, d):
    both = table(spark, d, "documents").select("doc_id").unionAll(table(spark, d, "labels").select("doc_id"))
    return both.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


@query("first_pages", "SELECT min(page_id) AS page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages GROUP BY 2")
def first_pages(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return D.keep_first(rows, ["host"], ["page_id"]).select("page_id", "host")
