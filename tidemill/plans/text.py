"""Scalar text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation as C
from tidemill.plans.registry import query
from tidemill.sources.tables import table

FOLD = f"translate(lower(text), '{T.MARKED}', '{T.PLAIN}')"
SQUEEZE = "trim(regexp_replace({}, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"
TOKENS = f"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{T.TOKEN}')"


# (DuckDB has no NFKC; the tables' texts are composed already, and the fixtures of the tests aren't)
@query("text_normalize", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '\r\n?', chr(10), 'g'), '[\t \f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS normalized_hash
FROM documents""")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize(T.nfkc(F.col("text"))), 256).alias("normalized_hash"))


@query("text_fold", f"SELECT doc_id, sha256({FOLD}) AS folded_hash, length({FOLD}) AS n FROM documents")
def text_fold(spark, d):
    folded = T.fold(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(folded, 256).alias("folded_hash"), F.length(folded).cast("long").alias("n"))


@query("folded_keys", f"SELECT doc_id, sha256({SQUEEZE.format(FOLD)}) AS key_hash, regexp_matches(lower(text), '[{T.MARKED}]') AS has_marks FROM documents")
def folded_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.folded_key(F.col("text")), 256).alias("key_hash"), F.lower("text").rlike(f"[{T.MARKED}]").alias("has_marks"))


@query("token_stats", f"SELECT doc_id, len({TOKENS})::INTEGER AS n_tokens, len(list_distinct({TOKENS}))::INTEGER AS n_distinct FROM documents")
def token_stats(spark, d):
    words = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("snippet", f"""
WITH s AS (SELECT doc_id, {SQUEEZE.format('text')} AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 280 THEN f ELSE regexp_replace(substr(f, 1, 279), ' [^ ]*$', '') || '…' END AS snippet FROM s""")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("error_snippet", f"""
WITH s AS (SELECT doc_id, {SQUEEZE.format("replace(text, '|', '/')")} AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 220 THEN f ELSE substr(f, 1, 220) || '…' END AS snippet FROM s""")
def error_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.error_snippet(F.col("text")).alias("snippet"))


@query("token_estimate", "SELECT doc_id, greatest(1, (length(text) + 2) // 3) AS estimate FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))


# conversations carry no reasoning tags, so these wrap some of their texts in them
TAGGED = """SELECT conv_id, turn, CASE (conv_id + turn) % 5
  WHEN 0 THEN '<think>' || substr(text, 1, 9) || '</think> ' || text WHEN 1 THEN substr(text, 1, 9) || '</reasoning>' || text
  WHEN 2 THEN '<THINKING>' || text ELSE text END AS text FROM conversations"""


@query("reasoning_strip", f"""
WITH c AS ({TAGGED}),
a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g') AS x FROM c),
b AS (SELECT conv_id, turn, regexp_replace(x, '(?is)^.*?</(think|thinking|reasoning)>', '') AS x FROM a)
SELECT conv_id, turn, CASE WHEN NOT regexp_matches(x, '(?i)</?(think|thinking|reasoning)>') THEN regexp_replace(x, '^[ \\n]+|[ \\n]+$', '', 'g') END AS text FROM b""")
def reasoning_strip(spark, d):
    c, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 5
    head = F.substring(c, 1, 9)
    tagged = F.when(k == 0, F.concat(F.lit("<think>"), head, F.lit("</think> "), c)).when(k == 1, F.concat(head, F.lit("</reasoning>"), c)).when(k == 2, F.concat(F.lit("<THINKING>"), c)).otherwise(c)
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_reasoning(tagged).alias("text"))


@query("role_markers_escaped", "SELECT conv_id, turn, replace(replace('<|' || role || '|>' || text, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') AS text FROM conversations")
def role_markers_escaped(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.escaped_roles(F.concat(F.lit("<|"), "role", F.lit("|>"), "text")).alias("text"))


MARKED_TEXT = "text || ' [S' || (doc_id % 4) || '] and [s' || (doc_id % 7) || '] or [S1].'"


@query("citation_marks", f"""
WITH t AS (SELECT doc_id, {MARKED_TEXT} AS x FROM documents),
c AS (SELECT doc_id, x, list_transform(regexp_extract_all(x, '\\[([Ss][0-9]+)\\]', 1), lambda v: upper(v)) AS all_marks FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(all_marks)), ',') AS marks, len(list_filter(list_distinct(all_marks), lambda v: NOT list_contains(['S1', 'S2', 'S3'], v)))::INTEGER AS n_unknown,
  list_reduce(list_concat([x], list_filter(['S0', 'S4', 'S5', 'S6'], lambda v: list_contains(all_marks, v))), lambda s, v: regexp_replace(s, '(?i)\\[' || v || '\\]', '', 'g')) AS text
FROM c""")
def citation_marks(spark, d):
    x = F.concat("text", F.lit(" [S"), (F.col("doc_id") % 4).cast("string"), F.lit("] and [s"), (F.col("doc_id") % 7).cast("string"), F.lit("] or [S1]."))
    valid = F.array(*map(F.lit, ("S1", "S2", "S3")))
    marks = T.cited(F.col("x"))
    return table(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", F.array_join(F.array_sort(marks), ",").alias("marks"), F.size(F.array_except(marks, valid)).alias("n_unknown"), T.known_citations(F.col("x"), valid).alias("text"))


@query("citation_ensured", "SELECT doc_id, CASE WHEN regexp_matches(t, '\\[[Ss][0-9]+\\]') THEN t ELSE t || ' [S1]' END AS text FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' [S2]' ELSE text END AS t FROM documents)")
def citation_ensured(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" [S2]"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.when(F.size(T.cited(F.col("t"))) > 0, F.col("t")).otherwise(F.concat("t", F.lit(" [S1]"))).alias("text"))


# sentences of conversations end with full stops; every third word-final stop becomes a question mark
@query("question_split", """
WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN replace(text, 'e.', 'e?') ELSE text END AS x FROM conversations)
SELECT conv_id, turn, len(regexp_extract_all(regexp_replace(x, '[*_#`>]+', '', 'g'), '[?]([ \\n]|$)'))::INTEGER AS n_questions FROM q""")
def question_split(spark, d):
    x = F.when(F.col("turn") % 2 == 1, F.replace("text", F.lit("e."), F.lit("e?"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.questions(x)).alias("n_questions"))


@query("labelled_summary", """
SELECT c_custkey AS id, concat_ws('; ', CASE WHEN c_mktsegment <> '' THEN 'segment: ' || c_mktsegment END, CASE WHEN c_acctbal > 5000 THEN 'balance: high' END, CASE WHEN c_nationkey % 3 = 0 THEN 'nation: ' || c_nationkey END) AS summary FROM customer""")
def labelled_summary(spark, d):
    parts = (F.when(F.col("c_mktsegment") != "", F.concat(F.lit("segment: "), "c_mktsegment")), F.when(F.col("c_acctbal") > 5000, F.lit("balance: high")), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("nation: "), F.col("c_nationkey").cast("string"))))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("; ", *parts).alias("summary"))


@query("query_expansion", f"""
WITH b AS (SELECT item_id, {SQUEEZE.format('text')} AS q, split_part(text, ' ', 1) AS lead FROM benchmark)
SELECT item_id, array_to_string(list_filter([q, CASE WHEN lead <> '' THEN 'signs of ' || lead END, CASE WHEN lead <> '' THEN 'what ' || lead || ' needs' END], lambda x: x IS NOT NULL AND x <> ''), '|') AS queries FROM b""")
def query_expansion(spark, d):
    lead = F.split("text", " ")[0]
    made = F.array(T.squeezed(F.col("text")), F.when(lead != "", F.concat(F.lit("signs of "), lead)), F.when(lead != "", F.concat(F.lit("what "), lead, F.lit(" needs"))))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.filter(made, lambda x: x.isNotNull() & (x != ""))), "|").alias("queries"))


@query("body_mass_class", """
SELECT c_custkey AS id, bmi, CASE WHEN bmi < 18.5 THEN 'under' WHEN bmi < 23 THEN 'normal' WHEN bmi < 25 THEN 'over' ELSE 'high' END AS class
FROM (SELECT c_custkey, round((45 + c_custkey % 60) / power((150 + c_custkey % 45) / 100.0::DOUBLE, 2), 1) AS bmi FROM customer)""")
def body_mass_class(spark, d):
    height, weight = (F.lit(150) + F.col("c_custkey") % 45) / F.lit(100.0), F.lit(45) + F.col("c_custkey") % 60
    bmi = F.round(weight / F.pow(height, F.lit(2.0)), 1)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), bmi.alias("bmi")).withColumn("class", F.when(F.col("bmi") < 18.5, "under").when(F.col("bmi") < 23, "normal").when(F.col("bmi") < 25, "over").otherwise("high"))


@query("url_safety", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+') AS scheme, regexp_extract(url, '^https?://([^/?#@]+)', 1) AS host, regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') AS is_safe FROM pages""")
def url_safety(spark, d):
    parse = lambda part: F.try_parse_url("url", F.lit(part))
    safe = F.coalesce(parse("PROTOCOL").isin("http", "https") & parse("HOST").isNotNull() & parse("USERINFO").isNull(), F.lit(False))
    return table(spark, d, "pages").select("page_id", parse("PROTOCOL").alias("scheme"), parse("HOST").alias("host"), safe.alias("is_safe"))


@query("prompt_payload", """
SELECT conv_id, turn, replace(replace('{"role":"' || role || '","n":' || length(text) || ',"head":"<' || substr(role, 1, 3) || '>"}', '<', '\\u003c'), '>', '\\u003e') AS payload FROM conversations""")
def prompt_payload(spark, d):
    body = F.to_json(F.struct("role", F.length("text").alias("n"), F.concat(F.lit("<"), F.substring("role", 1, 3), F.lit(">")).alias("head")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace(F.replace(body, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")).alias("payload"))


#: What stands for the person spoken to, and what is said of another: at a text's beginning, and anywhere.
PERSONS = [("^Thtion ", "The one "), (" (?:und|that) ", " the other ")]


@query("personalised", f"SELECT conv_id, turn, md5({T.rewritten_sql('text', PERSONS)}) AS text_hash, {T.rewritten_sql('text', PERSONS)} <> text AS changed FROM conversations")
def personalised(spark, d):
    """Texts of another person's case, in the third person."""
    said = T.rewritten(F.col("text"), PERSONS)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(said).alias("text_hash"), (said != F.col("text")).alias("changed"))


#: Claims that are too certain, and what stands for them.
CLAIMS = [("(?i)\\bof the\\b", "perhaps of the"), ("(?i)\\bder die\\b", "perhaps"), ("(?i)\\bque la\\b", "perhaps la")]


@query("claims_softened", f"SELECT conv_id, turn, md5(trim({T.rewritten_sql('text', CLAIMS)})) AS text_hash FROM conversations WHERE role = 'assistant'")
def claims_softened(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5(F.trim(T.rewritten(F.col("text"), CLAIMS))).alias("text_hash"))


#: Words by which a sentence asks without a question mark.
ASKING = "\\b(?:queren|than|dass)\\b"


@query("statements_only", f"""WITH s AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]?|[.!?\\n]'), lambda x: CASE WHEN regexp_matches(x, '[?]|{ASKING}') THEN repeat(' ', length(x)) ELSE x END) AS parts FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(array_to_string(parts, '')) AS text_hash, length(array_to_string(parts, ''))::INTEGER AS n FROM s""")
def statements_only(spark, d):
    said = T.statements(F.col("text"), ASKING)
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", said.alias("s")).select("conv_id", "turn", F.md5("s").alias("text_hash"), F.length("s").alias("n"))


@query("visible_text", f"""
WITH c AS ({TAGGED}),
a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g') AS x FROM c)
SELECT conv_id, turn, trim(regexp_replace(x, '(?is)<(think|thinking|reasoning)>.*$', '')) AS text FROM a""")
def visible_text(spark, d):
    """What a reader sees: no reasoning, nor what follows a tag that isn't closed."""
    c, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 5
    head = F.substring(c, 1, 9)
    tagged = F.when(k == 0, F.concat(F.lit("<think>"), head, F.lit("</think> "), c)).when(k == 1, F.concat(head, F.lit("</reasoning>"), c)).when(k == 2, F.concat(F.lit("<THINKING>"), c)).otherwise(c)
    return table(spark, d, "conversations").select("conv_id", "turn", T.visible(tagged).alias("text"))


SYSTEM = "Answer from the sources. <|system|>"


@query("chat_messages", """
WITH m AS (SELECT conv_id, -1 AS turn, 'system' AS role, replace(replace('Answer from the sources. <|system|>', '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') AS text FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, turn, role, replace(replace(text, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, count(*)::INTEGER AS n, md5(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS digest FROM m GROUP BY conv_id""")
def chat_messages(spark, d):
    """Conversations as a chat template takes them: a system turn first, then users' and assistants' turns, with markers escaped."""
    rows = C.conversations(table(spark, d, "conversations")).select("conv_id", T.chat("messages", SYSTEM).alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\x1f"), x["content"])), "\x1e")
    return rows.select("conv_id", F.size("m").alias("n"), F.md5(said).alias("digest"))


@query("local_urls", r"SELECT page_id, regexp_matches(url, '^https?://(localhost|127\.0\.0\.1|\[::1\])(:[0-9]+)?([/?#]|$)') AS is_local FROM pages")
def local_urls(spark, d):
    """Whether an address is one of this machine, without credentials."""
    return table(spark, d, "pages").select("page_id", T.local_url(F.col("url")).alias("is_local"))


PROFILE_YEAR = 2026


@query("profile_context", f"""
SELECT c_custkey AS id, concat_ws('; ', 'age: ' || ({PROFILE_YEAR} - (1930 + c_custkey % 80)), 'segment: ' || coalesce(nullif(c_mktsegment, ''), 'not given'), CASE WHEN c_acctbal > 0 THEN 'balance: ' || printf('%.1f', round(c_acctbal::DOUBLE, 1)) END, 'notes: none') AS context FROM customer""")
def profile_context(spark, d):
    """A profile as one line, with a default for what isn't given (customers stand for people)."""
    c = F.col
    fields = {"age": (F.lit(PROFILE_YEAR) - (1930 + c("c_custkey") % 80)).cast("string"), "segment": F.coalesce(F.nullif(c("c_mktsegment"), F.lit("")), F.lit("not given")), "balance": F.when(c("c_acctbal") > 0, F.format_string("%.1f", F.round(c("c_acctbal").cast("double"), 1))), "notes": F.lit("none")}
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), T.labelled(fields).alias("context"))


CARE = {"AUTOMOBILE": "see a mechanic", "BUILDING": "see a builder", "MACHINERY": "wait"}


@query("collected_facts", f"""
WITH f AS (SELECT c_custkey AS id, unnest([{{'label': 'Segment', 'value': c_mktsegment}}, {{'label': 'Nation', 'value': c_nationkey::VARCHAR}}, {{'label': 'Advice', 'value': CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CARE.items())} END}}]) AS x FROM customer)
SELECT id, x.label AS label, x.value AS value FROM f WHERE x.value IS NOT NULL AND x.value <> ''""")
def collected_facts(spark, d):
    """A row for each field that is given, under the name people read; codes become words."""
    words = F.create_map(*[F.lit(x) for pair in CARE.items() for x in pair])
    facts = T.facts({"Segment": F.col("c_mktsegment"), "Nation": F.col("c_nationkey").cast("string"), "Advice": F.try_element_at(words, F.col("c_mktsegment"))})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(facts).alias("x")).select("id", "x.label", "x.value")


@query("titles_cut", "SELECT doc_id, substr(text, 1, 46) AS title FROM documents")
def titles_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 46).alias("title"))


ALLOWED = ("the", "der", "que", "and", "los")


@query("slots_allowed", f"""
WITH w AS (SELECT item_id, list_filter([{", ".join(f"'{x}'" for x in ALLOWED)}], lambda x: list_contains({TOKENS}, x)) AS s FROM benchmark)
SELECT item_id, array_to_string(CASE WHEN len(s) = 0 THEN ['none'] ELSE s END, ',') AS slots, CASE len(s) WHEN 0 THEN 'none' WHEN 1 THEN s[1] ELSE array_to_string(s[1:len(s)-1], ', ') || ' or ' || s[len(s)] END AS phrase FROM w""")
def slots_allowed(spark, d):
    """Of the words those that are allowed, a default without any; and how a question lists them."""
    own = F.array_intersect(F.array(*map(F.lit, ALLOWED)), T.tokens(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", T.or_default(own, "none").alias("s")).select("item_id", F.array_join("s", ",").alias("slots"), T.any_of(F.col("s")).alias("phrase"))


@query("lists_joined", f"""
WITH w AS (SELECT item_id, {TOKENS} AS w FROM benchmark), u AS (SELECT item_id, w, [x for x in [w[3], w[1], 'the', w[2]] if x IS NOT NULL] AS l, CASE WHEN item_id % 3 = 0 THEN [] ELSE w[1:2] END AS planned FROM w)
SELECT item_id, array_to_string([x for x, i in l if list_position(l, x) = i], ',') AS joined, array_to_string(CASE WHEN len(planned) > 0 THEN planned ELSE w[4:5] END, ',') AS replies FROM u""")
def lists_joined(spark, d):
    """Two lists as one, each item once and where it came first; and planned replies in place of others, where there are any."""
    w = T.tokens(F.col("text"))
    rows = table(spark, d, "benchmark").select("item_id", w.alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    joined = F.array_union(F.array_compact(F.array(at(2), at(0))), F.array_compact(F.array(F.lit("the"), at(1))))
    planned = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.slice("w", 1, 2))
    return rows.select("item_id", F.array_join(joined, ",").alias("joined"), F.array_join(T.first_given(planned, F.slice("w", 4, 2)), ",").alias("replies"))
