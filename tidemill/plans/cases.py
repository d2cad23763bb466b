"""Checks of replies and cases, requests, sessions and lists of samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation as C
from tidemill.operators import dialogue as D
from tidemill.operators import shaping as S
from tidemill.plans import curation, metrics
from tidemill.plans import dialogue as rules
from tidemill.plans.registry import query
from tidemill.plans.text import FOLD, SQUEEZE, TOKENS
from tidemill.sources.tables import table

#: A cue that a condition is named, and nouns that are conditions (the tables' invented words stand for them).
CUE, NOUN = "(?:^|[ \n])(?:la|the|that)[ \n]", "(?:schst|eau|ing)"
MARKS = "[*_#`>]+"


@query("condition_naming", f"SELECT conv_id, turn, regexp_matches(f, '{CUE}') AND regexp_matches(f, '{NOUN}') AS names FROM (SELECT conv_id, turn, {FOLD.replace('text', f"regexp_replace(text, '{MARKS}', '', 'g')")} AS f FROM conversations WHERE role = 'assistant')")
def condition_naming(spark, d):
    """Whether a reply names a condition: a cue and a noun, in the text without its marks."""
    f = T.fold(F.regexp_replace("text", MARKS, ""))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", f.alias("f")).select("conv_id", "turn", (F.col("f").rlike(CUE) & F.col("f").rlike(NOUN)).alias("names"))


FLAGS = {"dose": "[0-9]+ ?(?:mg|ml|of)", "abstains": "(?:que|und) (?:la|die)", "duration": "on (?:th|er)[a-z]+"}


@query("reply_flags", f"SELECT conv_id, turn, {', '.join(f"regexp_matches(f, '{p}') AS {k}" for k, p in FLAGS.items())} FROM (SELECT conv_id, turn, {FOLD} AS f FROM conversations WHERE role = 'assistant')")
def reply_flags(spark, d):
    f = F.col("f")
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.fold(F.col("text")).alias("f")).select("conv_id", "turn", *[f.rlike(p).alias(k) for k, p in FLAGS.items()])


@query("schema_checks", """
WITH j AS (SELECT event_id, '{"k":"' || (props::JSON ->> 'k') || '","level":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN ',"items":["a","b"]' WHEN event_id % 3 = 1 THEN ',"items":"a"' ELSE '' END || '}' AS j FROM events)
SELECT event_id, concat_ws(',', CASE WHEN json_type(j, '$.k') IS DISTINCT FROM 'VARCHAR' THEN 'k' END, CASE WHEN (j ->> '$.level') NOT IN ('view', 'click', 'error') THEN 'level' END, CASE WHEN json_type(j, '$.items') IS DISTINCT FROM 'ARRAY' THEN 'items' END) AS problems FROM j""")
def schema_checks(spark, d):
    """Which required fields of a JSON reply aren't what they must be: a text, one of a list, a list of texts."""
    items = F.when(F.col("event_id") % 3 == 0, ',"items":["a","b"]').when(F.col("event_id") % 3 == 1, ',"items":"a"').otherwise("")
    reply = F.concat(F.lit('{"k":"'), F.get_json_object("props", "$.k"), F.lit('","level":"'), "event_type", F.lit('"'), items, F.lit("}"))
    rows = table(spark, d, "events").select("event_id", reply.alias("j"))
    return rows.select("event_id", F.array_join(D.schema_problems("j", texts=["k"], enums={"level": ["view", "click", "error"]}, lists=["items"]), ",").alias("problems"))


CUES = {"article": ["the", "der"], "link": ["and", "und"], "rest": ["que"]}
CUES_SQL = ", ".join(f"('{g}', '{w}')" for g, ws in CUES.items() for w in ws)


@query("boosted_samples", f"""
WITH cu(grp, cue) AS (VALUES {CUES_SQL}), b AS (SELECT item_id, lower(text) AS t, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 3)) AS words FROM benchmark),
c AS (SELECT conv_id, lower(text) AS o FROM conversations WHERE turn = 0),
g AS (SELECT item_id, conv_id, words, o, (SELECT count(DISTINCT grp) FROM cu WHERE contains(b.t, cu.cue) AND EXISTS (SELECT 1 FROM cu x WHERE x.grp = cu.grp AND contains(c.o, x.cue))) AS n FROM b CROSS JOIN c),
s AS (SELECT item_id, conv_id, 2 * len(list_filter(words, lambda w: contains(o, w))) + 10 * n AS score FROM g)
SELECT item_id, conv_id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id) AS k FROM s WHERE score > 0) WHERE k <= 2""")
def boosted_samples(spark, d):
    """Two sample conversations for each query: two points for each of its words that an opening contains, ten for each group of cues that both have."""
    from tidemill.operators import retrieval as R

    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 3))
    groups = lambda t: F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w)), g) for g, ws in CUES.items()]))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words"), groups(F.lower("text")).alias("q_groups"))
    c = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.lower("text").alias("t")).withColumn("groups", groups(F.col("t")))
    score = 2 * F.size(F.filter("words", lambda w: F.contains(F.col("t"), w))) + 10 * F.size(F.array_intersect("groups", "q_groups"))
    both = R.every_pair(c, q, "id").select("query_id", "id", score.cast("long").alias("score")).where("score > 0")
    return R.top(both, 2).select(F.col("query_id").alias("item_id"), F.col("id").alias("conv_id"), "score")


@query("smoke_subset", f"WITH {metrics.BASE} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM b) WHERE k = 1 UNION SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS k FROM b) WHERE k = 1")
def smoke_subset(spark, d):
    """The first case of each group, and the first of each kind (one of each is the feature)."""
    rows = metrics.base(spark, d).select("doc_id", "lang", "quality", "toxic")
    first = lambda *by: rows.groupBy(*by).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return first("lang").union(first("quality", "toxic")).distinct()


@query("template_mask", """
WITH m AS (SELECT conv_id, turn, role, len(regexp_extract_all(role || chr(10) || text || chr(10), '[^ \\n]+|\\n')) AS n, len(regexp_extract_all(text, '[^ \\n]+|\\n')) AS own FROM conversations)
SELECT conv_id, sum(n)::INTEGER AS n_ids, coalesce(sum(own) FILTER (role = 'assistant'), 0)::INTEGER AS n_labels FROM m GROUP BY conv_id""")
def template_mask(spark, d):
    """Conversations through a chat template and a tokenizer with offsets: how many ids, and how many of them an assistant says."""
    rows = C.conversations(table(spark, d, "conversations"))
    made = rows.select("conv_id", S.templated(F.col("messages"), S.plain_template, S.plain_tokens).alias("x"))
    return made.select("conv_id", F.size("x.ids").alias("n_ids"), F.size(F.filter("x.labels", lambda v: v != S.IGNORED)).alias("n_labels"))


@query("turn_scores", f"""
WITH t AS (SELECT conv_id, turn, role, {FOLD} AS f, lag({FOLD}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT conv_id, turn, f, list_filter([CASE WHEN regexp_matches(f, '(^|[ \\n])the[ \\n]') THEN 'where' END, CASE WHEN regexp_matches(f, '(^|[ \\n])und[ \\n]') THEN 'when' END], lambda x: x IS NOT NULL) AS slots, list_distinct(regexp_extract_all(f, '[a-z]+')) AS own, list_distinct(regexp_extract_all(before, '[a-z]+')) AS said FROM t WHERE role = 'assistant')
SELECT conv_id, turn, len(slots) > 0 AS asks, len(slots)::INTEGER AS n_slots, CASE WHEN len(own) > 0 AND said IS NOT NULL THEN round(len(list_intersect(own, said)) / len(own)::DOUBLE, 6) END AS relevance FROM s""")
def turn_scores(spark, d):
    """Metrics of a reply by itself: whether it asks, about how many slots, and the share of its words that the turn before has."""
    f = T.fold(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", f.alias("f")).withColumn("before", F.lag("f").over(Window.partitionBy("conv_id").orderBy("turn")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z]+)"), F.lit(1)))
    slots = F.array_compact(F.array(F.when(F.col("f").rlike("(^|[ \n])the[ \n]"), "where"), F.when(F.col("f").rlike("(^|[ \n])und[ \n]"), "when")))
    own = rows.where("role = 'assistant'").select("conv_id", "turn", slots.alias("slots"), words("f").alias("own"), words("before").alias("said"))
    relevance = F.when((F.size("own") > 0) & F.col("said").isNotNull(), F.round(F.size(F.array_intersect("own", "said")) / F.size("own"), 6))
    return own.select("conv_id", "turn", (F.size("slots") > 0).alias("asks"), F.size("slots").alias("n_slots"), relevance.alias("relevance"))


@query("api_case_scores", f"""
WITH {metrics.BASE}, k AS (SELECT doc_id, lang, quality = 1 AS action_matches, CASE WHEN toxic = 1 THEN NOT guess END AS emergency_first, CASE WHEN lang = 'fr' THEN n_chars < 3000 END AS asks_duration, CASE WHEN quality = 0 THEN n_chars < 2000 END AS abstains FROM b)
SELECT lang, count(*) AS n, count(*) FILTER (action_matches AND coalesce(emergency_first, true) AND coalesce(asks_duration, true) AND coalesce(abstains, true)) AS passed, count(emergency_first) AS n_emergency, count(asks_duration) AS n_duration, count(abstains) AS n_abstain FROM k GROUP BY lang""")
def api_case_scores(spark, d):
    """Checks of an interface's replies; a check that doesn't apply to a case is null and fails nothing."""
    rows = metrics.base(spark, d)
    n, good = F.col("n_chars"), F.col("quality") == 1
    checks = {"action_matches": good, "emergency_first": F.when(F.col("toxic") == 1, ~F.col("guess")), "asks_duration": F.when(F.col("lang") == "fr", n < 3000), "abstains": F.when(F.col("quality") == 0, n < 2000)}
    scored = rows.select("lang", *[c.alias(k) for k, c in checks.items()]).withColumn("passed", D.passes(list(checks)))
    return scored.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count("emergency_first").alias("n_emergency"), F.count("asks_duration").alias("n_duration"), F.count("abstains").alias("n_abstain"))


REPLIES = {"emergency": "Call for help now.", "possibilities": "It may be: ", "ask_duration": "How long has it lasted?"}


@query("triage_reply", f"""
WITH {rules.HITS}, f AS (SELECT conv_id, bool_or(affirmed > 0 AND label IN ('breath', 'bleeding')) AS urgent, string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (affirmed > 0) AS found FROM h WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN urgent THEN '{REPLIES["emergency"]}' WHEN found IS NOT NULL THEN '{REPLIES["possibilities"]}' || found ELSE '{REPLIES["ask_duration"]}' END AS reply FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') c LEFT JOIN f USING (conv_id)""")
def triage_reply(spark, d):
    """What the triage says: help first, else what the findings may be, else a question."""
    yes = F.col("affirmed") > 0
    found = rules.hits(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max(yes & F.col("label").isin("breath", "bleeding")).alias("urgent"), F.sort_array(F.collect_set(F.when(yes, F.col("label")))).alias("found"))
    everyone = rules.turns(spark, d).where("role = 'user'").select("conv_id").distinct()
    reply = F.when(F.col("urgent"), REPLIES["emergency"]).when(F.size("found") > 0, F.concat(F.lit(REPLIES["possibilities"]), F.array_join("found", ", "))).otherwise(REPLIES["ask_duration"])
    return everyone.join(found, "conv_id", "left").select("conv_id", reply.alias("reply"))


@query("requests_normalised", f"""
WITH r AS (SELECT conv_id, turn, {SQUEEZE.format('text')} AS message FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(message) AS message_hash, CASE WHEN length(message) < 2 THEN 'too_short' WHEN length(message) > 1000 THEN 'too_long' END AS problem FROM r""")
def requests_normalised(spark, d):
    """Requests with white space collapsed, and what is wrong with their length."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.squeezed(F.col("text")).alias("message"))
    n = F.length("message")
    return rows.select("conv_id", "turn", F.md5("message").alias("message_hash"), F.when(n < 2, "too_short").when(n > 1000, "too_long").alias("problem"))


@query("row_or_first", """
WITH f AS (SELECT arg_min(n_name, n_nationkey) AS name FROM nation)
SELECT c_custkey AS id, coalesce(n.n_name, f.name) AS name FROM customer CROSS JOIN f LEFT JOIN nation n ON n.n_nationkey = c_nationkey * 2""")
def row_or_first(spark, d):
    """The row that an identifier names, or the first of the list."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    first = nations.agg(F.min_by("n_name", "n_nationkey").alias("first"))  # one row
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 2).alias("k"))
    return rows.join(nations, F.col("k") == F.col("n_nationkey"), "left").join(F.broadcast(first)).select("id", F.coalesce("n_name", "first").alias("name"))


@query("session_updates", """
WITH l AS (SELECT user_id, event_id % 7 AS session, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS seen FROM events GROUP BY ALL)
SELECT user_id, session, last, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, session)::INTEGER AS place FROM l WHERE last <> 'error'""")
def session_updates(spark, d):
    """Sessions after their updates: the last one of each stands, a deletion (an error stands for it) takes it away, and the newest come first."""
    rows = table(spark, d, "events").withColumn("session", F.col("event_id") % 7)
    last = rows.groupBy("user_id", "session").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("at")).where("last <> 'error'")
    return last.select("user_id", "session", "last", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("at").desc(), "session")).alias("place"))


@query("history_guard", """
WITH m AS (SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND length(text) % 10 <> 0)
SELECT conv_id, count(*)::INTEGER AS n, count(*) >= 4 AS blocked FROM m GROUP BY conv_id""")
def history_guard(spark, d):
    """A conversation without failed messages, and whether it is too long to go on."""
    sent = F.filter("messages", lambda m: m["role"].isin("user", "assistant") & (F.length(m["content"]) % 10 != 0))
    rows = C.conversations(table(spark, d, "conversations")).select("conv_id", F.size(sent).alias("n"))
    return rows.where("n > 0").select("conv_id", "n", (F.col("n") >= 4).alias("blocked"))


@query("history_payload", """
SELECT conv_id, md5('[' || string_agg('{"role":"' || role || '","content":' || replace(replace(to_json(replace(replace(text, '<', ''), '>', ''))::VARCHAR, '<', ''), '>', '') || '}', ',' ORDER BY turn) || ']') AS payload_hash, count(*)::INTEGER AS n FROM conversations WHERE role <> 'system' AND regexp_full_match(text, '[ -~\\n]*') AND NOT contains(text, '/') GROUP BY conv_id""")
def history_payload(spark, d):
    """What a conversation is to a model as data: its turns as one JSON text, in which no bracket can open a tag (turns of plain letters here, which both engines write alike)."""
    spoken = table(spark, d, "conversations").where("role <> 'system'").where(F.col("text").rlike("^[ -~\n]*$") & ~F.contains("text", F.lit("/")))
    rows = C.conversations(spoken.withColumn("text", F.translate("text", "<>", "")))
    return rows.select("conv_id", F.md5(T.payload(F.col("messages"))).alias("payload_hash"), F.size("messages").alias("n"))


@query("sample_browser", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND (contains(lower(p_name), 'ri') OR contains(lower(p_brand), 'ri') OR contains(lower(p_type), 'ri') OR contains(p_size::VARCHAR, 'ri'))")
def sample_browser(spark, d):
    """Rows of the chosen groups in which one of four fields contains what was typed, folded."""
    asked = T.fold(F.lit("RI"))
    fields = [T.fold(F.col(c).cast("string")) for c in ("p_name", "p_brand", "p_type", "p_size")]
    return table(spark, d, "part").where(F.col("p_brand").isin("Brand#2", "Brand#4") & F.exists(F.array(*fields), lambda x: F.contains(x, asked))).select("p_partkey")


@query("known_slots", f"""
WITH w AS (SELECT conv_id, list_distinct(flatten(list({TOKENS}))) AS w FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(['place', 'time', 'kind'], lambda s: CASE s WHEN 'place' THEN list_contains(w, 'the') OR list_contains(w, 'der') WHEN 'time' THEN list_contains(w, 'on') ELSE list_contains(w, 'que') END), ',') AS slots FROM w""")
def known_slots(spark, d):
    """Of a fixed list of slots, in its order, those that the user has filled."""
    cues = {"place": ["the", "der"], "time": ["on"], "kind": ["que"]}
    words = table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.explode_outer(T.tokens(F.col("text"))).alias("w"))
    every = F.array(*[F.lit(w) for ws in cues.values() for w in ws])
    said = words.groupBy("conv_id").agg(F.collect_set(F.when(F.array_contains(every, F.col("w")), F.col("w"))).alias("w"))
    slots = F.array_compact(F.array(*[F.when(F.arrays_overlap("w", F.array(*map(F.lit, ws))), s) for s, ws in cues.items()]))
    return said.select("conv_id", F.array_join(slots, ",").alias("slots"))


@query("prepared_splits", f"""WITH {curation.GROUPED}, r AS (SELECT conv_id, group_id, split FROM gr JOIN sp2 USING (group_id)), n AS (SELECT group_id, count(DISTINCT split) AS k FROM r GROUP BY group_id)
SELECT split, count(*) AS n_rows, count(*) - count(DISTINCT conv_id) AS n_repeated, count(*) FILTER (k > 1) AS n_in_two, count(*) FILTER (hash IS NULL) AS n_unhashed FROM r JOIN n USING (group_id) LEFT JOIN un USING (conv_id) GROUP BY split""")
def prepared_splits(spark, d):
    """What must be nought in prepared splits: identifiers that repeat, groups in two splits, rows without a hash."""
    rows = C.kept(curation.split_rows(spark, d).select("conv_id", "group_id", "split", "hash"), "prepared")
    several = rows.select("group_id", "split").distinct().groupBy("group_id").agg(F.count("*").alias("k"))
    own = rows.groupBy("split", "conv_id").agg(F.count("*").alias("n"), F.min("group_id").alias("group_id"), F.count(F.when(F.col("hash").isNull(), 1)).alias("unhashed"))
    return own.join(several, "group_id").groupBy("split").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeated"), F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("n_in_two"), F.sum("unhashed").alias("n_unhashed"))
