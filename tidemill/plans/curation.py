"""Conversation curation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import curation as C
from tidemill.operators import dedup as D
from tidemill.plans import dedup
from tidemill.plans.registry import query
from tidemill.sources.tables import table

#: The tables' invented language has no doses or emergencies: these patterns stand for them.
RULES = C.Rules(dose="(?i)ththe", certain="(?i)ouaux", urgent_sign="(?i)thing", urgent_advice="(?i)and", strict={"role_inversion_user": "(?i)^the", "role_inversion_assistant": "(?i)^la", "simulation_artifact": "(?i)quere", "leaked_planning_notes": "(?i)erth"})


def turns(spark, d):
    return table(spark, d, "conversations")


def convs(spark, d):
    return C.conversations(turns(spark, d))


def clean(spark, d):
    return C.cleaned(convs(spark, d))


@query("conversation_summary", "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def conversation_summary(spark, d):
    of = lambda role: F.count(F.when(F.col("role") == role, 1))
    return turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_turns"), of("user").alias("n_user"), of("assistant").alias("n_assistant"), F.sum(F.length("text")).alias("n_chars"))


@query("role_adjacency", "SELECT conv_id, count(*) FILTER (role = before) AS n_same, count(*) FILTER (before = 'system') AS n_after_system FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id")
def role_adjacency(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, d).withColumn("before", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.count(F.when(F.col("role") == F.col("before"), 1)).alias("n_same"), F.count(F.when(F.col("before") == "system", 1)).alias("n_after_system"))


TRIM = "(SELECT conv_id, turn, role, text, max(turn) FILTER (role <> 'user') OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role <> 'system')"


@query("trim_trailing_user", f"SELECT conv_id, turn, role FROM {TRIM} WHERE turn <= last")
def trim_trailing_user(spark, d):
    last = F.max(F.when(F.col("role") != "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return turns(spark, d).where("role <> 'system'").withColumn("last", last).where("turn <= last").select("conv_id", "turn", "role")


@query("replies_after_first_user", """
WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY conv_id),
r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations JOIN f USING (conv_id) WHERE role = 'assistant' AND turn > first)
SELECT conv_id, turn, k::INTEGER AS k, md5(text) AS reply FROM r WHERE k <= 3""")
def replies_after_first_user(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, d).withColumn("first", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))).where("role = 'assistant' AND turn > first")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 3").select("conv_id", "turn", "k", F.md5("text").alias("reply"))


@query("prefix_items", """
WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, count(*) FILTER (role = 'user') OVER w AS k, string_agg(role || ':' || text, '|') OVER w AS prefix FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id || '#' || k AS item_id, turn, md5(prefix) AS prefix_hash, md5(next_text) AS reference FROM t WHERE role = 'user' AND next_role = 'assistant'""")
def prefix_items(spark, d):
    """A benchmark item for each user turn that an assistant answers: what came before it, and the answer."""
    return C.prefixes(turns(spark, d)).select(F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("k").cast("string")).alias("item_id"), "turn", F.md5("prefix").alias("prefix_hash"), F.md5("next_text").alias("reference"))


REASONS = f"""
a AS (SELECT conv_id, turn, role, regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g') AS text FROM conversations),
sp AS (SELECT *, max(turn) FILTER (role <> 'user') OVER (PARTITION BY conv_id) AS last FROM a WHERE role <> 'system'),
cl AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM sp WHERE turn <= last),
ag AS (SELECT c.conv_id, coalesce(bool_or(cl.role = cl.before), false) AS pairs, count(*) FILTER (cl.role = 'user') AS nu, count(*) FILTER (cl.role = 'assistant') AS na,
  coalesce(sum(length(regexp_replace(cl.text, '[^\\p{{L}}]', '', 'g'))) FILTER (cl.role = 'user'), 0) AS letters, coalesce(sum(length(regexp_replace(cl.text, '[^a-zA-ZÀ-ÿ]', '', 'g'))) FILTER (cl.role = 'user'), 0) AS wanted,
  bool_or(cl.role = 'assistant' AND regexp_matches(cl.text, '{RULES.dose}')) AS dose, bool_or(cl.role = 'assistant' AND regexp_matches(cl.text, '{RULES.certain}')) AS certain,
  min(cl.turn) FILTER (cl.role = 'user' AND regexp_matches(cl.text, '{RULES.urgent_sign}')) AS sign
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN cl USING (conv_id) GROUP BY c.conv_id),
em AS (SELECT a.conv_id, bool_or(text = '') AS empty FROM a GROUP BY conv_id),
st AS (SELECT conv_id, CASE WHEN empty THEN 'empty_message' WHEN pairs THEN 'consecutive_same_role' WHEN nu < 2 OR na < 2 THEN 'too_few_turns' WHEN letters = 0 OR wanted / letters < 0.05 THEN 'other_language' END AS reason FROM ag JOIN em USING (conv_id)),
es AS (SELECT ag.conv_id, sign IS NOT NULL AND NOT coalesce(bool_or(cl.role = 'assistant' AND cl.turn > sign AND regexp_matches(cl.text, '{RULES.urgent_advice}')), false) AS escalate FROM ag LEFT JOIN cl USING (conv_id) GROUP BY ag.conv_id, sign),
sr AS (SELECT conv_id, concat_ws(',', CASE WHEN dose THEN 'medication_dose' END, CASE WHEN certain THEN 'certain_diagnosis' END, CASE WHEN escalate THEN 'emergency_not_escalated' END) AS reasons FROM ag JOIN es USING (conv_id))"""


def structural(spark, d):
    return C.settled(clean(spark, d).withColumn("reason", C.structural_reason(RULES)))


@query("structural_reasons", f"WITH {REASONS} SELECT conv_id, reason FROM st")
def structural_reasons(spark, d):
    return structural(spark, d).select("conv_id", "reason")


@query("standard_reasons", f"WITH {REASONS} SELECT conv_id, reasons FROM sr JOIN st USING (conv_id) WHERE reason IS NULL")
def standard_reasons(spark, d):
    rows = structural(spark, d).select("conv_id", "clean", "reason")
    return rows.where("reason IS NULL").select("conv_id", F.array_join(C.standard_reasons(RULES), ",").alias("reasons"))


STRICT = f"""
fu AS (SELECT conv_id, min(turn) AS first FROM cl WHERE role = 'user' GROUP BY conv_id),
rp AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM cl JOIN fu USING (conv_id) WHERE role = 'assistant' AND turn > first),
tr AS (SELECT cl.conv_id, bool_or(role = 'user' AND regexp_matches(text, '{RULES.strict["role_inversion_user"]}')) AS a, bool_or(role = 'assistant' AND regexp_matches(text, '{RULES.strict["role_inversion_assistant"]}')) AS b, bool_or(regexp_matches(text, '{RULES.strict["simulation_artifact"]}')) AS c, bool_or(role = 'assistant' AND regexp_matches(text, '{RULES.strict["leaked_planning_notes"]}')) AS e FROM cl GROUP BY cl.conv_id),
rq AS (SELECT conv_id, bool_or(k = 1 AND NOT contains(text, '?')) AS nf, count(*) FILTER (k <= 3 AND contains(text, '?')) AS asks FROM rp GROUP BY conv_id),
xr AS (SELECT conv_id, concat_ws(',', CASE WHEN a THEN 'role_inversion_user' END, CASE WHEN b THEN 'role_inversion_assistant' END, CASE WHEN c THEN 'simulation_artifact' END, CASE WHEN e THEN 'leaked_planning_notes' END, CASE WHEN nf THEN 'no_followup_question' END, CASE WHEN coalesce(asks, 0) < 2 THEN 'insufficient_history_taking' END) AS reasons FROM tr LEFT JOIN rq USING (conv_id))"""


@query("strict_reasons", f"WITH {REASONS}, {STRICT} SELECT conv_id, reasons FROM xr JOIN st USING (conv_id) WHERE reason IS NULL")
def strict_reasons(spark, d):
    rows = structural(spark, d).select("conv_id", "clean", "reason")
    return rows.where("reason IS NULL").select("conv_id", F.array_join(C.strict_reasons(RULES), ",").alias("reasons"))


def assessed(spark, d):
    """conv_id, clean, reasons (the structural one, or the standard ones)."""
    rows = structural(spark, d)
    return C.settled(rows.select("conv_id", "clean", F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(C.standard_reasons(RULES)).alias("reasons")))


HASH = "sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY turn))"
ACCEPTED = f"""{REASONS},
ac AS (SELECT conv_id FROM st JOIN sr USING (conv_id) WHERE reason IS NULL AND reasons = ''),
hh AS (SELECT conv_id, {HASH} AS hash FROM cl JOIN ac USING (conv_id) GROUP BY conv_id),
un AS (SELECT min(conv_id) AS conv_id, hash FROM hh GROUP BY hash)"""


def accepted(spark, d):
    """conv_id, clean, hash of conversations without a reason, the first of exact duplicates."""
    rows = assessed(spark, d).where(F.size("reasons") == 0).select("conv_id", "clean", C.conversation_hash("clean").alias("hash"))
    return D.keep_first(rows, ["hash"], ["conv_id"])


@query("reason_histogram", f"WITH {REASONS} SELECT reason, count(*) AS n FROM (SELECT reason FROM st WHERE reason IS NOT NULL UNION ALL SELECT unnest(string_split(reasons, ',')) FROM sr JOIN st USING (conv_id) WHERE reason IS NULL AND reasons <> '') GROUP BY reason")
def reason_histogram(spark, d):
    return assessed(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("rejection_log", f"WITH {REASONS} SELECT conv_id AS sample_id, 'standard' AS level, CASE WHEN reason IS NOT NULL THEN reason ELSE reasons END AS reasons FROM st JOIN sr USING (conv_id) WHERE reason IS NOT NULL OR reasons <> ''")
def rejection_log(spark, d):
    return assessed(spark, d).where(F.size("reasons") > 0).select(F.col("conv_id").alias("sample_id"), F.lit("standard").alias("level"), F.array_join("reasons", ",").alias("reasons"))


@query("conversation_hash", f"SELECT conv_id, {HASH} AS hash FROM conversations GROUP BY conv_id")
def conversation_hash(spark, d):
    return convs(spark, d).select("conv_id", C.conversation_hash("messages").alias("hash"))


GROUPED = f"""{ACCEPTED},
gr AS (SELECT conv_id, substr(sha256('topic:' || conv_id % 17), 1, 16) AS group_id FROM un),
sz AS (SELECT group_id, count(*) AS size, sha256('42:' || group_id) AS h FROM gr GROUP BY group_id),
ru AS (SELECT group_id, size, coalesce(sum(size) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running, sum(size) OVER () AS total FROM sz),
sp2 AS (SELECT group_id, size, CASE WHEN running < 0.8 * total THEN 'train' WHEN running < (0.8::DOUBLE + 0.1::DOUBLE) * total THEN 'validation' ELSE 'test' END AS split FROM ru)"""


def grouped(spark, d):
    topic = F.concat(F.lit("topic:"), (F.col("conv_id") % 17).cast("string"))
    return accepted(spark, d).withColumn("group_id", F.substring(F.sha2(topic, 256), 1, 16))


@query("group_split", f"WITH {GROUPED} SELECT group_id, size, split FROM sp2")
def group_split(spark, d):
    return C.group_split(grouped(spark, d), "group_id")


def split_rows(spark, d):
    rows = grouped(spark, d)
    splits = C.group_split(rows, "group_id").select(F.col("group_id").alias("g"), "split")
    return rows.join(splits, F.col("group_id") == F.col("g")).drop("g")


@query("split_counts", f"WITH {GROUPED}, x AS (SELECT split, CASE WHEN xr.reasons = '' THEN 1 ELSE 0 END AS is_strict FROM gr JOIN sp2 USING (group_id) JOIN xr USING (conv_id)) SELECT level, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM (SELECT 'standard' AS level, split FROM x UNION ALL SELECT 'strict', split FROM x WHERE is_strict = 1) GROUP BY level".replace(f"WITH {GROUPED}, x", f"WITH {GROUPED}, {STRICT}, x"))
def split_counts(spark, d):
    rows = split_rows(spark, d).select("split", F.size(C.strict_reasons(RULES)).alias("n"))
    levels = rows.select(F.explode(F.when(F.col("n") == 0, F.array(F.lit("standard"), F.lit("strict"))).otherwise(F.array(F.lit("standard")))).alias("level"), "split")
    return levels.groupBy("level").pivot("split", ["train", "validation", "test"]).agg(F.count(F.lit(1))).na.fill(0)


@query("split_leakage", f"""WITH {GROUPED}, op AS (SELECT g.conv_id, split, lower(trim(arg_min(text, turn))) AS opening FROM gr g JOIN sp2 USING (group_id) JOIN cl USING (conv_id) WHERE role = 'user' GROUP BY g.conv_id, split)
SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.opening) AS n_shared FROM op a JOIN op b ON a.opening = b.opening AND a.split < b.split GROUP BY ALL""")
def split_leakage(spark, d):
    """Openings that two splits share: one row for each opening and split before they meet."""
    opening = F.lower(F.trim(F.get(F.filter("clean", lambda m: m["role"] == "user"), F.lit(0))["content"]))
    rows = split_rows(spark, d).select("split", opening.alias("opening")).distinct()
    sets = rows.groupBy("opening").agg(F.sort_array(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode_outer(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n_shared"))


@query("split_manifest", f"""WITH {GROUPED}, m AS (SELECT split, conv_id::VARCHAR AS line, sha256(conv_id::VARCHAR) AS h FROM gr JOIN sp2 USING (group_id)),
p AS (SELECT split, substr(h, 1, {D.LEAF}) AS part, sha256(string_agg(line, chr(10) ORDER BY line)) AS d, count(*) AS k FROM m GROUP BY 1, 2)
SELECT split, sum(k)::BIGINT AS n, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)) AS ids_digest FROM p GROUP BY split""")
def split_manifest(spark, d):
    """The size of each split, and a digest of its identifiers over digests of their parts."""
    line = F.col("conv_id").cast("string")
    rows = split_rows(spark, d).select("split", line.alias("line"), F.sha2(line, 256).alias("h"))
    sizes = rows.groupBy("split").agg(F.count("*").alias("n"))
    return sizes.join(D.digests(rows, "split", "h", "line").withColumnRenamed("digest", "ids_digest"), "split")


@query("turn_grouping", "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_group FROM conversations WHERE role <> 'system'")
def turn_grouping(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns(spark, d).where("role <> 'system'").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("turn_group"))


@query("latest_user_turn", "SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS text_hash FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_user_turn(spark, d):
    return turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.md5(F.max_by("text", "turn")).alias("text_hash"))


@query("last_n_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4")
def last_n_history(spark, d):
    """The last four turns of each conversation (the limit is the feature)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 4").select("conv_id", "turn", "role")


@query("question_answer_fallback", "SELECT conv_id, CASE WHEN q IS NOT NULL AND a IS NOT NULL THEN 'pair' WHEN q IS NOT NULL THEN 'prompt' ELSE 'none' END AS kind, md5(coalesce(q, '')) AS question FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)")
def question_answer_fallback(spark, d):
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = turns(spark, d).groupBy("conv_id").agg(first("user").alias("q"), first("assistant").alias("a"))
    return rows.select("conv_id", F.when(F.col("q").isNotNull() & F.col("a").isNotNull(), "pair").when(F.col("q").isNotNull(), "prompt").otherwise("none").alias("kind"), F.md5(F.coalesce("q", F.lit(""))).alias("question"))


SAID = "SELECT cl.conv_id AS doc_id, string_split(lower(string_agg(cl.text, ' ' ORDER BY cl.turn)), ' ') AS w FROM cl JOIN un USING (conv_id) WHERE role = 'user' GROUP BY cl.conv_id"
#: The clusters of accepted conversations: the signatures' SQL over their users' words.
CLUSTERS = (ACCEPTED + ", " + dedup.PAIRS.replace(f"w AS (SELECT doc_id, {dedup.TOKENS} AS w FROM documents)", f"w AS ({SAID})")) + """,
e AS (SELECT a, b FROM sim WHERE similarity >= 0.7 UNION SELECT b, a FROM sim WHERE similarity >= 0.7),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
cu AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


def patient_clusters(rows):
    """node, root: accepted conversations (conv_id, clean) by their users' words."""
    said = F.array_join(F.transform(F.filter("clean", lambda m: m["role"] == "user"), lambda m: m["content"]), " ")
    words = rows.select(F.col("conv_id").alias("doc_id"), F.split(F.lower(said), " ").alias("w"))
    return D.clusters(D.anchored_pairs(words.select("doc_id", D.signature(F.col("w")).alias("sig")).where("sig IS NOT NULL"), 0.7))


@query("near_duplicate_patients", f"WITH RECURSIVE {CLUSTERS} SELECT node, root FROM cu")
def near_duplicate_patients(spark, d):
    """Clusters of conversations by their users' words."""
    return patient_clusters(accepted(spark, d))


CURATED = f"""{CLUSTERS},
cg AS (SELECT conv_id, substr(sha256('conv:' || coalesce(root, conv_id)), 1, 16) AS group_id FROM un LEFT JOIN cu ON node = conv_id),
cz AS (SELECT group_id, count(*) AS size, sha256('42:' || group_id) AS h FROM cg GROUP BY group_id),
cr AS (SELECT group_id, size, coalesce(sum(size) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running, sum(size) OVER () AS total FROM cz),
cs AS (SELECT group_id, CASE WHEN running < 0.8 * total THEN 'train' WHEN running < (0.8::DOUBLE + 0.1::DOUBLE) * total THEN 'validation' ELSE 'test' END AS split FROM cr)"""


def curated(spark, d):
    """conv_id, group_id, split, level of accepted conversations, end to end: reasons, exact and near duplicates, near duplicates as one group, splits by group."""
    spark_rows = C.kept(accepted(spark, d).select("conv_id", "clean"), "curated")
    roots = patient_clusters(spark_rows)
    group = F.substring(F.sha2(F.concat(F.lit("conv:"), F.coalesce("root", "conv_id").cast("string")), 256), 1, 16)
    strict = F.when(F.size(C.strict_reasons(RULES)) == 0, "strict").otherwise("standard")
    rows = spark_rows.select("conv_id", strict.alias("level")).join(roots, F.col("conv_id") == F.col("node"), "left").select("conv_id", "level", group.alias("group_id"))
    rows = C.kept(rows, "grouped")
    splits = C.group_split(rows, "group_id").select(F.col("group_id").alias("g"), "split")
    return rows.join(splits, F.col("group_id") == F.col("g")).select("conv_id", "group_id", "split", "level")


@query("curated_splits", f"WITH RECURSIVE {CURATED}, {STRICT} SELECT conv_id, group_id, split, CASE WHEN xr.reasons = '' THEN 'strict' ELSE 'standard' END AS level FROM cg JOIN cs USING (group_id) JOIN xr USING (conv_id)")
def curated_splits(spark, d):
    return curated(spark, d)


@query("curated_report", f"""WITH RECURSIVE {CURATED}, g AS (SELECT group_id, split, count(*) AS n FROM cg JOIN cs USING (group_id) GROUP BY ALL), kk AS (SELECT group_id, count(*) AS k FROM g GROUP BY group_id)
SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (k > 1) AS n_leaked FROM g JOIN kk USING (group_id) GROUP BY split""")
def curated_report(spark, d):
    """Rows and groups of each split, and how many of its groups another split has too (none may)."""
    rows = C.kept(curated(spark, d), "splits")
    groups = rows.groupBy("group_id", "split").agg(F.count("*").alias("n"))
    leaked = groups.groupBy("group_id").agg(F.count("*").alias("k"))
    return groups.join(leaked, "group_id").groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count(F.when(F.col("k") > 1, 1)).alias("n_leaked"))
