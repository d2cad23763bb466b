"""Rule and dialogue queries. The invented words of the tables stand for symptoms; the rules are this module's own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import dialogue as D
from tidemill.plans.registry import query
from tidemill.plans.text import FOLD
from tidemill.sources.tables import table

#: label, phrase
RULES = [("bleeding", "er"), ("bleeding", "anth"), ("breath", "the thre"), ("fever", "ing"), ("pain", "schst"), ("pain", "la eau"), ("fever", "ciones")]
#: Words of the tables that stand for negators and clause ends.
NEGATED = r"\b(?:of|die|de)\b(?: +[^ ]+){0,4} *$"
CLAUSE = r"\b(?:and|und|et)\b|[,.;!?\n]"
RULES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in RULES)
#: Folded texts: word boundaries are those of plain letters in every engine.
TURNS = f"SELECT conv_id, turn, role, replace({FOLD}, 'ß', 'ss') AS t FROM conversations"
HITS = f"""r(label, phrase) AS (VALUES {RULES_SQL}), t AS ({TURNS}),
m AS (SELECT conv_id, turn, role, label, phrase, regexp_split_to_array(t, '\\b' || phrase || '\\b') AS parts FROM t JOIN r ON contains(t, phrase)),
h AS (SELECT conv_id, turn, role, label, phrase, len(parts) - 1 AS n, len(list_filter(parts[1:len(parts)-1], lambda p: NOT regexp_matches(list_extract(regexp_split_to_array(p, '{CLAUSE}'), -1), '{NEGATED}'))) AS affirmed FROM m)"""


def rules(spark):
    return spark.createDataFrame(RULES, "label string, phrase string")


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.replace(T.fold(F.col("text")), F.lit("ß"), F.lit("ss")).alias("t"))


def hits(spark, d):
    near = turns(spark, d).join(F.broadcast(rules(spark)), F.contains("t", F.col("phrase")))
    return near.select("conv_id", "turn", "role", "label", "phrase", D.occurrences(F.col("t"), F.col("phrase")).alias("n"), D.affirmed(F.col("t"), F.col("phrase"), CLAUSE, NEGATED).alias("affirmed"))


@query("negation_scope", f"WITH {HITS} SELECT conv_id, turn, phrase, n::INTEGER AS n, affirmed::INTEGER AS affirmed FROM h WHERE n > 0")
def negation_scope(spark, d):
    return hits(spark, d).where("n > 0").select("conv_id", "turn", "phrase", "n", "affirmed")


@query("phrase_rules_tagger", f"WITH {HITS} SELECT DISTINCT conv_id, turn, label FROM h WHERE affirmed > 0")
def phrase_rules_tagger(spark, d):
    return hits(spark, d).where("affirmed > 0").select("conv_id", "turn", "label").distinct()


@query("red_flags", f"""WITH {HITS}, f AS (SELECT conv_id, turn, label FROM h WHERE affirmed > 0 AND role = 'user'
  UNION SELECT conv_id, turn, 'combined' FROM t WHERE role = 'user' AND contains(t, 'th') AND conv_id IN (SELECT conv_id FROM h WHERE affirmed > 0 AND label = 'fever' AND h.turn = t.turn))
SELECT conv_id, string_agg(DISTINCT label, ',' ORDER BY label) AS flags FROM f GROUP BY conv_id""")
def red_flags(spark, d):
    """Labels over all user turns, and a combined one where a context and a symptom meet in a turn."""
    user = hits(spark, d).where("affirmed > 0 AND role = 'user'").select("conv_id", "turn", "label")
    context = turns(spark, d).where("role = 'user'").where(F.contains("t", F.lit("th"))).select("conv_id", "turn")
    both = user.where("label = 'fever'").join(context, ["conv_id", "turn"]).select("conv_id", "turn", F.lit("combined").alias("label"))
    return user.union(both).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("flags"))


@query("scope_check", f"WITH t AS ({TURNS}) SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'ignore (all|previous)|queren') THEN 'injection' WHEN regexp_matches(t, '^(hello|the)\\b') THEN 'greeting' WHEN regexp_matches(t, '\\b(er|ing|schst)\\b') THEN 'medical' WHEN regexp_matches(t, '\\b(und|et)\\b') THEN 'other' ELSE 'unclear' END AS scope FROM t WHERE role = 'user'")
def scope_check(spark, d):
    t = F.col("t")
    scope = F.when(t.rlike("ignore (all|previous)|queren"), "injection").when(t.rlike(r"^(hello|the)\b"), "greeting").when(t.rlike(r"\b(er|ing|schst)\b"), "medical").when(t.rlike(r"\b(und|et)\b"), "other").otherwise("unclear")
    return turns(spark, d).where("role = 'user'").select("conv_id", "turn", scope.alias("scope"))


@query("information_questions", f"WITH t AS ({TURNS}), b AS (SELECT conv_id, turn, regexp_replace(t, '[ ?.]+$', '') AS b FROM t WHERE role = 'user') SELECT conv_id, turn, b <> '' AND NOT regexp_matches(b, '[,.;:!?\\n]') AND regexp_matches(b, '^(the|die|le)\\b|th$') AND NOT regexp_matches(b, '\\b(is|ist|est)\\b') AS is_information FROM b")
def information_questions(spark, d):
    """One clause that begins or ends like a definition question, and that reports nobody's state."""
    b = F.col("b")
    rows = turns(spark, d).where("role = 'user'").select("conv_id", "turn", F.regexp_replace("t", "[ ?.]+$", "").alias("b"))
    return rows.select("conv_id", "turn", ((b != "") & ~b.rlike("[,.;:!?\n]") & b.rlike(r"^(the|die|le)\b|th$") & ~b.rlike(r"\b(is|ist|est)\b")).alias("is_information"))


@query("latest_intent", f"WITH t AS ({TURNS}) SELECT conv_id, CASE WHEN regexp_matches(arg_max(t, turn), '\\b(the|der)\\b') THEN 'symptom' ELSE 'information' END AS intent FROM t WHERE role = 'user' GROUP BY conv_id")
def latest_intent(spark, d):
    last = turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max_by("t", "turn").alias("t"))
    return last.select("conv_id", F.when(F.col("t").rlike(r"\b(the|der)\b"), "symptom").otherwise("information").alias("intent"))


#: Words of the tables that stand for units, and their days.
UNITS = {"en": 1 / 24, "of": 1, "du": 1, "und": 7, "the": 7, "la": 30}
UNIT_CASE = " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in UNITS.items())


@query("duration_bucket", f"""
WITH m AS (SELECT doc_id, regexp_extract(text, '([0-9]{{1,3}}) ({'|'.join(UNITS)})( |$)', 1) AS n, regexp_extract(text, '([0-9]{{1,3}}) ({'|'.join(UNITS)})( |$)', 2) AS unit FROM documents),
x AS (SELECT doc_id, CASE unit {UNIT_CASE} END AS each, try_cast(n AS DOUBLE) AS n FROM m)
SELECT doc_id, CASE WHEN each < 1 THEN 'hours' WHEN n * each <= 7 THEN 'acute' WHEN n * each <= 28 THEN 'subacute' WHEN n * each > 28 THEN 'chronic' END AS bucket FROM x""")
def duration_bucket(spark, d):
    """How long the first duration that a text tells is; null without one."""
    return table(spark, d, "documents").select("doc_id", T.duration_bucket(F.col("text"), UNITS).alias("bucket"))


#: condition, token, weight; condition, excluded token
SUPPORTS = [("amber", "bleeding", 1.0), ("amber", "pain", 1.0), ("birch", "fever", 1.5), ("birch", "breath", 1.0), ("birch", "bleeding", 0.5), ("cedar", "pain", 1.5), ("cedar", "long", 1.0), ("dune", "long", 1.0), ("dune", "bleeding", 1.0)]
EXCLUDES = [("cedar", "fever")]
SUP_SQL = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in SUPPORTS)
FEATURES = f"""{HITS}, ft AS (SELECT DISTINCT conv_id AS id, label AS token FROM h WHERE affirmed > 0 UNION SELECT conv_id, 'long' FROM t GROUP BY conv_id HAVING count(*) >= 5),
su(condition, token, weight) AS (VALUES {SUP_SQL}), ex(condition, token) AS (VALUES ('cedar', 'fever'))"""


def features(spark, d):
    said = hits(spark, d).where("affirmed > 0").select(F.col("conv_id").alias("id"), F.col("label").alias("token"))
    long = turns(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 5").select("id", F.lit("long").alias("token"))
    return said.union(long).distinct()


def knowledge(spark):
    return spark.createDataFrame(SUPPORTS, "condition string, token string, weight double"), spark.createDataFrame(EXCLUDES, "condition string, token string")


@query("feature_extraction", f"WITH {FEATURES} SELECT id, token FROM ft")
def feature_extraction(spark, d):
    return features(spark, d)


SCORED = "sc AS (SELECT id, condition, sum(weight) AS score, count(*) AS matched FROM ft JOIN su USING (token) WHERE (id, condition) NOT IN (SELECT id, condition FROM ft JOIN ex USING (token)) GROUP BY ALL)"


@query("hypothesis_ranking", f"WITH {FEATURES}, {SCORED} SELECT id, condition, score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, condition)::INTEGER AS rank FROM sc WHERE score >= 2 AND matched >= 2) WHERE rank <= 3")
def hypothesis_ranking(spark, d):
    return D.hypotheses(features(spark, d), *knowledge(spark))


GAIN = f"""{FEATURES}, sc AS (SELECT id, condition, sum(weight) AS score FROM ft JOIN su USING (token) GROUP BY ALL),
g AS (SELECT i.id, n.condition, 1 + coalesce(score, 0) AS prior FROM (SELECT DISTINCT id FROM ft) i CROSS JOIN (SELECT DISTINCT condition FROM su) n LEFT JOIN sc ON sc.id = i.id AND sc.condition = n.condition),
q AS (SELECT g.id, k.token, g.prior, CASE WHEN su.condition IS NULL THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END * prior AS yes FROM g CROSS JOIN (SELECT DISTINCT token FROM su) k LEFT JOIN su ON su.condition = g.condition AND su.token = k.token WHERE NOT EXISTS (SELECT 1 FROM ft WHERE ft.id = g.id AND ft.token = k.token)),
z AS (SELECT id, token, prior, yes, prior - yes AS no, sum(prior) OVER w AS p, sum(yes) OVER w AS py, sum(prior - yes) OVER w AS pn FROM q WINDOW w AS (PARTITION BY id, token)),
ig AS (SELECT id, token, round(greatest(0, -sum(prior / p * log2(prior / p)) + any_value(py / p) * sum(yes / py * log2(yes / py)) + any_value(pn / p) * sum(no / pn * log2(no / pn))), 6) AS gain FROM z GROUP BY id, token)"""


@query("information_gain", f"WITH {GAIN} SELECT id, token, gain FROM ig")
def information_gain(spark, d):
    return D.binary_gain(features(spark, d), knowledge(spark)[0])


@query("next_question", f"WITH {GAIN}, x AS (SELECT id, arg_max(token, (gain, -ascii(token))) AS token, max(gain) AS gain FROM ig GROUP BY id) SELECT id, CASE WHEN id IN (SELECT id FROM ft WHERE token = 'breath') THEN 'emergency' WHEN coalesce(gain, 0) < 0.01 THEN 'finish' ELSE 'ask' END AS strategy, CASE WHEN id NOT IN (SELECT id FROM ft WHERE token = 'breath') AND gain >= 0.01 THEN token END AS token FROM (SELECT DISTINCT id FROM ft) LEFT JOIN x USING (id)")
def next_question(spark, d):
    """Emergency first; else the token with the most gain, ties to the earlier letter; else an end."""
    f = features(spark, d)
    best = D.binary_gain(f, knowledge(spark)[0]).groupBy("id").agg(F.max_by("token", F.struct("gain", -F.ascii("token"))).alias("token"), F.max("gain").alias("gain"))
    urgent = f.groupBy("id").agg(F.max(F.col("token") == "breath").alias("urgent"))
    rows = urgent.join(best, "id", "left")
    strategy = F.when(F.col("urgent"), "emergency").when(F.coalesce("gain", F.lit(0.0)) < 0.01, "finish").otherwise("ask")
    return rows.select("id", strategy.alias("strategy"), F.when(strategy == "ask", F.col("token")).alias("token"))


@query("profile_pick", f"WITH {HITS}, p(label, profile) AS (VALUES ('bleeding', 'wound'), ('fever', 'infection'), ('pain', 'general')) SELECT conv_id, arg_min(profile, (turn, h.label)) AS profile FROM h JOIN p ON p.label = h.label WHERE affirmed > 0 AND role = 'user' GROUP BY conv_id")
def profile_pick(spark, d):
    profiles = spark.createDataFrame([("bleeding", "wound"), ("fever", "infection"), ("pain", "general")], "label string, profile string")
    own = hits(spark, d).where("affirmed > 0 AND role = 'user'").join(F.broadcast(profiles), "label")
    return own.groupBy("conv_id").agg(F.min_by("profile", F.struct("turn", "label")).alias("profile"))


@query("question_topics", f"WITH t AS ({TURNS}), s AS (SELECT conv_id, turn, unnest(string_split(t, '.')) AS s FROM t WHERE role = 'assistant'), q(topic, cue) AS (VALUES ('where', 'the'), ('when', 'und'), ('how', 'que')) SELECT conv_id, turn, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM s JOIN q ON regexp_matches(s, '\\b' || cue || '\\b') GROUP BY conv_id, turn")
def question_topics(spark, d):
    cues = {"where": "the", "when": "und", "how": "que"}
    sentences = turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.explode(F.split("t", r"\.")).alias("s"))
    found = F.array_compact(F.array(*[F.when(F.col("s").rlike(rf"\b{cue}\b"), topic) for topic, cue in cues.items()]))
    return sentences.select("conv_id", "turn", F.explode(found).alias("topic")).groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))


@query("dialogue_state", f"""WITH {HITS}, c AS (SELECT conv_id, arg_min(label, (turn, label)) FILTER (affirmed > 0) AS chief, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (affirmed > 0) AS present, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n > 0 AND affirmed = 0) AS denied FROM h WHERE role = 'user' GROUP BY conv_id),
s AS (SELECT conv_id, arg_min(nullif(regexp_extract(t, '\\b(th[a-z]+)\\b', 1), ''), turn) FILTER (regexp_matches(t, '\\bth[a-z]+\\b')) AS onset, arg_max(nullif(regexp_extract(t, '\\b(er[a-z]+)\\b', 1), ''), turn) FILTER (regexp_matches(t, '\\ber[a-z]+\\b')) AS severity FROM t WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, chief, coalesce(present, '') AS present, coalesce(denied, '') AS denied, onset, severity, CASE WHEN chief IS NULL THEN 'collecting' WHEN onset IS NOT NULL AND severity IS NOT NULL THEN 'ready' ELSE 'asking' END AS status FROM s LEFT JOIN c USING (conv_id)""")
def dialogue_state(spark, d):
    """The fold over a conversation's user turns, as aggregates: the first complaint, the union of findings, a slot in which the first answer stands, and one in which the last does."""
    user = hits(spark, d).where("role = 'user'")
    yes, no = F.col("affirmed") > 0, (F.col("n") > 0) & (F.col("affirmed") == 0)
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    found = user.groupBy("conv_id").agg(F.min_by(F.when(yes, F.col("label")), F.when(yes, F.struct("turn", "label"))).alias("chief"), labels(yes).alias("present"), labels(no).alias("denied"))
    word = lambda p: F.when(F.col("t").rlike(rf"\b{p}[a-z]+\b"), F.regexp_extract("t", rf"\b({p}[a-z]+)\b", 1))
    said = turns(spark, d).where("role = 'user'").select("conv_id", "turn", word("th").alias("a"), word("er").alias("b"))
    slots = said.groupBy("conv_id").agg(F.min_by("a", F.when(F.col("a").isNotNull(), F.col("turn"))).alias("onset"), F.max_by("b", F.when(F.col("b").isNotNull(), F.col("turn"))).alias("severity"))
    status = F.when(F.col("chief").isNull(), "collecting").when(F.col("onset").isNotNull() & F.col("severity").isNotNull(), "ready").otherwise("asking")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return slots.join(found, "conv_id", "left").select("conv_id", "chief", empty("present"), empty("denied"), "onset", "severity", status.alias("status"))


@query("triage_decision", f"WITH {HITS}, f AS (SELECT conv_id, bool_or(affirmed > 0 AND label IN ('breath', 'bleeding')) AS urgent, bool_or(affirmed > 0) AS found FROM h WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, CASE WHEN urgent THEN 'emergency' WHEN found THEN 'possibilities' ELSE 'ask_duration' END AS decision FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') c LEFT JOIN f USING (conv_id)")
def triage_decision(spark, d):
    user = hits(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max((F.col("affirmed") > 0) & F.col("label").isin("breath", "bleeding")).alias("urgent"), F.max(F.col("affirmed") > 0).alias("found"))
    everyone = turns(spark, d).where("role = 'user'").select("conv_id").distinct()
    return everyone.join(user, "conv_id", "left").select("conv_id", F.when(F.col("urgent"), "emergency").when(F.col("found"), "possibilities").otherwise("ask_duration").alias("decision"))


@query("asked_slots", f"WITH t AS ({TURNS}) SELECT conv_id, slot, count(*) AS times FROM (SELECT conv_id, unnest(list_filter([CASE WHEN regexp_matches(t, '\\bthe\\b') THEN 'where' END, CASE WHEN regexp_matches(t, '\\bund\\b') THEN 'when' END], lambda x: x IS NOT NULL)) AS slot FROM t WHERE role = 'assistant') GROUP BY ALL")
def asked_slots(spark, d):
    slots = F.array_compact(F.array(F.when(F.col("t").rlike(r"\bthe\b"), "where"), F.when(F.col("t").rlike(r"\bund\b"), "when")))
    return turns(spark, d).where("role = 'assistant'").select("conv_id", F.explode(slots).alias("slot")).groupBy("conv_id", "slot").agg(F.count("*").alias("times"))


@query("ranked_tokens", f"WITH {GAIN} SELECT id, token, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, token)::INTEGER AS rank FROM ig) WHERE rank <= 3")
def ranked_tokens(spark, d):
    w = Window.partitionBy("id").orderBy(F.col("gain").desc(), "token")
    return D.binary_gain(features(spark, d), knowledge(spark)[0]).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("id", "token", "rank")


@query("case_maker", f"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, sha256(message) AS content_hash, CASE WHEN ('0x' || substr(sha256('cases:' || conv_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE >= 0.8 THEN 'holdout' ELSE 'dev' END AS split FROM f WHERE length(message) BETWEEN 25 AND 3000""")
def case_maker(spark, d):
    """A case from each first user turn of a fitting length; a short first turn isn't replaced by a later one."""
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("message"))
    split = F.when(T.hash_fraction("cases", F.col("conv_id").cast("string")) >= 0.8, "holdout").otherwise("dev")
    return first.where(F.length("message").between(25, 3000)).select("conv_id", F.sha2("message", 256).alias("content_hash"), split.alias("split"))


@query("judge_scores", "SELECT event_type, count(*) FILTER (k BETWEEN 1 AND 5) AS n_valid, count(*) FILTER (NOT k BETWEEN 1 AND 5) AS n_invalid, round(avg(CASE WHEN k BETWEEN 1 AND 5 THEN k END), 2) AS mean_score FROM (SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events) GROUP BY event_type")
def judge_scores(spark, d):
    """Integer scores of 1 to 5 from JSON replies; others are invalid and count in no mean."""
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    valid = F.col("k").between(1, 5)
    return rows.groupBy("event_type").agg(F.count(F.when(valid, 1)).alias("n_valid"), F.count(F.when(~valid, 1)).alias("n_invalid"), F.round(F.avg(F.when(valid, F.col("k"))), 2).alias("mean_score"))


@query("question_validation", f"WITH t AS ({TURNS}) SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT contains(t, '?') THEN 'no_question' END, CASE WHEN length(t) > 300 THEN 'too_long' END, CASE WHEN regexp_matches(t, '\\b(schst|ing)\\b') THEN 'names_condition' END, CASE WHEN regexp_matches(t, '[0-9]+ ?mg') THEN 'dose' END) AS reasons FROM t WHERE role = 'assistant'")
def question_validation(spark, d):
    """Why a generated turn is no acceptable question: all reasons that hold."""
    t = F.col("t")
    reasons = F.array_compact(F.array(F.when(~F.contains(t, F.lit("?")), "no_question"), F.when(F.length(t) > 300, "too_long"), F.when(t.rlike(r"\b(schst|ing)\b"), "names_condition"), F.when(t.rlike("[0-9]+ ?mg"), "dose")))
    return turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.array_join(reasons, ",").alias("reasons"))


@query("case_checks", "SELECT doc_id, quality = 1 AS expected_action, CASE WHEN toxic = 1 THEN length(text) < 4000 END AS short_when_toxic, contains(source, 'src') AS grounded, quality = 1 AND coalesce(CASE WHEN toxic = 1 THEN length(text) < 4000 END, true) AND contains(source, 'src') AS passed FROM labels JOIN documents USING (doc_id)")
def case_checks(spark, d):
    """A check that doesn't apply is null, and doesn't fail its case."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")), "doc_id")
    checks = {"expected_action": F.col("quality") == 1, "short_when_toxic": F.when(F.col("toxic") == 1, F.col("n") < 4000), "grounded": F.contains("source", F.lit("src"))}
    every = F.forall(F.array(*checks.values()), lambda x: F.coalesce(x, F.lit(True)))
    return rows.select("doc_id", *(c.alias(k) for k, c in checks.items()), every.alias("passed"))


@query("prefix_state_examples", f"""WITH {HITS}, s AS (SELECT conv_id, turn, bool_or(affirmed > 0 AND label = 'breath') AS stop FROM h WHERE role = 'user' GROUP BY conv_id, turn),
x AS (SELECT t.conv_id, t.turn, t.role, coalesce(bool_or(stop) OVER (PARTITION BY t.conv_id ORDER BY t.turn), false) AS stopped, lead(t.role) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS next FROM t LEFT JOIN s ON s.conv_id = t.conv_id AND s.turn = t.turn)
SELECT conv_id, turn FROM x WHERE role = 'user' AND next = 'assistant' AND NOT stopped""")
def prefix_state_examples(spark, d):
    """User turns that an assistant answers, up to the first emergency of their conversation."""
    stop = hits(spark, d).where("role = 'user'").groupBy("conv_id", "turn").agg(F.max((F.col("affirmed") > 0) & (F.col("label") == "breath")).alias("stop"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, d).join(stop, ["conv_id", "turn"], "left").withColumn("stopped", F.coalesce(F.max("stop").over(w), F.lit(False))).withColumn("next", F.lead("role").over(w))
    return rows.where("role = 'user' AND next = 'assistant' AND NOT stopped").select("conv_id", "turn")


@query("repeated_questions", f"WITH t AS ({TURNS}), s AS (SELECT conv_id, turn, regexp_extract(t, '\\b(the|und|que)\\b', 1) AS topic FROM t WHERE role = 'assistant') SELECT conv_id, turn, topic FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, topic ORDER BY turn) AS k FROM s WHERE topic <> '') WHERE k > 1")
def repeated_questions(spark, d):
    """Assistant turns whose topic was asked before."""
    rows = turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.regexp_extract("t", r"\b(the|und|que)\b", 1).alias("topic")).where("topic <> ''")
    w = Window.partitionBy("conv_id", "topic").orderBy("turn")
    return rows.withColumn("k", F.row_number().over(w)).where("k > 1").select("conv_id", "turn", "topic")
