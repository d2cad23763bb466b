"""Evaluation queries over labels, documents and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import metrics as M
from tidemill.plans.registry import query
from tidemill.sources.tables import table

BASE = "b AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, length(d.text) % 3 = 0 AS guess, md5(d.text) AS h FROM labels l JOIN documents d USING (doc_id))"


def base(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", (F.length("text") % 3 == 0).alias("guess"), F.md5("text").alias("h"))
    return table(spark, d, "labels").join(docs, "doc_id")


@query("confusion_gates", f"""WITH {BASE}, c AS (SELECT lang, count(*) FILTER (toxic = 1 AND guess) AS tp, count(*) FILTER (toxic <> 1 AND guess) AS fp, count(*) FILTER (toxic = 1 AND NOT guess) AS fn, count(*) FILTER (toxic <> 1 AND NOT guess) AS tn FROM b GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_positive_rate, coalesce(tp / nullif(tp + fn, 0)::DOUBLE >= 0.3, false) AS passes FROM c""")
def confusion_gates(spark, d):
    out = M.confusion(base(spark, d), F.col("toxic") == 1, F.col("guess"), ["lang"])
    return out.withColumn("passes", F.coalesce(F.col("recall") >= 0.3, F.lit(False)))


SETS = "st AS (SELECT item_id, list_filter(['a', 'e', 'i', 'o', 'u', 'y'], lambda x: contains(text, x || 'n')) AS gold, list_filter(['a', 'e', 'i', 'o', 'u', 'y'], lambda x: contains(text, x || 's')) AS found FROM benchmark)"


def sets(spark, d):
    vowels = F.array(*map(F.lit, "aeiouy"))
    has = lambda c: F.filter(vowels, lambda x: F.contains(F.col("text"), F.concat(x, F.lit(c))))
    return table(spark, d, "benchmark").select("item_id", has("n").alias("gold"), has("s").alias("found"))


@query("set_scores", f"""WITH {SETS}, s AS (SELECT sum(len(list_intersect(gold, found)))::BIGINT AS tp, sum(len(found) - len(list_intersect(gold, found)))::BIGINT AS fp, sum(len(gold) - len(list_intersect(gold, found)))::BIGINT AS fn FROM st),
p AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM s)
SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM p""")
def set_scores(spark, d):
    return M.set_scores(sets(spark, d), "gold", "found")


@query("row_f1", f"WITH {SETS} SELECT item_id, CASE WHEN len(gold) + len(found) > 0 THEN round(2.0::DOUBLE * len(list_intersect(gold, found)) / (len(gold) + len(found)), 4) END AS f1 FROM st")
def row_f1(spark, d):
    n = F.size("gold") + F.size("found")
    return sets(spark, d).select("item_id", F.round(M.safe(2.0 * F.size(F.array_intersect("gold", "found")), n), 4).alias("f1"))


@query("cohen_kappa", f"""WITH {BASE}, c AS (SELECT quality AS a, CASE WHEN guess THEN 1 ELSE 0 END AS b FROM b),
t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM c),
e AS (SELECT sum(x.n * y.n)::DOUBLE / (SELECT n * n FROM t) AS pe FROM (SELECT a AS l, count(*) AS n FROM c GROUP BY a) x JOIN (SELECT b AS l, count(*) AS n FROM c GROUP BY b) y USING (l))
SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM t CROSS JOIN e""")
def cohen_kappa(spark, d):
    return M.kappa(base(spark, d).withColumn("b", F.col("guess").cast("int")), "quality", "b")


@query("percentile_nearest_rank", "SELECT event_type, round(value, 1) AS value, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE k = ceil((n - 1) * 0.95::DOUBLE - 1e-6)")
def percentile_nearest_rank(spark, d):
    return M.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@query("group_pass_counts", f"WITH {BASE} SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (guess) AS labelled, count(*) FILTER (guess AND quality = 1) AS correct FROM b GROUP BY source")
def group_pass_counts(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    good, guess = F.col("quality") == 1, F.col("guess")
    return base(spark, d).groupBy("source").agg(F.count("*").alias("n"), n(good).alias("passed"), n(guess).alias("labelled"), n(guess & good).alias("correct"))


ERRORS = f"{BASE}, er AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL)) AS error FROM b)"


@query("error_taxonomy", f"WITH {ERRORS} SELECT error, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS examples FROM er GROUP BY error")
def error_taxonomy(spark, d):
    """Counts of errors and the five first examples (the limit is the feature), chosen by rank, not from a list of all."""
    kinds = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short")))
    rows = base(spark, d).select("doc_id", F.explode(kinds).alias("error"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("error").orderBy("doc_id"))).where("k <= 5").groupBy("error").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("examples"))
    return rows.groupBy("error").agg(F.count("*").alias("n")).join(first, "error").select("error", "n", "examples")


@query("paired_difference", f"""WITH {BASE}, a AS (SELECT doc_id, n_chars::DOUBLE AS m FROM b WHERE quality = 1), z AS (SELECT doc_id, CASE WHEN guess THEN NULL ELSE n_chars * 1.5::DOUBLE END AS m FROM b)
SELECT count(*) AS n, round(avg(z.m - a.m), 6) AS difference FROM a JOIN z USING (doc_id) WHERE z.m IS NOT NULL""")
def paired_difference(spark, d):
    rows = base(spark, d)
    a = rows.where("quality = 1").select("doc_id", F.col("n_chars").cast("double").alias("m"))
    z = rows.select("doc_id", F.when(~F.col("guess"), F.col("n_chars") * 1.5).alias("z"))
    return a.join(z, "doc_id").where(F.col("m").isNotNull() & F.col("z").isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(F.col("z") - F.col("m")), 6).alias("difference"))


@query("run_item_set_guard", "SELECT count(*) FILTER (l.doc_id IS NULL) AS only_documents, count(*) FILTER (d.doc_id IS NULL) AS only_labels, count(*) FILTER (l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS same FROM documents d FULL JOIN labels l USING (doc_id)")
def run_item_set_guard(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("b"))
    n = lambda c: F.count(F.when(c, 1))
    no_a, no_b = F.col("a").isNull(), F.col("b").isNull()
    return a.join(b, F.col("a") == F.col("b"), "full").agg(n(no_b).alias("only_documents"), n(no_a).alias("only_labels"), (n(no_a | no_b) == 0).alias("same"))


@query("common_items", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT vec_id FROM embeddings")
def common_items(spark, d):
    ids = table(spark, d, "documents").select("doc_id")
    return ids.intersect(table(spark, d, "labels").where("quality = 1").select("doc_id")).intersect(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("annotator_agreement", f"""WITH {BASE}, s(doc_id, ann, v) AS (SELECT doc_id, 'a', quality FROM b UNION ALL SELECT doc_id, 'b', toxic FROM b UNION ALL SELECT doc_id, 'c', CASE WHEN guess THEN 1 END FROM b)
SELECT x.ann AS first, y.ann AS second, count(*) AS n, round(avg(CASE WHEN x.v = y.v THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.ann < y.ann WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2""")
def annotator_agreement(spark, d):
    rows = base(spark, d)
    sheet = rows.select("doc_id", F.lit("a").alias("ann"), F.col("quality").alias("v")).union(rows.select("doc_id", F.lit("b"), "toxic")).union(rows.select("doc_id", F.lit("c"), F.when(F.col("guess"), 1))).where("v IS NOT NULL")
    other = sheet.select("doc_id", F.col("ann").alias("second"), F.col("v").alias("u"))
    return sheet.join(other, "doc_id").where("ann < second").groupBy(F.col("ann").alias("first"), "second").agg(F.count("*").alias("n"), F.round(F.avg((F.col("v") == F.col("u")).cast("double")), 6).alias("agreement"))


@query("metrics_by_turn", "SELECT turn, count(*) AS n, round(avg(length(text)), 6) AS mean_length FROM conversations WHERE role = 'assistant' GROUP BY turn")
def metrics_by_turn(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("turn").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query("unsafe_rate_union", "SELECT count(*) AS n, round(avg(unsafe), 6) AS rate FROM (SELECT toxic::DOUBLE AS unsafe FROM labels UNION ALL SELECT CASE WHEN contains(text, 'ouaux') THEN 1.0 ELSE 0.0 END FROM conversations)")
def unsafe_rate_union(spark, d):
    a = table(spark, d, "labels").select(F.col("toxic").cast("double").alias("unsafe"))
    b = table(spark, d, "conversations").select(F.when(F.contains("text", F.lit("ouaux")), 1.0).otherwise(0.0))
    return a.unionAll(b).agg(F.count("*").alias("n"), F.round(F.avg("unsafe"), 6).alias("rate"))


@query("reliability_report", "SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(median(value), 6) AS median_value, max(value) AS max_value FROM events GROUP BY user_id")
def reliability_report(spark, d):
    ok = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("success_rate"), F.round(F.median("value"), 6).alias("median_value"), F.max("value").alias("max_value"))


@query("information_completeness", "WITH s AS (SELECT conv_id, list_distinct(list(substr(md5(text), 1, 1)) FILTER (role = 'user')) AS missing, list_distinct(list(substr(md5(text), 1, 1)) FILTER (role = 'assistant')) AS asked FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN len(missing) > 0 THEN round(coalesce(len(list_intersect(missing, asked)), 0) / len(missing)::DOUBLE, 6) END AS completeness FROM s")
def information_completeness(spark, d):
    slot = F.substring(F.md5("text"), 1, 1)
    of = lambda role: F.collect_set(F.when(F.col("role") == role, slot))
    sets = table(spark, d, "conversations").groupBy("conv_id").agg(of("user").alias("missing"), of("assistant").alias("asked"))
    return sets.select("conv_id", F.round(M.safe(F.size(F.array_intersect("missing", "asked")), F.size("missing")), 6).alias("completeness"))


@query("citation_correctness", "SELECT item_id, CASE WHEN len(c) > 0 AND len(list_filter(c, lambda x: NOT list_contains(['1', '2', '3', '4'], x))) = 0 THEN 1 ELSE 0 END AS correct FROM (SELECT item_id, list_filter([substr(md5(text), 1, 1), substr(md5(text), 2, 1)], lambda x: x < '6') AS c FROM benchmark)")
def citation_correctness(spark, d):
    digest = F.md5("text")
    marks = F.filter(F.array(F.substring(digest, 1, 1), F.substring(digest, 2, 1)), lambda x: x < "6")
    fine = (F.size("c") > 0) & (F.size(F.array_except("c", F.array(*map(F.lit, "1234")))) == 0)
    return table(spark, d, "benchmark").select("item_id", marks.alias("c")).select("item_id", fine.cast("int").alias("correct"))


@query("slot_totals", "SELECT o_custkey, sum(len(string_split(o_orderpriority, '-')))::BIGINT AS slots, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS taken FROM orders GROUP BY o_custkey")
def slot_totals(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.size(F.split("o_orderpriority", "-"))).alias("slots"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("taken"))


@query("max_measure", "SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '([0-9]{3})-[0-9]{4}', 1), lambda x: x::INTEGER)) AS most FROM documents")
def max_measure(spark, d):
    found = F.regexp_extract_all("text", F.lit("([0-9]{3})-[0-9]{4}"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.array_max(F.transform(found, lambda x: x.cast("int"))).alias("most"))


@query("means_by_kind", f"WITH {BASE} SELECT lang, round(avg(quality), 2) AS quality, round(avg(toxic), 2) AS toxic, round(1 - avg(quality), 2) AS short_of FROM b GROUP BY lang")
def means_by_kind(spark, d):
    return base(spark, d).groupBy("lang").agg(F.round(F.avg("quality"), 2).alias("quality"), F.round(F.avg("toxic"), 2).alias("toxic"), F.round(1 - F.avg("quality"), 2).alias("short_of"))


def drawn_sql(resamples: int, seed: int, last: int) -> str:
    """From v(cluster, x): the mean, and its bounds from whole clusters drawn with replacement."""
    return f"""c AS (SELECT cluster, sum(x::DOUBLE) AS s, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY cluster),
p AS (SELECT s, n, row_number() OVER (ORDER BY md5(cluster::VARCHAR), cluster) - 1 AS place, count(*) OVER () AS k FROM c),
dr AS (SELECT r, ('0x' || substr(md5('{seed}:' || r || ':' || place), 1, 15))::BIGINT % k AS drawn FROM p CROSS JOIN range(1, {resamples + 1}) t(r)),
ms AS (SELECT list_sort(list(m)) AS ms FROM (SELECT r, sum(s) / sum(n) AS m FROM dr JOIN p ON p.place = dr.drawn GROUP BY r))
SELECT (SELECT round(sum(s) / sum(n), 9) FROM c) AS mean, round(ms[{int(0.025 * resamples) + 1}], 9) AS low, round(ms[{min(resamples - 1, int(0.975 * resamples) - last) + 1}], 9) AS high, (SELECT sum(n)::BIGINT FROM c) AS n, (SELECT count(*) FROM c) AS n_clusters FROM ms"""


@query("cluster_bootstrap_ci", f"WITH {BASE}, v AS (SELECT source AS cluster, toxic AS x FROM b), {drawn_sql(1000, 42, 0)}")
def cluster_bootstrap_ci(spark, d):
    return M.cluster_bootstrap(base(spark, d), "toxic", "source")


@query("paired_difference_ci", f"""WITH {BASE}, v AS (SELECT a.source AS cluster, z.m - a.m AS x FROM (SELECT doc_id, source, n_chars::DOUBLE AS m FROM b WHERE quality = 1) a JOIN (SELECT doc_id, CASE WHEN guess THEN NULL ELSE n_chars * 1.5::DOUBLE END AS m FROM b) z USING (doc_id)),
{drawn_sql(500, 0, 1)}""")
def paired_difference_ci(spark, d):
    """The difference of two runs on the items that both score, with bounds from whole sources drawn."""
    rows = base(spark, d)
    a = rows.where("quality = 1").select("doc_id", "source", F.col("n_chars").cast("double").alias("m"))
    z = rows.select("doc_id", F.when(~F.col("guess"), F.col("n_chars") * 1.5).alias("m"))
    return M.paired_ci(a, z, "doc_id", "m", "source", resamples=500)


@query("reviewer_metrics", f"""WITH {BASE}, r AS (SELECT CASE WHEN toxic = 1 THEN 'Emergency' WHEN quality = 1 THEN 'self_care' WHEN n_chars > 2000 THEN 'gp' ELSE '' END AS gold, CASE WHEN guess THEN 'emergency' ELSE 'self_care' END AS model, CASE WHEN n_chars % 3 = 0 THEN ' Yes' WHEN n_chars % 3 = 1 THEN 'no' ELSE 'n/a' END AS violation FROM b),
t AS (SELECT upper(gold) AS gold, upper(model) AS model FROM r WHERE upper(gold) IN ('EMERGENCY', 'SELF_CARE', 'GP')), s AS (SELECT lower(trim(violation)) AS v FROM r WHERE lower(trim(violation)) IN ('yes', 'no'))
SELECT (SELECT count(*) FROM t) AS n_triage, (SELECT round(avg(CASE WHEN gold = model THEN 1.0::DOUBLE ELSE 0 END), 6) FROM t) AS accuracy, (SELECT count(*) FROM t WHERE gold = 'EMERGENCY') AS n_emergencies,
  (SELECT round(avg(CASE WHEN model = 'EMERGENCY' THEN 1.0::DOUBLE ELSE 0 END), 6) FROM t WHERE gold = 'EMERGENCY') AS recall, (SELECT count(*) FROM s) AS n_safety, (SELECT round(avg(CASE WHEN v = 'yes' THEN 1.0::DOUBLE ELSE 0 END), 6) FROM s) AS violation_rate""")
def reviewer_metrics(spark, d):
    """What reviewers' filled-in labels say; blank and unknown labels count nowhere."""
    rows = base(spark, d)
    gold = F.when(F.col("toxic") == 1, "Emergency").when(F.col("quality") == 1, "self_care").when(F.col("n_chars") > 2000, "gp").otherwise("")
    violation = F.when(F.col("n_chars") % 3 == 0, " Yes").when(F.col("n_chars") % 3 == 1, "no").otherwise("n/a")
    return M.reviewed(rows.select(gold.alias("gold"), F.when(F.col("guess"), "emergency").otherwise("self_care").alias("model"), violation.alias("violation")), ["EMERGENCY", "SELF_CARE", "GP"])


@query("window_loss", "SELECT event_type, count(value) AS n_windows, round(avg(value), 6) AS mean_loss FROM events GROUP BY event_type")
def window_loss(spark, d):
    """The mean of the losses of a run's windows; a window without one counts nowhere."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n_windows"), F.round(F.avg("value"), 6).alias("mean_loss"))


@query("ordered_cases", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM labels WHERE quality = 1), z AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM labels WHERE toxic = 0)
SELECT count(a.k) AS n_first, count(z.k) AS n_second, min(coalesce(a.k, z.k)) FILTER (a.doc_id IS DISTINCT FROM z.doc_id) AS first_difference, count(*) FILTER (a.doc_id IS DISTINCT FROM z.doc_id) = 0 AS same FROM a FULL JOIN z USING (k)""")
def ordered_cases(spark, d):
    """Whether two runs have the same cases in the same order, and the first place where they don't."""
    rows = table(spark, d, "labels")
    return M.same_order(rows.where("quality = 1").select("doc_id"), rows.where("toxic = 0").select("doc_id"), "doc_id")


@query("log_progress", """WITH e AS (SELECT user_id, row_number() OVER w AS step, epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed, sum(length(event_type)) OVER w AS tokens, count(*) OVER (PARTITION BY user_id) AS steps FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, step, round(CASE WHEN elapsed > 0 THEN tokens / elapsed ELSE 0 END, 6) AS tokens_per_second, round(CASE WHEN elapsed > 0 THEN step * 8 / elapsed ELSE 0 END, 6) AS samples_per_second, CASE WHEN step >= 5 THEN round(elapsed * steps / step, 3) END AS estimated_seconds FROM e""")
def log_progress(spark, d):
    """Throughput and estimated time of each step of a log (a user's events stand for a run's)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("user_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    rows = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), (seconds - F.min(seconds).over(every)).alias("elapsed"), F.sum(F.length("event_type")).over(w).alias("tokens"), F.count("*").over(every).alias("max_steps"))
    return M.progress(rows, batch=8, least_steps=5).select("user_id", "step", "tokens_per_second", "samples_per_second", "estimated_seconds")


@query("unsupported_rate", """WITH a AS (SELECT doc_id, source, list_transform(regexp_extract_all(text || ' [S' || (doc_id % 4) || '] and [s' || (doc_id % 7) || '].', '\\[([Ss][0-9]+)\\]', 1), lambda v: upper(v)) AS marks FROM documents)
SELECT source, count(*) AS n, round(avg(CASE WHEN len(list_filter(marks, lambda v: NOT list_contains(['S1', 'S2', 'S3'], v))) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS unsupported_rate FROM a GROUP BY source""")
def unsupported_rate(spark, d):
    """The share of answers with a mark that none of their sources has."""
    x = F.concat("text", F.lit(" [S"), (F.col("doc_id") % 4).cast("string"), F.lit("] and [s"), (F.col("doc_id") % 7).cast("string"), F.lit("]."))
    unknown = F.size(F.array_except(T.cited(x), F.array(*map(F.lit, ("S1", "S2", "S3"))))) > 0
    return table(spark, d, "documents").select("source", unknown.alias("bad")).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("bad").cast("double")), 6).alias("unsupported_rate"))


@query("number_cells", "SELECT user_id, CASE WHEN avg(value) FILTER (event_type = 'error') IS NULL THEN '—' ELSE printf('%.3f', round(avg(value) FILTER (event_type = 'error'), 3)) END AS cell FROM events GROUP BY user_id")
def number_cells(spark, d):
    """Numbers as table cells: three digits, a dash where there is none."""
    # a cell at a half hangs on the last bit of the sum, so values are added by event_id, whatever the partitions are (spilled, not collected);
    # the mean of the last row has all of them, also where identifiers are null or repeat; and the SQL rounds the product, where F.round(mean, 3)
    # would round the decimals, and keeps the sign of what rounds to nothing
    w = Window.partitionBy("user_id").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = table(spark, d, "events").select("user_id", F.count("*").over(w).alias("n"), F.avg(F.when(F.col("event_type") == "error", F.col("value"))).over(w).alias("mean"))
    x = F.col("x")
    rows = running.groupBy("user_id").agg((F.max_by("mean", "n") * 1000).alias("x")).select("user_id", (F.when(x < 0, -F.round(-x)).otherwise(F.round(x)) / 1000).alias("v"))
    return rows.select("user_id", F.when(F.col("v").isNull(), "—").otherwise(F.format_string("%.3f", "v")).alias("cell"))


@query("last_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def last_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))
