"""Queries that shape rows for training."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation as C
from tidemill.operators import shaping as S
from tidemill.plans.registry import query
from tidemill.sources.tables import table

WEIGHTS = {"en": 3.0, "fr": 1.0, "de": 2.0, "es": 0.5}
W_SQL = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())


@query("weighted_source_mix", f"""WITH w(lang, weight) AS (VALUES {W_SQL}), n AS (SELECT lang, weight, count(*) AS size FROM documents JOIN w USING (lang) GROUP BY ALL),
q AS (SELECT lang, size, greatest(1, round_even((SELECT min(size / weight) FROM n) * weight, 0))::BIGINT AS quota FROM n),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS i FROM documents)
SELECT doc_id, lang, quota // size + CASE WHEN i < quota % size THEN 1 ELSE 0 END AS copies FROM r JOIN q USING (lang) WHERE quota // size + CASE WHEN i < quota % size THEN 1 ELSE 0 END > 0""")
def weighted_source_mix(spark, d):
    return S.weighted_mix(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", WEIGHTS, "42")


@query("stratified_sample", "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM labels) WHERE k <= 20")
def stratified_sample(spark, d):
    return S.stratified(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 20, "7")


@query("one_per_source", "SELECT source, arg_min(doc_id, (sha256('9:' || doc_id), doc_id)) AS doc_id FROM documents GROUP BY source")
def one_per_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(S.hash_order("9", F.col("doc_id")), "doc_id")).alias("doc_id"))


@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id)::INTEGER AS place FROM documents")
def seeded_shuffle(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", S.hash_order("3", F.col("doc_id")).alias("h"))
    return S.hash_places(rows, ["lang"], "h", "doc_id").select("doc_id", F.col("place").cast("int").alias("place"))


LANGS = ("fr", "en", "de")


@query("distinct_until", f"""
WITH r AS (SELECT doc_id, lang, sha256(text) AS key, sha256('5:' || doc_id) AS h, list_position([{", ".join(f"'{x}'" for x in LANGS)}], lang) AS k FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k, h, doc_id) AS j FROM r WHERE k IS NOT NULL AND k > 0) WHERE j = 1)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS i FROM f) WHERE i <= 25""")
def distinct_until(spark, d):
    """Twenty-five documents of each language, in turn and shuffled, none with a text that was taken before (the limit is the feature)."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"), S.hash_order("5", F.col("doc_id")).alias("h"))
    return S.distinct_until(rows, "lang", list(LANGS), "key", "h", "doc_id", 25).select("doc_id", "lang")


@query("pad_to_multiple", "SELECT item_id, list_concat(ids, list_transform(range(0, (8 - len(ids) % 8) % 8), lambda x: 0)) AS ids FROM (SELECT item_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM benchmark)")
def pad_to_multiple(spark, d):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    return table(spark, d, "benchmark").select("item_id", ids.alias("ids")).select("item_id", S.padded(F.col("ids"), 8, 0).alias("ids"))


@query("length_batches", "SELECT item_id, ntile(5) OVER (ORDER BY length(text), item_id)::INTEGER AS batch FROM benchmark")
def length_batches(spark, d):
    """Batches of the benchmark texts by length; ntile needs them in one order, and the benchmark is the bounded table."""
    return table(spark, d, "benchmark").select("item_id", F.ntile(5).over(Window.orderBy(F.length("text"), "item_id")).alias("batch"))


def messages(spark, d):
    return C.conversations(table(spark, d, "conversations"))


@query("trim_history", """
WITH RECURSIVE m AS (SELECT conv_id, turn, greatest(1, (length(text) + 2) // 3) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), max(turn) OVER (PARTITION BY conv_id)) AS active FROM conversations),
o AS (SELECT conv_id, i, cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM m WHERE turn < active),
g(conv_id, k, left_over, keep) AS (SELECT conv_id, 0::BIGINT, 300::BIGINT, list(i ORDER BY i) FROM m WHERE turn >= active GROUP BY conv_id
 UNION ALL SELECT g.conv_id, o.k, CASE WHEN o.cost <= g.left_over THEN g.left_over - o.cost ELSE g.left_over END, CASE WHEN o.cost <= g.left_over THEN list_prepend(o.i, g.keep) ELSE g.keep END FROM g JOIN o ON o.conv_id = g.conv_id AND o.k = g.k + 1)
SELECT conv_id, array_to_string(arg_max(keep, k), ',') AS keep FROM g GROUP BY conv_id""")
def trim_history(spark, d):
    m = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), T.token_estimate(x["content"]).alias("cost")))
    return messages(spark, d).select("conv_id", m.alias("m")).select("conv_id", F.array_join(S.trimmed("m", 300).cast("array<string>"), ",").alias("keep"))


@query("assistant_mask", "SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')))::INTEGER AS n_ids, coalesce(sum(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''))) FILTER (role = 'assistant'), 0)::INTEGER AS n_own FROM conversations GROUP BY conv_id")
def assistant_mask(spark, d):
    ids, labels = S.assistant_mask("messages")
    rows = messages(spark, d).select("conv_id", ids.alias("ids"), labels.alias("labels"))
    return rows.select("conv_id", F.size("ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x != S.IGNORED)).alias("n_own"))


@query("chat_windows")
def chat_windows(spark, d):
    return S.chat_windows(table(spark, d, "conversations"), most=400, overlap=1)


@query("window_examples")
def window_examples(spark, d):
    """Training examples: a conversation or its windows, with how many ids each has and how many an assistant says; or the reason why it has none."""
    rows = pack_examples(table(spark, d, "conversations"))
    return rows.select("conv_id", "window", F.size("ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x != S.IGNORED)).alias("n_own"), "reason")


PACK = 1024


def pack_examples(turns):
    """conv_id, window, ids, labels, reason: a conversation that fits a pack as it is, the windows of a longer one, or why it has none.

    A full pack needs no end; what is shorter by one word has room for it.
    """
    ids, labels = S.assistant_mask("messages")
    turns = turns.withColumn("text", F.coalesce("text", F.lit("")))
    rows = C.conversations(turns).select("conv_id", "messages", F.size(ids).alias("n"))
    long = rows.where(F.col("n") > PACK).select(F.col("conv_id").alias("_of"), "messages")
    own = turns.join(long, F.col("conv_id").eqNullSafe(F.col("_of")), "left_semi")
    windows = S.chat_windows(own, most=PACK, overlap=1, count=S.mask_words)
    cut = windows.join(long, F.col("conv_id").eqNullSafe(F.col("_of"))).select("conv_id", "window", F.when(F.col("reason").isNull(), S.window_messages("messages", "first", "last")).alias("messages"), "reason")
    whole = rows.where(F.col("n") <= PACK).select("conv_id", F.lit(0).alias("window"), "messages", F.lit(None).cast("string").alias("reason"))
    return whole.union(cut).select("conv_id", "window", ids.alias("ids"), labels.alias("labels"), "reason")


@query("pack_sequences")
def pack_sequences(spark, d):
    """Conversations, the longer ones as windows, joined to packs of 1024. A conversation that no window holds is a row with its reason and no pack."""
    rows = pack_examples(table(spark, d, "conversations"))
    packs = S.packed(rows.where(F.col("reason").isNull()), ["conv_id", "window"], PACK, 0, 4).select("part", "pack", F.size("input_ids").alias("n_ids"), F.md5(F.array_join(F.col("labels").cast("array<string>"), ",")).alias("labels_hash"))
    none = F.lit(None)
    left = rows.where(F.col("reason").isNotNull()).select(none.cast("int").alias("part"), none.cast("int").alias("pack"), none.cast("int").alias("n_ids"), none.cast("string").alias("labels_hash"), "conv_id", "reason")
    return packs.withColumn("conv_id", none.cast("long")).withColumn("reason", none.cast("string")).union(left)
