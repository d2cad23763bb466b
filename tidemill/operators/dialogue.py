"""Rule-based analytics over texts and conversations. Rules are small tables; the rules here are examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A clause ends here; a negator within a clause, at most four words before a phrase, denies it.
CLAUSE = r"\b(?:and|but|however|now)\b|[,.;!?\n]"
NEGATED = r"\b(?:no|not|without|denies|never)\b(?: +[^ ]+){0,4} *$"


def affirmed(text: Column, phrase: Column | str, clause: str = CLAUSE, negated: str = NEGATED) -> Column:
    """How often a phrase (whole words) occurs in the text without being denied. text: a column, not an expression."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    parts = F.split(text, F.concat(F.lit(r"\b"), phrase, F.lit(r"\b")))
    # what stands before a match, from its clause's beginning; an earlier match of the same phrase begins it too
    clauses = F.transform(parts, lambda p: F.element_at(F.split(p, clause), -1))
    return F.size(F.filter(clauses, lambda p, i: (i < F.size(parts) - 1) & ~p.rlike(negated)))


def occurrences(text: Column, phrase: Column | str) -> Column:
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.size(F.split(text, F.concat(F.lit(r"\b"), phrase, F.lit(r"\b")))) - 1


def tagged(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """texts with each rule (label, phrase) that one affirms: a cheap test for the phrase's letters comes before the exact one.

    rules are a small table that every task gets.
    """
    near = texts.join(F.broadcast(rules), F.contains(F.col(text), F.col("phrase")))
    return near.where(affirmed(F.col(text), F.col("phrase")) > 0)


def entropy(weights: str) -> Column:
    """Of an array of weights, to base 2; 0 without mass."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    part = F.aggregate(weights, F.lit(0.0), lambda s, x: s + F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0))
    return F.when(total > 0, part).otherwise(0.0)


def candidates(features: DataFrame, supports: DataFrame, excludes: DataFrame) -> DataFrame:
    """id, condition, score, matched: conditions (condition, token, weight) by what features (id, token) support, without excluded ones."""
    scored = features.join(F.broadcast(supports), "token").groupBy("id", "condition").agg(F.sum("weight").alias("score"), F.count("*").alias("matched"))
    out = features.join(F.broadcast(excludes), "token").select("id", "condition").distinct()
    return scored.join(out, ["id", "condition"], "left_anti")


def hypotheses(features: DataFrame, supports: DataFrame, excludes: DataFrame, least_score: float = 2.0, least_matched: int = 2, k: int = 3) -> DataFrame:
    """The k best conditions of each id with enough support; ties by name."""
    fit = candidates(features, supports, excludes).where((F.col("score") >= least_score) & (F.col("matched") >= least_matched))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "condition")
    return fit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def binary_gain(features: DataFrame, supports: DataFrame, yes: float = 0.9, no: float = 0.1) -> DataFrame:
    """id, token, gain: the expected fall of entropy over conditions (prior 1 + score) from asking about a token that isn't known.

    Every id meets every condition once: conditions are a bounded table of knowledge.
    """
    names = supports.select("condition").distinct()
    ids = features.select("id").distinct()
    scored = features.join(F.broadcast(supports), "token").groupBy("id", "condition").agg(F.sum("weight").alias("score"))
    grid = ids.join(F.broadcast(names.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).drop("one").join(scored, ["id", "condition"], "left").select("id", "condition", (1.0 + F.coalesce("score", F.lit(0.0))).alias("prior"))
    tokens = supports.groupBy("token").agg(F.collect_set("condition").alias("having"))
    rows = grid.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("condition", "prior"))).alias("c"))
    known = features.groupBy("id").agg(F.collect_set("token").alias("known"))
    asked = rows.join(known, "id").join(F.broadcast(tokens)).where(~F.array_contains("known", F.col("token")))
    share = lambda up, down: F.transform("c", lambda c: c["prior"] * F.when(F.array_contains("having", c["condition"]), up).otherwise(down))
    parts = asked.select("id", "token", F.transform("c", lambda c: c["prior"]).alias("all"), share(yes, no).alias("yes"), share(1 - yes, 1 - no).alias("no"))
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    gain = entropy("all") - mass("yes") / mass("all") * entropy("yes") - mass("no") / mass("all") * entropy("no")
    return parts.select("id", "token", F.round(F.greatest(F.lit(0.0), gain), 6).alias("gain"))


def slot_scores(features: DataFrame, supports: DataFrame, slots: DataFrame, base: DataFrame, weight: float) -> DataFrame:
    """id, slot, place, gain, score: what asking about each slot is worth.

    features (id, token), supports (condition, token, weight), slots (slot, token), base (slot, base, place). An answer is a token of the slot that
    isn't known, or none of them. A condition gives its probability to its own answers in equal parts, or, without one, to all. gain is
    the expected fall of entropy over conditions as a share of the entropy; score = base + weight * gain. The knowledge is bounded.
    """
    ids = features.select("id").distinct()
    scored = features.join(F.broadcast(supports), "token").groupBy("id", "condition").agg(F.sum("weight").alias("w"))
    grid = ids.join(F.broadcast(supports.select("condition").distinct())).join(scored, ["id", "condition"], "left").select("id", "condition", (1.0 + F.coalesce("w", F.lit(0.0))).alias("prior"))
    priors = grid.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("condition", "prior"))).alias("c")).withColumn("all", F.transform("c", lambda x: x["prior"]))
    priors = priors.withColumn("before", entropy("all")).withColumn("total", F.aggregate("all", F.lit(0.0), lambda s, x: s + x))
    known = features.groupBy("id").agg(F.collect_set("token").alias("known"))
    tokens = slots.groupBy("slot").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    having = supports.groupBy("condition").agg(F.collect_set("token").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("condition", "t"))).alias("having"))
    asked = priors.join(known, "id").join(F.broadcast(tokens)).join(F.broadcast(having)).withColumn("answers", F.array_except("tokens", "known")).where(F.size("answers") > 0)
    asked = asked.withColumn("answer", F.explode(F.concat("answers", F.array(F.lit(None).cast("string")))))
    asked = asked.withColumn("n", F.size("answers") + 1)

    def joint(x: Column) -> Column:
        own = F.array_intersect(F.col("answers"), F.element_at(F.col("having"), x["condition"]))
        part = F.when(F.size(own) > 0, F.when(F.coalesce(F.array_contains(own, F.col("answer")), F.lit(False)), 1.0 / F.size(own)).otherwise(0.0)).otherwise(1.0 / F.col("n"))
        return x["prior"] * part

    rows = asked.withColumn("joint", F.transform("c", joint)).withColumn("p", F.aggregate("joint", F.lit(0.0), lambda s, x: s + x) / F.col("total"))
    after = rows.groupBy("id", "slot").agg(F.sum(F.col("p") * entropy("joint")).alias("after"), F.first("before").alias("before"))
    gains = after.select("id", "slot", F.when(F.col("before") > 0, F.greatest(F.lit(0.0), F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return ids.join(F.broadcast(base)).join(gains, ["id", "slot"], "left").select("id", "slot", "place", F.round(gain, 6).alias("gain"), F.round(F.col("base") + weight * gain, 6).alias("score"))


def schema_problems(reply: str, texts: list[str], enums: dict[str, list[str]], lists: list[str]) -> Column:
    """An array of the fields of a JSON reply that aren't what they must be: a text, one of some values, a list of texts. A reply that isn't JSON has all."""
    kinds = ", ".join([*[f"`{k}` variant" for k in [*texts, *lists]], *[f"`{k}` string" for k in enums]])
    body = F.from_json(F.col(reply), kinds)
    kind = lambda k: F.schema_of_variant(body.getField(k))
    bad = {k: ~(kind(k) == "STRING") for k in texts} | {k: ~body.getField(k).isin(v) for k, v in enums.items()} | {k: ~kind(k).startswith("ARRAY") for k in lists}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in bad.items()]))


def passes(checks: list[str]) -> Column:
    """Whether no check that applies (isn't null) fails."""
    return F.forall(F.array(*checks), lambda x: F.coalesce(x, F.lit(True)))
