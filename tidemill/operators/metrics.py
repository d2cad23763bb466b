"""Evaluation metrics as aggregations; null is not scorable and counts nowhere."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.dedup import shared
from tidemill.operators.shaping import hash_places


def safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, recall and false_positive_rate (null where nothing is there to count)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy(*(by or [])).agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"), n(~truth & ~predicted).alias("tn"))
    return out.withColumn("recall", F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6)).withColumn("false_positive_rate", F.round(safe(F.col("fp"), F.col("fp") + F.col("tn")), 6))


def set_scores(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """Micro precision, recall and F1 of two array columns, rounded to 4 digits; 0 where nothing is there."""
    tp, fp, fn = (F.sum(F.size(x)) for x in (F.array_intersect(gold, found), F.array_except(found, gold), F.array_except(gold, found)))
    sums = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = (F.coalesce(safe(F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    f1 = F.coalesce(safe(2 * p * r, p + r), F.lit(0.0))
    return sums.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns over rows that have both; 1 where chance agreement is complete, null without rows."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    left = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("total"), F.coalesce("both", F.lit(0)) / (F.col("total") * F.col("total"))
    return total.join(chance).select(F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def nearest_rank(rows: DataFrame, by: str, value: str, p: float, steps: int = 1024) -> DataFrame:
    """The value at the ceiling of (n - 1) p, from 0, of each group.

    Values are counted in steps between the least and the greatest; only those of the step that holds the rank are ordered.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    ends = own.groupBy("_by").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("n")).withColumnRenamed("_by", "_of")
    step = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * steps)).otherwise(F.lit(0)).cast("int")
    stepped = own.join(ends, F.col("_by").eqNullSafe(F.col("_of"))).select("_by", "_v", "n", step.alias("_step"))
    counts = stepped.groupBy("_by", "n", "_step").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_by").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.ceil((F.col("n") - 1) * p - 1e-6)
    held = counts.withColumn("_before", before).where((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c"))).select(F.col("_by").alias("_of"), F.col("_step").alias("_in"), (rank - F.col("_before")).alias("_rank"))
    near = stepped.join(held, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_step") == F.col("_in")))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("_by").orderBy("_v")) - 1)
    return ranked.where(F.col("_k") == F.col("_rank")).select(F.col("_by").alias(by), F.round("_v", 1).alias("value"), "n")


def drawn_means(rows: DataFrame, value: str, cluster: str, resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The clusters' sums and counts, and the mean of each resample: as many whole clusters as there are, drawn with replacement.

    A draw is a number from MD5 of seed, resample and draw, so that reruns agree. Clusters are sums before any draw; the draws of
    all resamples are counted and meet the clusters in one join.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    placed = hash_places(sums.withColumn("_h", F.md5(F.coalesce(F.col("cluster").cast("string"), F.lit("")))), [], "_h", "cluster", "place").withColumn("place", F.col("place") - 1)
    total = sums.agg(F.count("*").alias("k"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("place").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = placed.select("place").join(F.broadcast(total)).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).select("r", (number % F.col("k")).alias("drawn")).groupBy("r", "drawn").agg(F.count("*").alias("times"))
    means = draws.join(placed, F.col("drawn") == F.col("place")).groupBy("r").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    return sums, means


def cluster_bootstrap(rows: DataFrame, value: str, cluster: str, resamples: int = 1000, seed: int = 42, last: int = 0) -> DataFrame:
    """mean, low, high, n, n_clusters: the bounds are order statistics of the resamples' means at 2.5 and 97.5 %, the upper one less `last`. No rows: nulls."""
    sums, means = drawn_means(rows, value, cluster, resamples, seed)
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("ms"))  # as many as resamples
    at = lambda k: F.round(F.get("ms", F.lit(k)), 9)
    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples) - last)
    return sums.agg(F.round(F.sum("s") / F.sum("n"), 9).alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_clusters")).join(ordered).select("mean", at(low).alias("low"), at(high).alias("high"), "n", "n_clusters")


def paired_ci(base: DataFrame, other: DataFrame, item: str, metric: str, cluster: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """mean (other minus base), low, high, n, n_clusters over items that both runs score, with whole clusters of the base drawn."""
    pairs = base.select(F.col(item).alias("item"), F.col(cluster).alias("cluster"), F.col(metric).cast("double").alias("a")).join(other.select(F.col(item).alias("item"), F.col(metric).cast("double").alias("b")), "item")
    return cluster_bootstrap(pairs.select("cluster", (F.col("b") - F.col("a")).alias("d")), "d", "cluster", resamples, seed, last=1)


def reviewed(rows: DataFrame, classes: list[str], urgent: str = "EMERGENCY") -> DataFrame:
    """Metrics over the labels (gold, model, violation) that reviewers filled in: accuracy, recall of urgent cases, rate of violations. Other labels count nowhere."""
    gold, model, said = F.upper("gold"), F.upper("model"), F.lower(F.trim("violation"))
    rated, hot, safety = F.coalesce(gold.isin(classes), F.lit(False)), F.coalesce(gold == urgent, F.lit(False)), F.coalesce(said.isin("yes", "no"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    share = lambda c, among: F.round(F.avg(F.when(among, F.coalesce(c, F.lit(False)).cast("double"))), 6)
    return rows.agg(n(rated).alias("n_triage"), share(gold == model, rated).alias("accuracy"), n(hot).alias("n_emergencies"), share(model == urgent, hot).alias("recall"), n(safety).alias("n_safety"), share(said == "yes", safety).alias("violation_rate"))


def progress(rows: DataFrame, batch: int, least_steps: int) -> DataFrame:
    """Rows of a log (step, elapsed seconds, tokens so far, max_steps) with throughput, and from `least_steps` on the estimated time of all steps."""
    per = lambda x: F.round(F.when(F.col("elapsed") > 0, x / F.col("elapsed")).otherwise(0.0), 6)
    left = F.when(F.col("step") >= least_steps, F.round(F.col("elapsed") * F.col("max_steps") / F.col("step"), 3))
    return rows.withColumn("tokens_per_second", per(F.col("tokens"))).withColumn("samples_per_second", per(F.col("step") * batch)).withColumn("estimated_seconds", left)


def in_places(rows: DataFrame, key: str) -> DataFrame:
    """rows with their place (k, from 1) by key: counts of sorted ranges, and places within a range."""
    ranged = rows.repartitionByRange(key).select(key, F.spark_partition_id().alias("_p")).transform(_settled)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = counts.select(F.col("_p").alias("_of"), before.alias("_offset"))
    return ranged.join(F.broadcast(offsets), F.col("_p") == F.col("_of")).select(key, (F.col("_offset") + F.row_number().over(Window.partitionBy("_p").orderBy(key))).alias("k"))


def _settled(df: DataFrame) -> DataFrame:
    """Written and read again: the ranges come from samples, and both uses must see the same."""
    path = f"{shared(df.sparkSession)}/places-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_order(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """n_first, n_second, first_difference, same: two runs' cases, each ordered by key."""
    a, b = (in_places(x.select(F.col(key).alias("id")), "id").select(F.col("k").alias(f"k{i}"), F.col("id").alias(f"id{i}")) for i, x in enumerate((first, second)))
    both = a.join(b, F.col("k0") == F.col("k1"), "full")
    differ = ~F.col("id0").eqNullSafe(F.col("id1"))
    return both.agg(F.count("k0").alias("n_first"), F.count("k1").alias("n_second"), F.min(F.when(differ, F.coalesce("k0", "k1"))).alias("first_difference"), (F.count(F.when(differ, 1)) == 0).alias("same"))
