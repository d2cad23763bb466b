"""Mixing sources to target weights.

Every row gets a hash-random key. Within its source, rows are ordered by that key
over ranges of it (blocks), block totals give each block's offset, and a sum
within the block gives each row's place in words. A source is cut at its
budget: whole epochs first, then the rows whose midpoint lies before the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, pieces_for, work_dir, written

#: A source takes no more than this many epochs of its own words.
MOST_EPOCHS = 3
#: Weights of the sources in the order of their code points (null last), repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: MB of input for each block of every source, and the least number of blocks.
BLOCK_MB, LEAST_BLOCKS = 1, 256
#: Up to so many sources the targets are computed by the driver and broadcast; beyond, by Spark.
MOST_SOURCES = 50_000


def word_count(text: str) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Each source's target: shares of all words by weight, held at `most` times the source's words, the excess reshared.

    A level is raised until all words are given out: a source takes level * weight or its
    limit. An empty source takes nothing.
    """
    order = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    weighed = sorted(((most * n, weights[i % len(weights)], s) for i, (s, n) in enumerate(order)), key=lambda x: x[0] / x[1])
    out: dict[str | None, float] = {}
    left, rest = sum(n for _, n in order), sum(w for _, w, _ in weighed)
    for k, (limit, w, s) in enumerate(weighed):
        if limit * rest > left * w:  # from here on the level is below every limit
            out |= {s: left * w / rest for _, w, s in weighed[k:]}
            break
        out[s] = float(limit)
        left, rest = left - limit, rest - w
    return out


def _in_order(rows: DataFrame, order: list[Column], sums: list[str], place: str) -> DataFrame:
    """rows with their place (from 0) in an order without ties, and before_x, the sum of each x in `sums` over the rows before: ranges of the order, their sums, and sums within a range."""
    spark = rows.sparkSession
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), work_dir(spark, "mix-order"))
    every = [F.lit(1).cast("decimal(38,0)").alias("_1"), *[F.col(x).cast("decimal(38,0)").alias(f"_{x}") for x in sums]]
    names = ["_1", *[f"_{x}" for x in sums]]
    ranged = ranged.select("*", *every)
    parts = ranged.groupBy("_range").agg(*[F.sum(x).cast("decimal(38,0)").alias(f"{x}_n") for x in names])  # a row for each range
    zero = F.lit(0).cast("decimal(38,0)")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"{x}_n").over(upto), zero).alias(f"{x}_before") for x in names])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upon = {x: (F.col(f"{x}_before") + F.coalesce(F.sum(x).over(within), zero)).cast("decimal(38,0)") for x in names}
    return ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_of")).select(*rows.columns, upon["_1"].cast("long").alias(place), *[upon[f"_{x}"].alias(f"before_{x}") for x in sums])


def targets_of_many(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """_of, source_size, target: targets() of sources (_source, n) that are too many for the driver.

    Sources are numbered in their order, then ordered by limit per weight with sums of limits and weights; the first one whose limit
    the level stays below gives the level.
    """
    big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    numbered = _in_order(totals.select("_source", "n"), [F.col("_source").isNull(), F.col("_source")], [], "_number")
    rows = numbered.select("_source", "n", (most * F.col("n")).alias("lim"), F.element_at(F.array(*map(F.lit, weights)), (F.col("_number") % len(weights) + 1).cast("int")).alias("w"))
    filled = _in_order(rows.withColumn("each", F.col("lim") / F.col("w")), [F.col("each"), F.col("_source").isNull(), F.col("_source")], ["lim", "w"], "k")
    filled = written(filled, work_dir(totals.sparkSession, "mix-levels"))
    whole = filled.agg(F.sum(big("n")).alias("words"), F.sum(big("w")).alias("parts")).first()
    left, rest = F.lit(whole["words"]) - F.col("before_lim"), F.lit(whole["parts"]) - F.col("before_w")
    level = filled.where(F.col("lim").cast("double") * rest.cast("double") > left.cast("double") * F.col("w")).agg(F.min(F.struct("k", left.cast("double").alias("left"), rest.cast("double").alias("rest"))).alias("x")).first()["x"]
    target = F.col("lim").cast("double")
    if level is not None:
        target = F.when(F.col("k") < level["k"], target).otherwise(F.lit(level["left"]) * F.col("w") / F.lit(level["rest"]))
    return filled.select(F.col("_source").alias("_of"), F.col("n").alias("source_size"), target.alias("target"))


def mixed(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix takes the row) and taken (= copies * size) for each row.

    `keep` names columns of docs that come along in a struct, `row`. A null
    text has size 0; rows of size 0 are taken in every epoch of their source and, at a place before the cut, in
    the last one too. Null is a source of its own. Equal keys are ordered by identifier and
    size; equal rows are interchangeable. Rows of an empty table: none. Reruns agree, as keys come from seed and identifier.
    A hot source is dealt over its blocks; no task orders a whole source.
    """
    spark = docs.sparkSession
    n_blocks = pieces_for(docs, BLOCK_MB, LEAST_BLOCKS)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), docs[id_col].cast("string"), F.md5(docs[text_col]))), 1, 15), 16, 10).cast("long")
    along = [F.struct(*[docs[c] for c in keep]).alias("row")] if keep else []
    rows = docs.select(docs[id_col].alias("doc_id"), word_count(text_col).alias("size"), docs[source_col].alias("_source"), key.alias("_key"), *along).withColumn("_block", F.floor(F.col("_key") / F.lit(float(1 << 60)) * n_blocks).cast("int"))
    if not keep:
        rows = written(rows, work_dir(spark, "mix-rows"))
    sums = rows.groupBy("_source", "_block").agg(F.sum("size").alias("_n")).persist()
    try:
        totals = sums.groupBy("_source").agg(F.sum("_n").alias("n"))
        found = totals.limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            plan = targets_of_many(totals, weights, most)
        else:
            goal = targets([(r["_source"], r["n"]) for r in found], weights, most)
            plan = F.broadcast(spark.createDataFrame([(r["_source"], r["n"], goal[r["_source"]]) for r in found], "_of string, source_size long, target double"))
        before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        blocks = sums.withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_n").join(plan, F.col("_source").eqNullSafe(F.col("_of"))).select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_offset", "source_size", "target")
        blocks = written(blocks, work_dir(spark, "mix-blocks"))
    finally:
        sums.unpersist()
    # one row for each block and source joins its rows; then only rows of one block are ordered together
    placed = rows.join(blocks, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    inner = Window.partitionBy("_source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("_start", start).withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    copies = (F.col("_epochs") + F.when(2 * F.col("_start") + F.col("size") <= 2 * F.col("_rest"), 1).otherwise(0)).cast("long")
    copies = F.least(copies, F.lit(most).cast("long"))
    return placed.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if keep else []))


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}' || coalesce(':' || doc_id, '') || coalesce(':' || md5(text), '')), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS n FROM rows GROUP BY source),
ranked AS (
  SELECT source, n, {MOST_EPOCHS} * n AS lim, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS w FROM totals),
filled AS (
  SELECT *, sum(n) OVER () - coalesce(sum(lim) OVER before, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest,
         row_number() OVER (ORDER BY lim / w::DOUBLE, source NULLS LAST) AS k
  FROM ranked WINDOW before AS (ORDER BY lim / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min(k) AS k FROM filled WHERE lim * rest > remaining * w),
goals AS (
  SELECT f.source, f.n AS source_size,
         CASE WHEN f.k < coalesce(l.k, f.k + 1) THEN f.lim::DOUBLE ELSE (c.remaining * f.w)::DOUBLE / c.rest::DOUBLE END AS target
  FROM filled f CROSS JOIN level l LEFT JOIN filled c ON c.k = l.k),
placed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT *, least({MOST_EPOCHS}, epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)
"""
