"""Shaping rows for training: windows, packs, masks, mixes, samples."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_places(rows: DataFrame, by: list[str], hashed: str, tie: str, into: str = "place") -> DataFrame:
    """rows with their place (from 1) in their group by a hexadecimal hash: offsets of its ranges, and places within a range, so that a large group isn't one task."""
    ranged = rows.withColumn("_range", F.substring(hashed, 1, 3))
    sums = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))  # 4096 rows for each group at most
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), before.alias("_offset"))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    place = F.col("_offset") + F.row_number().over(Window.partitionBy(*by, "_range").orderBy(hashed, tie))
    return ranged.join(offsets, same).withColumn(into, place).select(*rows.columns, into)


def distinct_until(rows: DataFrame, by: str, order: list[str], key: str, hashed: str, tie: str, n: int) -> DataFrame:
    """The first n rows of each group, in the order of a hash, whose key no row of an earlier group (in the given order) or earlier row has."""
    rank = F.coalesce(*[F.when(F.col(by) == v, F.lit(i)) for i, v in enumerate(order)])
    own = rows.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    rest = [c for c in rows.columns if c != key]
    first = own.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_rank", hashed, tie)).alias("_x")).select(*[F.col(c) if c == key else F.col("_x").getField(c).alias(c) for c in rows.columns])
    w = Window.partitionBy(by).orderBy(hashed, tie)
    return first.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum in the order of a seeded hash; the window keeps n on the map side."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def weighted_mix(rows: DataFrame, source: str, key: str, weights: dict[str, float], seed: str) -> DataFrame:
    """rows with `copies`: each source in `weights` is drawn round(weight * smallest normalised size) times, again from its beginning when it ends.

    Row numbers within a source come from ranges of the seeded hash, so that a large source is not one task.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    spark = rows.sparkSession
    named = spark.createDataFrame(list(weights.items()), f"{source} string, weight double")
    own = rows.join(F.broadcast(named), source)
    # one row for each source in `weights`
    sizes = own.groupBy(source, "weight").agg(F.count("*").alias("_size"))
    smallest = sizes.agg(F.min(F.col("_size") / F.col("weight")).alias("_least"))
    plan = sizes.join(F.broadcast(smallest)).select(F.col(source).alias("_s"), "_size", F.greatest(F.lit(1), F.rint(F.col("_least") * F.col("weight"))).cast("long").alias("_quota"))
    placed = hash_places(own.withColumn("_h", hash_order(seed, F.col(key))), [source], "_h", key, "_i").join(F.broadcast(plan), F.col(source) == F.col("_s"))
    copies = F.floor(F.col("_quota") / F.col("_size")) + F.when(F.col("_i") <= F.col("_quota") % F.col("_size"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("long")).where("copies > 0").select(*rows.columns, "copies")


def padded(ids: Column, multiple: int, pad: int) -> Column:
    n = F.ceil(F.size(ids) / multiple) * multiple
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), (n - F.size(ids)).cast("int")))


def trimmed(messages: str, budget: int) -> Column:
    """Indices that stay of an array of (role, cost): the last user turn and what follows always, older ones from new to old while they fit, skipping what doesn't."""
    n = F.size(messages)
    last = F.coalesce(F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())), n - 1)
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.sequence(last, n - 1).alias("keep"))
    older = F.when(last > 0, F.sequence(last - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, i: Column) -> Column:
        cost = F.get(F.col(messages), i)["cost"]
        return F.when(cost <= s["left"], F.struct((s["left"] - cost).alias("left"), F.concat(F.array(i), s["keep"]).alias("keep"))).otherwise(s)

    return F.aggregate(older, start, step, lambda s: s["keep"])


def chat_windows(turns: DataFrame, most: int, overlap: int, count: Callable[[str], int] = lambda s: len(s.split())) -> DataFrame:
    """conv_id, window, first, last (turn groups), tokens, reason: the longest runs of turn groups within `most` tokens.

    A turn group is a user turn with what follows it; system texts count in each window. A group that alone is too long makes the
    conversation untrainable (reason), as does one without a whole group. Greedy, so a conversation is folded in Python.
    """
    schema = "conv_id long, window int, first int, last int, tokens int, reason string"

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        system = sum(count(t or "") for t in rows.loc[rows.role == "system", "text"])
        groups: list[tuple[int, set[str]]] = []
        for role, text in zip(rows.role, rows.text, strict=True):
            if role == "system":
                continue
            if role == "user" or not groups:
                groups.append((0, set()))
            n, roles = groups[-1]
            groups[-1] = (n + count(text or ""), roles | {role})
        sizes = [n for n, roles in groups if {"user", "assistant"} <= roles]
        if not sizes:
            return pd.DataFrame([(key[0], 0, None, None, None, "no_complete_turn")], columns=[x.split()[0] for x in schema.split(", ")])
        out, first = [], 0
        while True:
            last, total = first, system
            while last < len(sizes) and total + sizes[last] <= most:
                total += sizes[last]
                last += 1
            if last == first:
                return pd.DataFrame([(key[0], 0, None, None, None, "turn_too_long")], columns=[x.split()[0] for x in schema.split(", ")])
            out.append((key[0], len(out), first, last - 1, total, None))
            if last == len(sizes):
                return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
            first = max(first + 1, last - overlap)

    return turns.groupBy("conv_id").applyInPandas(fold, schema)


def mask_words(text: str) -> int:
    """How many ids assistant_mask() gives a text."""
    return sum(1 for w in re.split("[ \n]+", text) if w)


def window_messages(messages: str, first: str, last: str) -> Column:
    """The messages of a window of chat_windows(): system texts, and turn groups first to last of those with a user and an assistant."""
    spoken = F.filter(messages, lambda m: ~m["role"].eqNullSafe("system"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    start = F.struct(F.array().cast("array<array<struct<role:string,content:string>>>").alias("done"), none.alias("now"))
    new = lambda s, m: m["role"].eqNullSafe("user") & (F.size(s["now"]) > 0)
    step = lambda s, m: F.struct(F.when(new(s, m), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(new(s, m), F.array(m)).otherwise(F.concat(s["now"], F.array(m))).alias("now"))
    groups = F.aggregate(spoken, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    complete = F.filter(groups, lambda g: F.exists(g, lambda m: m["role"] == "user") & F.exists(g, lambda m: m["role"] == "assistant"))
    return F.concat(F.filter(messages, lambda m: m["role"] == "system"), F.flatten(F.slice(complete, F.col(first) + 1, F.col(last) - F.col(first) + 1)))


def packed(examples: DataFrame, order: str | list[str], most: int, end_id: int, parts: int) -> DataFrame:
    """part, pack, input_ids, labels: examples (ids, labels) joined in order, each with an end, until the next does not fit.

    Full-length examples pass as they are. Order matters, so packs are made within ranges of it; a range is streamed, not collected.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        labels: list[int] = []
        done: list[tuple] = []
        n, part = 0, None

        def flush() -> None:
            nonlocal ids, labels, n
            if ids:
                done.append((part, n, ids, labels))
                ids, labels, n = [], [], n + 1

        for rows in batches:
            for p, i, lab in zip(rows.part, rows.ids, rows.labels, strict=True):
                part = p if part is None else part
                if len(i) > most:
                    raise ValueError("an example is longer than a pack")
                if len(i) == most:
                    flush()
                    done.append((part, n, list(i), list(lab)))
                    n += 1
                    continue
                if len(ids) + len(i) + 1 > most:
                    flush()
                ids = [*ids, *i, end_id]
                labels = [*labels, *lab, IGNORED]
                if len(ids) > most:
                    raise ValueError("an example with its end is longer than a pack")
            if done:
                yield pd.DataFrame(done, columns=["part", "pack", "input_ids", "labels"])
                done.clear()
        flush()
        if done:
            yield pd.DataFrame(done, columns=["part", "pack", "input_ids", "labels"])

    by = [order] if isinstance(order, str) else order
    rows = examples.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "ids", "labels")
    return rows.mapInPandas(run, "part int, pack int, input_ids array<long>, labels array<long>")


def assistant_mask(messages: str) -> tuple[Column, Column]:
    """Words of an array of (role, content) as crc32 ids, and labels that are the ids where an assistant speaks and IGNORED elsewhere."""
    words = F.flatten(F.transform(messages, lambda m: F.transform(F.filter(F.split(m["content"], "[ \n]+"), lambda w: w != ""), lambda w: F.struct(F.crc32(w.cast("binary")).alias("id"), (m["role"] == "assistant").alias("own")))))
    return F.transform(words, lambda w: w["id"]), F.transform(words, lambda w: F.when(w["own"], w["id"]).otherwise(F.lit(IGNORED).cast("long")))


Template = Callable[[list[tuple[str, str]]], list[tuple[str, bool]]]
Tokens = Callable[[str], list[tuple[int, int, int]]]


def templated(messages: Column, template: Template, tokenize: Tokens) -> Column:
    """ids and labels of an array of (role, content) through a chat template and a tokenizer.

    The template gives pieces of text and whether an assistant says them; the tokenizer gives (id, begin, end) over
    the whole text. A token is a label where its characters meet an assistant's, and IGNORED elsewhere.
    """

    def one(m) -> dict:
        pieces = template([(x["role"], x["content"] or "") for x in (m if m is not None else [])])
        text = "".join(p for p, _ in pieces)
        own = [False] * len(text)
        at = 0
        for piece, says in pieces:
            own[at : at + len(piece)] = [says] * len(piece)
            at += len(piece)
        tokens = tokenize(text)
        return {"ids": [t for t, _, _ in tokens], "labels": [t if any(own[a:b]) else IGNORED for t, a, b in tokens]}

    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(m) for m in rows], columns=["ids", "labels"])

    return F.pandas_udf(run, "ids array<long>, labels array<long>")(messages)


def plain_template(messages: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """Role and text on lines of their own."""
    return [x for role, text in messages for x in ((f"{role}\n", False), (text, role == "assistant"), ("\n", False))]


def plain_tokens(text: str) -> list[tuple[int, int, int]]:
    """Words and line ends, by CRC-32."""
    return [(zlib.crc32(m[0].encode()), m.start(), m.end()) for m in re.finditer(r"[^ \n]+|\n", text)]
