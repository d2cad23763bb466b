"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is of byte 5-grams, one for each language. Counts, continuation counts and
discounts are tables of distinct n-grams, sharded by Spark; probabilities of the n-grams that
documents ask for come from joins of these tables, order by order. A group of
documents asks once for each distinct n-gram, and gets a value for each back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.llm.common import pieces_for, release, removed, sliced, text_buffer, work_dir, written
from tidemill.llm.suffix_dedup import ascending, dealt, mix, values_of

ORDER = 5
#: MB of input for each group of documents.
GROUP_MB = 4
#: One trusted document in so many isn't trained on: the thresholds are quantiles of these.
HELD_OUT = 5
QUANTILE = 0.99
#: Documents that a language's threshold needs.
LEAST_HELD_OUT = 10
#: Natural-log probabilities travel as negative multiples of this.
STEP = 1 / 1024
#: How hard texts are compressed before they are shuffled.
LEVEL = 7
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
FOLD[0x30:0x3A] = 0x30
FOLD[0x09:0x0E] = 0x20


def keys_of(data: np.ndarray, at: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each n-gram of the texts (24 bits of its language, then its bytes), and where each text's begin."""
    folded = FOLD[data].astype(np.uint64)
    n = np.maximum(np.diff(at) - (ORDER - 1), 0)
    if len(folded) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    m = len(folded) - ORDER + 1
    gram = np.zeros(m, np.uint64)
    for k in range(ORDER):
        gram = gram << np.uint64(8) | folded[k : k + m]
    inside = np.zeros(m + 1, np.int64)
    some = n > 0
    np.add.at(inside, at[:-1][some], 1)
    np.add.at(inside, (at[:-1] + n)[some], -1)
    first = np.concatenate([[0], np.cumsum(n)])
    return gram[np.cumsum(inside)[:-1] > 0] | np.repeat(lang.astype(np.uint64) << np.uint64(40), n), first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, how often each comes, and the place of each key among them."""
    coded = pc.dictionary_encode(pa.array(keys))
    found, codes = np.asarray(coded.dictionary, np.uint64), np.asarray(coded.indices, np.int64)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], np.bincount(codes, minlength=len(found))[order], place[codes]


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending keys by shard, ascending within, and where each shard begins in it."""
    shard = dealt(mix(keys), shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one group as one compressed blob for each slice of texts: texts are most of what a shuffle holds."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))
    for batch in sliced(batches):
        group = np.asarray(batch.column("_group"), np.int64)
        order = np.argsort(group, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
        numbers, blobs = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.take(pa.array(order[a:b]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                w.write_batch(part)
            numbers.append(int(group[order[a]]))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["_group", "rows"])


def unpacked(table: pa.Table, schema: pa.Schema) -> pa.Table:
    parts = [pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()]
    return pa.concat_tables(parts) if parts else schema.empty_table()


# the model: tables (key, c) of distinct n-grams of one order; the key of an n-gram has its language above bit 40

LANGUAGE = ((1 << 23) - 1) << 40


def _suffix(k: int) -> F.Column:
    """The key of the last k bytes."""
    return F.col("key").bitwiseAND(LANGUAGE | ((1 << 8 * k) - 1))


def _context() -> F.Column:
    return F.col("key").bitwiseAND(LANGUAGE).bitwiseOR(F.shiftright(F.col("key").bitwiseAND((1 << 40) - 1), 8))


def _order(grams: DataFrame, base: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Of n-grams of order k: (key, alpha), their discounted shares, and (context, gamma), what is left for lower orders."""
    c, lang = F.col("c"), F.shiftright("key", 40).alias("lang")
    seen = [F.sum(F.when(c == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]
    n = grams.groupBy(lang).agg(*seen)
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.0))
    usual = {1: 0.5, 2: 1.0, 3: 1.5}
    discounts = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(usual[i]).alias(f"d{i}") for i in (1, 2, 3)]
    own = grams.select("key", "c", lang, _context().alias("context")).join(n.select("lang", *discounts), "lang")
    d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    own = written(own.select("key", "context", "c", d.alias("d")), f"{base}/order-{k}")
    total = own.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    alpha = own.join(total, "context").select("key", ((c - F.col("d")) / F.col("total")).alias("alpha"))
    return alpha, total.select("context", (F.col("left") / F.col("total")).alias("gamma"))


def probabilities(grams: DataFrame, asked: DataFrame, base: str, k: int = ORDER) -> DataFrame:
    """(key, p) for every key in asked (distinct, of order k), from the n-grams (key, c) of order k."""
    lower = F.lit(1.0 / 256)
    alpha, gamma = _order(grams, base, k)
    if k > 1:
        below = grams.groupBy(_suffix(k - 1).alias("key")).agg(F.count("*").alias("c"))
        below = written(below, f"{base}/grams-{k - 1}")
        p = probabilities(below, asked.select(_suffix(k - 1).alias("key")).distinct(), base, k - 1).select(F.col("key").alias("suffix"), F.col("p").alias("lower"))
        asked = asked.select("key", _suffix(k - 1).alias("suffix")).join(p, "suffix").select("key", "lower")
        lower = F.col("lower")
    rows = asked.withColumn("context", _context()).join(alpha, "key", "left").join(gamma, "context", "left")
    return rows.select("key", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower).alias("p"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, trusted, held_out, n_grams and perplexity (null without n-grams) of each row.

    trusted holds the identifiers of trusted documents (column doc_id); those that aren't held out are trained on,
    all of them. A null text is empty, a null language is a language of its own. Texts of fewer than ORDER bytes have no n-grams.
    Equal rows give equal rows. Two shuffles of the texts, each with a group's own notes: who is
    trusted, and then the values of its n-grams. Memory: the texts of one group, about 40 bytes for each byte.
    """
    spark = docs.sparkSession
    base = work_dir(spark, "kneser-ney")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, shards = pieces_for(docs, GROUP_MB, parallel), max(parallel, pieces_for(docs, 2 * GROUP_MB))
    group = F.pmod(F.xxhash64(F.lit(21), F.col("doc_id")), F.lit(groups)).cast("int").alias("_group")
    held = (F.pmod(F.xxhash64(F.lit(22), F.col("doc_id")), F.lit(HELD_OUT)) == 0).alias("held_out")
    code = F.coalesce(F.xxhash64(F.col("lang")).bitwiseAND((1 << 23) - 1), F.lit(0)).alias("code")
    # rows without an identifier are never trusted: their texts deal them out
    own = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(F.lit(23), "text"), F.lit(groups)).cast("int")).otherwise(group).alias("_group")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).select("doc_id", "text", "lang", code, held, own)
    shape = to_arrow_schema(rows.schema)
    packs = rows.mapInArrow(packed, "_group int, rows binary")
    known = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().select(F.col("doc_id").alias("known"), group)

    def of(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data, at = text_buffer(texts.column("text").combine_chunks() if texts.num_rows else pa.array([], pa.string()))
        return keys_of(data, at, np.asarray(texts.column("code").combine_chunks() if texts.num_rows else pa.array([], pa.int64()), np.int64))

    def counted(packs: pa.Table, known: pa.Table) -> pa.Table:
        texts = unpacked(packs, shape)
        keys, first = of(texts)
        trained = pc.and_(pc.is_in(texts.column("doc_id"), known.column("known").combine_chunks() if known.num_rows else pa.array([], known.schema.field("known").type)), pc.invert(texts.column("held_out")))
        asked, _, place = distinct(keys)
        own = np.repeat(np.asarray(trained.to_numpy(), bool), np.diff(first)) if texts.num_rows else np.zeros(0, bool)
        count = np.bincount(place[own], minlength=len(asked))
        order, edges = by_shard(asked, shards)
        number = texts.column("_group")[0].as_py() if texts.num_rows else 0
        out = []
        for s in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[s] : edges[s + 1]]
            out.append((s, number, ascending(asked[at]), zstandard.compress(count[at].astype("<u4").tobytes(), 1)))
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "_group", "keys", "counts"])

    asked = packs.groupBy("_group").cogroup(known.groupBy("_group")).applyInArrow(counted, "shard int, _group int, keys binary, counts binary")
    asked = written(asked, f"{base}/asked")
    release(spark)

    def merged(table: pa.Table) -> pa.Table:
        keys = np.concatenate([values_of(x) for x in table.column("keys").to_pylist()])
        count = np.concatenate([np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        found, at = np.unique(keys, return_inverse=True)
        return pa.table({"key": found.astype(np.int64), "c": np.bincount(at, weights=count).astype(np.int64)})

    grams = written(asked.groupBy("shard").applyInArrow(merged, "key long, c long"), f"{base}/grams")
    p = probabilities(grams.where("c > 0"), grams.select("key"), base)
    p = written(p.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(dealt(mix(np.asarray(b.column("key"), np.int64).astype(np.uint64)), shards).astype(np.int32)), b.column("key"), b.column("p")], names=["shard", "key", "p"]) for b in batches), "shard int, key long, p double"), f"{base}/probabilities")

    def answered(asked: pa.Table, p: pa.Table) -> pa.Table:
        keys, value = np.asarray(p.column("key").combine_chunks(), np.int64), np.asarray(p.column("p").combine_chunks(), np.float64)
        order = np.argsort(keys)
        keys, cost = keys[order], np.minimum(np.round(-np.log(np.maximum(value[order], 1e-30)) / STEP), 65535).astype("<u2")
        found = [cost[np.searchsorted(keys, values_of(x).astype(np.int64))].tobytes() for x in asked.column("keys").to_pylist()]
        return pa.table([asked.column("_group"), asked.column("shard"), pa.array(found, pa.binary())], names=["_group", "shard", "costs"])

    costs = written(asked.select("shard", "_group", "keys").groupBy("shard").cogroup(p.groupBy("shard")).applyInArrow(answered, "_group int, shard int, costs binary"), f"{base}/costs")
    for name in ("asked", "grams", "probabilities", *(f"order-{k}" for k in range(1, ORDER + 1)), *(f"grams-{k}" for k in range(1, ORDER))):
        removed(spark, f"{base}/{name}")
    release(spark)

    def scored(packs: pa.Table, costs: pa.Table) -> pa.Table:
        texts = unpacked(packs, shape)
        keys, first = of(texts)
        asked, _, place = distinct(keys)
        order, edges = by_shard(asked, shards)
        cost = np.zeros(len(asked), np.int64)
        for s, c in zip(costs.column("shard").to_pylist(), costs.column("costs").to_pylist(), strict=True):
            cost[order[edges[s] : edges[s + 1]]] = np.frombuffer(c, "<u2")
        total = np.concatenate([[0], np.cumsum(cost[place])])
        n = np.diff(first)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.exp(STEP * (total[first[1:]] - total[first[:-1]]) / n)
        return pa.table([texts.column("doc_id"), texts.column("lang"), texts.column("held_out"), pa.array(n), pa.array(value, mask=n == 0)], names=["doc_id", "lang", "held_out", "n_grams", "perplexity"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    value = packs.groupBy("_group").cogroup(costs.groupBy("_group")).applyInArrow(scored, f"doc_id {kind}, lang string, held_out boolean, n_grams long, perplexity double")
    value = written(value, f"{base}/values")
    return value.join(known.select("known"), F.col("doc_id") == F.col("known"), "left").select("doc_id", "lang", F.col("known").isNotNull().alias("trusted"), "held_out", "n_grams", "perplexity")


def classified(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, n_grams, perplexity, threshold and kept of each row.

    A language's threshold is the QUANTILE of the perplexities of its trusted documents that weren't trained
    on; it is null, and every document with n-grams kept, where there are fewer than LEAST_HELD_OUT. A document without n-grams isn't kept.
    """
    rows = perplexities(docs, trusted)
    own = rows.where(F.col("trusted") & F.col("held_out") & F.col("perplexity").isNotNull()).groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), F.percentile_approx("perplexity", QUANTILE, 10_000).alias("threshold"))
    both = rows.join(own.where(F.col("n") >= LEAST_HELD_OUT), F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return both.select("doc_id", "n_grams", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), kept.alias("kept"))


__all__ = ["classified", "perplexities", "probabilities"]
