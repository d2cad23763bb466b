"""Exact and near duplicates."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: MinHash: functions (a x + b) mod a Mersenne prime, of which 32 bits are kept.
PRIME, KEPT = (1 << 61) - 1, (1 << 32) - 1
HASHES, BANDS = 64, 16


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; it must be a total order. The aggregate combines on the map side, so a hot key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns])


#: Hexadecimal digits of a hash that name a part of what is digested: 4096 parts.
LEAF = 3


def digests(rows: DataFrame, by: str, hashed: str, line: str) -> DataFrame:
    """by, digest: SHA-256 over the sorted lines of each group, in two levels: lines of a part (by the leading digits of their hash), then parts.

    No task has more than a part's lines. Lines that repeat count.
    """
    parts = rows.groupBy(by, F.substring(hashed, 1, LEAF).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return parts.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit(":"), "d"))), "\n"), 256).alias("digest"))


def _run_hashes(words: Column, n: int) -> Column:
    """A hash of each run of n words. words: a column, not an expression."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def contained(rows: DataFrame, probes: DataFrame, longest: int = 8) -> DataFrame:
    """id, probe_id: rows (id, text) whose text contains a probe's (probe_id, probe), anywhere, also within words.

    A probe's first and last word can be parts of a text's words; those between are words of it. So a hash of the run of
    inner words (the first `longest` of them) finds candidates, identifiers alone, and their texts are compared
    in full. Probes of fewer than three words have no inner word: they are a stated set of queries against all rows.
    """
    inner = F.slice(F.col("w"), 2, F.greatest(F.lit(0), F.least(F.lit(longest), F.size("w") - 2)))
    keyed = probes.where("probe IS NOT NULL").select("probe_id", "probe", F.split("probe", " ").alias("w")).select("probe_id", "probe", F.when(F.size("w") > 2, inner).otherwise(F.array().cast("array<string>")).alias("inner"))
    sizes = [r[0] for r in keyed.select(F.size("inner")).distinct().collect()]  # `longest` numbers at most
    found = []
    words = rows.select("id", F.split("text", " ").alias("w"))
    for n in sorted(x for x in sizes if x):
        own = words.select("id", F.explode_outer(F.array_distinct(_run_hashes(F.col("w"), n))).alias("key"))
        asked = keyed.where(F.size("inner") == n).select("probe_id", F.xxhash64(*[F.get("inner", F.lit(k)) for k in range(n)]).alias("key"))
        found.append(own.join(asked, "key").select("id", "probe_id").distinct())
    out = None
    for pairs in found:
        exact = pairs.join(probes, "probe_id").join(rows, "id").where(F.contains("text", F.col("probe"))).select("id", "probe_id")
        out = exact if out is None else out.union(exact)
    if 0 in sizes:
        short = keyed.where(F.size("inner") == 0).select("probe_id", "probe")
        exact = rows.join(short, F.contains("text", F.col("probe"))).select("id", "probe_id")
        out = exact if out is None else out.union(exact)
    return out if out is not None else rows.select("id").limit(0).crossJoin(probes.select("probe_id").limit(0))


def first_of(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """df with the least identifier of its key and the key's row count. The aggregate combines on the map side, so a hot key is one row per task."""
    least = df.groupBy(key).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    return df.join(least, key)


def coefficients(n: int = HASHES) -> list[tuple[int, int]]:
    """The multipliers and offsets of n hash functions, by a linear congruence; all below 2^31."""
    x, out = 42, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) & 0x7FFFFFFF
            pair.append(x | 1)
        out.append((pair[0], pair[1]))
    return out


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct runs of n words; a shorter text is one shingle, an empty one has none. words: a column, not an expression, as each run reads it."""
    # (slice() would copy the whole array for each run)
    full = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    short = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= n, F.array_distinct(full)).otherwise(short)


def signature(words: Column, n: int = HASHES, run: int = 5) -> Column:
    """An array of n minima over the 32-bit hashes (of MD5) of the shingles of an array of words: shingles(), each once; null for none.

    In Arrow batches, a hash function at a time over all shingles of a batch: hashing and 64 products for
    each shingle cost about 20 times as much in expressions.
    """
    pairs = [(np.uint64(a), np.uint64(b)) for a, b in coefficients(n)]

    def least(rows: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = []
        for begin in range(0, len(rows), 256):
            sets = [_hashes(w, run) for w in rows.iloc[begin : begin + 256]]
            size = np.array([len(x) for x in sets])
            some = np.flatnonzero(size)
            if not len(some):
                out += [None] * len(sets)
                continue
            x = np.concatenate([sets[i] for i in some])
            edge = np.cumsum(size[some]) - size[some]
            found = np.stack([np.minimum.reduceat((x * a + b) % np.uint64(PRIME) & np.uint64(KEPT), edge) for a, b in pairs], axis=1).astype(np.int64)
            number = np.cumsum(size > 0) - 1
            out += [found[number[i]] if size[i] else None for i in range(len(sets))]
        return pd.Series(out)

    return F.pandas_udf(least, "array<long>")(words)


def _hashes(words: np.ndarray | None, run: int) -> np.ndarray:
    """The first 32 bits of the MD5 of each distinct run of words."""
    if words is None or not len(words):
        return np.zeros(0, np.uint64)
    w = list(words)
    runs = {" ".join(w[i : i + run]) for i in range(max(1, len(w) - run + 1))}
    return np.frombuffer(b"".join(hashlib.md5(s.encode(), usedforsecurity=False).digest()[:4] for s in runs), ">u4").astype(np.uint64)


def bands(sig: str = "sig", n: int = BANDS, rows: int = HASHES // BANDS) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("band"), F.md5(F.array_join(F.slice(sig, i * rows + 1, rows).cast("array<string>"), ",")).alias("bucket")) for i in range(n)])


def anchored_pairs(signatures: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity: b against the least member (anchor) of each bucket they share, at an estimated Jaccard of threshold or more.

    signatures: doc_id and sig, not null. A bucket of n members gives n - 1 pairs, not n squared; a hot bucket is combined on the map side and joins back to its members.
    """
    spark = signatures.sparkSession
    path = f"{shared(spark)}/signatures-{uuid.uuid4().hex}"
    signatures.write.parquet(path)  # read three times below
    signatures = spark.read.parquet(path)
    keyed = signatures.select("doc_id", F.explode_outer(bands()).alias("k")).select("doc_id", "k.band", "k.bucket")
    anchors = keyed.groupBy("band", "bucket").agg(F.min("doc_id").alias("a"))
    pairs = keyed.join(anchors, ["band", "bucket"]).where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    left, right = (signatures.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / HASHES
    return pairs.join(left, "a").join(right, "b").select("a", "b", same.alias("similarity")).where(F.col("similarity") >= threshold)


def shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        own, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not own.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = own.get() if own.isDefined() else "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clusters(pairs: DataFrame) -> DataFrame:
    """node, root: the least identifier reachable over pairs (a, b). Labels spread until none changes; each round is written to the shared folder."""
    spark = pairs.sparkSession
    base = f"{shared(spark)}/clusters-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    links = kept(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "links")
    labels = kept(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "0")
    step = 0
    while True:
        step += 1
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        # a node takes the least label around it, and then its label's own label
        now = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"))
        jump = now.select(F.col("node").alias("of"), F.col("root").alias("further"))
        now = kept(now.join(jump, F.col("root") == F.col("of"), "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root")), str(step))
        changed = now.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        _drop(spark, f"{base}/{step - 1}")
        labels = now
        if not changed:
            return labels
