"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints are dealt to groups that share a masked bit pattern: of four
blocks of 16 bits, two fingerprints at two or fewer differing bits agree on two, so
six masks find every link. A group that is too large is dealt again by
the same rule within its free 32 bits, and then holds at most 2^16 fingerprints.
Within a group fingerprints are sorted by Gray rank; nodes are runs that share their
leading bits. Pairs of nodes carry the differences so far, and a pair goes,
with all pairs below it, as soon as it has more than the links may have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.llm.common import IS_SPACE, ragged, release, sliced, spans_of_words, text_buffer, work_dir, written
from tidemill.llm.components import components

#: Words of a shingle, and differing bits of a link.
SHINGLE, MOST_BITS = 3, 2
SEED = 42
#: A group of more fingerprints is dealt again by its free bits.
GROUP_ROWS = 1024
#: Bits that each level of the hierarchy adds, and pairs of nodes looked at together.
LEVEL_BITS, PAIRS_AT_ONCE = 8, 1 << 20
#: Hashes whose bits are counted together, and bytes beyond which a text is hashed in parts.
RUN, LONG = 1 << 15, 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def hashed_shingles(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every text's shingles, repeats included, and where each text's begin (one more at the end)."""
    begin, end, first = spans_of_words(data, at)
    # the words of a text, lower-cased, with one space after each
    length = end - begin
    place = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int(length.sum() + len(length)), 0x20, np.uint8)
    joined[ragged(place, length)] = LOWER[data[~IS_SPACE[data]]]
    raw, stop = joined.tobytes(), place + length
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    lead = ragged(first[:-1], n)
    last = lead + np.minimum(shingle, np.repeat(n_words, n)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(lead), np.uint64)
    for i in range(0, len(lead), RUN):
        hashes[i : i + RUN] = [digest(raw[a:b], SEED) for a, b in zip(place[lead[i : i + RUN]].tolist(), stop[last[i : i + RUN]].tolist(), strict=True)]
    return hashes, np.append(0, np.cumsum(n))


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[i : i + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority_of_runs(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each run hashes[edge[i]:edge[i + 1]] the bits that are set in over half of it; 0 for an empty one. So many at once that the bits stay small.

    hashes: 64-bit numbers, or rows of several; so is the result.
    """
    if hashes.ndim > 1:
        return np.stack([majority_of_runs(np.ascontiguousarray(h), edge) for h in hashes.T], axis=1)
    n = np.diff(edge)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(edge[some + 1], edge[some[lo]] + RUN, "right")))
        runs = some[lo:hi]
        part = hashes[edge[runs[0]] : edge[runs[-1] + 1]]
        if len(runs) == 1:
            ones = ones_of(part)[None]
        else:
            ones = np.add.reduceat(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), edge[runs] - edge[runs[0]], axis=0, dtype=np.int32)
        out[runs] = np.packbits(2 * ones > n[runs][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        lo = hi
    return out


def fingerprint_slice(data: np.ndarray, at: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit fingerprint of every text: bit set if set in over half of its shingles' hashes, repeats included."""
    if len(at) == 2 and len(data) > LONG:
        return fingerprint_long(data, shingle)
    return majority_of_runs(*hashed_shingles(data, at, shingle))


def fingerprint_long(data: np.ndarray, shingle: int) -> np.ndarray:
    """The same for one long text, in parts that share shingle - 1 words."""
    ones, n, lo = np.zeros(64, np.int64), 0, 0
    while lo < len(data):
        hi, step = len(data), LONG
        while lo + step < len(data):
            begin, end, _ = spans_of_words(data[lo : lo + step], np.array([0, step]))
            if len(begin) > 2 * shingle:  # the last word may go on
                hi = lo + int(end[-2])
                back = lo + int(begin[-shingle])
                break
            step *= 2
        hashes, _ = hashed_shingles(data[lo:hi], np.array([0, hi - lo]), shingle)
        whole = hi == len(data)
        if whole and lo and len(spans_of_words(data[lo:hi], np.array([0, hi - lo]))[0]) < shingle:
            break  # what is left are words of the part before
        ones += ones_of(hashes)
        n += len(hashes)
        if whole:
            break
        lo = back
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64) if n else np.zeros(1, np.uint64)


def with_fingerprints(rows: DataFrame, text_col: str, into: str, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `keep`, and each row's fingerprint as a signed 64-bit integer; no words (or a null text): 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, LONG):
            fp = fingerprint_slice(*text_buffer(batch.column(text_col)), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, into])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField(into, LongType())]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of each row."""
    return with_fingerprints(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", "fp", shingle, ("doc_id",))


# the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of bit patterns in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def linked(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j as numbers in Gray order of distinct fps) at `most` or fewer differing bits; fps are sorted by Gray rank."""
    levels = []  # at each level: the nodes' patterns, and where their children begin
    starts = np.arange(len(fps) + 1)
    nodes = fps
    bits = 0
    while True:
        levels.append((nodes, starts))
        bits += LEVEL_BITS
        if len(nodes) <= 2 or bits >= 64:
            break
        upper = nodes >> np.uint64(LEVEL_BITS) if bits > LEVEL_BITS else fps >> np.uint64(LEVEL_BITS)
        new = np.flatnonzero(np.append(True, upper[1:] != upper[:-1]))
        starts = np.append(new, len(upper))
        nodes = upper[new]
    out_a, out_b = [], []
    top, top_starts = levels[-1]
    a, b = np.triu_indices(len(top)) if len(top) < 2000 else (None, None)
    stack = []
    if a is not None:
        stack.append((len(levels) - 1, a, b))
    else:
        for i in range(len(top)):  # the top row of pairs by parts
            stack.append((len(levels) - 1, np.full(len(top) - i, i), np.arange(i, len(top))))
    while stack:
        level, a, b = stack.pop()
        nodes, starts = levels[level]
        near = np.bitwise_count(nodes[a] ^ nodes[b]) <= most
        a, b = a[near], b[near]
        if level == 0:
            keep = a < b
            out_a.append(a[keep])
            out_b.append(b[keep])
            continue
        na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
        total = np.cumsum(na * nb)
        lo = 0
        while lo < len(a):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right")))
            wide = (na * nb)[lo:hi]
            k = ragged(np.zeros(hi - lo, np.int64), wide)
            width = np.repeat(nb[lo:hi], wide)
            ca, cb = np.repeat(starts[a[lo:hi]], wide) + k // width, np.repeat(starts[b[lo:hi]], wide) + k % width
            ok = ca <= cb
            stack.append((level - 1, ca[ok], cb[ok]))
            lo = hi
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: as much as components need."""
    parent = list(range(n))
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = i, j
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            out.append((i, j))
    return out


def _masks(blocks: list[int], width: int, most: int) -> list[int]:
    """Masks of all but `most` of the blocks (of `width` bits, at these places)."""
    return [sum(((1 << width) - 1) << at for at in kept) for kept in combinations(blocks, len(blocks) - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pattern(fp: str, masks: list[int]) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("pattern")) for i, m in enumerate(masks)]))


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """a, b: enough links between distinct fingerprints (column fp) that their components are those of all links.

    Of a group no more than a spanning forest leaves, so that dense groups don't multiply.
    """
    if most != 2:
        raise ValueError("four blocks find links of two differing bits")
    spark = distinct.sparkSession
    coarse = _masks([0, 16, 32, 48], 16, most)
    keyed = distinct.select("fp", _pattern("fp", coarse).alias("k")).select("fp", F.concat_ws(":", "k.mask", "k.pattern").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), work_dir(spark, "simhash-groups"))
    small = keyed.join(sizes.where(F.col("n") <= GROUP_ROWS).select("key"), "key")
    # what is too large: two more blocks out of four within the free bits
    large = keyed.join(sizes.where(F.col("n") > GROUP_ROWS).select("key"), "key")
    finer = []
    for i, mask in enumerate(coarse):
        free = [at for at in range(0, 64, 8) if not mask >> at & 1]
        finer.append(F.when(F.col("key").startswith(f"{i}:"), F.array(*[F.struct(F.lit(j).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask | m))).alias("pattern")) for j, m in enumerate(_masks(free, 8, most))])))
    large = large.select("fp", F.substring_index("key", ":", 1).alias("outer"), F.explode(F.coalesce(*finer)).alias("k")).select("fp", F.concat_ws(":", "outer", "k.mask", "k.pattern").alias("key"))

    def search(group: pa.Table) -> pa.Table:
        fps = np.unique(np.asarray(group.column("fp").combine_chunks(), np.int64).view(np.uint64))
        fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        i, j = linked(fps, most)
        found = np.array(forest(len(fps), i, j), np.int64).reshape(-1, 2)
        named = fps.view(np.int64)
        return pa.table({"a": named[found[:, 0]], "b": named[found[:, 1]]})

    made = [x.groupBy("key").applyInArrow(search, "a long, b long") for x in (small, large)]
    return made[0].union(made[1]).distinct()


def classes(rows: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """own (each distinct fingerprint of rows), root and component_id (the smallest doc_id of its component)."""
    spark = rows.sparkSession
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), work_dir(spark, "fingerprints-distinct"))
    roots = components(links(distinct, most))
    release(spark)
    # tables, so that the join below has plain sides and a large component's rows can be dealt to several tasks
    named = written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), work_dir(spark, "fingerprint-roots"))
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), work_dir(spark, "fingerprint-least"))
    return written(named.select("fp", "root").join(least, "root").select(F.col("fp").alias("own"), "root", "component_id"), work_dir(spark, "fingerprint-classes"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) for each row.

    Texts without words, null and empty ones included, have fingerprint zero and link like any
    other. A null doc_id keeps its row; it names no component unless no other row of the component has one (then null).
    Equal rows give equal rows; an empty table gives none. Copies meet in one distinct fingerprint
    before any search. Memory: a slice of texts, or one group of at most 2^16 fingerprints.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), work_dir(docs.sparkSession, "fingerprints"))
    return rows.join(classes(rows, most), F.col("fp") == F.col("own")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["classes", "fingerprints", "gray_rank", "linked", "links", "majority_of_runs", "near_duplicates"]
