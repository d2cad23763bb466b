"""Removal of repeated byte strings over a difference cover.

Let D be a perfect difference set modulo v: for any two positions i and j there is
a shift s < v with both i + s and j + s in the sample, the positions that are in D
modulo v. So two equal strings of `length` bytes have, at one shift, two equal
sampled tuples of length - v + 1 bytes inside. Texts are packed, a few MB together, once.

1. Sample: the distinct sampled tuples of a pack are named; names are dealt by ranges and sorted.
2. A name with no equal neighbour goes. What is left is where a long repeat can be.
3. Merge the remaining suffixes: the suffixes that start less than v before a sample
   that is left are named by their leading `length` bytes, dealt and sorted as well.
4. Compare adjacent prefixes: a name with an equal neighbour starts a repeat.

A pack sends each of its names once, whatever number of its texts hold it, so a hot
passage is one name for each pack, and equal texts of a pack are one text. A text that other packs
have too (by SHA-256) is a repeat as a whole, and stands as others' partner in one pack only.

Names are fingerprints, not ranks: polynomials modulo primes below 2^32 at points drawn anew
for each call, two of them for a sampled tuple (a chance equality there only costs work) and
three, 96 bits, for a remaining suffix. No text can be built to collide; two different strings share all three
with a probability of at most (length / 2^32)^3, and of 2^-96 as a rule.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemill.llm.common import one_chunk, pieces_for, ragged, release, removed, sliced, text_buffer, work_dir, written

#: Bytes of a repeat.
LENGTH = 400
#: The order of the projective plane behind the difference set: 11 gives 12 residues modulo 133.
ORDER = 11
#: Bytes of text in a pack; MB of (compressed) input for each range of sampled names, and of names of remaining suffixes.
PACK_BYTES, RANGE_MB, SUFFIX_RANGE_MB = 4 << 20, 8, 2
#: How hard packs are compressed.
LEVEL = 5
#: Bytes that are hashed at a time; at most 2^24, so that sums of 2^40 each fit in 64 bits.
PART = 1 << 18
#: The largest primes below 2^32.
PRIMES = (4294967291, 4294967279, 4294967231)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def difference_set(q: int) -> tuple[int, np.ndarray]:
    """v = q^2 + q + 1 and q + 1 residues whose differences are all residues but 0, each once (q prime).

    They are the powers of a generator of the field of q^3 elements that lie in a plane.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x^3 = a x^2 + b x + c
                x, plane = (1, 0, 0), []
                for n in range(v):
                    if x[2] == 0:
                        plane.append(n)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(plane) == q + 1 and len({(i - j) % v for i in plane for j in plane if i != j}) == v - 1:
                    return v, np.array(plane, np.int64)
    raise ValueError(f"{q} is not a prime")


def powers(prime: int, point: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the point and of its inverse, modulo the prime."""
    if (prime, point) not in _POWERS:
        if len(_POWERS) >= len(PRIMES):  # another call's
            _POWERS.clear()
        made = []
        for base in (point, pow(point, -1, prime)):
            out = np.ones(PART + 1, np.uint64)
            n = 1
            while n <= PART:
                more = out[: min(n, PART + 1 - n)]
                out[n : n + len(more)] = more * np.uint64(pow(base, n, prime)) % np.uint64(prime)
                n *= 2
            made.append(out)
        _POWERS[prime, point] = made[0], made[1]
    return _POWERS[prime, point]


def drawn_points() -> tuple[tuple[int, int], ...]:
    return tuple((p, 2 + secrets.randbelow(p - 3)) for p in PRIMES)


def residues_of(data: np.ndarray, at: np.ndarray, width: int, points: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each point the polynomial of data[i:i + width], for ascending i in `at`; long data are taken in overlapping parts."""
    out = [np.empty(len(at), np.uint64) for _ in points]
    lo, step = 0, PART - width
    while lo < len(at):
        begin = int(at[lo])
        hi = int(np.searchsorted(at, begin + step, "right"))
        part = data[begin : begin + PART].astype(np.uint64) + np.uint64(1)
        own = at[lo:hi] - begin
        for into, (prime, point) in zip(out, points, strict=True):
            power, inverse = powers(prime, point)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            into[lo:hi] = (total[own + width] - total[own]) % np.uint64(prime) * inverse[own] % np.uint64(prime)
        lo = hi
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads them over the ranges."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sample(at: np.ndarray, v: int, residues: np.ndarray, width: int) -> np.ndarray:
    """The sampled positions, of texts that lie one after the other, at which a tuple of `width` bytes of one text begins."""
    size = int(at[-1])
    if size < width:
        return np.zeros(0, np.int64)
    place = (np.arange(0, size - width + 1, v)[:, None] + residues).ravel()
    place = place[place <= size - width]
    return place[place + width <= at[np.searchsorted(at, place, "right")]]


def dealt(name: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each name, by its leading bits."""
    return ((name >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def ascending(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as their differences, each of as many bytes as the largest takes."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max()).bit_length() + 7) // 8) if len(gaps) > 1 else 1
    head = int(gaps[0]).to_bytes(8, "little")
    return bytes([width]) + head + np.ascontiguousarray(gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def values_of(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[1:, :width] = body
    out = gaps.view("<u8").ravel().astype(np.uint64)
    out[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(out)


def in_order(name: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal names (and further bits; empty: none) together, and where in it another name begins."""
    order = np.argsort(name)
    first = np.ones(len(name), bool)
    ranked = name[order]
    first[1:] = ranked[1:] != ranked[:-1]
    if len(more):
        rest = more[order]
        differ = rest[1:] != rest[:-1]
        if (~first[1:] & differ).any():
            order = np.lexsort((more, name))
            ranked, rest = name[order], more[order]
            first[1:], differ = ranked[1:] != ranked[:-1], rest[1:] != rest[:-1]
        first[1:] |= differ
    return order, first


class Names:
    """The names of a pack's suffixes, each once and sorted, and which of them it has more than once."""

    def __init__(self, name: np.ndarray, more: np.ndarray = np.zeros(0, np.uint32)):
        order, first = in_order(name, more)
        lead = order[first]
        self.name, self.more = name[lead], more[lead] if len(more) else more
        self.rank = np.empty(len(name), np.int64)
        self.rank[order] = np.cumsum(first) - 1
        self.repeated = np.bincount(self.rank, minlength=len(lead)) > 1

    def _ranges(self, n: int) -> Iterator[tuple[int, int, int]]:
        edges = np.searchsorted(dealt(self.name, n), np.arange(n + 1))
        for r in np.flatnonzero(np.diff(edges)).tolist():
            yield r, int(edges[r]), int(edges[r + 1])

    def rows(self, group: int, n: int) -> pa.RecordBatch:
        """A row for each range of names that some are in."""
        out = [(r, group, ascending(self.name[a:b]), self.more[a:b].astype("<u4").tobytes(), np.packbits(self.repeated[a:b]).tobytes()) for r, a, b in self._ranges(n)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["range", "group", "names", "more", "repeated"])

    def equal(self, flags: pa.Table, n: int) -> np.ndarray:
        """Of each suffix, whether its name has an equal anywhere."""
        answers = dict(zip(flags.column("range").to_pylist(), flags.column("equal").to_pylist(), strict=True))
        out = np.zeros(len(self.name), bool)
        for r, a, b in self._ranges(n):
            if r in answers:
                out[a:b] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=b - a)
        return out[self.rank]


#: In place of a range: the texts of a pack (their numbers) that others have too, and those that stand for others.
COPY, STANDS = -1, -2
NAMES = "range int, group long, names binary, more binary, repeated binary"
FLAGS = "group long, range int, equal binary"


def compared(table: pa.Table) -> pa.Table:
    """Adjacent equal names, from two packs or marked by one, are repeats: a bit for each name of each pack, where one is set."""
    own = [values_of(x) for x in table.column("names").to_pylist()]
    size = [len(x) for x in own]
    more = np.frombuffer(b"".join(table.column("more").to_pylist()), "<u4")
    repeated = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("repeated").to_pylist(), size, strict=True)]).astype(bool)
    name = np.concatenate(own)
    order, first = in_order(name, more)
    lead = np.flatnonzero(first)
    again = (np.add.reduceat(repeated[order], lead, dtype=np.int64) > 0) | (np.diff(np.append(lead, len(name))) > 1)
    flag = np.empty(len(name), bool)
    flag[order] = again[np.cumsum(first) - 1]
    bits = np.split(flag, np.cumsum(size)[:-1])
    some = pa.array([i for i, x in enumerate(bits) if x.any()], pa.int64())
    return pa.table([table.column("group").take(some), pa.array([np.packbits(bits[i]).tobytes() for i in some.to_pylist()], pa.binary()), table.column("range").take(some)], names=["group", "equal", "range"]).select(["group", "range", "equal"])


def covered(starts: np.ndarray, length: int, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that strings of `length` bytes at ascending starts cover: begins and ends. text: the text of each start, which no run leaves."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = starts[1:] > starts[:-1] + length
    if text is not None:
        cut |= text[1:] != text[:-1]
    new = np.flatnonzero(np.append(True, cut))
    return starts[new], np.append(starts[new[1:] - 1], starts[-1]) + length


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


NONE = np.zeros(0, np.int64)
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]


def repeats(docs: DataFrame, finish: Finish, fields: str, length: int = LENGTH, order: int = ORDER, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (the columns named in `keep`) and found (what finish(bytes, begins, ends) gives; its DDL: fields) for each row.

    begins and ends are the maximal runs of the text's bytes that repeats cover. A repeat is a
    string of `length` bytes that starts at two places, of one row or of two; overlaps count, and
    nothing crosses rows. A null text is empty. Equal rows repeat each other. Identifiers play no part:
    they can be null or repeat. Both columns are structs, so names can't clash. An empty table gives no rows.

    Texts are shuffled once, those with a candidate once more, and names twice.
    Memory: a pack of texts (or one longer text) with about 60 bytes for each suffix in it that is left,
    and a range of names.
    """
    spark = docs.sparkSession
    v, residues = difference_set(order)
    width = length - v + 1
    if width < 16:
        raise ValueError("the difference set is too wide for this length")
    base = work_dir(spark, "suffixes")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, suffix_ranges = pieces_for(docs, RANGE_MB, parallel), pieces_for(docs, SUFFIX_RANGE_MB, parallel)
    points = drawn_points()
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", PACK_BYTES):
            text = batch.column("text").fill_null("").cast(pa.large_binary()).dictionary_encode()
            of = pa.table([batch.column("row"), text.indices], names=["row", "code"])
            digests = [hashlib.sha256(t).digest() if len(t) >= length else None for t in text.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_blob(of)], pa.binary()), pa.array([_blob(pa.table([text.dictionary], names=["text"]))], pa.binary()), pa.array([digests], pa.list_(pa.binary()))], names=["rows", "texts", "digests"])

    packs = rows.mapInArrow(packed, "rows binary, texts binary, digests array<binary>").withColumn("group", F.monotonically_increasing_id())
    packs = written(packs, f"{base}/packs")  # a pack keeps its number from here on

    # texts of several packs; those digests are a table, so that both sides of the join below are shuffled and a hot digest's rows can be dealt to several tasks
    digests = packs.select("group", F.posexplode("digests").alias("at", "digest")).where("digest IS NOT NULL")
    twice = digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("group").alias("stands")).where("n > 1").select(F.col("digest").alias("d"), "stands")
    twice = written(twice, f"{base}/twice")
    copies = digests.join(twice, F.col("digest") == F.col("d")).select("group", "at", (F.col("group") == F.col("stands")).alias("stands"))

    def noted(table: pa.Table) -> pa.Table:
        """The copies of a pack as a row beside its flags."""
        at, stands = np.asarray(table.column("at"), "<i4"), np.asarray(table.column("stands").to_numpy(zero_copy_only=False), bool)
        kinds = [(COPY, at[~stands]), (STANDS, at[stands])]
        return pa.table([pa.array([table.column("group")[0].as_py()] * 2, pa.int64()), pa.array([k for k, _ in kinds], pa.int32()), pa.array([x.tobytes() for _, x in kinds], pa.binary())], names=["group", "range", "equal"])

    notes = copies.groupBy("group").applyInArrow(noted, FLAGS)

    # 1 and 2: names of sampled suffixes, sorted by ranges
    def samples(texts: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, Names]:
        own = _table(texts)
        data, at = text_buffer(one_chunk(own.column("text")))
        place = sample(at, v, residues, width)
        a, b = residues_of(data, place, width, points[:2])
        return own, data, at, place, Names(mix(a << np.uint64(32) | b))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in zip(batch.column("group").to_pylist(), batch.column("texts"), strict=True):
                yield samples(texts.as_buffer())[-1].rows(group, ranges)

    flags = packs.select("group", "texts").mapInArrow(sampled, NAMES).groupBy("range").applyInArrow(compared, FLAGS)
    # a few bits for each name: gathered into few files, as for every file in a local folder Hadoop starts two processes (chmod) and a third for its task
    flags = written(flags.union(notes).hint("rebalance"), f"{base}/sample")
    release(spark)

    # 3: samples that are left meet their texts; what can hold a repeat is packed again
    result = StructType([StructField("row", rows.schema["row"].dataType), StructField("found", StructType.fromDDL(fields))])
    made = to_arrow_schema(result)
    ends_type = made.field("found").type

    def finished(of: pa.Table, pick: np.ndarray, ends: list[tuple], at: np.ndarray) -> list[pa.Array]:
        """The rows numbered `pick`; ends[i] belongs to the row pick[i], by at[i]."""
        found = pa.StructArray.from_arrays([pa.array([e[i] for e in ends], ends_type.field(i).type) for i in range(ends_type.num_fields)], fields=[ends_type.field(i) for i in range(ends_type.num_fields)])
        return [one_chunk(of.column("row")).take(pa.array(pick)), found.take(pa.array(at))]

    def gather(packs: pa.Table, flags: pa.Table) -> pa.Table:
        of = _table(packs.column("rows")[0].as_buffer())
        own, data, at, place, names = samples(packs.column("texts")[0].as_buffer())
        code = np.asarray(one_chunk(of.column("code")), np.int64)
        n = len(at) - 1
        noted = {r: np.frombuffer(x, "<i4") for r, x in zip(flags.column("range").to_pylist(), flags.column("equal").to_pylist(), strict=True) if r < 0}
        left = place[names.equal(flags, ranges)]
        text = np.searchsorted(at, left, "right") - 1
        lo, hi = np.maximum(left - v + 1, at[text]), np.minimum(left + 1, at[text + 1] - length + 1)
        some = lo < hi
        lo, hi, text = lo[some], hi[some], text[some]
        new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(lo) else NONE
        begin, end, text = lo[new], hi[np.append(new[1:] - 1, len(hi) - 1)] if len(lo) else NONE, text[new]
        whole = (np.bincount(code, minlength=n) > 1) & (np.diff(at) >= length)
        for copied in noted.values():
            whole[copied] = True
        with_spans = np.zeros(n, bool)
        with_spans[text] = True
        with_spans[noted.get(COPY, NONE)] = False
        some = with_spans[text]
        begin, end, text = begin[some], end[some], text[some]
        # texts without a candidate are finished
        done = np.flatnonzero(~with_spans)
        ends = [finish(data[a:b], *((np.zeros(1, np.int64), np.array([b - a])) if w else (NONE, NONE))) for a, b, w in zip(at[done].tolist(), at[done + 1].tolist(), whole[done].tolist(), strict=True)]
        number = np.cumsum(~with_spans) - 1
        pick = np.flatnonzero(~with_spans[code])
        columns = finished(of, pick, ends, number[code[pick]])
        out = pa.table([*columns, pa.nulls(len(pick), pa.int64()), pa.nulls(len(pick), pa.binary()), pa.nulls(len(pick), pa.binary())], names=["row", "found", "group", "rows", "texts"])
        if len(text):
            kept = np.flatnonzero(with_spans)
            number = np.cumsum(with_spans) - 1
            pick = np.flatnonzero(with_spans[code])
            edge = np.searchsorted(text, np.append(kept, n))
            spans = [np.stack([begin[a:b], end[a:b]], axis=1) - at[k] for k, a, b in zip(kept.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            texts = pa.table([one_chunk(own.column("text")).take(pa.array(kept)), pa.array([s.astype("<i8").tobytes() for s in spans], pa.large_binary()), pa.array(whole[kept])], names=["text", "spans", "whole"])
            again = pa.table([one_chunk(of.column("row")).take(pa.array(pick)), pa.array(number[code[pick]])], names=["row", "code"])
            one = pa.table([*(pa.nulls(1, t) for t in made.types), one_chunk(packs.column("group")).slice(0, 1), pa.array([_blob(again)], pa.binary()), pa.array([_blob(texts)], pa.binary())], names=out.schema.names)
            out = pa.concat_tables([out, one])
        return out

    with_packs = StructType([*result.fields]).add("group", "long").add("rows", "binary").add("texts", "binary")
    gathered = written(packs.groupBy("group").cogroup(flags.groupBy("group")).applyInArrow(gather, with_packs), f"{base}/texts")
    for done in ("packs", "twice", "sample"):
        removed(spark, f"{base}/{done}")
    release(spark)
    packs = gathered.where(F.col("group").isNotNull()).select("group", "rows", "texts")

    def suffixes(texts: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, Names]:
        own = _table(texts)
        data, at = text_buffer(one_chunk(own.column("text")))
        spans = [np.frombuffer(s, "<i8").reshape(-1, 2) + a for s, a in zip(own.column("spans").to_pylist(), at.tolist(), strict=False)]
        spans = np.concatenate(spans).astype(np.int64)
        start = ragged(spans[:, 0], spans[:, 1] - spans[:, 0])
        a, b, c = residues_of(data, start, length, points)
        return own, data, at, start, Names(mix(a << np.uint64(32) | b), c.astype(np.uint32))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in zip(batch.column("group").to_pylist(), batch.column("texts"), strict=True):
                yield suffixes(texts.as_buffer())[-1].rows(group, suffix_ranges)

    flags = packs.select("group", "texts").mapInArrow(named, NAMES).groupBy("range").applyInArrow(compared, FLAGS)
    flags = written(flags.hint("rebalance"), f"{base}/flags")
    release(spark)

    # 4: repeats of each text
    def cut(packs: pa.Table, flags: pa.Table) -> pa.Table:
        of = _table(packs.column("rows")[0].as_buffer())
        own, data, at, start, names = suffixes(packs.column("texts")[0].as_buffer())
        start = start[names.equal(flags, suffix_ranges)]
        begin, end = covered(start, length, np.searchsorted(at, start, "right"))
        edge = np.searchsorted(begin, at)
        ends = []
        for k, whole in enumerate(own.column("whole").to_pylist()):
            a, b = int(at[k]), int(at[k + 1])
            runs = (np.zeros(1, np.int64), np.array([b - a])) if whole else (begin[edge[k] : edge[k + 1]] - a, end[edge[k] : edge[k + 1]] - a)
            ends.append(finish(data[a:b], *runs))
        code = np.asarray(one_chunk(of.column("code")), np.int64)
        return pa.table(finished(of, np.arange(len(code)), ends, code), schema=made)

    rest = packs.groupBy("group").cogroup(flags.groupBy("group")).applyInArrow(cut, result)
    return gathered.where(F.col("group").isNull()).select("row", "found").union(rest)


def digest(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 of a text without its repeats."""
    sha, at, data = hashlib.sha256(), 0, memoryview(text)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        sha.update(data[at:a])
        at = b
    sha.update(data[at:])
    return len(text), int((ends - begins).sum()), len(begins), sha.hexdigest()


def without_repeats(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[str, int]:
    """The text without its repeats, and how many bytes went; a character that a run holds in part stays whole."""
    raw, out, at, gone = text.tobytes(), [], 0, 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at, gone = b, gone + b - a
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace"), gone


def removed_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row: see repeats()."""
    found = repeats(docs, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", text_col=text_col, keep=(id_col,))
    return found.select(F.col("row").getField(id_col).alias("doc_id"), "found.*")
