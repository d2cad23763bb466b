"""Near copies: operator 6 at five-word shingles and a similarity (Jaccard, of sets of shingles) of at least 0.8, all of them.

The Gray-order index finds fingerprints at two or fewer differing bits. At a similarity
of 0.8 fingerprints of 64 bits differ in ten bits on average, and no masks tell pairs
so far apart from chance. So what the index links is checked first, and pairs beyond its radius are
sought among texts that share a key (prefix filtering): shingles have one order for all
texts, those that are common last, and a text's keys are the first n - ceil(0.8 n) + 1 of
its n shingles. Two sets that are similar enough share one of these, whatever the order is; and what stands behind
the first one they share, on both sides, must be enough (the positional filter), so texts that share
little but a common passage aren't candidates. Sets whose marks (a bit turned by each shingle) differ in more bits than sets
so similar can differ in shingles aren't either. Of the candidates those go whose fingerprints, of WORDS times 64 bits here, differ in more than FAR bits: 39 are expected
at the least similarity, and more than 80 have a probability of about 1e-10; texts that merely share a
passage differ in about 100. Sets of at most SMALL shingles together are spared that, as one shingle more
turns many of their bits: 48 on average between four shingles and these with a fifth, and 81 in one of 200 000 such pairs that were
drawn. Each other candidate's similarity is computed from the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm.common import encoded_words, input_bytes, pieces_for, ragged, release, removed, sliced, spans_of_words, text_buffer, work_dir, written
from tidemill.llm.components import components
from tidemill.llm.simhash import LOWER, SEED, links, majority_of_runs
from tidemill.llm.suffix_dedup import ascending, dealt, values_of

#: Words of a shingle; the least similarity is four fifths; 64-bit words of a fingerprint, and differing bits beyond which a pair isn't looked at.
SHINGLE, PART, WHOLE, WORDS, FAR = 5, 4, 5, 4, 80
PRINTS = tuple(f"fp{i}" for i in range(WORDS))
#: Shingles of two sets up to which their fingerprints aren't looked at: marks tell them apart, and no pair is lost.
SMALL = 64
#: A set's marks: of so many times 64 bits, each shingle turns one. Sets whose marks differ in h bits differ in h shingles at least.
MARKS = tuple(f"m{i}" for i in range(4))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Slots in which a sample's shingles are counted, bytes of text in the sample, and the least count that matters.
SLOTS, SAMPLE_BYTES, COMMON = 1 << 23, 32 << 20, 2
#: Bytes of text that a Python worker looks at together, and MB of (compressed) input for each range of keys.
AT_ONCE, RANGE_MB = 2 << 20, 8
#: Sets with a key up to which all pairs of them are compared at once, and the share of sets of fuller keys (one in so many) that a turn must link to go on with turns.
FEW, LITTLE = 17, 20
#: Members of a key that the others are compared with in a turn.
ANCHORS = 4


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit names of every text's shingles in ascending order, and where each text's begin (one more at the end).

    A text of fewer words is one shingle; one without words has none. Words are lower-cased (ASCII).
    """
    begin, end, first = spans_of_words(data, at)
    words, code = encoded_words(LOWER[data], begin, end)
    named = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.to_pylist()), np.uint64, len(words))[code]
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    lead, stop = ragged(first[:-1], n), np.repeat(first[1:], n)
    names = np.zeros(len(lead), np.uint64)
    for k in range(shingle):
        here = lead + k < stop
        names[here] = names[here] * MULTIPLIER + named[lead[here] + k]
    names ^= names >> np.uint64(32)
    names *= MULTIPLIER
    names ^= names >> np.uint64(29)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((names, text))
    names = names[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    return names[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_names(names: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    raw = names.tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(raw[8 * a : 8 * b], SEED) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)), np.uint64, len(edge) - 1).view(np.int64)


def prints(names: np.ndarray, edge: np.ndarray) -> list[pa.Array]:
    """The fingerprints of sets, a column for each of their words; the first is operator 6's over five-word shingles."""
    more = names[:, None] ^ (np.arange(WORDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    more[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
    more[:, 1:] ^= more[:, 1:] >> np.uint64(31)
    more[:, 1:] *= np.uint64(0x94D049BB133111EB)
    more[:, 1:] ^= more[:, 1:] >> np.uint64(30)
    return [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in majority_of_runs(more, edge).T]


def marks(names: np.ndarray, edge: np.ndarray) -> list[pa.Array]:
    n, bits = len(edge) - 1, 64 * len(MARKS)
    at = np.repeat(np.arange(n), np.diff(edge)) * bits + (names >> np.uint64(40)).view(np.int64) % bits
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in np.packbits(odd, axis=1).view(np.uint64).T]


def commonness(docs: DataFrame) -> np.ndarray:
    """For each slot of shingle names, how common they are in a sample (a logarithm; 0: rare). Bounded, whatever the corpus is.

    It only orders shingles: any order gives the same links.
    """
    share = max(1, input_bytes(docs) // SAMPLE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int32)
        for batch in sliced(batches, "text", AT_ONCE):
            names, _ = shingle_sets(*text_buffer(batch.column("text")))
            slot, n = np.unique(names & np.uint64(SLOTS - 1), return_counts=True)
            seen[slot.view(np.int64)] += n.astype(np.int32)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["slot", "n"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    found = sample.mapInArrow(run, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[np.asarray(found.column("slot"))] = np.log2(np.asarray(found.column("n"))).astype(np.uint8)
    return out


def _once(names: np.ndarray, edge: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets (not empty), each once: their names, sizes, and the shingles' places."""
    named, at = np.unique(named, return_index=True)
    size = np.diff(edge)[at]
    named, at, size = named[size > 0], at[size > 0], size[size > 0]
    return named, size, ragged(edge[at], size)


#: A row of described() is a document's (id: its set's name), a range of a slice's keys with the sets that have them, or one key that several sets of a slice have.
DESCRIBED = f"k1 long, k2 long, id long, size int, {', '.join(f'{p} long' for p in (*PRINTS, *MARKS))}, range int, keys binary, owners binary, places binary, several binary, key long, place int"


def described(rows: DataFrame, order: np.ndarray, ranges: int) -> DataFrame:
    """What one pass over the texts (columns doc_id, k1, k2, text) gives: see DESCRIBED, and doc_id.

    A slice sends a key once; where several of its sets have it, they are also rows of their own, so
    that no range holds more of a hot key than a set for each slice.
    """
    shared = rows.sparkSession.sparkContext.broadcast(order)
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(DESCRIBED).fields])
    names_of = schema.fieldNames()

    def made(n: int, **columns: pa.Array) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([columns[c].cast(types.field(c).type) if c in columns else pa.nulls(n, types.field(c).type) for c in names_of], names=names_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", AT_ONCE):
            names, edge = shingle_sets(*text_buffer(batch.column("text")))
            own = set_names(names, edge)
            size = np.diff(edge)
            yield made(batch.num_rows, doc_id=batch.column("doc_id"), k1=batch.column("k1"), k2=batch.column("k2"), id=pa.array(own), size=pa.array(size.astype(np.int32)), **dict(zip((*PRINTS, *MARKS), [*prints(names, edge), *marks(names, edge)], strict=True)))
            named, size, place = _once(names, edge, own)
            mine = names[place]
            owner = np.repeat(np.arange(len(size)), size)
            mine = mine[np.lexsort((mine, shared.value[(mine & np.uint64(SLOTS - 1)).view(np.int64)], owner))]
            n = size - -(-PART * size // WHOLE) + 1
            begin = np.cumsum(size) - size
            at = ragged(begin, n)
            key, of, at = mine[at], np.repeat(named, n), at - np.repeat(begin, n)
            by = np.argsort(key, kind="stable")
            key, of, at = key[by], of[by], at[by]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.flatnonzero(new)
            several = np.diff(np.append(lead, len(key))) > 1
            again = np.repeat(several, np.diff(np.append(lead, len(key))))
            if again.any():
                yield made(int(again.sum()), key=pa.array(key[again].view(np.int64)), id=pa.array(of[again]), place=pa.array(at[again]))
            key, of, at = key[lead], of[lead], at[lead]
            edges = np.searchsorted(dealt(key, ranges), np.arange(ranges + 1))
            out = [(r, ascending(key[a:b]), of[a:b].astype("<i8").tobytes(), at[a:b].astype("<i4").tobytes(), np.packbits(several[a:b]).tobytes()) for r, a, b in zip(range(ranges), edges[:-1].tolist(), edges[1:].tolist(), strict=True) if a < b]
            if out:
                yield made(len(out), **{c: pa.array([o[i] for o in out]) for i, c in enumerate(("range", "keys", "owners", "places", "several"))})

    return rows.mapInArrow(run, schema)


def _in_two(table: pa.Table) -> pa.Table:
    """key, id and place of the keys of one range that two sets have."""
    own = [values_of(x) for x in table.column("keys").to_pylist()]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("several").to_pylist(), own, strict=True)]).astype(bool)
    owner = np.frombuffer(b"".join(table.column("owners").to_pylist()), "<i8")
    place = np.frombuffer(b"".join(table.column("places").to_pylist()), "<i4")
    key = np.concatenate(own)
    by = np.argsort(key, kind="stable")
    key, owner, place, several = key[by], owner[by], place[by], several[by]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(lead, len(key)))
    two = np.repeat(np.logical_or.reduceat(several, lead) | (np.minimum.reduceat(owner, lead) != np.maximum.reduceat(owner, lead)), n)
    return pa.table([pa.array(key[two].view(np.int64)), pa.array(owner[two]), pa.array(place[two])], names=["key", "id", "place"])


def bodies(texts: DataFrame) -> DataFrame:
    """id and shingles (their names) of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", AT_ONCE):
            names, edge = shingle_sets(*text_buffer(batch.column("text")))
            named, size, place = _once(names, edge, set_names(names, edge))
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[place].view(np.int64)))], names=["id", "shingles"])

    return texts.select("text").mapInArrow(run, "id long, shingles array<long>")


def _fit(a: str, b: str) -> F.Column:
    """Sizes, places of a shared key and marks at which the similarity can be reached, and fingerprints that aren't too far apart (but of small sets)."""
    size, place = (lambda x: F.col(f"size{x}")), (lambda x: F.col(f"place{x}"))
    room = F.least(size(a) - place(a), size(b) - place(b))
    apart = lambda words: reduce(lambda s, p: s + F.bit_count(F.col(f"{p}{a}").bitwiseXOR(F.col(f"{p}{b}"))), words, F.lit(0))
    both = size(a) + size(b)  # at the least similarity this part of them differs: (whole - part) / (whole + part)
    return ((WHOLE + PART) * room >= PART * both) & ((WHOLE + PART) * apart(MARKS) <= (WHOLE - PART) * both) & ((both <= SMALL) | (apart(PRINTS) <= FAR))


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128 bits that equal rows share), text."""
    return docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("k2"), "text")


def similar_links(rows: DataFrame, docs: DataFrame, ranges: int, base: str) -> DataFrame:
    """a, b: enough links between sets (by name) that their components are those of all pairs at the least similarity.

    rows: a written described(); base: a folder for what is worked on. What the Gray-order index links is checked first. Then members of each key
    that more than FEW have are compared with some of them (the one that has most links, the others at random); a key whose members are all linked by then is done,
    so a group of near copies doesn't multiply, however many smaller keys there are beside it. When that finds little more, or every key has few pairs left, all pairs
    that share a key and aren't linked yet are compared.
    """
    spark = docs.sparkSession
    step = count()
    path = lambda what: f"{base}/{next(step)}-{what}"
    attributes = rows.where("k1 is not null and size > 0").groupBy("id").agg(F.min(F.struct("k1", "k2", "size", *PRINTS, *MARKS)).alias("x"))
    attributes = written(attributes.select("id", "x.*"), path("sets"))
    known: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        """Those pairs that are similar enough; the sets of texts are made when they are first asked for."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs, path("pairs"))
        release(spark)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        for sets in known:
            ids = ids.join(sets.select("id"), "id", "left_anti")
        wanted = attributes.join(ids, "id").select("k1", "k2")
        texts = row_keys(docs).select("k1", "k2", "text").join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        known.append(written(bodies(texts), path("shingles")))
        release(spark)
        sets = known[0]
        for more in known[1:]:
            sets = sets.union(more)
        left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
        both = F.size(F.array_intersect("of_a", "of_b"))
        good = pairs.join(left, "a").join(right, "b").where((WHOLE + PART) * both >= PART * (F.size("of_a") + F.size("of_b")))
        good = written(good.select("a", "b"), path("links"))
        release(spark)
        return good

    # the index: equal fingerprints, and those that it links
    first = attributes.select("id", F.col(PRINTS[0]).alias("fp"))
    distinct = written(first.groupBy("fp").agg(F.min("id").alias("id")), path("fingerprints"))
    equal = first.select("fp", F.col("id").alias("b")).join(distinct.withColumnRenamed("id", "a"), "fp").where("a <> b").select("a", "b")
    near = links(distinct.select("fp")).join(distinct.select(F.col("fp").alias("a"), F.col("id").alias("id_a")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("id").alias("id_b")), "b")
    near = equal.union(near.select("id_a", "id_b"))
    for c in "ab":
        near = near.join(attributes.select(F.col("id").alias(c), F.lit(0).alias(f"place_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("size", *PRINTS, *MARKS)]), c)
    found = linked(near.where(_fit("_a", "_b")).select("a", "b"))

    # beyond its radius
    shared = rows.where("keys is not null").select("range", "keys", "owners", "places", "several").groupBy("range").applyInArrow(_in_two, "key long, id long, place int")
    shared = shared.union(rows.where("key is not null").select("key", "id", "place")).distinct()
    shared = written(shared.join(attributes, "id").select("key", "id", "place", "size", *PRINTS, *MARKS), path("shared"))
    release(spark)
    full = written(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("key"), path("full"))
    crowded = written(shared.join(full, "key"), path("crowded"))

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "place", "size", *PRINTS, *MARKS, F.coalesce("root", "id").alias("root"))

    turn, gained, used = 0, None, []
    while True:
        roots = written(components(found), path("roots"))
        for old in used:  # this turn's rows are all that goes on
            removed(spark, old)
        named = written(rooted(crowded), at := path("named"))
        parts = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), (F.pow(F.sum("n"), 2) - F.sum(F.pow("n", F.lit(2)))).alias("pairs"))  # each twice
        still = written(parts.where("pairs > 0").select("key", (F.col("pairs") > (FEW - 1) * F.col("n")).alias("many")), path("open"))
        here = written(named.join(still, "key"), left := path("rows"))
        removed(spark, at)
        release(spark)
        many = here.where("many")
        sets = many.agg(F.countDistinct("id")).first()[0]
        if not sets or gained is not None and gained * LITTLE < sets:
            break
        # the member that most links name: of many copies of one text that is the text itself, which links them all
        ends = found.select("a").union(found.select("b")).groupBy(F.col("a").alias("of")).agg(F.count("*").alias("degree"))
        ranked = many.join(ends, F.col("id") == F.col("of"), "left")
        member, mixed = F.struct("id", "place", "size", *PRINTS, *MARKS, "root"), [F.xxhash64(F.lit(ANCHORS * turn + i), "id") for i in range(ANCHORS)]
        chosen = [F.max_by(member, F.struct(F.coalesce("degree", F.lit(0)), mixed[0])), *[F.max_by(member, m) for m in mixed[1:]]]
        anchor = ranked.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("x")).select("key", F.explode("x").alias("x"))
        anchor = written(anchor.select("key", F.col("x.id").alias("a"), *[F.col(f"x.{c}").alias(f"{c}_a") for c in ("place", "size", *PRINTS, *MARKS, "root")]), at := path("anchors"))
        used = [left, at]
        good = linked(many.join(anchor, "key").where((F.col("root") != F.col("root_a")) & _fit("", "_a")).select("a", F.col("id").alias("b")))
        turn, gained = turn + 1, good.count()
        found = found.union(good)
    here = written(rooted(shared.join(full, "key", "left_anti")).union(here.drop("many")), path("unlinked"))
    removed(spark, left)
    release(spark)
    a, b = (here.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "place", "size", *PRINTS, *MARKS, "root")]) for x in "ab")
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("root_a") < F.col("root_b")) & _fit("_a", "_b"))
    return found.union(linked(rest.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs (columns doc_id, text and any others, with any names) of which each is its component's smallest doc_id; one, where rows repeat.

    Texts without words, null ones included, are copies of one another. A null doc_id stays only where its
    component has no other; of equal ones with different texts one stays, the same in every run. An empty table gives no rows.
    docs is read several times: a table, not a long plan. Memory: slices of texts of AT_ONCE bytes (or one longer text), and a range of keys.
    """
    spark = docs.sparkSession
    ranges = pieces_for(docs, RANGE_MB, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = work_dir(spark, "near-copies")
    rows = written(described(row_keys(docs), commonness(docs), ranges), f"{base}/described")
    own = rows.where("k1 is not null").select("doc_id", "k1", "k2", "id")
    roots = written(components(similar_links(rows, docs, ranges, base)), f"{base}/components")
    rooted = own.join(roots, F.col("id") == F.col("node"), "left").select("doc_id", "k1", "k2", F.coalesce("root", "id").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("x"), F.count("*").alias("n"))
    first = written(first.select(F.col("x.k1").alias("first_1"), F.col("x.k2").alias("first_2"), "n"), work_dir(spark, "near-copies-first"))
    removed(spark, base)
    release(spark)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("k2"))
    met = whole.join(first, (F.col("k1") == F.col("first_1")) & (F.col("k2") == F.col("first_2")))
    # rows that repeat are alike: only where a component has several rows, one of those that met is taken
    alone = met.where("n = 1").select("row")
    taken = met.where("n > 1").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row")
    return alone.union(taken).select("row.*")


__all__ = ["bodies", "described", "one_of_similar", "shingle_sets", "similar_links"]
