"""Token counts, encoding, shards and quality rules against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, prose, same, texts
from tidemill.llm import bpe, quality_rules, sstable, token_counts
from tidemill.llm.common import sliced

PARTS = ["a", "B", "é", "ß", " ", "  ", "　", "'s", "1", "²", "<|endoftext|>", "!!", "日本", "́", "\xa0", "\n", "\t", "\x1c", "\x85", "🙂", "Hello", " world", ".", ","]


def noise(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_token_counts_match_the_library(spark):
    library = Tokenizer.from_file(token_counts.word_bpe())
    rows = texts() + [(1000 + i, t, "en", "s") for i, t in enumerate(noise(300, 1))]
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, _, _ in rows]
    same(token_counts.token_counts(documents(spark, rows), token_counts.word_bpe(), 50), expected)
    assert token_counts.token_counts(documents(spark, []), token_counts.word_bpe(), 50).count() == 0


def test_whole_tokens_are_proven():
    by = token_counts.counter(token_counts.word_bpe())
    assert len(by.whole) > 10_000
    assert all(len(by.tokenizer.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(by.plain)[::97])


def test_tree_encoding_matches_the_library(spark):
    path, pattern = bpe.multilingual()
    by = bpe.coder(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=by.ranks, special_tokens={})
    rows = texts() + [(1000 + i, t, "en", "s") for i, t in enumerate(noise(300, 2))]
    expected = []
    for i, t, _, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        expected.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.round_trip(documents(spark, rows), path, pattern), expected)
    both = bpe.decode(bpe.encode(documents(spark), path, pattern), path, pattern).select("text", "decoded").collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both)
    assert bpe.round_trip(documents(spark, []), path, pattern).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(documents(spark), path, pattern, into="size")


def test_tree_of_long_pieces():
    by = bpe.coder(*bpe.multilingual())
    library = tiktoken.Encoding("own", pat_str=by.pattern.pattern, mergeable_ranks=by.ranks, special_tokens={})
    r = random.Random(5)
    for piece in [b"a" * 3000, b"ab" * 999, bytes(r.choice(b"abtheion\xc3\xa9") for _ in range(4000)), *(bytes(r.choice(b"abtheion \xc3\xa9") for _ in range(r.randint(1, 90))) for _ in range(1500))]:
        expected = library._encode_single_piece(piece)
        assert by.piece(piece) == expected
        assert by.merged_long(piece) == by.tree(piece)


def test_shards_read_back(spark):
    library = Tokenizer.from_file(sstable.byte_bpe())
    rows = texts() + [(1000 + i, t, "en", "s") for i, t in enumerate(noise(200, 3))]
    encoded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _, _ in rows]
    # equal identifiers by the hash of their texts
    hashed = {r["text"]: r["h"] for r in documents(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashed[rows[k][1]]))
    encoded = [encoded[k] for k in order]
    start, expected = 0, []
    for i, ids in encoded:
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(sstable.written_and_read(documents(spark, rows), sstable.byte_bpe(), 2), expected)
    assert sstable.written_and_read(documents(spark, []), sstable.byte_bpe(), 2).count() == 0


def test_shard_lookup_and_damage():
    out = pa.BufferOutputStream()
    w = sstable.Writer(out)
    r = random.Random(3)
    ids = {i: np.array([r.randrange(70_000) for _ in range(r.randint(0, 60))], np.uint32) for i in r.sample(range(-(10**9), 10**9), 4000)}
    w.add(sstable.key_of(None, 0), np.array([1, 2], np.uint32))
    for i in sorted(ids):
        w.add(sstable.key_of(i, 0), ids[i])
    with pytest.raises(ValueError):
        w.add(sstable.key_of(min(ids), 0), ids[min(ids)])
    w.close()
    data = out.getvalue()
    shard = sstable.Reader(pa.BufferReader(data))
    assert all((shard.get(sstable.key_of(i, 0)) == x).all() for i, x in ids.items())
    assert all(shard.get(sstable.key_of(i, 1)) is None for i in ids)
    assert sum(shard.may_hold(sstable.key_of(i, 1)) for i in ids) < 0.03 * len(ids)
    assert [k for k, _ in shard] == [sstable.key_of(None, 0), *(sstable.key_of(i, 0) for i in sorted(ids))]
    bad = bytearray(data.to_pybytes())
    bad[100] ^= 1
    with pytest.raises(OSError):
        list(sstable.Reader(pa.BufferReader(bytes(bad))))


def counted(t: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


def test_quality_base_counts(spark):
    line = prose(50, 12)
    rows = texts() + [(200, "\n".join([line] * 6 + [prose(51, 30)]), "en", "s"), (201, f"{line}\n{prose(52, 70)}\n{line}\n \n", "en", "s"), (202, "| # $ % & < > * " * 9, "en", "s")]
    out = quality_rules.quality(documents(spark, rows))
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(i, *counted(t or "")) for i, t, _, _ in rows])
    assert not out.where("base_failed AND kept").count()
    assert quality_rules.quality(documents(spark, [])).count() == 0


def test_quality_divergence(spark):
    def clean(seed):
        r = random.Random(seed)
        return ". ".join(" ".join(r.choice([r.choice(quality_rules.COMMON["en"]), prose(r.randrange(10**6), 1)]) for _ in range(12)).capitalize() for _ in range(9))

    junk = " | ".join(prose(900, 120).upper().split())
    rows = [(i, clean(i), "en", "s") for i in range(60)] + [(100, junk, "en", "s"), (101, " ".join(junk.split()[:30]), "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(60))
    assert not kept[100]
    assert kept[101], "short texts are guarded"


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 100, "c"])], names=["text"])
    cut = list(sliced(iter([batch]), most=12))
    assert [b.column("text").to_pylist() for b in cut] == [["a" * 10, None, ""], ["b" * 100], ["c"]]


def test_vocabulary_files_are_parameters():
    assert public_tokenizers.path("byte_bpe_50k.json") == sstable.byte_bpe()
