"""Byte-level BPE encoding and decoding by a monoid tree reduction.

The elements are (bytes, ids) with the encoding of joined bytes as the product.
A piece is encoded by halves; two neighbours are joined by encoding again a
window around their boundary, which grows until the tokens outside are proven
stable. The proof is local: a sequence of tokens is the encoding of its bytes
exactly if every two adjacent tokens, encoded together, stay these two tokens.
Inside each half and inside the window this holds already, so only the window's
two edges are looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemill.llm.common import Memo, ragged, sliced, text_buffer
from tidemill.llm.pieces import encoded

#: Pieces up to this many bytes are merged directly: the leaves of the tree.
LEAF_BYTES = 12
#: Memos begin anew at this size; they only save time.
MEMO_WORDS, MEMO_PAIRS = 150_000, 300_000
#: Ids that one leaf of the decoding tree joins.
LEAF_IDS = 1 << 16


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.length = np.fromiter((len(t) for t in self.tokens), np.int64, size)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.memo = Memo(MEMO_WORDS)
        self.stays: dict[tuple[int, int], bool] = {}

    # encoding

    def merged(self, piece: bytes) -> list[int]:
        """The lowest-ranked pair merges first, the leftmost of equals; meant for short pieces."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while pairs:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        return [ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same merges from a queue, for windows that have grown."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(queue, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(queue, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b, encoded together, stay as they are."""
        known = self.stays.get((a, b))
        if known is None:
            if len(self.stays) >= MEMO_PAIRS:
                self.stays.clear()
            both = self.tokens[a] + self.tokens[b]
            known = self.stays[a, b] = (self.merged(both) if len(both) <= 64 else self.merged_long(both)) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        m = n = 1
        while True:
            window = b"".join([self.tokens[t] for t in (*left[len(left) - m :], *right[:n])])
            inner = self.merged(window) if len(window) <= 64 else self.merged_long(window)
            holds = m == len(left) or self.stable(left[-m - 1], inner[0])
            held = n == len(right) or self.stable(inner[-1], right[n])
            if holds and held:
                return left[: len(left) - m] + inner + right[n:]
            m = m if holds else min(len(left), 2 * m)
            n = n if held else min(len(right), 2 * n)

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def words(self, words: list[bytes]) -> list[bytes]:
        memo = self.memo
        young, old = memo.young.get, memo.old.get
        out = [young(w) or old(w) for w in words]
        for i, ids in enumerate(out):
            if ids is None:
                found: list[int] = []
                for p in self.pattern.findall(words[i].decode("utf-8", "replace")):
                    found += self.piece(p.encode())
                out[i] = np.array(found, np.uint32).tobytes()
        memo.keep(words, out)
        return out

    # decoding

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: leaves are looked up, neighbours concatenated up the tree."""
        leaves = [self.flat[ragged(self.first[x], self.length[x])].tobytes() for x in (ids[i : i + LEAF_IDS] for i in range(0, len(ids), LEAF_IDS))]
        while len(leaves) > 1:
            leaves = [b"".join(leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else b""


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> TreeBPE:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeBPE(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of the ids (array of int) of its texts; a null or empty text has none.

    One pass without a shuffle; every other column passes through. `into` must not be a column of docs.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path, pattern)
        for batch in sliced(batches, text_col):
            ids, first = encoded(*text_buffer(batch.column(text_col)), by.words)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, into])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with a binary column of the bytes of its ids; null ids stand for none."""
    if into in rows.columns:
        raise ValueError(f"{into} is a column already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path, pattern)
        for batch in batches:
            made = [by.decoded(np.asarray(x.values, dtype=np.int64)) if x.is_valid else b"" for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, into])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encode and decode in one pass, without a column of ids.

    A null text is empty: no tokens, and both digests are those of no bytes.
    Equal rows give equal rows. Memory: a slice of texts with its ids, and memos of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path, pattern)
        for batch in sliced(batches):
            ids, first = encoded(*text_buffer(batch.column("text")), by.words)
            digests, back = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = ids[a:b]
                digests.append(hashlib.sha256(own.astype("<u4", copy=False).tobytes()).hexdigest())
                back.append(hashlib.sha256(by.decoded(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(first)), pa.array(digests, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def multilingual() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
