"""Token counts by a whole-token shortcut.

Offline, every vocabulary string that closes a word is encoded alone; those that
give exactly one token are proven whole tokens. A pre-token that is one of them
counts 1 without any merge; only the others run through the merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemill.llm.common import encoded_words, sliced, spans_of_words, sums_between, text_buffer

#: A worker's memo of word counts begins anew at this size; it only saves time.
MEMO_WORDS = 400_000


class WordCounter:
    """Counts the tokens of words, that is, of what ASCII white space separates.

    The vocabulary's normalizer and pre-tokenizer never join text across white
    space, so counts of words add up to the count of a text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalizer, self.pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self.proven()
        self.plain = {w for w in self.whole if w.isascii() and w.isalpha() and w.islower()}
        self.memo: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def proven(self) -> frozenset[str]:
        """Vocabulary strings (in the byte alphabet, without the word end) that encode alone as one token."""
        ends = (w[: -len("</w>")] for w in self.tokenizer.get_vocab(with_added_tokens=False) if w.endswith("</w>"))
        return frozenset(w for w in ends if w and len(self.model.tokenize(w)) == 1)

    def merge(self, pre_token: str) -> int:
        n = self.merged.get(pre_token)
        if n is None:
            if len(self.merged) >= MEMO_WORDS:
                self.merged.clear()
            n = self.merged[pre_token] = len(self.model.tokenize(pre_token))
        return n

    def word(self, word: str) -> int:
        if word in self.plain:
            return 1
        if any(s in word for s in self.special):
            return len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        whole, n = self.whole, 0
        for pre_token, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word)):
            n += 1 if pre_token in whole else self.merge(pre_token)
        return n

    def words(self, words: list[str]) -> np.ndarray:
        memo, out = self.memo, np.empty(len(words), np.int64)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for i, w in enumerate(words):
            n = memo.get(w)
            if n is None:
                n = memo[w] = self.word(w)
            out[i] = n
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row; a null text is empty: no bytes, no tokens.

    One pass without a shuffle. Equal rows give equal rows; special strings inside
    a text count as the library takes them by default. Memory: a slice of
    texts and memos of bounded size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(path)
        for batch in sliced(batches):
            data, at = text_buffer(batch.column("text"))
            begin, end, first = spans_of_words(data, at)
            words, codes = encoded_words(data, begin, end)
            n = sums_between(by.words(words.cast(pa.large_string()).to_pylist())[codes], first)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
