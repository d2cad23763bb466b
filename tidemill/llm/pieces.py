"""Ids of byte-level vocabularies for whole slices of texts at once.

A text is cut before single spaces, and before and after single line ends, between two
solid characters, and between a letter and a mark. The splitting pattern always begins
a new match there, so that the words between cuts can be encoded one by one and remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from tidemill.llm.common import ragged

#: Characters beyond ASCII that the pattern's \s may take; texts with one are cut by the pattern alone.
ODD_SPACE = regex.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")
#: Bytes on both sides of a safe cut: printable ASCII, or part of a longer character.
SOLID = np.zeros(256, dtype=bool)
SOLID[0x21:0x7F] = True
SOLID[0x80:] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
MARK = SOLID & ~LETTER
MARK[0x30:0x3A] = MARK[0x80:] = False
#: First bytes of the longer characters in ODD_SPACE.
LEAD = np.zeros(256, dtype=bool)
LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def cuts(data: np.ndarray, at: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Where words begin: at every text and at every safe cut. odd: texts that stay whole."""
    solid = SOLID[data]
    safe = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        between = solid[:-2] & solid[2:]
        safe[1:-1] = (data[1:-1] == 0x20) & between
        line = np.flatnonzero((data[1:-1] == 0x0A) & between) + 1
        safe[line] = safe[line + 1] = True
        safe[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
    inner = at[(at > 0) & (at < len(data))]
    safe[inner - 1] = False  # white space that ends a text
    safe[inner] = False  # or begins one
    inner = inner[inner + 1 < len(data)]
    safe[inner + 1] &= data[inner] != 0x0A
    for i in np.flatnonzero(odd):
        safe[at[i] : at[i + 1]] = False
    safe[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(safe)


def encoded(data: np.ndarray, at: np.ndarray, ids_of: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids (uint32) of the texts, one text after the other, and where each text's begin (one more at the end).

    ids_of gives for each distinct word its ids as little-endian unsigned 32-bit integers.
    """
    odd = np.zeros(len(at) - 1, dtype=bool)
    whole = data.tobytes()
    if LEAD[data].any():
        odd[:] = [bool(ODD_SPACE.search(whole[a:b].decode("utf-8", "replace"))) for a, b in zip(at[:-1], at[1:], strict=True)]
    begin = cuts(data, at, odd)
    offsets = np.append(begin, len(data)).astype(np.int64)
    if not len(begin):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    each = ids_of(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(each), np.uint32)
    length = np.fromiter((len(x) for x in each), np.int64, len(each)) // 4
    first = np.cumsum(length) - length
    ids = flat[ragged(first[codes], length[codes])]
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(length[codes], out=total[1:])
    return ids, total[np.searchsorted(begin, at)]
