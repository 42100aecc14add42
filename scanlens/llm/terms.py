"""Words of whole texts as Arrow strings, cut by byte class without a loop over rows.

The classes are complements of ASCII ranges, so every byte of a character above U+007F belongs to a
word and no character is cut. Strings stay exact: dictionary encoding compares them, no hash decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import PrefixHash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags: all bytes but those of the inclusive ranges ``outside``."""
    table = np.ones(256, dtype=bool)
    for low, high in outside:
        table[low:high + 1] = False
    return table


#: letters: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]``
LETTERS = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: letters and digits: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``, what ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` is after A-Z are lower-cased
LETTERS_DIGITS = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def byte_words(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column, A-Z lower-cased, and the word offsets per row: row r owns
    ``words[o[r]:o[r + 1]]``. A null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    _, offs_buf, data_buf = texts.buffers()
    offs = np.frombuffer(offs_buf, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    if data_buf is None or offs[-1] == offs[0]:
        return pa.array([], pa.large_string()), np.zeros(n + 1, np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = word[cut]  # a row begins a new word
    starts = np.nonzero(first)[0]
    # where a word begins among the bytes that are kept
    kept = np.cumsum(word)
    begins = np.append(kept[starts] - 1, kept[-1]).astype(np.int64)
    letters = _LOWER[data[word]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(begins), pa.py_buffer(letters))
    return words, np.searchsorted(starts, offs).astype(np.int64)


def string_digests(strings: pa.Array) -> np.ndarray:
    """A 64-bit digest of every string of a null-free array."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offs_buf, data_buf = strings.buffers()
    offs = np.frombuffer(offs_buf, dtype=np.int64)[strings.offset:strings.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8)[offs[0]:offs[-1]] if data_buf is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    return PrefixHash(data).spans(offs[:-1], offs[1:])
