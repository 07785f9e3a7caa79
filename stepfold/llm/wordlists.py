"""Words of whole blocks of texts: where they lie, end to end, and as numbers, by numpy and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stepfold.llm.common import ranges

#: Bytes of words that white space parts, and of terms: ASCII letters and digits, and all of any other character.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Each byte, ASCII capitals in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, starts: np.ndarray, of_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and how many words each row has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    word = of_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    before = np.concatenate([[False], word[:-1]]) & ~cut[:-1]
    after = np.concatenate([word[1:], [False]]) & ~cut[1:]
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return first, last, np.diff(np.searchsorted(first, starts))


def spaced(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end with one space after each, and where each starts there (one more than words)."""
    lengths = last - first + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = data[np.minimum(ranges(first, lengths), max(len(data) - 1, 0))]
    out[at[1:] - 1] = 32
    return out, at


def strings(data: np.ndarray, starts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The byte ranges between the starts as Arrow values."""
    starts = np.ascontiguousarray(starts, np.int64)
    return pa.LargeBinaryArray.from_buffers(kind or pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each byte range, the same for equal ones, and the distinct ranges by number."""
    if len(starts) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    coded = strings(data, starts).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
