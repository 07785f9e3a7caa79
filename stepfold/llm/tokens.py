"""Tokenizing columns of text with a tokenizers-library file.

Both public vocabularies cut a text before each run of white space that follows another character, and between
letters or digits and punctuation but apostrophes, whatever comes later, so the ids of a text are those of its
chunks end to end. Each distinct chunk is therefore encoded once and its ids are copied. The rules hold for
ASCII; a text with any other white space, or with a special token, is encoded as a whole. Chunks are remembered.

Chunks that are plain words go to the vocabulary's own merges many at a time: they are joined by a symbol that takes
part in no merge, so the merges of one word never touch another. Where the vocabulary marks the ends of words by a
suffix, the last symbol of each word is written as one character of its own instead; ids and merges stay as they are.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stepfold.llm.common import row_blocks, text_bytes

#: White space beyond ASCII, for which chunks are not cut.
OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A chunk that is one word of the model as it stands: precomposed Latin letters, maybe after one space.
PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Chunks whose ids are remembered; the memory is emptied beyond that, which changes no result.
MEMORY = 500_000
#: Rows that are handed to an encoder at once.
SLICE = 1024
#: Words that are joined for one call; short strings keep the queue of merges small.
JOINED = 1000
#: The symbol between words, and the first of those for the last bytes of words (of private use, so in no vocabulary).
_BETWEEN, _LAST = "\n", 0xE000
#: 1: ASCII letters and digits, 2: ASCII punctuation but the apostrophe, 3: ASCII white space, 0: the rest.
_KIND = np.array([1 if chr(b).isalnum() and b < 128 else 2 if 32 < b < 127 and b != 39 else 3 if b in (9, 10, 11, 12, 13, 32) else 0 for b in range(256)], np.uint8)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        self.lower = shape["normalizer"] is not None  # then white space is dropped as well
        self.whole = "|".join([OTHER_SPACE, *(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())])
        letters = np.array([ord(c) for c in bytes_to_letters()], np.uint32)
        suffix = shape["model"].get("end_of_word_suffix")
        self.words, self.between = joined_model(shape["model"], suffix, letters)
        self.letters, self.last = letters, letters if not suffix else np.arange(_LAST, _LAST + 256, dtype=np.uint32)
        self.letters[ord(_BETWEEN)] = ord(_BETWEEN)
        self._forget()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end (uint32) and the number of each row's ids. Null is empty."""
        data, starts = text_bytes(texts)
        odd = pc.match_substring_regex(pc.fill_null(texts, ""), self.whole).to_numpy(zero_copy_only=False).astype(bool)
        parts = [self._block(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], odd[a:b]) for a, b in row_blocks(starts)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _block(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind = _KIND[data]
        space = kind == 3
        cut = np.zeros(len(data) + 1, bool)
        # a letter or digit beside punctuation: 1 and 2 differ in both bits, and white space has both
        cut[1:-1] = (space[1:] > space[:-1]) | ((kind[1:] ^ kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0))
        for row in np.flatnonzero(odd):
            cut[starts[row] : starts[row + 1]] = False
        cut[starts] = True
        bounds = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        at = self._numbers(chunks.dictionary)[chunks.indices.to_numpy()]
        each = pa.ListArray.from_arrays(pa.array(self.first), pa.array(self.flat))
        upto = np.concatenate([[0], np.cumsum(np.diff(self.first)[at], dtype=np.int64)])
        return each.take(pa.array(at)).flatten().to_numpy(), np.diff(upto[np.searchsorted(bounds, starts)])

    def _forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The number of each of these distinct chunks: its ids are flat[first[number] : first[number + 1]]."""
        names = chunks.to_numpy(zero_copy_only=False)  # strings
        number = np.fromiter(map(self.memory.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(number < 0)
        if len(self.memory) + len(new) > MEMORY:
            self._forget()
            new = np.arange(len(names))
        if len(new):
            known, names = len(self.memory), names[new]
            plain = pc.match_substring_regex(chunks.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False).astype(bool)
            new = np.concatenate([new[plain], new[~plain]])
            words, rest = names[plain].tolist(), names[~plain].tolist()
            others = [x.ids for x in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
            sizes = np.fromiter(map(len, others), np.int64, len(others))
            found = [self._of_words(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            found.append((np.fromiter(chain.from_iterable(others), np.uint32, int(sizes.sum())), sizes))
            number[new] = np.arange(known, known + len(new))
            self.memory.update(zip([*words, *rest], range(known, known + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *(x for x, _ in found)])
            lengths = np.concatenate([n for _, n in found])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)]).astype(np.int32)
        return number

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = _BETWEEN.join([*words, ""])
        if self.lower:
            text = text.replace(" ", "").lower()
        data = np.frombuffer(text.encode(), np.uint8)
        end = np.flatnonzero(data == ord(_BETWEEN))
        symbols = self.letters[data]
        symbols[end - 1] = self.last[data[end - 1]]
        ids = np.array([t.id for t in self.words.tokenize(symbols.tobytes().decode("utf-32-le"))], np.uint32)
        ends = np.flatnonzero(ids == self.between)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1


def joined_model(model: dict, suffix: str | None, letters: np.ndarray):
    """The merges of `model` for words that are joined by a symbol without merges, and the id of that symbol.

    Tokens that end with the suffix get, in place of it and the byte before, the symbol of that byte as a last one.
    """
    from tokenizers.models import BPE

    number = {chr(c): i for i, c in enumerate(letters.tolist())}

    def name(token: str) -> str:
        if not suffix or not token.endswith(suffix):
            return token
        token = token.removesuffix(suffix)
        return token[:-1] + chr(_LAST + number[token[-1]])

    between = max(model["vocab"].values()) + 1
    vocab = {name(t): i for t, i in model["vocab"].items()} | {_BETWEEN: between}
    merges = [tuple(map(name, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return BPE(vocab=vocab, merges=merges, cache_capacity=0), between


def bytes_to_letters() -> list[str]:
    """The letter that byte-level models write for each byte: itself where it is printable Latin-1, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, which tasks share."""
    return Encoder(path)
