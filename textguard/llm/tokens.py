"""Token ids of texts by a public tokenizer file, word by word.

A byte-level BPE never merges across the start of a word that follows a
non-space character, so a text is the concatenation of its words' ids, each
word with the one space before it. Words repeat, so a task encodes each
distinct word once and joins the ids as bytes. Nor does it merge a letter with the
sign after it: what stands before a word's first sign and the rest are encoded
apart, so "end", "end," and "end." are one word. A text that holds the string of
an added token (``<|endoftext|>``) is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spread_ranges

#: File of the tokenizer: a name among the public tokenizers, or a path.
TOKENIZER = "byte_bpe_50k.json"
# A space is a safe cut only after a character that no tokenizer takes for white space.
_SPACES = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
_CUT = re.compile(rf"(?<=[^{_SPACES}]) ")
#: The same for RE2: a space at the start or after a character that is no safe one.
_UNSAFE_SPACE = "^ |[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in (
    (0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF))) + "] "
#: ASCII letters, and signs that no tokenizer joins to the letter before them (it may an apostrophe).
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_SIGN[list(b"\n!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~")] = True
#: Words of one of the two generations a worker keeps, and the longest word
#: kept (bounds on memory alone).
KEPT_WORDS, KEPT_LENGTH = 400_000, 48
#: Text bytes encoded together.
AT_ONCE = 4 << 20


@cache
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    if not os.path.isabs(name):
        import public_tokenizers
        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def _flat(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, where each cell's begin, how many they are)."""
    n = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
    return np.frombuffer(b"".join(cells), "<u4"), np.cumsum(n) - n, n


def _cut_signs(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(words before their first sign, which have more, the rest of those). The
    first ASCII character that is no letter cuts if it is a sign, comes after an
    ASCII or Latin-1 letter and the rest is short."""
    off = np.frombuffer(words.buffers()[1], "<i8")[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    other = np.append(np.flatnonzero((data < 128) & ~_LETTER[data]), len(data))
    first = other[np.searchsorted(other, off[:-1])]
    more = np.flatnonzero((first > off[:-1]) & (first < off[1:]) & (off[1:] - first <= KEPT_LENGTH))
    at = first[more]
    before, lead = data[at - 1], np.where(at - 2 >= off[more], data[at - 2], 0)
    more = more[_SIGN[data[at]] & (_LETTER[before] | (lead == 0xC3) & (before != 0x97) & (before != 0xB7))]
    end = off[1:].copy()
    end[more] = first[more]

    def strings(start: np.ndarray, size: np.ndarray) -> pa.Array:
        places = np.concatenate(([0], np.cumsum(size)))
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(places.astype("<i8").tobytes()), pa.py_buffer(data[spread_ranges(start, size)].tobytes()))
    return strings(off[:-1], end - off[:-1]), more, strings(end[more], off[1:][more] - end[more])


class Encoder:
    """``encode(texts)``: the ids of all texts and where each text's begin."""

    def __init__(self, name: str = TOKENIZER):
        self.tokenizer = tokenizer(name)
        size = self.tokenizer.get_vocab_size()
        #: Ids whose token begins with a space: each word's first one, and no other.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        #: Strings that the library finds in a text before it cuts words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct words, each with the space before it."""
        if len(self.words) > KEPT_WORDS:
            self.words, self.older = {}, self.words
        kept, older = self.words, self.older
        got = list(map(kept.get, distinct))
        odd, plain = [], []
        for i in [i for i, b in enumerate(got) if b is None]:
            w = distinct[i]
            b = got[i] = older.get(w)
            if b is not None:
                kept[w] = b
            elif not w or " " in w or len(w) > KEPT_LENGTH:
                odd.append(i)
            else:
                plain.append(i)
        for lo in range(0, len(plain), 500):
            part = plain[lo:lo + 500]
            ids = self._ids([" " + " ".join([distinct[i] for i in part])])[0]
            raw, at = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(at) != len(part):  # a space was merged with something else
                odd += part
                continue
            at.append(len(raw))
            for i, a, b in zip(part, at, at[1:], strict=False):
                got[i] = kept[distinct[i]] = raw[a:b]
        for i, ids in zip(odd, self._ids([" " + distinct[i] for i in odd]) if odd else (), strict=True):
            got[i] = ids.tobytes()
        return got

    def _rests(self, distinct: list[str]) -> list[bytes]:
        """Ids of what follows the first letters of words, as it stands."""
        if len(self.rests) > KEPT_WORDS:
            self.rests = {}
        new = [r for r in distinct if r not in self.rests]
        self.rests.update((r, i.tobytes()) for r, i in zip(new, self._ids(new) if new else (), strict=True))
        return [self.rests[r] for r in distinct]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words one after the other, the ids' number for each)."""
        letters, more, rests = _cut_signs(words)
        letters, rests = letters.dictionary_encode(), rests.dictionary_encode()
        cells = self._words(letters.dictionary.to_pylist())
        at = np.full((len(words), 2), len(cells))  # two parts of each word, the second mostly empty
        at[:, 0] = letters.indices.to_numpy()
        at[more, 1] += 1 + rests.indices.to_numpy()
        ids, start, n = _flat(cells + [b""] + self._rests(rests.dictionary.to_pylist()))
        return ids[spread_ranges(start[at.ravel()], n[at.ravel()])], n[at].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: strings, none null. Returns (ids, offsets): text i has
        ``ids[offsets[i]:offsets[i + 1]]``."""
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        texts = texts.cast(pa.large_string())
        # texts with a space that is no safe cut are cut with care
        bad = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE_SPACE).to_numpy(zero_copy_only=False))
        whole = np.zeros(len(texts), bool)  # texts with an added token's string
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if whole.any():
            all_texts, texts = texts, pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
            bad = bad[~whole[bad]]
        parts = pc.split_pattern(texts, " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(off[0], off[-1] - off[0])
        off -= off[0]
        if len(bad):
            lists = {i: _CUT.split(texts[i].as_py()) for i in bad.tolist()}
            pieces, counts, lo = [], np.diff(off), 0
            for i in bad.tolist():
                pieces += [words.slice(off[lo], off[i] - off[lo]), pa.array(lists[i], pa.large_string())]
                counts[i], lo = len(lists[i]), i + 1
            pieces.append(words.slice(off[lo]))
            words = pa.concat_arrays(pieces)
            off = np.concatenate(([0], np.cumsum(counts)))
        code = words.dictionary_encode()
        entry = code.indices.to_numpy().astype(np.int64)
        ids, size = self._distinct(code.dictionary)
        # a text's first word has no space before it
        heads = words.take(pa.array(off[:-1]))
        if whole.any():
            heads = pc.if_else(pa.array(whole), all_texts, heads)
        heads = heads.dictionary_encode()
        entry[off[:-1]] = len(size) + heads.indices.to_numpy()
        first, _, n = _flat([i.tobytes() for i in self._ids(heads.dictionary.to_numpy(zero_copy_only=False).tolist())])
        size = np.concatenate((size, n))
        start = np.cumsum(size) - size
        n = size[entry]
        ids = np.concatenate((ids, first))[spread_ranges(start[entry], n)]
        return ids, np.concatenate(([0], np.cumsum(n)))[off]

    def batches(self, batch: pa.RecordBatch, text: int):
        """Parts of a batch of about ``AT_ONCE`` text bytes: (part, ids, offsets)."""
        texts = pc.fill_null(batch.column(text), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = int(size[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + AT_ONCE, side="right")))
            yield batch.slice(lo, hi - lo), *self.encode(texts.slice(lo, hi - lo))
            lo = hi


@cache
def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder; its words go when the worker turns to another
    operator (``common.forget_words``)."""
    return Encoder(name)
