"""Token ids of texts, by a public tokenizer file, with every distinct
pre-token encoded once per Python worker.

The tokenizer splits at white space, at digits, and between letters and other
signs, and encodes each part alone.  A task therefore cuts texts into such
units as arrays of bytes, hashes them, hands only units that it has not seen
to the tokenizer, and gathers all ids by index.  A word is cut inside only
where the tokenizer is sure to cut too: words of ASCII and of the letters of
Latin-1, without apostrophe or '<' (contractions, special tokens); any other
word is one unit.  Letters of cut words are lowered first, as the tokenizer
lowers them.  ``tests/llm/test_tokens.py`` compares the ids with the
tokenizer's own on hostile texts.
"""

from __future__ import annotations

import functools

import numpy as np

from feedspark.llm.common import span_hashes

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: Units that a worker remembers before it starts anew.
MOST_UNITS = 1_000_000
#: Splits a list of units in one call to the tokenizer; '<' units go alone.
MARK = "<|startoftext|>"

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[128:] = ODD
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = ODD
_CLASS[[39, 60]] = ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes in order, and the unit of each
        self.unit = np.zeros(0, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the offsets (n + 1) of each row's."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        low, starts, stops = units(data, offs)
        rows = np.searchsorted(offs, starts, "right") - 1
        unit = self._units(low, starts, stops)
        counts = self.counts[unit]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[unit] - (ends - counts), counts)
        upto = np.concatenate([[0], ends])[np.searchsorted(rows, np.arange(len(offs)))]
        return self.ids[at], upto

    def _units(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        import pandas as pd

        codes, uniques = pd.factorize(span_hashes(data, starts, stops))
        if len(self.known) > MOST_UNITS:
            self.clear()
        at = np.searchsorted(self.known, uniques)
        new = np.ones(len(uniques), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != uniques[inside]
        if new.any():
            first = np.empty(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            pick = np.flatnonzero(new)
            pick = pick[np.argsort(uniques[pick])]
            raw = data.tobytes()
            n = len(self.known)
            self._learn(n, [raw[a:b].decode("utf-8", "replace") for a, b in
                            zip(starts[first[pick]].tolist(), stops[first[pick]].tolist())])
            self.unit = np.insert(self.unit, at[pick], np.arange(n, n + len(pick)))
            self.known = np.insert(self.known, at[pick], uniques[pick])
            at = np.searchsorted(self.known, uniques)
        return self.unit[at][codes]

    def _learn(self, n: int, texts: list[str]) -> None:
        """Encode new units; they get the numbers from n on."""
        alone = [i for i, t in enumerate(texts) if "<" in t]
        plain = [t for t in texts if "<" not in t] if alone else texts
        flat, lens = [], []
        for lo in range(0, len(plain), 2000):
            part = plain[lo:lo + 2000]
            ids = np.array(self.tokenizer.encode(MARK.join(part), add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            lens.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            flat.append(np.delete(ids, marks))
        for i in alone:
            flat.append(np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32))
            lens.append(np.array([len(flat[-1])]))
        ids, counts = np.concatenate(flat), np.concatenate(lens).astype(np.int64)
        places = n + np.concatenate([np.setdiff1d(np.arange(len(texts)), alone), np.array(alone, np.int64)]).astype(np.int64)
        self.starts, self.counts = _room(self.starts, n + len(texts)), _room(self.counts, n + len(texts))
        self.starts[places] = self.used + np.cumsum(counts) - counts
        self.counts[places] = counts
        self.ids = _room(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, lowered in words that are cut, and each unit's start and end."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead, tail = (x[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)] for x in (lead, tail))
    kind[lead] = kind[lead + 1] = LETTER
    space = kind == SPACE
    first = np.zeros(len(data), bool)  # of a word
    first[0] = True
    first[1:] = space[:-1]
    first[offs[:-1][offs[:-1] < len(data)]] = True
    first &= ~space
    starts = np.flatnonzero(first)
    if not len(starts):
        return data, starts, starts
    odd_at = np.flatnonzero(kind == ODD)
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, odd_at, "right") - 1] = True
    odd_word = np.zeros(len(data), bool)
    if whole.any():  # marks the bytes of words that stay whole
        nexts = np.append(starts[1:], len(data))
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts[whole]] += 1
        mark[nexts[whole]] -= 1
        odd_word = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    low = np.where(odd_word, data, _LOWER[data])
    up = lead[(tail <= 0x9E) & ~odd_word[lead]]
    low[up + 1] += 0x20
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & ~odd_word[1:]
    cut |= first
    cut &= ~space
    starts = np.flatnonzero(cut)
    last = np.zeros(len(data), bool)
    last[:-1] = cut[1:] | space[1:]
    ends = offs[1:]
    last[ends[ends > 0] - 1] = True
    last &= ~space
    return low, starts, np.flatnonzero(last) + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return UnitEncoder(path)
