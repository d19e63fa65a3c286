"""Tokenizers kept per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np

from tidemark.llm.support import numbered


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(f"ranks:{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 letter, 1 number, 2 other, 3 white space."""
    import regex

    out = np.full(0x110000, 2, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    code = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for value, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            out[code[found.start() : found.end()]] = value
    return out


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the matches of the byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    start in each row, and the number of the first match of each row (one entry more at the end).

    A match opens where the class of character changes, save that one blank goes with the
    visible run behind it, that the last character of white space before visible text stands
    alone, and that a lone apostrophe may take one or two letters.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    where = np.flatnonzero(lead)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = np.searchsorted(where, offsets)
    n = len(code)
    kind = _classes()[code]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True
    edge[n] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    space = kind == 3
    start = change[:n].copy()
    before_visible = np.zeros(n, dtype=bool)  # white space with visible text of its row behind it
    before_visible[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= before_visible
    after_blank = np.zeros(n, dtype=bool)  # visible, with a blank of its row in front
    after_blank[1:] = (code[:-1] == 0x20) & ~edge[1:n]
    start &= space | ~after_blank
    quote = np.flatnonzero((code == 0x27) & change[:n] & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == 0)]
    if len(quote):
        one = code[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        pair = one.astype(np.uint64) * 0x110000 + two
        long = np.isin(pair, np.array([ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
        start[quote[short | long] + 1] = False
        for some, far in ((short, 2), (long, 3)):
            to = quote[some] + far
            start[to[to < n]] = True
    at = np.flatnonzero(start)
    return where[at], np.searchsorted(at, rows)


#: Bytes of one text that are encoded at once.
BLOCK = 4_000_000
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def safe_cuts(data: np.ndarray, block: int) -> list[int]:
    """Where a text may be cut, every ``block`` bytes or so: before a blank behind an ASCII letter or
    digit. A pre-token always ends there, and what follows depends on nothing before it."""
    cuts, at = [0], block
    while at < len(data):
        some = np.flatnonzero((data[at : at + 65_536] == 0x20) & _ALNUM[data[at - 1 : at + 65_535][: len(data[at : at + 65_536])]])
        if len(some):
            cuts.append(at + int(some[0]))
            at = cuts[-1] + block
        else:
            at += 65_536
    return [*cuts, len(data)]


class PieceEncoder:
    """Encodes with the tokenizers library. The model never merges across pre-tokens, so the
    ids of a text are those of its pre-tokens in a row. Each distinct pre-token is sent to the
    library once and its ids are kept under its bytes, up to ``keep`` pre-tokens, after
    which the store starts anew. A text over ``block`` bytes is encoded in parts.
    """

    def __init__(self, path: str, keep: int = 800_000, block: int = BLOCK) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.keep, self.block = keep, block
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            got = [x.ids for x in self.model.encode_batch_fast([x.decode("utf-8") for x in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
            n = len(self.place)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) > len(self.begin):
                self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
            self.ids[self.used : self.used + len(flat)] = flat
            self.begin[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(part)] = sizes
            self.place.update(zip(part, range(n, n + len(part)), strict=True))
            self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of UTF-8 rows: all ids in a row, and how many each row has."""
        if len(offsets) == 2 and len(data) > self.block:
            cuts = safe_cuts(data, self.block)
            flat = np.concatenate([self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)])
            return flat, np.array([len(flat)])
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first = pretoken_starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        number, strings = numbered(data, np.diff(np.append(start, len(data))))  # pre-tokens leave no byte out
        if len(self.place) > self.keep:
            self.clear()
        keys = strings.to_pylist()
        self._learn([x for x in keys if x not in self.place])
        place = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[number]
        size = self.size[place]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.begin[place] - total[:-1], size) + np.arange(total[-1])
        return self.ids[source], np.diff(total[first])


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
