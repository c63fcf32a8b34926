"""Splitting of texts into the pieces that byte-level BPE encodes one by one, and numbering of the pieces."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
import regex

# The split pattern of byte-level BPE vocabularies of 50 thousand tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Unicode White_Space; letters and numbers below U+0100.
SPACE = "\\t-\\r \x85\xa0  -     　"
LATIN_SPACE, LATIN_LETTER, LATIN_NUMBER = "\\t-\\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"

_WIDE = regex.compile(PATTERN.replace(r"[^\s\p", rf"[^{SPACE}\p").replace(r"\s+", f"[{SPACE}]+").replace(r"\S", f"[^{SPACE}]"))
#: The same for texts without characters above U+00FF; alternatives begin differently, so their order is free.
_LATIN = re.compile(f" ?[{LATIN_LETTER}]+| ?[{LATIN_NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")
_ABOVE = re.compile("[^\x00-\xff]")


def pieces(text: str) -> list[str]:
    return (_WIDE if _ABOVE.search(text) else _LATIN).findall(text)


_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
#: Classes of the characters up to U+00FF; NUL ends a text.
_CLASS = np.full(256, _OTHER, np.uint8)
for _class, _signs in ((_SPACE, LATIN_SPACE), (_LETTER, LATIN_LETTER), (_NUMBER, LATIN_NUMBER)):
    _CLASS[[c for c in range(256) if re.match(f"[{_signs}]", chr(c))]] = _class
_CLASS[0] = _END
#: Bytes of a word of eight that belong to a piece, by how many there are.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _latin(text: str) -> bytes | None:
    """One byte a character, if all of them have one and none is NUL."""
    try:
        own = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b"\0" in own else own


def latin_cuts(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece, as _LATIN cuts them, in texts of one byte a character; each text has a NUL before and after it and none within."""
    kind = _CLASS[signs]
    solid = (kind - np.uint8(1)) < 3
    cut = np.append(True, kind[1:] != kind[:-1])
    cut[1:] &= ~((signs[:-1] == 0x20) & solid[1:])  # one space goes with what follows
    cut[:-1] |= (kind[:-1] == _SPACE) & solid[1:]  # the last of many spaces stands apart from them
    mark = np.flatnonzero((signs == 0x27) & cut)
    a, b = signs[mark + 1], signs[np.minimum(mark + 2, len(signs) - 1)]
    short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    cut[mark[short | long] + 1] = False
    cut[mark[short] + 2] = True
    cut[mark[long] + 3] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(signs))
    inside = signs[begin] != 0
    return begin[inside], end[inside]


def _words_at(signs: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The eight bytes from each begin on as a number, those beyond size as zeros; signs has eight bytes beyond the last begin."""
    eights = np.lib.stride_tricks.as_strided(signs, (len(signs) - 7, 8), (1, 1))
    return eights[begin].view("<u8").ravel() & _MASK[size]


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Pieces:
    """Numbers for pieces, kept from call to call until there are more than limit of them; encode makes the ids of new pieces."""

    def __init__(self, encode, special: dict[str, int], limit: int = 350_000):
        self.encode, self.special, self.limit = encode, special, limit
        self.split = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for i in self.special.values():
            self._add([[i]])
        for s in self.special:
            self.number[s]

    def _add(self, lists) -> None:
        flat, lengths = lists if isinstance(lists, tuple) else (np.concatenate([np.asarray(x, np.int32) for x in lists]), [len(x) for x in lists])
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def _split(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return pieces(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*pieces(text[at : m.start()]), m[0]]
            at = m.end()
        return out + pieces(text[at:])

    def _numbers_of_latin(self, raw: list[bytes]) -> list[np.ndarray]:
        """The same as the numbers of _split's pieces, for texts of one byte a character without special tokens or NUL. Pieces of up to 16 bytes are told apart by their bytes as two numbers, so that each different one becomes a string once."""
        whole = b"\0" + b"\0".join(raw) + b"\0"
        signs = np.frombuffer(whole + bytes(16), np.uint8)
        begin, end = latin_cuts(signs[: len(whole)])
        size = end - begin
        numbers = np.empty(len(begin), np.int64)

        def put(at: np.ndarray, codes: np.ndarray) -> None:
            """Numbers for the pieces at, equal ones of which have equal codes: 0, 1, 2 and so on as they come."""
            first = at[np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))]
            own = [whole[i:j].decode("latin-1") for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            numbers[at] = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))[codes]

        for least, most in ((1, 8), (9, 16)):
            at = np.flatnonzero((size >= least) & (size <= most))
            if not len(at):
                continue
            codes, _ = pd.factorize(_words_at(signs, begin[at], np.minimum(size[at], 8)))
            if least > 1:
                more, kinds = pd.factorize(_words_at(signs, begin[at] + 8, size[at] - 8))
                codes, _ = pd.factorize(codes * len(kinds) + more)
            put(at, codes)
        at = np.flatnonzero(size > 16)
        if len(at):
            put(at, np.arange(len(at)))
        starts = np.cumsum([1, *[len(t) + 1 for t in raw]])
        return np.split(numbers, np.searchsorted(begin, starts[1:-1]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > self.limit:
            self.clear()
        number = self.number
        known = len(number)
        numbered: list = [None] * len(texts)
        plain, raw = [], []
        for k, t in enumerate(texts):
            own = _latin(t) if self.split is None or not self.split.search(t) else None
            if own is not None:
                plain.append(k)
                raw.append(own)
            else:
                own = self._split(t)
                numbered[k] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        if plain:
            for k, own in zip(plain, self._numbers_of_latin(raw), strict=True):
                numbered[k] = own
        if len(number) > known:
            fresh = list(islice(number, known, None))
            self._add(self.encode(fresh))
        out = []
        for own in numbered:
            first, count = self.ends[own], self.ends[own + 1] - self.ends[own]
            total = int(count.sum())
            place = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
            out.append(self.ids[place])
        return out
