"""JSON objects read from any byte of their file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_AHEAD = 1 << 16  # bytes first read beyond a range for the end of its last member; doubled until it is found
_SIGNS = np.zeros(256, np.int8)
_SIGNS[[ord(c) for c in "{["]] = 1
_SIGNS[[ord(c) for c in "}]"]] = -1
_QUOTE, _ESCAPE, _COMMA = (ord(c) for c in '"\\,')


@dataclass
class Block:
    """Bytes with the places of their quotes that are not escaped, and of their brackets."""

    data: np.ndarray
    quotes: np.ndarray
    brackets: np.ndarray

    def outside(self, at: np.ndarray, quoted: bool) -> np.ndarray:
        """Those of the places that lie outside strings, if the block begins inside one (``quoted``) or not."""
        return at[np.searchsorted(self.quotes, at) % 2 == int(quoted)]

    def depth(self, quoted: bool) -> int:
        return int(_SIGNS[self.data[self.outside(self.brackets, quoted)]].sum())

    def bounds(self, quoted: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where members of the outermost object begin or end: its brackets and the commas between. With whether one begins there."""
        brackets = self.outside(self.brackets, quoted)
        signs = _SIGNS[self.data[brackets]]
        after = depth + np.cumsum(signs, dtype=np.int64)
        commas = self.outside(np.flatnonzero(self.data == _COMMA), quoted)
        levels = np.concatenate([[depth], after])[np.searchsorted(brackets, commas)]
        commas = commas[levels == 1]
        opens, ends = brackets[(signs == 1) & (after == 1)], brackets[(signs == -1) & (after == 0)]
        at = np.concatenate([opens, commas, ends])
        begins = np.concatenate([np.ones(len(opens) + len(commas), bool), np.zeros(len(ends), bool)])
        order = np.argsort(at)
        return at[order], begins[order]


def scan(data: bytes, escaped: bool) -> Block:
    """``escaped``: whether the bytes before make the first one escaped."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == _QUOTE)
    odd = np.zeros(len(quotes), bool)
    left, at = np.arange(len(quotes)), quotes - 1
    while len(left):  # each step goes back over one escape sign before the quotes that are left
        first = at < 0
        odd[left[first]] ^= escaped
        more = ~first & (a[at] == _ESCAPE)
        left, at = left[more], at[more] - 1
        odd[left] ^= True
    return Block(a, quotes[~odd], np.flatnonzero(_SIGNS[a]))


def escaped_at(file, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of escape signs."""
    n, size = 0, 64
    while start > n:
        size = min(size * 2, start - n)
        part = file.read_at(size, start - n - size)
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n % 2 == 1


def members_from(file, start: int, end: int, length: int, quoted: bool, depth: int) -> Iterator[str]:
    """The members of the outermost object that begin between ``start`` and ``end``, each as an object of its own."""
    escaped, ahead = escaped_at(file, start), 0
    while True:
        data = file.read_at(min(end + ahead, length) - start, start)
        at, begins = scan(data, escaped).bounds(quoted, depth)
        owned = np.flatnonzero(begins & (at < end - start))
        if not len(owned) or owned[-1] + 1 < len(at) or end + ahead >= length:
            break
        ahead = max(_AHEAD, 2 * ahead)
    for i in owned:
        if i + 1 < len(at) and (member := data[at[i] + 1 : at[i + 1]].strip()):
            yield "{" + member.decode("utf-8", "replace") + "}"
