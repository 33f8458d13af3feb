"""Word spans and window hashes of many texts at once, as NumPy arrays.

Texts are UTF-8 bytes. A batch is cut into chunks of a few MB, so memory does not grow with the batch.
Hashes are 64 bits wide and only propose matches: every operator that uses them either verifies the words
or pairs two hashes with independent multipliers (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 2 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words for contamination checks: digits, lower-case letters, everything beyond ASCII.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Odd multipliers of the two hash families (byte level, word level) and the finaliser of splitmix64.
_BYTE_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_MUL = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass
class Chunk:
    """Some neighbouring texts of a batch.

    first: index of the chunk's first text; data: their bytes, each followed by a separator; starts, ends:
    byte spans of all words; offsets: word i of text k is at offsets[k] + i.
    """

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def words(self, lo: int, hi: int) -> list[bytes]:
        raw = self.data.tobytes() if hi - lo > 1000 else None
        if raw is None:
            return [self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True)]
        return [raw[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]


def chunks(texts: Sequence[bytes | None], alnum: bool = False) -> Iterator[Chunk]:
    """Cut texts into chunks of about CHUNK_BYTES. alnum: lower-case A-Z and take [0-9a-z and beyond ASCII]+
    as words; otherwise words are what lies between white space (space and 0x09-0x0D)."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= CHUNK_BYTES:
            yield _chunk(first, held, alnum)
            first, size, held = i + 1, 0, []
    if held:
        yield _chunk(first, held, alnum)


def _chunk(first: int, texts: list[bytes], alnum: bool) -> Chunk:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if alnum:
        data = _LOWER[data]
        inside = _ALNUM[data]
    else:
        inside = ~_SPACES[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return Chunk(first, data, starts, ends, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mul**i and its inverse modulo 2**64, for i < n. The tables grow by doubling up to those of a whole
    chunk, so that a process which hashes short texts only, as the driver does, holds short ones."""
    have = _POWERS.get(mul)
    if have is None or len(have[0]) < n:
        n = max(n, min(2 * n, CHUNK_BYTES + (CHUNK_BYTES >> 2)))
        inverse = pow(mul, -1, 1 << 64)
        have = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, m, np.uint64))]) for m in (mul, inverse)
        )
        _POWERS[mul] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(chunk: Chunk, family: int = 0) -> np.ndarray:
    """One hash per word: a polynomial over its bytes, from one running sum over the chunk."""
    up, down = _powers(_BYTE_MUL[family], len(chunk.data) + 1)
    total = np.zeros(len(chunk.data) + 1, np.uint64)
    np.cumsum((chunk.data.astype(np.uint64) + np.uint64(1)) * up[: len(chunk.data)], out=total[1:])
    return mix((total[chunk.ends] - total[chunk.starts]) * down[chunk.starts])


def window_hashes(words: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of words[i : i + size] for every i; windows that leave their text must be masked by the caller."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mul = np.uint64(_WORD_MUL[family])
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= mul
        out += words[j : j + n]
    return mix(out)


def window_starts(offsets: np.ndarray, size: int, total: int) -> np.ndarray:
    """For every word index below total - size + 1, whether the window from it stays in its text."""
    n = max(total - size + 1, 0)
    ok = np.ones(n, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - size + 1) : min(end, n)] = False
    return ok
