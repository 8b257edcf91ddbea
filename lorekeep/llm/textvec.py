"""Words of many texts at once, as numpy arrays of positions and 64-bit hashes.

Texts are joined with newlines into one byte buffer. A word is a maximal run of bytes other than space and \\x09-\\x0D;
its hash is a sum of random byte values times powers of an odd number, modulo 2**64, which prefix sums give for all words
at once, then mixed. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUFFER_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHINGLE_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers: dict[str, np.ndarray] = {}


KEPT_POWERS = 2 * BUFFER_BYTES


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1 at least. Those for a text beyond the usual buffer are not kept."""
    if n <= len(_powers.get("up", ())):
        return _powers["up"], _powers["down"]
    size = max(n, KEPT_POWERS)
    made = {}
    for name, base in (("up", BASE), ("down", BASE_INVERSE)):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        made[name] = np.multiply.accumulate(p)
    if size <= KEPT_POWERS:
        _powers.update(made)
    return made["up"], made["down"]


class Words:
    """``start`` and ``stop`` are byte positions of words, ``doc`` the number of each word's text, ``first[i]`` the
    number of text i's first word (and ``first[-1]`` the number of words)."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.raw = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
        self.bytes = LOWER[self.raw] if lower else self.raw
        space = IS_SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.stop = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_start = np.cumsum(np.r_[1, lengths + 1])
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, chars: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
        """One hash for each word, of ``chars`` (default: the lower-cased bytes) where ``keep`` (default: all)."""
        chars = self.bytes if chars is None else chars
        up, down = powers(len(chars) + 1)
        if keep is None:
            total = BYTE_VALUE[chars]
            total *= up[: len(chars)]
            at = np.r_[np.uint64(0), np.add.accumulate(total)]
            return mix((at[self.stop] - at[self.start]) * down[self.start])
        rank = np.r_[0, np.cumsum(keep)]
        total = BYTE_VALUE[chars[keep]]
        total *= up[: len(total)]
        at = np.r_[np.uint64(0), np.add.accumulate(total)]
        a, b = rank[self.start], rank[self.stop]
        return mix((at[b] - at[a]) * down[a])


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; runs that cross texts are for the caller to leave out."""
    size = max(0, len(word_hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out *= SHINGLE_BASE
        out += word_hashes[k : k + size]
    return mix(out)


def batched(items: list[tuple[int, bytes]], limit: int = BUFFER_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Consecutive items of about ``limit`` bytes together; one item that is longer comes alone."""
    held, size = [], 0
    for item in items:
        if held and size + len(item[1]) > limit:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    if held:
        yield held
