"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one token that can end its encoding: the token whose bytes end the
prefix, which follows the (unique) last token of the rest, and which merges would leave apart from it. ``Encoder`` keeps
that token for each prefix. Appending bytes only adds entries; an edit keeps the entries before it, and those after it
become valid again where the same token boundary recurs.

A piece that is itself in the vocabulary is that token, as the merge rule has it for rank files.

A worker process makes the vocabulary's table once, whatever number of tasks it runs, and remembers pieces up to a
number of bytes.

Defined results over documents: null and empty texts have no tokens; a text of any length is encoded whole (time grows
with its length, not with its square); equal texts give equal rows; an empty table gives an empty table; only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

MEMO_BYTES = 96 << 20
PIECE_OVERHEAD = 200  # bytes of a dictionary's slot, a string's head and a tuple's
MEMO_CHARS = 64
MEMO_PAIRS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Vocabulary:
    """Ranks, and for each token the pair whose merge makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.unreachable: set[int] = set()
        self.apart_memo: dict[int, bool] = {}
        for i in sorted(self.bytes_of):
            self._split(i)
        self.reachable = {b: i for b, i in ranks.items() if i not in self.unreachable}
        self.length_bits = self.longest.bit_length()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in self.reachable.items():
            self.automaton.add_word(b.decode("latin-1"), i << self.length_bits | len(b))
        self.automaton.make_automaton()

    def _split(self, i: int) -> None:
        """Merge the token's bytes with lower ranks only; two parts must be left, or merges never make it."""
        b = self.bytes_of[i]
        if len(b) == 1:
            self.halves[i] = None
            return
        parts = [b[k : k + 1] for k in range(len(b))]
        while len(parts) > 2:
            rank, k = min(((self.ranks.get(parts[k] + parts[k + 1], i), k) for k in range(len(parts) - 1)))
            if rank >= i:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2 and all(p in self.ranks for p in parts):
            self.halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
        else:
            self.unreachable.add(i)

    def apart(self, left: int, right: int) -> bool:
        """Whether merges of both tokens' bytes leave the boundary between them."""
        key = left << 32 | right
        if key not in self.apart_memo:
            if len(self.apart_memo) >= MEMO_PAIRS:
                self.apart_memo.clear()
            self.apart_memo[key] = self._apart(left, right)
        return self.apart_memo[key]

    def _apart(self, a: int, b: int) -> bool:
        """Undo merges from the latest back: at each moment the tokens that touch the boundary must not have merged
        before the later of the two merges that used them up. ``limit`` is that merge's rank; at equal ranks the
        merge further left came first."""
        limit = float("inf")
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], limit)
            if joined < limit:
                return False
            if a > b and self.halves[a]:
                limit, a = a, self.halves[a][1]
            elif self.halves[b]:
                limit, b = b + 1, self.halves[b][0]
            elif self.halves[a]:
                limit, a = a, self.halves[a][1]
            else:
                return True


class Encoder:
    """The last token of every prefix of the bytes so far."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self._ending(end))

    def _ending(self, end: int) -> int:
        base = max(0, end - self.v.longest)
        return ending(self.v, bytes(self.data[base:end]), self.last, base)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]. Entries before ``start`` stay; those behind are computed anew until, for as many
        bytes as the longest token has, each is what it was before, from where all the rest is too. Returns how many
        entries were computed."""
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start:]
        self.append(new)
        done, same = len(new), 0
        for k in range(len(tail)):
            self.data += tail[k : k + 1]
            self.last.append(self._ending(len(self.data)))
            done += 1
            same = same + 1 if self.last[-1] == old[k] else 0
            if same >= self.v.longest:
                self.data += tail[k + 1 :]
                self.last += old[k + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


def ending(v: Vocabulary, data: bytes, last: list[int], base: int) -> int:
    """The last token of a prefix that ends with ``data``; ``last`` has those of all shorter ones, ``base`` bytes come before."""
    token, memo, n = v.reachable.get, v.apart_memo, len(data)
    for start in range(n):
        t = token(data[start:])
        if t is not None:
            if not base + start:
                return t
            before = last[base + start - 1]
            ok = memo.get(before << 32 | t)
            if ok or ok is None and v.apart(before, t):
                return t
    raise ValueError("a byte is not in the vocabulary")


def encode_piece(v: Vocabulary, piece: bytes) -> tuple[int, ...]:
    """The same table as ``Encoder`` has, filled in one pass of an automaton that tells all tokens which end at each byte."""
    whole = v.ranks.get(piece)
    if whole is not None:
        return (whole,)
    last = [-1] * len(piece)
    memo, shift, low = v.apart_memo.get, v.length_bits, (1 << v.length_bits) - 1
    for end, packed in v.automaton.iter(piece.decode("latin-1")):
        if last[end] >= 0:
            continue
        start, t = end - (packed & low), packed >> shift
        if start < 0:
            last[end] = t
            continue
        before = last[start]
        ok = memo(before << 32 | t)
        if ok or ok is None and v.apart(before, t):
            last[end] = t
    out, end = [], len(piece)
    while end:
        out.append(last[end - 1])
        end -= len(v.bytes_of[out[-1]])
    return tuple(out[::-1])


class TextEncoder:
    """Whole texts: each match of the pattern is a piece; pieces that recur are remembered, a bounded number of them."""

    def __init__(self, path: str, pattern: str):
        self.v, self.find = Vocabulary(load_ranks(path)), regex.compile(pattern).findall
        self.memo, self.older, self.held = {}, {}, 0
        self.decimal = {i: str(i) for i in self.v.bytes_of}
        self.number = {i: i for i in self.v.bytes_of}  # one object for each id, however many pieces have it

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        memo, older, same = self.memo, self.older, self.number.__getitem__
        new = set(pieces).difference(memo)
        for p in new:
            memo[p] = older[p] if p in older else tuple(map(same, encode_piece(self.v, p.encode("utf-8"))))
        out = list(chain.from_iterable(map(memo.__getitem__, pieces)))
        self.held += sum(map(len, new)) * 4 + len(new) * PIECE_OVERHEAD
        if self.held > MEMO_BYTES:  # those that recur come back from the older half
            self.memo, self.older, self.held = {}, {p: x for p, x in memo.items() if len(p) <= MEMO_CHARS}, 0
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """The process's own, kept between tasks: the vocabulary's table is made once for each worker."""
    return TextEncoder(path, pattern)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode the ids, and give the digests of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = text_encoder(path, pattern)
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = coder.encode(t or "")
                joined = ",".join(map(coder.decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text as an array."""
    import pyspark.sql.types as T

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = text_encoder(path, pattern)
        for b in batches:
            yield pd.Series([coder.encode(t or "") for t in b], dtype=object)

    return in_batches(docs).withColumn(out, ids(docs[text]))
