"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Documents are tokenized once, into a small table of pieces (id, start, length). Pieces are dealt evenly over partitions
and packed best-fit decreasing in each. Dual-feasible functions give a lower bound for each partition's bins: a
partition that meets its bound is certified and stays as it is. In one that does not, full bins stay, and the documents
of the bins with gaps are dealt anew, together with those of other such partitions and over fewer partitions, and packed
again. Rounds end when nothing is left to exchange, when one partition held all that was left, or when a round's exchange
saved less than one of a thousand bins (``LEAST_SAVING``): then the gaps are too small for what is left.

A document's pieces follow one another only within documents longer than a sequence; no document is cut otherwise.

A worker process loads the tokenizer once, whatever number of tasks it runs, and remembers a number of chunks that is
bounded in bytes.

Defined results: a null text is packed like an empty one (the end id alone); a text of any length is tokenized whole;
each row is packed, repeated ones too; ties in size go to the smaller document and piece; an empty table gives an empty
table; only the id and text columns are read, so that extra columns don't matter.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, in_batches

CAPACITY = 4096
END_ID = 1
MEMO_BYTES = 48 << 20
CHUNK_OVERHEAD = 170  # bytes of a dictionary's slot and the two objects' heads
MEMO_CHARS = 64
ROWS_PER_PARTITION = 20_000
LAST_ROWS = 20_000
LEAST_SAVING = 0.001

#: Texts that Python's split and lower treat otherwise than the tokenizer: other white space, the context-bound final
#: sigma, the dotted capital I, and the special tokens' strings. So do those that the tokenizer's normal form changes
#: before or after its lower case; they go to the library whole.
ODD = re.compile("[\x1c-\x1f\u03a3\u0130]|<\\|(?:start|end)oftext\\|>")


class ChunkTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, drops white space and never looks across it: chunks between white space are encoded one by
    one, and those that recur are remembered, a bounded number. It parts punctuation from letters, so that a word with a
    full stop or comma behind it has the ids of both. Chunks not seen before that are letters only are encoded as one string, whose words
    end where tokens with the end-of-word mark are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.mark = {m: self._raw([m])[0] for m in ".,"}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo, about
        vocabulary = self.t.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        low = text.lower()
        if ODD.search(text) or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return self._raw([text])[0]
        chunks = low.split()
        new = set(chunks).difference(self.memo)
        if new:
            self._learn(new)
            self.held += sum(map(len, new)) * 3 + len(new) * CHUNK_OVERHEAD
        out = b"".join(map(self.memo.__getitem__, chunks))
        if self.held > MEMO_BYTES:  # those that recur come back from the older half
            self.memo, self.older, self.held = {}, {c: x for c, x in self.memo.items() if len(c) <= MEMO_CHARS}, 0
        return out

    def _learn(self, new: set[str]) -> None:
        memo, older = self.memo, self.older
        plain, other, marked = [], [], []
        for c in new:
            known = older.get(c)
            if known is not None:
                memo[c] = known
            elif c.isalpha():
                plain.append(c)
            elif c[-1] in ".," and (stem := c[:-1]).isalpha():
                marked.append(c)
                if stem not in memo and stem not in new:
                    known = older.get(stem)
                    if known is not None:
                        memo[stem] = known
                    else:
                        memo[stem] = b""  # so that it is asked for once
                        plain.append(stem)
            else:
                other.append(c)
        if plain:
            ids = np.array(self.t.encode(" ".join(plain), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(plain):
                raw = ids.tobytes()
                memo.update(zip(plain, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                other += plain
        if other:
            memo.update(zip(other, self._raw(other), strict=True))
        for c in marked:
            memo[c] = memo[c[:-1]] + self.mark[c[-1]]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its bytes)."""
    whole = memoryview(ids + END_ID.to_bytes(4, "little"))
    n = len(whole) // 4
    return [(k, s, min(capacity, n - s), zlib.crc32(whole[4 * s : 4 * min(n, s + capacity)])) for k, s in enumerate(range(0, n, capacity))]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> ChunkTokenizer:
    """The process's own, kept between tasks."""
    return ChunkTokenizer(path)


def tokenize(docs: DataFrame, path: str, capacity: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(path)
        for b in batches:
            rows = [(i, *p) for i, t in zip(b["doc_id"], b["text"], strict=True) for p in pieces_of(coder.ids(t or ""), capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(rows).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The bin of each item (given in decreasing order) and each bin's room. Bins wait by room; a bit set of the rooms
    that occur gives the tightest one that is large enough."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, where, room_of = 0, np.empty(len(lengths), dtype=np.int64), []
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(room_of)
            room_of.append(capacity)
        where[i] = b
        room -= n
        room_of[b] = room
        if room:
            waiting[room].append(b)
            rooms |= 1 << room
    return where, room_of


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that two families of dual-feasible functions prove to be needed.

    The first, for each e up to half a bin, counts an item longer than capacity - e as a bin, one shorter than e as
    nothing and any other as its length. The second, for small k, rounds (k + 1) x length / capacity down to k-ths of a
    bin, where it is not whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    items, mass = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    large = items[-1] - items[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    for k in range(1, 21):
        x = (k + 1) * size
        whole = x % capacity == 0
        value = np.where(whole, size * k, (x // capacity) * capacity)  # in 1 / (k * capacity) bins
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def pack_partition(frame: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Pack the rows; ``open`` marks those of a partition above its bound that sit in bins with gaps."""
    frame = frame.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy()
    where, room = best_fit_decreasing(lengths, capacity)
    gaps = np.array(room, dtype=np.int64)[where] > 0
    certified = len(room) <= lower_bound(lengths, capacity)
    order = np.argsort(where, kind="stable")
    sorted_lengths, sorted_bins = lengths[order], where[order]
    ends = np.cumsum(sorted_lengths)
    first = np.r_[True, sorted_bins[1:] != sorted_bins[:-1]] if len(order) else np.zeros(0, dtype=bool)
    base = np.repeat((ends - sorted_lengths)[first], np.diff(np.r_[np.flatnonzero(first), len(order)])) if len(order) else ends
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = ends - sorted_lengths - base
    return frame.assign(bin=where, offset=offset, open=gaps & (not certified and not last))


#: A sequence's number: the round, the partition (32 bits) and the bin (20 bits; a partition has far fewer rows).
def _packer(columns: list[str], capacity: int, last: bool, tag: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_partition(frame.drop(columns="__part"), capacity, last)
        out["sequence_id"] = tag + (int(frame["__part"].iloc[0]) << 20) + out["bin"]
        return out[[*columns, "sequence_id", "offset", "open"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...) with sequence_id and offset.

    A round's partition is (hash of the row's place) mod the number of partitions, which follows the number of rows, so
    that no key decides how much a task gets, and equal rows part too. ``pieces`` must be checkpointed, as each round's
    rows are: places don't change then. What is closed is kept, what is open goes on.
    """
    columns = [*pieces.columns]
    left, done, salt, saved = pieces, [], 0, True
    before = None  # bins that the rows at hand took in the round before
    while True:
        n = left.count()
        parts = max(1, -(-n // rows_per_partition))
        last = parts == 1 or not saved
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, open boolean"
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(parts)).cast("int")
        packed = cut(left.withColumn("__part", part).groupBy("__part").applyInPandas(_packer(columns, capacity, last, salt << 52), schema))
        done.append(packed.where("NOT open").drop("open"))
        if last:
            break
        bins = packed.where("offset = 0").agg(F.count("*").alias("all"), F.count(F.when(F.col("open"), 1)).alias("open")).first()
        if not bins["open"]:
            break
        saved = before is None or bins["all"] <= (1 - LEAST_SAVING) * before
        before, left = bins["open"], packed.where("open").select(*columns)
        rows_per_partition = max(rows_per_partition, LAST_ROWS)
        salt += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(cut(tokenize(docs, path, capacity, key, text)), capacity)
