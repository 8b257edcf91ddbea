"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has 64 bits, one for each bit position that is set in over half of the hashes of the text's three-word
shingles. Two fingerprints are linked if they differ in two bits at most. Five blocks of bits: such a pair shares at
least three blocks, so each distinct fingerprint goes to ten buckets, one for each choice of three blocks, and pairs come
from a join within buckets, verified by their Hamming distance.

A bucket with many fingerprints (large groups of near copies) is not joined with itself. There, each fingerprint goes to
one key for each choice of two bits outside the bucket's blocks, with those bits cleared: two fingerprints of the bucket
share such a key exactly if they differ in these bits at most, so that linking each with the key's smallest one loses no
link and makes a number of rows in proportion to the fingerprints.

Equal fingerprints are one node from the start; copies are never paired. Nodes are fingerprints, not ids: texts that share
an id are linked by what they say only. Joins on fingerprints, roots and buckets deal out both sides anew, so that
adaptive execution can split a hot one.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like any other; fewer than
three words make one shingle; a text of any length counts whole; repeated rows are copies; rows that share an id and
differ in text get a row each; rows without a doc_id link like others and get their component's smallest id (null if no
row of it has an id); an empty table gives an empty table; only the id and text columns are read, so that extra columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .components import components
from .shared import cut, fresh, in_batches, split_join

SEED = 42
SHINGLE = 3
DISTANCE = 2
BLOCKS = 5
JOINED_BUCKET = 24
ROWS_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly space and \x09-\x0D
    digest = xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        return [digest(b" ".join(w), SEED)] if w else []
    return [digest(s, SEED) for s in map(b" ".join, zip(w, w[1:], w[2:]))]


def majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """The fingerprint of each run of hashes; ``counts`` are the runs' lengths, zero for no words."""
    out = np.zeros(len(counts), dtype=np.uint64)
    sizes = np.array(counts)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        held = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(held * 2 > sizes[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    out, held, counts = [], [], []
    for t in texts:
        h = shingle_hashes(t)
        held += h
        counts.append(len(h))
        if len(held) >= ROWS_AT_ONCE:
            out.append(majority(np.array(held, dtype=np.uint64), counts))
            held, counts = [], []
    out.append(majority(np.array(held, dtype=np.uint64), counts))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) with the fingerprint as a signed long; ``text_hash`` tells texts of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fingerprints_of(b["text"].tolist()).view(np.int64)})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return in_batches(rows).mapInPandas(run, "doc_id long, text_hash long, fp long")


def block_bits() -> list[list[int]]:
    edges = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): the links, or as many of them as connect the same nodes; ``nodes`` has the distinct fp and its node."""
    blocks = block_bits()
    free = list(combinations(range(BLOCKS), DISTANCE))
    masks = [signed(sum(1 << i for k in range(BLOCKS) if k not in f for i in blocks[k])) for f in free]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks)))
    rows = nodes.select("node", "fp", keys.alias("way", "key"))
    sizes = rows.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(split_join(rows, sizes, ["way", "key"]))
    few = shared.where(F.col("n") <= JOINED_BUCKET)
    other = few.select("way", "key", F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    near = lambda x: F.bit_count(F.col("fp").bitwiseXOR(F.col(x))) <= DISTANCE
    pairs = few.join(other, ["way", "key"]).where((F.col("node") > F.col("b")) & near("fp_b")).select(F.col("node").alias("a"), "b")
    many = shared.where(F.col("n") > JOINED_BUCKET)
    cleared = F.lit(None).cast("array<bigint>")
    for way, f in enumerate(free):
        outside = sorted(i for k in f for i in blocks[k])
        pairs_of_bits = [signed(~((1 << i) | (1 << j)) & (2**64 - 1)) for i, j in combinations(outside, 2)]
        cleared = F.when(F.col("way") == way, F.transform(F.lit(pairs_of_bits), lambda m: F.col("fp").bitwiseAND(m))).otherwise(cleared)
    spread = many.select("node", "fp", "way", F.posexplode(cleared).alias("bits", "rest"))
    star = spread.groupBy("way", "bits", "rest").agg(F.min(F.struct("node", "fp")).alias("m"), F.count("*").alias("n")).where("n > 1")
    star = star.select("way", "bits", "rest", F.col("m.node").alias("b"), F.col("m.fp").alias("fp_b"))
    more = split_join(spread, star, ["way", "bits", "rest"]).where((F.col("node") != F.col("b")) & near("fp_b")).select(F.col("node").alias("a"), "b")
    return pairs.union(more).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every document. ``root`` is a fingerprint that names the component,
    ``component_id`` its smallest id."""
    printed = cut(fingerprints(docs, key, text))
    nodes = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"))).select(F.col("node").alias("fp"), "component")
    named = cut(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = split_join(named.select("fp", "root"), ids, ["root"])
    return split_join(printed, whole, ["fp"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that with the smallest id. Rows are judged by id
    and text: several texts under one id belong to as many components as their fingerprints do, and of each one row
    stays. Of several texts under the smallest id the one with the smallest hash stays; of rows equal in id and text, the
    one whose other columns come first as strings. Rows without an id stay."""
    id_, hash_ = fresh(docs, "__id"), fresh(docs, "__hash")
    rows = docs.withColumns({id_: docs[key].cast("long"), hash_: F.xxhash64(docs[text])})
    judged = near_duplicates(docs, key, text).where("doc_id IS NOT NULL").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = judged.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("m"))
    best = cut(best.select(F.col("m.doc_id").alias(id_), F.col("m.text_hash").alias(hash_), F.col("m.n").alias("n")))
    only = lambda cond: rows.join(best.where(cond).select(id_, hash_), [id_, hash_], "left_semi")
    kept = only("n = 1").select(*docs.columns).unionByName(docs.where(docs[key].cast("long").isNull()))
    if best.where("n > 1").isEmpty():
        return kept
    plain = [F.col(f.name).cast("string") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    first = only("n > 1").groupBy(id_, hash_).agg(F.min_by(F.struct(*docs.columns), F.struct(*plain)).alias("__row"))
    return kept.unionByName(first.select("__row.*"))
