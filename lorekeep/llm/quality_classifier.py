"""Document quality by logistic regression over hashed word n-grams.

Features are shares of n-grams in a text: words, pairs of words, and the same of word shapes (runs of capitals, small
letters, digits and equal marks), each hashed to one of 2**18 numbers. A pair of equal words is one feature whatever the
word. Weights are learned with follow-the-regularised-leader updates, document by document, on a bounded sample of labelled rows,
and a document's score is the logistic function of a sparse dot product. One task learns, as updates follow each other:
it reads the sample's features as a sorted stream, each epoch's behind the one before, and holds the weights and a batch.

Defined results: a null text scores like an empty one, whose only feature is the bias; texts count whole; equal texts get
equal scores; without labelled rows every score is 0.5; an empty table gives an empty table; only the id and text columns
are read, and labels only of rows that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, training_rows
from .shared import in_batches
from .textvec import Words, batched, mix, shingles

FOLDS, HELD_OUT = 3, 1
BITS = 18
SAMPLE_PER_CLASS = 2000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
SALTS = mix(np.arange(11, 15, dtype=np.uint64))
REPEAT = np.uint64(0x1234567890ABCDEF)

#: Classes of bytes for shapes: capitals, small letters and all beyond ASCII, digits; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = ord("A")
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[48:58] = ord("0")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of every n-gram; values of one family in one text sum to 1."""
    w = Words(texts, lower=False)
    shape = SHAPE[w.raw]
    start = np.zeros(len(shape), dtype=bool)
    start[w.start] = True
    changed = np.r_[True, shape[1:] != shape[:-1]] | start
    doc, idx, val = [], [], []
    same = w.doc[1:] == w.doc[:-1]
    for family, h in enumerate((w.hashes(), w.hashes(shape, changed))):
        pair = shingles(h, 2)
        pair[h[1:] == h[:-1]] = REPEAT
        for n, (grams, owner) in enumerate(((h, w.doc), (pair[same], w.doc[1:][same]))):
            count = np.bincount(owner, minlength=len(texts))
            doc.append(owner)
            idx.append((mix(grams ^ SALTS[2 * family + n]) >> np.uint64(64 - BITS)).astype(np.int64))
            val.append(1.0 / count[owner])
    return np.concatenate(doc), np.concatenate(idx), np.concatenate(val)


def sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and values."""
    doc, idx, val = features(texts)
    key, at = np.unique((doc << BITS) | idx, return_inverse=True)
    total = np.bincount(at, weights=val, minlength=len(key))
    edges = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    return [((key[a:b] & ((1 << BITS) - 1)).astype(np.int32), total[a:b].astype(np.float32)) for a, b in zip(edges, edges[1:])]


class Follower:
    """Follow-the-regularised-leader: weights come from sums of gradients and of their squares. The last is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, idx: np.ndarray, val: np.ndarray, y: int) -> None:
        i, x = np.r_[idx, len(self.z) - 1], np.r_[val, 1.0]
        w = self.weights(i)
        g = (logistic(w @ x) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> np.ndarray:
    """Weights (float32, 2**18 + 1 of them) from about ``per_class`` labelled documents of each class at most. The driver
    gets the weights only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
            for part in batched(list(enumerate(texts))):
                found = sparse([t for _, t in part])
                at = [i for i, _ in part]
                ids = b["id"].to_numpy(dtype=np.int64)[at]
                place = (mix(ids.view(np.uint64) + np.uint64(1)) ^ np.uint64(1 << 63)).view(np.int64)  # in order as unsigned
                yield pd.DataFrame({"place": place, "id": ids, "y": b["y"].to_numpy()[at], "idx": [f[0].tobytes() for f in found], "val": [f[1].tobytes() for f in found]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Follower()
        for b in batches:
            for r in b.itertuples():
                model.learn(np.frombuffer(r.idx, dtype=np.int32), np.frombuffer(r.val, dtype=np.float32), r.y)
        yield pd.DataFrame({"weights": [model.weights().astype(np.float32).tobytes()]})

    rows = in_batches(training_rows(docs, labels, "quality", FOLDS, HELD_OUT, per_class))
    rows = rows.mapInPandas(run, "place long, id long, y int, idx binary, val binary")
    stream = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).repartition(1).sortWithinPartitions("epoch", "place", "id", "idx", "val")
    made = stream.select("y", "idx", "val").mapInPandas(learn, "weights binary").first()
    return np.frombuffer(made["weights"], dtype=np.float32) if made else Follower().weights().astype(np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    doc, idx, val = features(texts)
    return logistic(np.bincount(doc, weights=weights[idx] * val, minlength=len(texts)) + weights[-1])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted). The weights are 1 MB, whatever the input's size."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = held.value
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
            done = [score_texts([t for _, t in part], w) for part in batched(list(enumerate(texts)))]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.concatenate(done) if done else np.zeros(0)})

    scored = in_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
