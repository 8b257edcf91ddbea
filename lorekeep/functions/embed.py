"""Seams to outside services: embedding, re-ranking, summaries. Offline stand-ins are deterministic."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 100
RETRIES = 3


class Embedder(Protocol):
    def model(self) -> str: ...
    def embed_batch(self, texts: list[str]) -> list[list[float] | None]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class Summarizer(Protocol):
    def summarize(self, text: str) -> str: ...


class HashEmbedder:
    """Words hashed to signed places of a vector of unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def model(self) -> str:
        return f"hash-{self.dimension}"

    def embed_batch(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).tolist())
        return out


class Busy(Exception):
    """A service asks to be called later."""


def with_retries(call: Callable[[], list], attempts: int = RETRIES, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """Call again after a random part of a doubling delay while the service is busy."""
    for k in range(attempts + 1):
        try:
            return call()
        except Busy:
            if k == attempts:
                raise
            sleep(random.random() * base * 2**k)
    return []


def embed_all(embedder: Embedder, texts: list[str], size: int = BATCH, sleep: Callable[[float], None] = time.sleep) -> list[list[float] | None]:
    """In batches; a batch that fails is tried text by text, and a text that fails has no vector."""
    out: list[list[float] | None] = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        try:
            made = with_retries(lambda part=part: embedder.embed_batch(part), sleep=sleep)
            if len(made) != len(part):
                raise ValueError("a vector is missing")
        except Exception:  # noqa: BLE001
            made = []
            for t in part:
                try:
                    made += with_retries(lambda t=t: embedder.embed_batch([t]), sleep=sleep)
                except Exception:  # noqa: BLE001
                    made.append(None)
        out += made
    return out


def embedding(embedder: Embedder, text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(embed_all(embedder, b.fillna("").tolist()), dtype=object)

    return run(text)


def summary(summarizer: Summarizer, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.fillna("").map(summarizer.summarize)

    return run(text)


def dimension(embedder: Embedder) -> int:
    own = getattr(embedder, "dimension", None)
    return own if own is not None else len(embedder.embed_batch(["x"])[0] or [])


def check_model(meta: dict[str, str], model: str, dimension: int) -> dict[str, str]:
    """The store's model and dimension; another one may not write to it."""
    if not meta:
        return {"model": model, "dimension": str(dimension)}
    if meta.get("model") != model or meta.get("dimension") != str(dimension):
        raise ValueError(f"the store has vectors of {meta}, not of {model} with {dimension} dimensions")
    return meta


def reranked(query: str, reranker: Reranker, top: int = 20) -> Callable[[DataFrame], DataFrame]:
    """A step for searches: the first ``top`` rows in the service's order; the old order if it fails or answers short."""

    def step(rows: DataFrame) -> DataFrame:
        head = rows.where(F.col("rank") <= top).orderBy("rank").collect()
        try:
            scores = reranker.scores(query, [r["content"] for r in head])
            if len(scores) != len(head):
                return rows
        except Exception:  # noqa: BLE001
            return rows
        order = sorted(range(len(head)), key=lambda i: (-scores[i], i))
        new = rows.sparkSession.createDataFrame([(head[i]["chunk_id"], k) for k, i in enumerate(order, 1)], f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, new_rank int")
        return rows.where(F.col("rank") <= top).join(new, "chunk_id").withColumn("rank", F.col("new_rank")).drop("new_rank")

    return step
