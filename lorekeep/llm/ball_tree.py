"""Exact top-k inner-product search with a ball tree for each shard.

Vectors become integers (floor of 256 times each component), so that scores are exact. Rows are dealt into shards of
bounded size, each with its own ball tree; queries are dealt into blocks of bounded size. A few trees and a few blocks
meet in one task, so that no key has more rows than that: blocks travel to all trees, and a tree only to as many tasks as
there are groups of blocks. A task takes its trees in the order of the largest inner product that their root balls allow,
and in a tree its nodes likewise; a query leaves what is bounded below its current k-th score, which goes along from tree
to tree, and a leaf is scored for all its queries at once. Trees are searched in rounds of growing size: the k-th scores
of one round are the floors of the next.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither as queries nor as
candidates; a query is compared with vectors of its own length only; rows equal in id and vector count once, and of
several vectors with one id the lexicographically smallest counts; ties go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives an empty table; only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, in_batches

SCALE = 256
LEAF = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
TREES_AT_ONCE, BLOCKS_AT_ONCE = 4, 16
GROWTH = 4  # of the number of tree groups from round to round
NONE = np.iinfo(np.int64).min
EXACT_IN_DOUBLE = 2**53


def dumped(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def loaded(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return dict(f)


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes in one array each; children come after their parent, a leaf has child -1."""
    order = np.argsort(ids, kind="stable")
    x = vectors[order].astype(np.float64)
    start, stop, left, right, centre, radius = [], [], [], [], [], []
    perm = np.arange(len(ids))
    todo = [(0, len(ids), -1, False)]
    while todo:
        a, b, parent, is_right = todo.pop()
        me = len(start)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        p = x[perm[a:b]]
        c = p.mean(axis=0) if b > a else np.zeros(x.shape[1])
        r = float(np.sqrt(((p - c) ** 2).sum(axis=1).max())) if b > a else 0.0
        for where, value in ((start, a), (stop, b), (left, -1), (right, -1), (centre, c), (radius, r)):
            where.append(value)
        if b - a > LEAF and r > 0:
            far = p[np.argmax(((p - c) ** 2).sum(axis=1))]
            side = np.argsort((p - c) @ (far - c), kind="stable")
            perm[a:b] = perm[a:b][side]
            half = (a + b) // 2
            todo += [(half, b, me, True), (a, half, me, False)]
        else:
            perm[a:b].sort()  # by id
    return {
        "ids": ids[order][perm], "x": vectors[order][perm], "start": np.array(start), "stop": np.array(stop), "left": np.array(left),
        "right": np.array(right), "centre": np.array(centre).reshape(len(start), -1), "radius": np.array(radius),
    }


def root_bound(tree: dict[str, np.ndarray], q: np.ndarray) -> float:
    """The largest inner product that any of the queries can have with any vector of the tree."""
    q = q.astype(np.float64)
    return float((q @ tree["centre"][0] + np.sqrt((q**2).sum(axis=1)) * tree["radius"][0]).max(initial=-np.inf))


def search(tree: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, so_far: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best (scores, ids), NONE where there are fewer, of this tree and of ``so_far``, what was found before.
    Scores below ``floor`` may be left out: the k-th score is known to be no lower."""
    n = len(qids)
    best, best_ids = so_far or (np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max))
    x, ids = tree["x"], tree["ids"]
    reach = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(x).max(initial=0))) * max(1, q.shape[1])
    kind = np.float64 if reach < EXACT_IN_DOUBLE else np.int64
    qk, xk = q.astype(kind), x.astype(kind)
    qf = q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        inner, spread = qf[who] @ tree["centre"][node], norm[who] * tree["radius"][node]
        return inner + spread + 1e-6 + 1e-9 * (np.abs(inner) + spread)

    everyone = np.arange(n)
    first = bound(0, everyone)
    heap = [(-float(first.max(initial=-np.inf)), 0, everyone, first)]
    while heap:
        _, node, who, limit = heapq.heappop(heap)
        live = limit >= np.maximum(best[who, k - 1], floor[who])
        who = who[live]
        if not len(who):
            continue
        if tree["left"][node] >= 0:
            for child in (int(tree["left"][node]), int(tree["right"][node])):
                limit = bound(child, who)
                heapq.heappush(heap, (-float(limit.max()), child, who, limit))
            continue
        a, b = int(tree["start"][node]), int(tree["stop"][node])
        score = np.rint(qk[who] @ xk[a:b].T).astype(np.int64) if kind is np.float64 else qk[who] @ xk[a:b].T
        score[qids[who][:, None] == ids[a:b][None, :]] = NONE
        better = score.max(axis=1, initial=NONE) >= np.maximum(np.maximum(best[who, k - 1], floor[who]), NONE + 1)
        who, score = who[better], score[better]
        if not len(who):
            continue
        all_ids = np.concatenate([best_ids[who], np.broadcast_to(ids[a:b], score.shape)], axis=1)
        score = np.concatenate([best[who], score], axis=1)
        if score.shape[1] > 4 * k:  # all that can be among the k best: those from the k-th score on
            kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            width = int((score >= kth[:, None]).sum(axis=1).max())
            keep = np.argsort(score < kth[:, None], axis=1, kind="stable")[:, :width]
            score, all_ids = np.take_along_axis(score, keep, 1), np.take_along_axis(all_ids, keep, 1)
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        score, all_ids = np.take_along_axis(score, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
        top = np.argsort(~score, axis=1, kind="stable")[:, :k]  # the complement turns the order round without overflow
        best[who], best_ids[who] = np.take_along_axis(score, top, 1), np.take_along_axis(all_ids, top, 1)
    return best, best_ids


def integers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, v) of the rows that take part."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return rows.where(sound).select(F.col(key).cast("long").alias("id"), F.size(v).alias("dim"), whole.alias("v")).where("id IS NOT NULL")


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one vector for each id."""
    rows = sorted(zip(frame["id"].tolist(), map(tuple, frame["v"]), strict=True))
    rows = [r for i, r in enumerate(rows) if not i or rows[i - 1][0] != r[0]]
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), int(frame["dim"].iloc[0]))


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    ids, x = _matrix(frame)
    return pd.DataFrame({"dim": frame["dim"].iloc[:1], "shard": frame["shard"].iloc[:1], "tree": [dumped(**build(ids, narrow(x)))]})


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    ids, q = _matrix(frame)
    floor = frame.groupby("id")["floor"].first().reindex(ids).to_numpy(dtype=np.int64)
    return pd.DataFrame({"dim": frame["dim"].iloc[:1], "block": frame["block"].iloc[:1], "queries": [dumped(ids=ids, q=narrow(q), floor=floor)]})


def narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _searcher(k: int):
    def run(lots: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        opened = [loaded(t) for t in trees["tree"]]
        for raw in lots["queries"]:
            asked = loaded(raw)
            q, so_far = asked["q"].astype(np.int64), None
            for tree in sorted(opened, key=lambda t: -root_bound(t, q)):
                so_far = search(tree, asked["ids"], q, k, asked["floor"], so_far)
            if so_far:
                best, ids = so_far
                found = best > NONE
                out.append(pd.DataFrame({"query_id": np.repeat(asked["ids"], found.sum(axis=1)), "vec_id": ids[found], "score": best[found]}))
        return pd.concat(out, ignore_index=True)

    return run


def rounds(groups: int) -> list[tuple[int, int]]:
    """(first, last) tree group of each round; each has ``GROWTH`` times as many as all before."""
    out, at = [], 0
    while at < groups:
        end = min(groups, max(1, (GROWTH + 1) * at))
        out.append((at, end - 1))
        at = end
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates.

    A task holds ``TREES_AT_ONCE`` trees and ``BLOCKS_AT_ONCE`` blocks. Between rounds go k rows for each query.
    """
    used = integers(rows, key, vector)
    dealt = lambda of, name: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(name)
    group = lambda column, size: F.floor(F.col(column) / size).cast("int")
    shards = max(1, -(-used.count() // shard_rows))
    trees = cut(in_batches(used).select("*", dealt(shards, "shard")).groupBy("dim", "shard").applyInPandas(_shard, "dim int, shard int, tree binary"))
    asked = integers(rows.where(is_query), key, vector)
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.select("*", dealt(blocks, "block"))
    trees = trees.withColumn("trees", group("shard", TREES_AT_ONCE)).withColumn("blocks", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_AT_ONCE))))
    at, best, floors = ["dim", "trees", "blocks"], None, None
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for first, last in rounds(-(-shards // TREES_AT_ONCE)):
        known = asked.withColumn("floor", F.lit(NONE)) if floors is None else asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        lots = known.groupBy("dim", "block").applyInPandas(_block, "dim int, block int, queries binary")
        lots = lots.withColumn("trees", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("blocks", group("block", BLOCKS_AT_ONCE))
        met = trees.where(F.col("trees").between(first, last))
        found = lots.groupBy(*at).cogroup(met.groupBy(*at)).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = cut(found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k))
        floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    return best
