"""Graph analytics: kinds, degrees, surprising edges, communities, questions, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import display_id
from lorekeep.operators.graph import degrees
from lorekeep.operators.store import written

TOP = 10
GAIN = 1e-6  # modularity that a sweep must gain to count
LEAST = 1e-9  # gain of a move, in links, that is more than a rounding error


def edge_kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = TOP) -> DataFrame:
    """The nodes with most edges."""
    return degrees(edges).join(nodes.select("id", "label", "kind"), "id").orderBy(F.desc("degree"), "id").limit(top)


def surprising(edges: DataFrame, community: DataFrame, top: int = TOP) -> DataFrame:
    """Edges between communities (id, community): rare kinds and small communities first."""
    counts = edges.groupBy("kind").agg(F.count("*").alias("kind_count"))
    sizes = community.groupBy("community").agg(F.count("*").alias("size"))
    member = community.join(sizes, "community")
    ends = lambda end, p: member.select(F.col("id").alias(end), F.col("community").alias(f"{p}_community"), F.col("size").alias(f"{p}_size"))
    rows = edges.where("from_node <> to_node").join(ends("from_node", "from"), "from_node").join(ends("to_node", "to"), "to_node")
    rows = rows.where("from_community <> to_community").join(counts, "kind")
    score = F.lit(1.0) / F.col("kind_count") / F.greatest(F.least("from_size", "to_size"), F.lit(2))
    picked = rows.select("from_node", "to_node", "kind", "from_community", "to_community", F.round(score, 9).alias("score"))
    return picked.orderBy(F.desc("score"), "from_node", "to_node", "kind").limit(top)


def community_labels(community: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, size, label): each one's member with most edges names it, the smaller id at a tie."""
    deg = community.join(degrees(edges), "id", "left").join(nodes.select("id", "label"), "id", "left")
    named = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(display_id(F.col("id")))
    first = deg.groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "id", named.alias("label"))).alias("m"))
    return first.select("community", "size", F.col("m.label").alias("label"))


def questions(gods: DataFrame, community: DataFrame, surprises: DataFrame, named: DataFrame) -> DataFrame:
    """(kind, text), from lists of a few rows: what joins two hubs, why the top edge, what else is in the two largest
    communities."""
    spark = gods.sparkSession
    hubs = gods.join(community, "id", "left").orderBy(F.desc("degree"), "id").limit(TOP).collect()
    out = []
    if len(hubs) >= 2:
        other = next((h for h in hubs[2:] if h["community"] != hubs[0]["community"]), hubs[1]) if hubs[0]["community"] == hubs[1]["community"] else hubs[1]
        out.append(("god_pair", f"What connects {hubs[0]['label']} to {other['label']}?"))
    for s in surprises.withColumns({"a": display_id(F.col("from_node")), "b": display_id(F.col("to_node"))}).orderBy(F.desc("score"), "from_node", "to_node", "kind").limit(1).collect():
        out.append(("bridge", f'Why does {s["a"]} reference {s["b"]} via a "{s["kind"]}" edge?'))
    for c in named.orderBy(F.desc("size"), "label").limit(2).collect():
        out.append(("cluster_tour", f'What else lives in the "{c["label"]}" cluster ({c["size"]} nodes)?'))
    return spark.createDataFrame(out, "kind string, text string")


def simple_graph(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: undirected, without loops and repeats."""
    return edges.where("from_node <> to_node").select(F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")).distinct()


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): nodes move to the neighbouring community of largest gain in modularity until no sweep gains
    ``GAIN`` or more; communities become nodes, and so on until a level moves none. One algorithm at every size: each sweep
    is a few joins and aggregates, and nothing but its modularity comes to the driver.

    Loops and repeated edges count once or not at all; a node without edges is its own community; edges of unknown nodes
    are left out. A community is named by its smallest member.
    """
    known = nodes.select("id").where("id IS NOT NULL").distinct()
    ends = lambda end: known.withColumnRenamed("id", end)
    pairs = simple_graph(edges.join(ends("from_node"), "from_node", "left_semi").join(ends("to_node"), "to_node", "left_semi"))
    one = F.lit(1.0).alias("w")
    links = written(pairs.select("a", "b", one).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), one)))
    two_m = links.agg(F.sum("w")).first()[0]
    member = known.select("id", F.col("id").alias("group"))
    while two_m:
        place = _level(links, two_m)
        if place is None:
            break
        to = place.select(F.col("id").alias("group"), "home")
        member = written(member.join(to, "group", "left").select("id", F.coalesce("home", "group").alias("group")))
        a, b = place.select(F.col("id").alias("a"), F.col("home").alias("ha")), place.select(F.col("id").alias("b"), F.col("home").alias("hb"))
        links = written(links.join(a, "a").join(b, "b").groupBy(F.col("ha").alias("a"), F.col("hb").alias("b")).agg(F.sum("w").alias("w")))
    least = member.groupBy("group").agg(F.min("id").alias("least"))
    return member.join(least, "group").select("id", F.col("least").alias("community"))


def _level(links: DataFrame, two_m: float) -> DataFrame | None:
    """(id, home) after the sweeps of one level, None if no sweep gains. ``links`` (a, b, w) has both directions; a loop has
    the weight of all links inside, in both directions."""
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d"))
    loops = links.where("a = b").agg(F.sum("w")).first()[0] or 0.0
    between = links.where("a <> b")
    seen = _survey(between, degree.select("id", F.col("id").alias("home"), "d"), two_m)
    score, movers = _score(seen, loops, two_m)
    swept = False
    while movers:
        for alone in (False, True):
            then = _survey(between, _moved(seen, alone), two_m)
            now, left = _score(then, loops, two_m)
            if now >= score + GAIN:
                break
        else:
            break
        seen, score, movers, swept = then, now, left, True
    return seen.select("id", "home") if swept else None


def _survey(between: DataFrame, place: DataFrame, two_m: float) -> DataFrame:
    """(id, home, d, total, own, best): each node's community with its total degree, the weight of its links there, and the
    best other community as (value, total, community). Sums of whole weights are exact, so that ties are ties."""
    total = place.groupBy(F.col("home").alias("c")).agg(F.sum("d").alias("t"))
    near = between.join(place.select(F.col("id").alias("b"), F.col("home").alias("c")), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
    rows = near.join(total, "c").join(place, "id")
    value = F.col("w") - F.col("d") * F.col("t") / two_m
    other = F.when(F.col("c") != F.col("home"), F.struct(value.alias("value"), F.col("t").alias("t"), F.col("c").alias("c")))
    best = rows.groupBy("id").agg(F.sum(F.when(F.col("c") == F.col("home"), F.col("w"))).alias("own"), F.max(other).alias("best"))
    held = place.join(total.withColumnsRenamed({"c": "home", "t": "total"}), "home").join(best, "id", "left")
    return written(held.select("id", "home", "d", "total", F.coalesce("own", F.lit(0.0)).alias("own"), "best", _gain(two_m).alias("gain")))


def _gain(two_m: float) -> Column:
    return F.col("best.value") - (F.coalesce("own", F.lit(0.0)) - F.col("d") * (F.col("total") - F.col("d")) / two_m)


def _score(seen: DataFrame, loops: float, two_m: float) -> tuple[float, int]:
    """Modularity, and how many nodes would gain by a move."""
    row = seen.agg(F.sum("own"), F.sum(F.col("d") * F.col("total")), F.count(F.when(F.col("gain") > LEAST, 1))).first()
    return ((row[0] or 0.0) + loops) / two_m - (row[1] or 0.0) / two_m**2, row[2]


def _moved(seen: DataFrame, alone: bool) -> DataFrame:
    """(id, home, d) after the moves of a sweep. A community whose best move is one of its own nodes' gives nodes and takes
    none; the others take and give none, so that no two nodes change places. Moves to one community may still hinder each
    other: with ``alone`` a community has part in its best move only, and the gains add up."""
    key = F.struct("gain", F.col("best.t").alias("t"), F.col("best.c").alias("c"), F.col("id").alias("id"))
    moves = seen.where(F.col("gain") > LEAST).select("id", "home", F.col("best.c").alias("target"), key.alias("key"))
    parts = moves.select(F.col("home").alias("c"), "key", F.lit(True).alias("gives")).unionAll(moves.select(F.col("target").alias("c"), "key", F.lit(False).alias("gives")))
    role = parts.groupBy("c").agg(F.max(F.struct("key", "gives")).alias("top"))
    of = lambda end, name: role.select(F.col("c").alias(end), F.col("top").alias(name))
    taken = moves.join(of("home", "x"), "home").join(of("target", "y"), "target").where("x.gives AND NOT y.gives")
    if alone:
        taken = taken.where("x.key = key AND y.key = key")
    return seen.select("id", "home", "d").join(taken.select("id", "target"), "id", "left").select("id", F.coalesce("target", "home").alias("home"), "d")


class Anchors:
    """Unit vectors of one length, in the order in which they came."""

    def __init__(self, length: int):
        self.ids, self.rows = [], np.zeros((64, length))

    def first(self, block: np.ndarray, threshold: float) -> np.ndarray:
        """For each row of ``block`` the number of the first anchor that is near enough, -1 without one."""
        if not self.ids:
            return np.full(len(block), -1)
        near = block @ self.rows[: len(self.ids)].T >= threshold
        return np.where(near.any(axis=1), near.argmax(axis=1), -1)

    def add(self, id_, row: np.ndarray) -> None:
        if len(self.ids) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self.ids)] = row
        self.ids.append(id_)


def greedy_clusters(items: DataFrame, threshold: float = 0.85, key: str = "id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """(id, anchor): in order of key, an item joins the first anchor that is near enough, or becomes an anchor.

    Whether an item is an anchor depends on all before it, so that the pass is one stream in the order of keys. It holds
    the anchors; blocks of items are multiplied by those that were there before, and then by the block's own. Similarity is
    cosine; zero vectors and other lengths are alike to nothing.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors: dict[int, Anchors] = {}
        for b in batches:
            for at in range(0, len(b), block):
                part = b.iloc[at : at + block]
                ids, found = part["id"].tolist(), [None] * len(part)
                vectors = [np.array(v if v is not None else [], dtype=float) for v in part["v"]]
                for length in sorted({len(v) for v in vectors}):
                    where = [i for i, v in enumerate(vectors) if len(v) == length and v.any()]
                    if not where:
                        continue
                    held = anchors.setdefault(length, Anchors(length))
                    unit = np.stack([vectors[i] / np.sqrt((vectors[i] ** 2).sum()) for i in where])
                    known, old = held.first(unit, threshold), len(held.ids)
                    for i, row, n in zip(where, unit, known.tolist(), strict=True):
                        if n < 0 and len(held.ids) > old:  # anchors of this block
                            near = np.flatnonzero(held.rows[old : len(held.ids)] @ row >= threshold)
                            n = old + int(near[0]) if len(near) else -1
                        if n < 0:
                            held.add(ids[i], row)
                            n = len(held.ids) - 1
                        found[i] = held.ids[n]
                yield pd.DataFrame({"id": ids, "anchor": [i if f is None else f for i, f in zip(ids, found)]})

    rows = items.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = rows.repartition(1).sortWithinPartitions("id").mapInPandas(run, f"id {kind}, anchor {kind}")
    return out.withColumnRenamed("id", key)
