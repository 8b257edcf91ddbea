"""Property-graph operators over two frames: nodes (id, kind, label, source_path, metadata, line_number) and edges
(from_node, to_node, kind, weight, metadata).

A point query filters; a walk is a loop of joins from a frontier, one for each hop, whose number the caller bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import display_id
from lorekeep.operators.store import settle

MAX_DEPTH = 6


class Ambiguous(ValueError):
    """A name fits several nodes."""


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def of_kind(rows: DataFrame, kind: str, metadata: str | None = None) -> DataFrame:
    """Nodes or edges of a kind; with ``metadata``, those whose metadata has that text, small and capital letters alike."""
    out = rows.where(F.col("kind") == kind)
    return out if metadata is None else out.where(F.lower("metadata").contains(metadata.lower()))


def find_nodes(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The node of that id, then those whose label or path has the text, by label."""
    q = query.lower()
    hit = (F.col("id") == query) | F.lower("label").contains(q) | F.coalesce(F.lower("source_path").contains(q), F.lit(False))
    return nodes.where(hit).orderBy(F.col("id") != query, "label", "id").limit(limit)


def resolve_node(nodes: DataFrame, name: str, prefixes: list[str] | None = None) -> str:
    """The id that a name stands for: itself, else with a prefix, else the only node found by text."""
    from lorekeep.functions.text import ID_PREFIXES

    for wanted in ([name], [p + name for p in prefixes or ID_PREFIXES]):
        hits = [r["id"] for r in nodes.where(F.col("id").isin(wanted)).select("id").limit(len(wanted)).collect()]
        if len(hits) == 1:
            return hits[0]
        if hits:
            raise Ambiguous(f"{name}: {sorted(hits)}")
    hits = [r["id"] for r in find_nodes(nodes, name, 10).collect()]
    if len(hits) == 1:
        return hits[0]
    raise Ambiguous(f"{name}: {hits}") if hits else KeyError(name)


def neighbors(edges: DataFrame, node_id: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """Incident edges; the kinds bind for both directions."""
    out, into = F.col("from_node") == node_id, F.col("to_node") == node_id
    hit = {"out": out, "in": into, "both": out | into}[direction]
    rows = edges.where(hit)
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.orderBy("from_node", "to_node", "kind")


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    """(kind, other): a row for each edge of the node, whatever their number."""
    other = F.when(F.col("from_node") == node_id, F.col("to_node")).otherwise(F.col("from_node"))
    return edges.where((F.col("from_node") == node_id) | (F.col("to_node") == node_id)).select("kind", other.alias("other"))


def explain(edges: DataFrame, node_id: str, most: int | None = None) -> DataFrame:
    """(kind, others, n): the other ends by kind, as a list for a reader. ``most`` bounds the list of a hub, of which
    ``incident`` has all; ``n`` counts all."""
    near = incident(edges, node_id)
    if most is not None:
        near = near.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("other")))
        listed = near.where(F.col("nth") <= most).groupBy("kind").agg(F.sort_array(F.collect_list("other")).alias("others"))
        return listed.join(near.groupBy("kind").agg(F.count("*").alias("n")), "kind")
    return near.groupBy("kind").agg(F.sort_array(F.collect_list("other")).alias("others"), F.count("*").alias("n"))


def k_hop(edges: DataFrame, start: list[str], hops: int, kinds: list[str] | None = None, backward: bool = False) -> DataFrame:
    """(id, depth) of what can be reached, least depth first, the start included."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    a, b = ("to_node", "from_node") if backward else ("from_node", "to_node")
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], "id string, depth int")
    front = seen
    for d in range(1, hops + 1):
        front = settle(front.join(steps, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth")))
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(step, from_node, to_node, kind, weight) of a directed path with fewest edges; of several, the one whose steps come
    first by (to, kind) hop by hop. No rows for a node to itself, or without a path."""
    spark = edges.sparkSession
    schema = "step int, from_node string, to_node string, kind string, weight double"
    empty = spark.createDataFrame([], schema)
    max_depth = max_depth if max_depth > 0 else MAX_DEPTH
    if start == goal:
        return empty
    one = Window.partitionBy("to_node").orderBy("order", "kind")
    front = spark.createDataFrame([(start, "", [])], "id string, `order` string, steps array<struct<from_node string, to_node string, kind string, weight double>>")
    seen = front.select("id")
    for _ in range(max_depth):
        ahead = front.join(edges, front["id"] == edges["from_node"]).join(seen.withColumnRenamed("id", "to_node"), "to_node", "left_anti")
        step = F.struct("from_node", "to_node", "kind", F.col("weight").cast("double").alias("weight"))
        # the order of the frontier is by the steps taken: \x01 and \x02 come before any character of an id
        ahead = ahead.select("to_node", "kind", F.concat("order", F.lit("\x01"), "to_node", F.lit("\x02"), "kind").alias("order"), F.concat("steps", F.array(step)).alias("steps"))
        front = ahead.withColumn("nth", F.row_number().over(one)).where("nth = 1").select(F.col("to_node").alias("id"), "order", "steps")
        front = settle(front)
        found = front.where(F.col("id") == goal)
        if not found.isEmpty():
            return found.select(F.posexplode("steps").alias("at", "s")).select((F.col("at") + 1).cast("int").alias("step"), "s.*")
        if front.isEmpty():
            return empty
        seen = seen.unionByName(front.select("id"))
    return empty


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): one for each end of an edge, one for a loop."""
    ends = edges.select(F.col("from_node").alias("id")).unionAll(edges.where("from_node <> to_node").select(F.col("to_node").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Nodes (of the kinds) without an edge."""
    rows = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    ends = edges.select(F.col("from_node").alias("id")).union(edges.select(F.col("to_node").alias("id")))
    return rows.join(ends, "id", "left_anti").select(*nodes.columns)


def affected_paths(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(source_path) of other files with a symbol that has an edge to one of this file's nodes."""
    own = nodes.where(F.col("source_path") == path).select(F.col("id").alias("to_node"))
    users = edges.join(own, "to_node", "left_semi").select(F.col("from_node").alias("id"))
    out = nodes.join(users, "id", "left_semi").where("source_path IS NOT NULL AND source_path <> ''").where(F.col("source_path") != path)
    return out.select("source_path").distinct()


def mentions(refs: DataFrame) -> DataFrame:
    """Document-to-file edges of refs (doc_id, code_file_id)."""
    return refs.select(F.concat(F.lit("doc:"), "doc_id").alias("from_node"), F.concat(F.lit("file:"), "code_file_id").alias("to_node"), F.lit("mentions").alias("kind"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata")).distinct()


def shared_references(refs: DataFrame, left: str = "doc_id", by: str = "code_file_id", most: int | None = None) -> DataFrame:
    """(a, b): pairs of documents that refer to one file, a < b, each once.

    The result itself has all pairs of a file's documents, so that it grows with the square of a file's references;
    ``most`` leaves files with more references to ``shared_groups``, which has them as groups.
    """
    pairs = refs.select(left, by).distinct()
    if most is not None:
        few = pairs.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(by)
        pairs = pairs.join(few, by, "left_semi")
    other = pairs.select(F.col(left).alias("b"), by)
    return pairs.select(F.col(left).alias("a"), by).join(other, by).where("a < b").select("a", "b").distinct()


def shared_groups(refs: DataFrame, left: str = "doc_id", by: str = "code_file_id") -> DataFrame:
    """(by, first, n): each file's number of documents and the first of them; membership is ``refs`` itself."""
    return refs.select(left, by).distinct().groupBy(by).agg(F.min(left).alias("first"), F.count("*").alias("n"))


def related_documents(documents: DataFrame, edges: DataFrame, doc_id: str) -> DataFrame:
    """Documents that share a file with this one, by title."""
    me = f"doc:{doc_id}"
    shared = edges.where(F.col("kind") == "shared_code_ref")
    ids = shared.where(F.col("from_node") == me).select(F.col("to_node").alias("n")).union(shared.where(F.col("to_node") == me).select("from_node"))
    other = ids.select(F.regexp_replace("n", "^doc:", "").alias("id")).where(F.col("id") != doc_id).distinct()
    return documents.join(other, "id", "left_semi").select(*documents.columns).orderBy("title", "id")


def labels(nodes: DataFrame) -> DataFrame:
    """(id, label): the label, or the id without its prefix."""
    return nodes.select("id", F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(display_id(F.col("id"))).alias("label"))


def target_id(kind: Column, target: Column, node_kind: Column) -> Column:
    """The node id that a reference of a kind points to; null for kinds that make no edge."""
    prefixed = lambda p: F.concat(F.lit(p), target)
    rerouted = F.when(node_kind == "external", prefixed("ext:")).when(node_kind.isin("code_file", "file"), prefixed("file:"))
    named = F.when(kind.isin("call", "inherits", "extends", "implements", "requires", "references", "body_references", "import", "implements_rpc", "call_rpc"), prefixed("sym:"))
    return F.coalesce(rerouted, named, F.when(kind.isin("part", "mentions", "tests"), prefixed("file:")), F.when(kind == "config-key", prefixed("key:")))
