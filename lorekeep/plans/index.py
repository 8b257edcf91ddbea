"""From files to tables: the documents pass and the graph pass, each one plan over the parsed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.embed import Embedder, embedding
from lorekeep.functions.text import content_hash, language
from lorekeep.operators import graph as G
from lorekeep.operators import resolve as R
from lorekeep.operators import store as K
from lorekeep.plans.queries import code_references
from lorekeep.sources import code

#: Unit kinds that are no symbols, and kinds of edges that references make.
NO_SYMBOLS = ["section", "page", "row", "key-path", "paragraph"]
EDGE_KINDS = {"extends": "inherits", "implements": "inherits"}

NODE = ["id", "kind", "label", "source_path", "metadata", "line_number", "is_placeholder"]


def documents(parsed: DataFrame) -> DataFrame:
    """One row for each document that has chunks; its id is a hash of its path, so that it stays."""
    rows = parsed.where(F.col("error").isNull() & (F.size("chunks") > 0))
    return rows.select(F.sha2("path", 256).alias("id"), F.col("path").alias("file_path"), "title", "doc_type", "summary", "headings", "frontmatter", "content_hash", F.size("chunks").alias("chunk_count"))


def document_chunks(parsed: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with stored text (the text that is embedded) and vectors. Chunks without a vector stay without one."""
    rows = parsed.where(F.col("error").isNull()).select("path", F.explode("chunks").alias("c"))
    out = rows.select(
        F.xxhash64("path", "c.index").alias("chunk_id"), F.sha2("path", 256).alias("doc_id"), F.col("path").alias("file_path"), F.col("c.heading").alias("section_heading"), F.col("c.hierarchy").alias("section_hierarchy"),
        F.col("c.index").alias("chunk_index"), F.col("c.embedding_text").alias("content"), F.lit("").alias("summary"), F.col("c.token_count").alias("token_count"), F.coalesce(F.nullif("c.signal_meta", F.lit("")), F.lit("{}")).alias("signal_meta"),
    )
    return out.withColumn("embedding", embedding(embedder, F.col("content"))) if embedder else out


def code_files(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code_files, refs): the files, folders and patterns that documents mention."""
    chunks = document_chunks(parsed).select("doc_id", "chunk_index", F.col("content").alias("text"))
    whole = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    found = code_references(whole.select("doc_id", F.array_join(F.col("c.text"), "\n").alias("text")), "doc_id", "text")
    files = found.groupBy("path").agg(F.first("ref_type").alias("ref_type")).select(F.sha2("path", 256).alias("id"), F.col("path").alias("file_path"), language(F.col("path")).alias("language"), "ref_type")
    return files, found.select("doc_id", F.sha2("path", 256).alias("code_file_id"), F.col("path").alias("file_path")).distinct()


def document_graph(docs: DataFrame, refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of documents and code files; mentions, and edges between documents that share a file."""
    d = docs.select(F.concat(F.lit("doc:"), "id").alias("id"), F.lit("document").alias("kind"), F.col("title").alias("label"), F.col("file_path").alias("source_path"), F.lit("{}").alias("metadata"), F.lit(0).alias("line_number"), F.lit(False).alias("is_placeholder"))
    f = files.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("code_file").alias("kind"), F.col("file_path").alias("label"), F.col("file_path").alias("source_path"), F.lit("{}").alias("metadata"), F.lit(0).alias("line_number"), F.lit(True).alias("is_placeholder"))
    shared = G.shared_references(refs, "doc_id", "file_path").select(F.concat(F.lit("doc:"), "a").alias("from_node"), F.concat(F.lit("doc:"), "b").alias("to_node"), F.lit("shared_code_ref").alias("kind"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"))
    return d.unionByName(f), G.mentions(refs.select("doc_id", F.col("file_path").alias("code_file_id"))).unionByName(shared)


def project(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of code: files, their symbols, and what they refer to. A reference's target that no file defines
    is a placeholder, which any real node replaces."""
    rows = parsed.where(F.col("error").isNull())
    files = rows.groupBy("path").agg(F.max("metadata").alias("metadata")).select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("code_file").alias("kind"), F.col("path").alias("label"), F.col("path").alias("source_path"), "metadata", F.lit(0).alias("line_number"), F.lit(False).alias("is_placeholder"))
    units = rows.select("path", F.explode("units").alias("u")).where(~F.col("u.kind").isin(NO_SYMBOLS))
    symbol = units.select(F.concat(F.lit("sym:"), "u.path").alias("id"), F.lit("symbol").alias("kind"), F.col("u.title").alias("label"), F.col("path").alias("source_path"), F.col("u.metadata").alias("metadata"), F.col("u.line").alias("line_number"), F.lit(False).alias("is_placeholder"))
    contains = symbol.select(F.concat(F.lit("file:"), "source_path").alias("from_node"), F.col("id").alias("to_node"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"))
    refs = rows.select("path", F.explode("refs").alias("r")).select("path", "r.*")
    kind = F.create_map(*(F.lit(x) for p in EDGE_KINDS.items() for x in p))[F.col("kind")]
    refs = refs.withColumn("kind", F.coalesce(kind, F.col("kind"))).withColumn("node_kind", F.get_json_object("metadata", "$.node_kind"))
    target = F.when(F.col("kind") == "contains", F.concat(F.lit("sym:"), "target")).otherwise(G.target_id(F.col("kind"), F.col("target"), F.col("node_kind")))
    source = F.when(F.col("source").contains(":"), F.col("source")).when(F.col("source") == F.col("path"), F.concat(F.lit("file:"), "source")).otherwise(F.concat(F.lit("sym:"), "source"))
    edges = refs.select(source.alias("from_node"), target.alias("to_node"), "kind", F.lit(1.0).alias("weight"), "metadata").where("to_node IS NOT NULL")
    ends = edges.select(F.col("to_node").alias("id")).union(edges.select("from_node")).distinct()
    of_prefix = F.when(F.col("id").startswith("ext:"), F.lit("external")).when(F.col("id").startswith("file:"), F.lit("code_file")).when(F.col("id").startswith("key:"), F.lit("config_key")).otherwise(F.lit("symbol"))
    holders = ends.select("id", of_prefix.alias("kind"), F.regexp_replace("id", "^[a-z]+:", "").alias("label"), F.lit(None).cast("string").alias("source_path"), F.lit('{"unresolved":true}').alias("metadata"), F.lit(0).alias("line_number"), F.lit(True).alias("is_placeholder"))
    real = K.latest(files.unionByName(symbol).withColumn("seq", F.struct("source_path", "line_number").cast("string")), ["id"], "seq").drop("seq")
    nodes = real.select(*NODE).unionByName(holders.join(real.select("id"), "id", "left_anti").select(*NODE))
    return nodes, contains.unionByName(edges).dropDuplicates(["from_node", "to_node", "kind"])


def manifest_of(parsed: DataFrame) -> DataFrame | None:
    """(proto_path, lang, prefix) of the project's generator configuration, None without one."""
    plugins = parsed.where(F.col("metadata").contains('"buf_gen"')).select(F.explode(F.from_json(F.get_json_object("metadata", "$.buf_gen"), "array<struct<lang string, out string>>")).alias("p")).select("p.lang", "p.out", F.lit("").alias("project"))
    if plugins.isEmpty():
        return None
    protos = parsed.where("handler = 'proto'").select(F.col("path").alias("proto_path"), F.lit("").alias("project"))
    return R.buf_manifest(plugins, protos)


EDGE = ["from_node", "to_node", "kind", "weight", "metadata"]


def module_edges(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports of JavaScript and TypeScript with a relative specifier go to the file that it means, if there is one."""
    wanted = parsed.where("handler = 'javascript' AND error IS NULL").select("path", F.explode("refs").alias("r")).where("r.kind = 'import'").select("path", F.col("r.target").alias("specifier")).distinct()
    found = R.resolve_modules(wanted, parsed.select("path").distinct())
    ends = found.select(F.concat(F.lit("file:"), "path").alias("from_node"), F.concat(F.lit("sym:"), "specifier").alias("to_node"), F.concat(F.lit("file:"), "target").alias("file"))
    moved = edges.where("kind = 'import'").join(ends, ["from_node", "to_node"]).select("from_node", F.col("file").alias("to_node"), "kind", "weight", "metadata")
    kept = edges.join(ends.select("from_node", "to_node", F.lit("import").alias("kind")), ["from_node", "to_node", "kind"], "left_anti").select(*EDGE)
    return kept.unionByName(moved)


def call_rpc_edges(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """call_rpc edges from functions to the rpcs that they call on generated clients: connect stubs in TypeScript and
    JavaScript, client classes in Dart. What goes to the tasks is the generated classes, as many as the project has
    services. ``files`` has path and content."""
    stub = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    stubs = {r["const_name"]: r["service_typename"] for r in nodes.where(F.col("metadata").contains('"connect_es_stub"')).select(stub("const_name"), stub("service_typename")).distinct().collect()}
    dart = edges.where("kind = 'implements_rpc'").join(nodes.where(F.lower("source_path").endswith(".dart")).select(F.col("id").alias("from_node")), "from_node")
    registry: dict[str, dict[str, str]] = {}
    for r in dart.select("from_node", "to_node").collect():
        *_, cls, method = r["from_node"].split(".")
        registry.setdefault(cls, {})[method] = r["to_node"].removeprefix("sym:")
    schema = "caller string, rpc string"
    if not stubs and not registry:
        return edges.select(*EDGE).limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path, data in zip(b["path"], b["content"], strict=True):
                text = bytes(data).decode("utf-8", "replace")
                if path.endswith(".dart"):
                    found += code.dart_call_sites(path, text, registry)
                else:
                    found += [(f"{code.module_title(path)}.{caller}", rpc) for caller, rpc in code.connect_call_sites(text, stubs)]
            yield pd.DataFrame(found, columns=["caller", "rpc"])

    callable_ = F.col("path").rlike(r"(?i)\.(ts|tsx|js|jsx|mts|mjs|cts|cjs|dart)$") & ~F.col("path").rlike(r"(?i)_connect(web)?\.(ts|js)$")
    sites = files.where(callable_).select("path", "content").mapInPandas(run, schema).distinct()
    made = sites.select(F.concat(F.lit("sym:"), "caller").alias("from_node"), F.concat(F.lit("sym:"), "rpc").alias("to_node"), F.lit("call_rpc").alias("kind"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"))
    rpcs = nodes.where(F.col("metadata").contains('"input_type":')).select(F.col("id").alias("to_node"))
    callers = nodes.where("NOT is_placeholder").select(F.col("id").alias("from_node"))
    return made.join(callers, "from_node", "left_semi").join(rpcs, "to_node", "left_semi").select(*EDGE)


def resolve_all(parsed: DataFrame, nodes: DataFrame, edges: DataFrame, tests: bool = True, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The resolvers in order: modules, rpc implementations, calls of rpcs (with ``files``), names, body references, tests;
    then edges whose ends are gone go."""
    nodes, edges = K.settle(nodes), K.settle(edges)
    edges = K.settle(module_edges(parsed, edges.select(*EDGE)).unionByName(R.implements_rpc(nodes, manifest_of(parsed))))
    if files is not None:
        edges = edges.unionByName(call_rpc_edges(files, nodes, edges))
    edges = K.settle(R.resolve_names(K.settle(edges), nodes))
    bodies = edges.where("kind = 'body_references'").withColumns({"target_name": F.coalesce(F.get_json_object("metadata", "$.target_name"), F.regexp_replace("to_node", "^sym:", "")), "op": F.get_json_object("metadata", "$.op")})
    solved = R.resolve_body_references(bodies.select("from_node", "target_name", "op"), nodes.where("NOT is_placeholder"))
    solved = solved.select("from_node", "to_node", F.lit("body_references").alias("kind"), F.lit(1.0).alias("weight"), F.to_json(F.struct("op", F.when(F.col("unresolved"), F.lit(True)).alias("unresolved"), F.when(F.col("unresolved"), F.col("target_name")).alias("target_name"))).alias("metadata"))
    edges = edges.where("kind <> 'body_references'").unionByName(solved)
    if tests:
        edges = edges.unionByName(R.test_edges(parsed.select("path").distinct()))
    edges = K.settle(K.cascade_edges(edges.dropDuplicates(["from_node", "to_node", "kind"]), nodes))
    used = edges.select(F.col("to_node").alias("id")).union(edges.select("from_node"))
    return nodes.where("NOT is_placeholder").unionByName(nodes.where("is_placeholder").join(used, "id", "left_semi").select(*nodes.columns)), edges


def still_parsed(files: DataFrame, old: DataFrame | None, force: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(files to parse, parsed rows that hold): a file whose content's hash is that of its stored rows is not parsed again,
    and rows of files that are gone or changed go."""
    if old is None or force:
        return files, None
    now = files.select("path", content_hash(F.col("content")).alias("content_hash"))
    kept = old.join(now, ["path", "content_hash"], "left_semi").select(*old.columns)
    fresh = files.withColumn("content_hash", content_hash(F.col("content"))).join(old.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")
    return fresh.select(*files.columns), kept


def reindexed(new: DataFrame, old_documents: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content is not what the store has."""
    known = old_documents.select(F.col("file_path").alias("path"), F.col("content_hash").alias("old"))
    hashed = new.withColumn("__hash", content_hash(F.col("content")))
    if force:
        return hashed.drop("__hash")
    return hashed.join(known, "path", "left").where(F.col("old").isNull() | (F.col("old") != F.col("__hash"))).select(*new.columns)
