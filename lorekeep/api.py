"""The tools: searches, documents, graph questions, and writes, over a store's tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.embed import Embedder, HashEmbedder, Reranker, Summarizer, check_model, dimension, reranked, summary
from lorekeep.operators import graph as G
from lorekeep.operators import resolve as R
from lorekeep.operators import retrieval as S
from lorekeep.operators.store import Store, fill_summaries, settle
from lorekeep.plans import faq, trace
from lorekeep.plans import index as I
from lorekeep.sources.files import closed_issues, default_registry, git_log, ignore_rules, scan, walk, without_generated
from lorekeep.sources.handlers import parse_files


def within(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


@dataclass
class Config:
    docs_dir: str = "docs"
    hybrid: bool = True
    test_edges: bool = True
    exclude: list[str] = field(default_factory=list)
    metric: str = "l2"
    rerank_top: int = S.RERANK_TOP


class Workspace:
    """A store and what is asked of it. A summarizer fills the chunks' summaries, a reranker orders vector searches."""

    def __init__(self, spark: SparkSession, root: str, store: str, embedder: Embedder | None = None, config: Config | None = None, reranker: Reranker | None = None, summarizer: Summarizer | None = None):
        self.spark, self.root, self.config = spark, root, config or Config()
        self.store, self.embedder = Store(spark, store), embedder or HashEmbedder()
        self.reranker, self.summarizer = reranker, summarizer

    # --- writing ---

    def _parsed(self, name: str, files: DataFrame, force: bool) -> DataFrame:
        """The files' parsed rows: those that the store has for the same content, and the others made now."""
        fresh, kept = I.still_parsed(files, self.store.read(name), force)
        made = parse_files(fresh)
        return settle(made if kept is None else kept.unionByName(made))

    def index(self, force: bool = False) -> dict[str, int]:
        """Documents of the docs folder, code of the whole project. Files whose content is the stored one are not parsed
        again, and unchanged documents keep their chunks and vectors. Another model than the store's is refused before
        anything is embedded."""
        stored = self.store.read("meta")
        meta = check_model({r["key"]: r["value"] for r in stored.collect()} if stored is not None else {}, self.embedder.model(), dimension(self.embedder))
        files = walk(scan(self.spark, f"{self.root}/{self.config.docs_dir}"), default_registry(), self.config.exclude)
        old_docs, old_chunks = self.store.read("documents"), self.store.read("chunks")
        parsed = self._parsed("parsed_docs", files, force)
        docs, chunks = I.documents(parsed), I.document_chunks(parsed, self.embedder)
        if old_chunks is not None and not force:
            same = docs.select("file_path", "content_hash").join(old_docs.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi").select("file_path")
            changed = parsed.join(same.withColumnRenamed("file_path", "path"), "path", "left_anti")
            chunks = old_chunks.join(same, "file_path", "left_semi").select(*chunks.columns).unionByName(I.document_chunks(changed, self.embedder))
        frames = {}
        if self.summarizer is not None:
            cache = self.store.read("summary_cache")
            cache = self.spark.createDataFrame([], "content_hash string, summary string") if cache is None else cache
            filled, cache = fill_summaries(chunks.withColumn("embedding_text", F.col("content")), cache, lambda c: summary(self.summarizer, c))
            chunks, frames["summary_cache"] = filled.select(*chunks.columns), settle(cache)
        everything = scan(self.spark, self.root)
        sources = without_generated(walk(everything, default_registry(), self.config.exclude, ignore_rules(everything)))
        code = self._parsed("parsed_code", sources, force)
        nodes, edges = I.resolve_all(code, *I.project(code), tests=self.config.test_edges, files=sources)
        cited, refs = map(settle, I.code_files(parsed))
        docs, chunks, nodes = settle(docs), settle(chunks), settle(nodes)
        doc_nodes, doc_edges = I.document_graph(docs, refs, cited)
        nodes = nodes.unionByName(doc_nodes.join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))
        postings, lengths = S.word_index(chunks)
        frames |= {"postings": postings.repartitionByRange("term").sortWithinPartitions("term"), "lengths": lengths}
        frames["meta"] = self.spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1)
        self.store.write(documents=docs, chunks=chunks, code_files=cited, refs=refs, nodes=nodes, edges=edges.unionByName(doc_edges), parsed_docs=parsed, parsed_code=code, **frames)
        errors = parsed.where("error IS NOT NULL").count() + code.where("error IS NOT NULL").count()
        return self.status() | {"errors": errors}

    def reindex(self) -> dict[str, int]:
        """Drop vectors, chunks and the model's record, and make them anew, as for another model."""
        self.store.clear_vectors()
        return self.index(force=True)

    def write_questions(self, git_log_path: str | None = None, issues_path: str | None = None, folder: str = "faq") -> int:
        """Questions that a log or closed issues answer, as documents of the docs folder; then index. Returns how many."""
        rows = []
        if git_log_path:
            rows.append(git_log(self.spark, git_log_path).select(F.col("hash").alias("id"), F.col("subject").alias("title"), F.col("body").alias("detail")))
        if issues_path:
            rows.append(closed_issues(self.spark, issues_path))
        if not rows:
            return 0
        both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        made = faq.as_markdown(faq.entries(faq.questions_from(both), self.embedder))
        base = f"{self.root}/{self.config.docs_dir}/{folder}"
        os.makedirs(base, exist_ok=True)
        n = 0
        for r in made.toLocalIterator():
            with open(os.path.join(base, os.path.basename(r["file_name"])), "w", encoding="utf-8") as f:
                f.write(r["content"])
            n += 1
        self.index()
        return n

    def update_docs(self, file_path: str, content: str) -> None:
        """Write a document, which must lie in the docs folder, and index it."""
        base = os.path.realpath(f"{self.root}/{self.config.docs_dir}")
        target = os.path.realpath(os.path.join(base, file_path))
        if not target.startswith(base + os.sep):
            raise ValueError(f"{file_path} is outside of the docs folder")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(content)
        self.index()

    def capture_session(self, title: str, body: str, category: str = "sessions", session_id: str = "", author: str = "") -> str:
        """Write a note under its category; the file's name comes from the date and the title."""
        one_line = lambda s: re.sub(r"[\r\n]+", " ", s).strip()
        name = re.sub(r"[^a-z0-9]+", "-", one_line(title).lower()).strip("-")
        name = (name if len(name) <= 50 else name[:50].rsplit("-", 1)[0]) or "note"
        folder = re.sub(r"[^a-z0-9-]+", "-", one_line(category).lower()).strip("-") or "sessions"
        path = f"{folder}/{datetime.now(timezone.utc):%Y-%m-%d}-{name}.md"
        head = {"title": one_line(title), "type": folder, "session_id": one_line(session_id), "author": one_line(author)}
        self.update_docs(path, "---\n" + "".join(f"{k}: {v!r}\n" for k, v in head.items() if v) + f"---\n\n# {head['title']}\n\n{body}\n")
        return path

    def collect_garbage(self, kinds: list[str] | None = None, delete: bool = False) -> DataFrame:
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        lost = G.orphans(nodes, edges, kinds or ["symbol"])
        if delete:
            self.store.write(nodes=nodes.join(lost.select("id"), "id", "left_anti").select(*nodes.columns))
        return lost.orderBy("id")

    # --- reading ---

    def status(self) -> dict[str, int]:
        out = {}
        for name in ("documents", "chunks", "nodes", "edges"):
            df = self.store.read(name)
            out[name] = df.count() if df is not None else 0
        return out

    def search_docs(self, query: str, limit: int = 5, include_refs: bool = False, include_body: bool = False, budget: int = 0) -> DataFrame:
        chunks, limit = self.store.read("chunks"), within(limit, 1, 20)
        vector = self.embedder.embed_batch([query])[0]
        if self.config.hybrid:
            found = S.hybrid_search(chunks, vector, query, limit, self.config.metric, index=(self.store.read("postings"), self.store.read("lengths")))
        else:
            order = reranked(query, self.reranker, max(self.config.rerank_top, limit)) if self.reranker is not None else None
            found = S.search_chunks(chunks, vector, limit, self.config.metric, order, self.config.rerank_top)
        out = S.summaries_or_bodies(S.token_budget(found, budget), include_body)
        if include_refs:
            paths = S.referenced_paths(self.store.read("documents"), self.store.read("refs").select("doc_id", "code_file_id"), self.store.read("code_files"))
            out = out.join(paths, "file_path", "left")
        return out.orderBy("rank")

    def get_context(self, query: str, limit: int = 5, budget: int = 0) -> dict[str, DataFrame]:
        found = self.search_docs(query, within(limit, 1, 10), budget=budget)
        sources = self.store.read("documents").join(found.groupBy("doc_id").agg(F.min("rank").alias("rank")).withColumnRenamed("doc_id", "id"), "id").orderBy("rank")
        refs = self.store.read("refs").join(sources.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        files = self.store.read("code_files").join(refs.select(F.col("code_file_id").alias("id")).distinct(), "id", "left_semi")
        shared = self.store.read("edges").where("kind = 'shared_code_ref'")
        near = shared.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).union(shared.select("to_node", "from_node"))
        own = sources.select(F.concat(F.lit("doc:"), "id").alias("a"))
        other = near.join(own, "a", "left_semi").join(own.withColumnRenamed("a", "b"), "b", "left_anti").select(F.regexp_replace("b", "^doc:", "").alias("id")).distinct()
        return {"chunks": found, "sources": sources, "code": files.groupBy("ref_type").agg(F.sort_array(F.collect_list("file_path")).alias("paths")), "related": self.store.read("documents").join(other, "id", "left_semi").orderBy("title", "id")}

    def get_document(self, file_path: str) -> DataFrame:
        return self.store.read("chunks").where(F.col("file_path") == file_path).orderBy("chunk_index")

    def list_documents(self, doc_type: str | None = None) -> DataFrame:
        docs = self.store.read("documents")
        return (docs.where(F.col("doc_type") == doc_type) if doc_type else docs).orderBy("file_path")

    def expand_chunks(self, ids: list[int]) -> DataFrame:
        return self.store.read("chunks").where(F.col("chunk_id").isin(ids)).orderBy("chunk_id")

    def graph_neighbors(self, node_id: str, direction: str = "both", edge_kinds: list[str] | None = None) -> DataFrame:
        return G.neighbors(self.store.read("edges"), G.resolve_node(self.store.read("nodes"), node_id), direction, edge_kinds)

    def graph_path(self, from_id: str, to_id: str, max_depth: int = 6) -> DataFrame:
        nodes = self.store.read("nodes")
        return G.shortest_path(self.store.read("edges"), G.resolve_node(nodes, from_id), G.resolve_node(nodes, to_id), within(max_depth, 1, 20))

    def graph_explain(self, node_id: str) -> DataFrame:
        return G.explain(self.store.read("edges"), G.resolve_node(self.store.read("nodes"), node_id))

    def trace_rpc(self, rpc: str, format: str | None = None) -> dict[str, DataFrame] | str:
        """What is known of an rpc, as frames, or rendered as ``markdown`` or ``json``. Accepted are the node's id, its dotted
        path or the end of it, and file:method."""
        if format not in (None, "markdown", "json"):
            raise ValueError(f"unsupported format {format!r}")
        nodes = self.store.read("nodes")
        calls = nodes.where(F.col("metadata").contains('"input_type":'))
        name = rpc.strip().removeprefix("sym:")
        hits = [r["id"] for r in calls.where((F.col("id") == f"sym:{name}") | F.col("id").endswith(f".{name}") | (F.concat("source_path", F.lit(":"), "label") == rpc)).select("id").limit(10).collect()]
        hits = [f"sym:{name}"] if f"sym:{name}" in hits else hits
        if len(hits) != 1:
            raise G.Ambiguous(f"{rpc}: {sorted(hits)}") if hits else KeyError(rpc)
        found = R.rpc_implementations(self.store.read("edges"), nodes, hits[0])
        return found if format is None else trace.render(rpc, found, format)
