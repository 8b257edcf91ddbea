"""The command line: python -m lorekeep COMMAND, over a project's folder and its store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from lorekeep.api import Config, Workspace
from lorekeep.plans import report

SHOWN = 200


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorekeep")
    p.add_argument("--root", default=".", help="the project's folder")
    p.add_argument("--store", default=None, help="where tables are kept (default: ROOT/.lorekeep/store)")
    p.add_argument("--docs", default="docs", help="the folder of documents below ROOT")
    p.add_argument("--json", action="store_true", help="rows as JSON lines")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text, *arguments in (
        ("index", "index documents and code", "--force"), ("reindex", "drop vectors and index anew"), ("status", "count what is stored"), ("list", "list documents", "--type="),
        ("search", "search documents", "query", "--limit=5", "--refs", "--body", "--budget=0"), ("context", "search with sources, code and related documents", "query", "--limit=5", "--budget=0"),
        ("doc", "a document's chunks", "file"), ("update", "write a document from standard input", "file"), ("neighbors", "a node's edges", "node", "--direction=both", "--kind="),
        ("path", "a shortest path", "start", "goal", "--depth=6"), ("explain", "a node's edges by kind", "node"), ("trace", "trace an rpc", "rpc", "--format=markdown"),
        ("report", "analyse the graph", "--format=markdown"), ("gc", "nodes without edges", "--delete"), ("faq", "questions that history answers", "--log=", "--issues="),
    ):
        c = sub.add_parser(name, help=text)
        for a in arguments:
            flag, given, default = a.partition("=")
            if not given:
                c.add_argument(flag, **({"action": "store_true"} if flag.startswith("--") else {}))
            else:
                c.add_argument(flag, default=int(default) if default.isdigit() else default or None, type=int if default.isdigit() else str)
    return p


def show(result, as_json: bool, out=sys.stdout) -> None:
    """Frames as lines (``SHOWN`` at most, and says so), all else as it is."""
    if isinstance(result, DataFrame):
        rows = [r.asDict(recursive=True) for r in result.drop("embedding").limit(SHOWN + 1).collect()]
        for r in rows[:SHOWN]:
            print(json.dumps(r, default=str, ensure_ascii=False) if as_json else "\t".join(str(v) for v in r.values()), file=out)
        if len(rows) > SHOWN:
            print(f"... more than {SHOWN} rows", file=sys.stderr)
    elif isinstance(result, dict):
        for name, part in result.items():
            if isinstance(part, DataFrame):
                print(f"# {name}", file=out)
                show(part, as_json, out)
            else:
                print(f"{name}\t{part}", file=out)
    elif result is not None:
        print(result, file=out)


def answer(w: Workspace, a: argparse.Namespace):
    nodes = lambda: (w.store.read("nodes"), w.store.read("edges"))
    match a.command:
        case "index":
            return w.index(a.force)
        case "reindex":
            return w.reindex()
        case "status":
            return w.status()
        case "list":
            return w.list_documents(a.type)
        case "search":
            return w.search_docs(a.query, a.limit, a.refs, a.body, a.budget)
        case "context":
            return w.get_context(a.query, a.limit, a.budget)
        case "doc":
            return w.get_document(a.file)
        case "update":
            return w.update_docs(a.file, sys.stdin.read())
        case "neighbors":
            return w.graph_neighbors(a.node, a.direction, a.kind.split(",") if a.kind else None)
        case "path":
            return w.graph_path(a.start, a.goal, a.depth)
        case "explain":
            return w.graph_explain(a.node)
        case "trace":
            return w.trace_rpc(a.rpc, a.format)
        case "report":
            found = report.analyze(*nodes())
            return report.to_json(found) if a.format == "json" else report.to_markdown(found)
        case "gc":
            return w.collect_garbage(delete=a.delete)
        case "faq":
            return {"written": w.write_questions(a.log, a.issues)}
    raise ValueError(a.command)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lorekeep").getOrCreate()
    w = Workspace(spark, a.root, a.store or f"{a.root.rstrip('/')}/.lorekeep/store", config=Config(docs_dir=a.docs))
    try:
        show(answer(w, a), a.json, out)
    except (KeyError, ValueError) as e:
        print(f"lorekeep: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
