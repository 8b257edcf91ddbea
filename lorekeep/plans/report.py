"""A graph's report: analysis, and its rendering as JSON, Markdown and a page with a drawing."""

from __future__ import annotations

import html
import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import analytics as A

SCHEMA_VERSION = 1
DRAWN = 400
ITERATIONS = 120
#: A palette for communities.
COLOURS = "#4e79a7 #f28e2b #e15759 #76b7b2 #59a14f #edc948 #b07aa1 #ff9da7 #9c755f #bab0ac".split()


@dataclass
class Report:
    schema_version: int
    node_count: int
    edge_count: int
    edge_kinds: dict[str, int]
    god_nodes: list[dict]
    surprising: list[dict]
    communities: list[dict]
    questions: list[dict]


def analyze(nodes: DataFrame, edges: DataFrame, top: int = A.TOP, listed: int = 50) -> Report:
    """What is listed is bounded; counts come from the tables."""
    community = A.communities(nodes, edges).persist()
    gods, odd = A.god_nodes(nodes, edges, top), A.surprising(edges, community, top)
    named = A.community_labels(community, edges, nodes)
    rows = lambda df: [r.asDict() for r in df.collect()]
    try:
        return Report(
            SCHEMA_VERSION, nodes.count(), edges.count(), {r["kind"]: r["n"] for r in A.edge_kind_counts(edges).orderBy("kind").collect()}, rows(gods), rows(odd),
            rows(named.orderBy(F.desc("size"), "community").limit(listed)), rows(A.questions(gods, community, odd, named)),
        )
    finally:
        community.unpersist()


def to_json(r: Report) -> str:
    return json.dumps(asdict(r), indent=2, sort_keys=True, default=str)


def cell(x) -> str:
    return str(x).replace("|", "\\|").replace("\r\n", " ").replace("\n", " ")


def to_markdown(r: Report) -> str:
    out = ["# Graph report", "", f"{r.node_count} nodes, {r.edge_count} edges, {len(r.communities)} communities listed.", ""]
    for title, rows, columns in (("God nodes", r.god_nodes, ["label", "kind", "degree"]), ("Surprising connections", r.surprising, ["from_node", "to_node", "kind", "score"]), ("Communities", r.communities, ["label", "size"])):
        out += [f"## {title}", ""]
        if rows:
            out += ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(cell(x[c]) for c in columns) + " |" for x in rows)]
        else:
            out.append("_none_")
        out.append("")
    out += ["## Questions", "", *(f"- {q['text']}" for q in r.questions), ""]
    return "\n".join(out)


def layout(n: int, pairs: list[tuple[int, int]], iterations: int = ITERATIONS, seed: int = 42) -> np.ndarray:
    """Positions in the unit square: nodes push apart and edges pull together while the largest step shrinks."""
    rng = np.random.default_rng(seed)
    at = rng.random((n, 2))
    if n < 2:
        return at
    ideal = math.sqrt(1.0 / n)
    for step in range(iterations):
        gap = at[:, None] - at[None, :]
        far = np.maximum(np.sqrt((gap**2).sum(-1)), 1e-6)
        move = (gap / far[..., None] * (ideal**2 / far)[..., None]).sum(1)
        for a, b in pairs:
            d = at[a] - at[b]
            pull = d * max(float(np.sqrt((d**2).sum())), 1e-6) / ideal
            move[a] -= pull
            move[b] += pull
        size = np.maximum(np.sqrt((move**2).sum(-1)), 1e-9)
        at = np.clip(at + move / size[:, None] * np.minimum(size, 0.1 * (1 - step / iterations))[:, None], 0, 1)
    return at


def to_html(r: Report, nodes: list[dict], pairs: list[tuple[str, str]]) -> str:
    """One file without outside parts. ``nodes`` (id, label, degree, community) are at most ``DRAWN`` of highest degree."""
    nodes = sorted(nodes, key=lambda x: (-x["degree"], x["id"]))[:DRAWN]
    number = {x["id"]: i for i, x in enumerate(nodes)}
    lines = [(number[a], number[b]) for a, b in pairs if a in number and b in number]
    at = layout(len(nodes), lines) * 920 + 40
    colour = {c: COLOURS[i % len(COLOURS)] for i, c in enumerate(sorted({str(x["community"]) for x in nodes}))}
    svg = [f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#ccc"/>' for a, b in lines]
    for x, p in zip(nodes, at):
        radius = min(18.0, 4 + 2.5 * math.log1p(x["degree"]))
        svg.append(f'<circle cx="{p[0]:.1f}" cy="{p[1]:.1f}" r="{radius:.1f}" fill="{colour[str(x["community"])]}"><title>{html.escape(str(x["label"]))}</title></circle>')
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph report</title></head><body><svg viewBox="0 0 1000 1000">{"".join(svg)}</svg><pre>{html.escape(to_markdown(r))}</pre></body></html>'
