"""An rpc's trace for a reader or a program."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

LISTED = 200


def streaming(meta: dict) -> str:
    """unary, or which sides stream."""
    client, server = bool(meta.get("client_streaming")), bool(meta.get("server_streaming"))
    return "bidirectional streaming" if client and server else "client streaming" if client else "server streaming" if server else "unary"


def facts(asked: str, found: dict[str, DataFrame]) -> dict:
    """Plain values of the frames; lists have ``LISTED`` rows at most, and say so."""
    rows = {name: [r.asDict() for r in df.limit(LISTED + 1).collect()] for name, df in found.items()}
    node = rows["definition"][0]
    meta = json.loads(node["metadata"] or "{}")
    *package, service, method = node["id"].removeprefix("sym:").split(".")
    site = lambda r: {"symbol": r["id"].removeprefix("sym:"), "file": r["source_path"], "line": r["line_number"]}
    return {
        "asked": asked,
        "definition": {
            "package": ".".join(package), "service": service, "method": method, "file": node["source_path"], "line": node["line_number"],
            "input": meta.get("input_type", ""), "output": meta.get("output_type", ""), "kind": streaming(meta),
            "fields": [{k: r[k] for k in ("role", "level", "message", "field", "type", "number")} for r in rows["fields"][:LISTED]],
        },
        "implementations": [site(r) | {"language": r["language"], "side": r["side"]} for r in rows["implementations"][:LISTED]],
        "callers": [site(r) | {"depth": r["depth"]} for r in rows["callers"][:LISTED]],
        "direct_callers": [site(r) for r in rows["direct"][:LISTED]],
        "related": [site(r) for r in rows["related"][:LISTED]],
        "more": sorted(name for name, r in rows.items() if len(r) > LISTED),
    }


def render(asked: str, found: dict[str, DataFrame], format: str) -> str:
    out = facts(asked, found)
    if format == "json":
        return json.dumps(out, indent=2, ensure_ascii=False)
    d = out["definition"]
    lines = [f"# {'.'.join(filter(None, (d['package'], d['service'], d['method'])))}", "", f"{d['file']}:{d['line']} ({d['kind']})", f"{d['input']} -> {d['output']}", ""]
    for role in ("input", "output"):
        own = [f for f in d["fields"] if f["role"] == role]
        if own:
            lines += [f"## Fields of the {role}", "", *(f"{'  ' * (f['level'] - 1)}- {f['message']}.{f['field']}: {f['type']} = {f['number']}" for f in own), ""]
    for title, key, text in (
        ("Implementations", "implementations", lambda r: f"- {r['language']} {r['side']}: {r['symbol']} ({r['file']}:{r['line']})"),
        ("Callers of the rpc", "direct_callers", lambda r: f"- {r['symbol']} ({r['file']}:{r['line']})"),
        ("Callers of implementations", "callers", lambda r: f"- {r['symbol']} ({r['file']}:{r['line']}, {r['depth']} away)"),
        ("Other rpcs of the service", "related", lambda r: f"- {r['symbol']}"),
    ):
        if out[key]:
            lines += [f"## {title}", "", *map(text, out[key]), ""]
    if out["more"]:
        lines.append(f"Lists end after {LISTED} rows: {', '.join(out['more'])}.")
    return "\n".join(lines)
