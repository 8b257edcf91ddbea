"""Configuration formats, Dockerfiles and SQL files."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib

import yaml

from lorekeep.sources.parsed import Parsed, Reference, Unit, note_signals


def _base(path: str) -> str:
    return posixpath.basename(path)


def _start(path: str, data: bytes, kind: str) -> Parsed:
    return Parsed(path, kind, _base(path), kind, data.decode("utf-8", "replace"))


def _whole(doc: Parsed, error: str | None = None) -> Parsed:
    doc.units = [Unit("key-path", doc.title, doc.title, doc.raw, 1, hierarchy=[doc.title], metadata={"parse_error": error} if error else {})]
    return doc


def comments(text: str, marks: str) -> str:
    """What stands behind a comment mark at a line's start or after white space."""
    return "\n".join(m[1].strip() for m in re.finditer(rf"(?m)(?:^|\s)[{re.escape(marks)}]\s?(.*)$", text))


def parse_yaml(path: str, data: bytes) -> Parsed:
    """A unit for each top-level key, with the lines from its comments to the next key's."""
    doc = _start(path, data, "yaml")
    try:
        root = yaml.compose(doc.raw, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        return _whole(doc, str(e))
    doc.signals = note_signals(comments(doc.raw, "#"))
    if not isinstance(root, yaml.MappingNode):
        return _whole(doc)
    lines = doc.raw.split("\n")
    keys = [k for k, _ in root.value]
    starts = []
    for k in keys:
        at = k.start_mark.line
        while at > (starts[-1] + 1 if starts else 0) and lines[at - 1].startswith("#"):
            at -= 1
        starts.append(at)
    for k, a, b in zip(keys, starts, [*starts[1:], len(lines)]):
        text = "\n".join(lines[a:b]).rstrip()
        doc.units.append(Unit("key-path", str(k.value), str(k.value), text, k.start_mark.line + 1, note_signals(comments(text, "#")), hierarchy=[doc.title, str(k.value)]))
    if _base(path) in ("buf.gen.yaml", "buf.gen.yml"):
        doc.metadata["buf_gen"] = buf_plugins(yaml.safe_load(doc.raw))
    return doc


#: Languages of protobuf generators by name.
PLUGIN_LANGUAGES = {"go": "go", "go-grpc": "go", "connect-go": "go", "dart": "dart", "es": "ts", "connect-es": "ts", "ts": "ts", "grpc-web": "ts", "js": "ts"}


def buf_plugins(config: dict) -> list[dict]:
    """(lang, out) of a generator configuration's plugins."""
    out = []
    for p in config.get("plugins") or []:
        name = str(p.get("name") or p.get("plugin") or p.get("remote") or p.get("local") or "").rsplit("/", 1)[-1].split(":")[0].removeprefix("protoc-gen-")
        if name in PLUGIN_LANGUAGES and p.get("out"):
            out.append({"lang": PLUGIN_LANGUAGES[name], "out": str(p["out"]), "plugin": name})
    return out


def parse_json(path: str, data: bytes) -> Parsed:
    doc = _start(path, data, "json")
    try:
        root = json.loads(doc.raw)
    except ValueError as e:
        return _whole(doc, str(e))
    if not isinstance(root, dict):
        return _whole(doc)
    for k in sorted(root):
        doc.units.append(Unit("key-path", k, k, f"{json.dumps(k)}: {json.dumps(root[k], indent=2, ensure_ascii=False)}", hierarchy=[doc.title, k]))
    return doc


def toml_value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, list):
        return "[" + ", ".join(map(toml_value, v)) + "]"
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{k} = {toml_value(x)}" for k, x in v.items()) + " }"
    return str(v)


def parse_toml(path: str, data: bytes) -> Parsed:
    doc = _start(path, data, "toml")
    try:
        root = tomllib.loads(doc.raw)
    except tomllib.TOMLDecodeError as e:
        return _whole(doc, str(e))
    for k in sorted(root):
        v = root[k]
        body = f"[{k}]\n" + "\n".join(f"{a} = {toml_value(b)}" for a, b in v.items()) if isinstance(v, dict) else f"{k} = {toml_value(v)}"
        doc.units.append(Unit("key-path", k, k, body, hierarchy=[doc.title, k]))
    doc.signals = note_signals(comments(doc.raw, "#"))
    return doc


def parse_xml(path: str, data: bytes) -> Parsed:
    doc = _whole(_start(path, data, "xml"))
    doc.signals = note_signals("\n".join(re.findall(r"(?s)<!--(.*?)-->", doc.raw)))
    doc.units[0].signals = doc.signals
    return doc


def parse_properties(path: str, data: bytes) -> Parsed:
    return _commented(_whole(_start(path, data, "properties")), "#!")


def parse_env(path: str, data: bytes) -> Parsed:
    return _commented(_whole(_start(path, data, "env")), "#")


def _commented(doc: Parsed, marks: str) -> Parsed:
    own = "\n".join(x.strip()[1:].strip() for x in doc.raw.split("\n") if x.strip()[:1] and x.strip()[0] in marks)
    doc.signals = doc.units[0].signals = note_signals(own)
    return doc


# --- Dockerfile ---

FROM = re.compile(r"(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?")


def logical_lines(text: str) -> list[tuple[int, str]]:
    """(first line, text): lines that end with a backslash go on in the next; comment lines between don't count."""
    out, held, start = [], "", 0
    for n, line in enumerate(text.split("\n"), 1):
        if held and line.strip().startswith("#"):
            continue
        if not held:
            start = n
        if line.rstrip().endswith("\\"):
            held += line.rstrip()[:-1] + " "
        else:
            out.append((start, held + line))
            held = ""
    return out + ([(start, held)] if held else [])


def parse_dockerfile(path: str, data: bytes) -> Parsed:
    """A section for each build stage, and the graph of stages: what each is built from, and copies from."""
    doc = _start(path, data, "dockerfile")
    doc.signals = note_signals(doc.raw)
    lines = doc.raw.split("\n")
    heads = [i for i, x in enumerate(lines) if FROM.match(x)]
    bounds = [0, *heads[1:], len(lines)] if heads else [0, len(lines)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:]), 1):
        body = "\n".join(lines[a:b]).strip()
        m = FROM.match(lines[heads[k - 1]]) if heads else None
        title = f"stage {k}: {m[2]}" if m and m[2] else f"stage {k}"
        if body:
            doc.units.append(Unit("section", title, title, body, a + 1, note_signals(body), hierarchy=[doc.title, title]))
    stages: dict[str, str] = {}
    current: Unit | None = None
    for n, line in logical_lines(doc.raw):
        word, _, rest = line.strip().partition(" ")
        word = word.upper()
        if word == "FROM" and (m := FROM.match(line)):
            name = m[2] or str(len(stages))
            current = Unit("stage", f"{path}:{name}", name, line.strip(), n, metadata={"base": m[1]})
            doc.units.append(current)
            base = m[1].lower()
            if base in stages:
                doc.refs.append(Reference("inherits", current.path, stages[base], line.strip(), n, {"relation": "stage"}))
            elif base != "scratch":
                doc.refs.append(Reference("import", path, m[1], line.strip(), n, {"node_kind": "external"}))
            stages[name.lower()] = current.path
        elif current and word in ("COPY", "ADD") and (m := re.search(r"--from=(\S+)", rest)):
            source = stages.get(m[1].lower())
            if source:
                doc.refs.append(Reference("inherits", current.path, source, line.strip(), n, {"relation": "copy-from"}))
            elif not m[1].isdigit():
                doc.refs.append(Reference("import", path, m[1], line.strip(), n, {"node_kind": "external"}))
        elif current and word == "EXPOSE":
            current.metadata.setdefault("expose", []).extend(rest.split())
        elif current and word in ("CMD", "ENTRYPOINT"):
            current.metadata[word.lower()] = rest.strip()
        elif current and word == "RUN" and (mounts := re.findall(r"--mount=(\S+)", rest)):
            current.metadata.setdefault("mounts", []).extend(mounts)
    return doc


# --- SQL statements ---

SQL_TOKEN = re.compile(r"--[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|(\$[A-Za-z_0-9]*\$).*?(?:\1|\Z)|;|[^-/'\"$;]+|.", re.S)


def statements(text: str) -> list[tuple[int, str]]:
    """(line, statement): parts that semicolons outside of comments, literals and dollar quotes end. What has comments
    only at the end is none."""
    out, held, start, solid = [], "", 0, False
    for m in SQL_TOKEN.finditer(text):
        t = m[0]
        if t == ";":
            if solid:
                out.append((text.count("\n", 0, start) + 1, (held + ";").strip()))
            held, solid, start = "", False, m.end()
            continue
        solid = solid or not (t.startswith(("--", "/*")) or t.isspace())
        if not held and t.isspace():
            start = m.end()
            continue
        held += t
    if solid:
        out.append((text.count("\n", 0, start) + 1, held.strip()))
    return out


def parse_sql(path: str, data: bytes) -> Parsed:
    doc = _start(path, data, "sql")
    for line, s in statements(doc.raw):
        title = next((x.strip() for x in s.split("\n") if x.strip() and not x.strip().startswith(("--", "/*", "*"))), s[:60])
        title = title if len(title) <= 60 else title[:60] + "…"
        doc.units.append(Unit("section", title, title, s, line, note_signals(s), hierarchy=[doc.title, title]))
    doc.signals = note_signals(doc.raw)
    return doc
