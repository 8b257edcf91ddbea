"""Markdown: front matter, a tree of headings, tables and diagrams in words."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import yaml

from lorekeep.sources.parsed import Parsed, Reference, Unit, bold_signals, note_signals

MAX_ROWS = MAX_COLUMNS = 20
MAX_LABELS = 10

#: What names a part in a diagram's source.
MERMAID = [r"[\[({|]+\"?([^\[\](){}|\"]+)\"?[\])}|]+", r"--\s*([^->|]+?)\s*--", r"(?m)^\s*participant\s+(?:\S+\s+as\s+)?(.+)$", r"(?m)^\s*title:?\s+(.+)$", r"(?m)^\s*subgraph\s+(.+)$"]
PLANTUML = [r"(?i)title:?\s+(.+)", r"(?:participant|actor|database|entity|boundary|control|collections)\s+(?:\"([^\"]+)\"|(\S+))", r"(?:class|interface|enum|component|package)\s+(?:\"([^\"]+)\"|(\S+))", r"(?:-->|->|<--|<-)\s*\S*\s*:\s*(.+)"]
ASCII = [r"[|\u2502]\s*([A-Za-z][A-Za-z0-9 _/.-]{2,}?)\s*[|\u2502]"]
SUBTYPES = [("sequencediagram", "sequence"), ("classdiagram", "class"), ("statediagram", "state"), ("erdiagram", "er"), ("gantt", "gantt"), ("flowchart", "flowchart"), ("graph", "flowchart"), ("pie", "pie")]

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
BOX = re.compile("[+|<>^v/\\\\_=\\-\u2500-\u257f\u2190-\u21ff]")
LINK = re.compile(r"(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")


def linearized(headers: list[str], rows: list[list[str]]) -> str:
    """A table in words: its size and headers, then each row's cells that are not empty."""
    headers, rows = headers[:MAX_COLUMNS], [r[:MAX_COLUMNS] for r in rows[:MAX_ROWS]]
    lines = [f"[Table: {len(headers)} columns, {len(rows)} rows \u2014 {', '.join(headers)}]"]
    for r in rows:
        named = [f"{headers[i] if i < len(headers) and headers[i] else f'Column {i + 1}'}: {c}" for i, c in enumerate(r) if c]
        if named:
            lines.append(", ".join(named))
    return "\n".join(lines)


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.head: list[bool] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.head.append(False)
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
                self.head.append(False)
            self.cell = []
            self.head[-1] |= tag == "th"

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_table(source: str) -> str | None:
    t = _Table()
    t.feed(source)
    t.close()
    rows = [(r, h) for r, h in zip(t.rows, t.head) if r]
    if not rows:
        return None
    return linearized(rows[0][0], [r for r, _ in rows[1:]])


def diagram_kind(info: str, body: str) -> str | None:
    """By a fence's tag, or for untagged text by its share of box-drawing bytes."""
    tag = info.strip().split()[0].lower() if info.strip() else ""
    if tag in ("mermaid",):
        return "mermaid"
    if tag in ("plantuml", "puml"):
        return "plantuml"
    if tag in ("ascii", "ascii-art"):
        return "ascii"
    size = len(body.encode())
    if not tag and size >= 20 and body.rstrip("\n").count("\n") >= 2 and sum(len(c.encode()) for c in BOX.findall(body)) > 0.30 * size:
        return "ascii"
    return None


def diagram_labels(kind: str, body: str) -> list[str]:
    found = set()
    for pattern in {"mermaid": MERMAID, "plantuml": PLANTUML, "ascii": ASCII}[kind]:
        for m in re.finditer(pattern, body):
            label = next((g for g in m.groups() if g), "").strip().strip('"')
            if len(label) > 2 or " " in label:
                found.add(label)
    return sorted(found)


def diagram_summary(kind: str, body: str) -> str:
    first = body.strip().lower().removeprefix("@startuml").strip()
    sub = next((name for start, name in SUBTYPES if first.startswith(start)), "")
    labels = diagram_labels(kind, body)[:MAX_LABELS]
    return f"[Diagram: {' '.join(filter(None, (kind, sub)))}" + (f" \u2014 {', '.join(labels)}" if labels else "") + "]"


def cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def front_matter(text: str) -> tuple[dict, str]:
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return {}, text
    try:
        meta = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, text
    return (meta, text[m.end() :]) if isinstance(meta, dict) else ({}, text)


def rendered(lines: list[str]) -> str:
    """A section's text, its tables and diagrams in words."""
    out, i = [], 0
    while i < len(lines):
        fence = FENCE.match(lines[i])
        if fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1]) and not lines[j].strip().strip(fence[1][0])), len(lines))
            body = "\n".join(lines[i + 1 : end])
            kind = diagram_kind(fence[2], body)
            out.append(diagram_summary(kind, body) if kind else body)
            i = end + 1
        elif "|" in lines[i] and i + 1 < len(lines) and RULE.match(lines[i + 1]) and "|" in lines[i + 1] + lines[i]:
            end = i + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                end += 1
            out.append(linearized(cells(lines[i]), [cells(x) for x in lines[i + 2 : end]]))
            i = end
        elif "<table" in lines[i].lower():
            end = next((j for j in range(i, len(lines)) if "</table" in lines[j].lower()), len(lines) - 1)
            source = "\n".join(lines[i : end + 1])
            out.append(html_table(source) or source)
            i = end + 1
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def parse_markdown(path: str, data: bytes) -> Parsed:
    text = data.decode("utf-8", "replace").replace("\r\n", "\n")
    meta, body = front_matter(text)
    doc = Parsed(path, "markdown", str(meta.get("title") or ""), str(meta.get("type") or "guide"), text, str(meta.get("description") or ""), frontmatter=meta)
    sections: list[tuple[list[str], list[str], int]] = [([], [], 1)]
    stack: list[tuple[int, str]] = []
    fence = None
    for n, line in enumerate(body.split("\n"), 1):
        f = FENCE.match(line)
        if f and (fence is None or line.strip().startswith(fence) and not line.strip().strip(fence[0])):
            fence = f[1] if fence is None else None
        h = HEADING.match(line) if fence is None and not f else None
        if h:
            level, title = len(h[1]), re.sub(r"[*_`]", "", h[2] or "").strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            doc.headings.append(title)
            if level == 1 and not doc.title:
                doc.title = title
            sections.append(([t for _, t in stack], [], n))
        else:
            sections[-1][1].append(line)
    if not doc.summary:
        doc.summary = next((b.strip() for b in "\n".join(sections[0][1]).split("\n\n") if b.strip()), "")
    for hierarchy, lines, n in sections[1:]:
        content = rendered(lines).strip()
        if content:
            signals = bold_signals("\n".join(lines)) + note_signals("\n".join(lines))
            doc.units.append(Unit("section", " > ".join(hierarchy), hierarchy[-1], content, n, signals, hierarchy=hierarchy))
            doc.signals += signals
    doc.refs = [Reference("link", path, m[1]) for m in LINK.finditer(body)]
    doc.title = doc.title or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return doc
