"""What handlers make of a file: units, signals and references; and chunks of units."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from lorekeep.functions.text import LABELS, RISKS

#: Chunk sizes in tokens, lines of overlap.
MAX_TOKENS, OVERLAP_LINES, MIN_TOKENS = 512, 3, 50

NOTE = re.compile(r"(?i)\b(TODO|FIXME|HACK|WHY|NOTE)\b:?\s*(.*)$")
BOLD = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1(\s*:)?([^.\n]*)", re.S)


@dataclass
class Signal:
    kind: str
    value: str
    detail: str = ""
    line: int = 0


@dataclass
class Unit:
    kind: str
    path: str
    title: str
    content: str = ""
    line: int = 0
    signals: list[Signal] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    hierarchy: list[str] = field(default_factory=list)


@dataclass
class Reference:
    kind: str
    source: str
    target: str
    context: str = ""
    line: int = 0
    metadata: dict = field(default_factory=dict)


@dataclass
class Parsed:
    path: str
    format: str
    title: str
    doc_type: str
    raw: str = ""
    summary: str = ""
    headings: list[str] = field(default_factory=list)
    frontmatter: dict = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    signals: list[Signal] = field(default_factory=list)
    refs: list[Reference] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def tokens(text: str) -> int:
    n = int(len(text.split()) / 0.75)
    return 1 if not n and text else n


def note_signals(text: str) -> list[Signal]:
    """A line's first marker: what is to be done, or why something is as it is."""
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        m = NOTE.search(line)
        if m:
            marker = m[1].lower()
            out.append(Signal("todo" if marker in ("todo", "fixme", "hack") else "rationale", marker, m[2].strip(), i))
    return out


def bold_signals(text: str) -> list[Signal]:
    """Labels, risks, values and terms that a block has in bold."""
    out: list[Signal] = []

    def add(kind: str, value: str, detail: str = "") -> None:
        if not any(s.kind == kind and s.value == value for s in out):
            out.append(Signal(kind, value, detail))

    for m in BOLD.finditer(text):
        bold = " ".join(m[2].split())
        term = bold.rstrip(":").strip().lower()
        if not term:
            continue
        add("emphasis", bold.lower() if not bold.endswith(":") else term)
        if bold.endswith(":") or m[3]:
            value = m[4].strip().lstrip(":").strip()
            name = LABELS.get(term) or RISKS.get(term)
            if name:
                add("label" if term in LABELS else "risk", name)
            if value:
                add("label-value", name or term, value)
        elif term in RISKS:
            add("risk", RISKS[term])
    return out


def signal_line(signals: list[Signal]) -> str:
    names = [s.value for s in signals if s.kind in ("label", "risk")]
    return f"Signals: {', '.join(names)}" if names else ""


def signal_meta(signals: list[Signal]) -> str:
    """The signals as JSON without empty parts."""
    out: dict = {}
    for key, kind in (("inline_labels", "label"), ("risk_markers", "risk"), ("emphasis_terms", "emphasis")):
        if values := list(dict.fromkeys(s.value for s in signals if s.kind == kind)):
            out[key] = values
    if values := {s.value: s.detail for s in signals if s.kind == "label-value"}:
        out["label_values"] = values
    for key, kind in (("todos", "todo"), ("rationale", "rationale"), ("annotations", "annotation")):
        if values := [f"{s.value}: {s.detail}" if s.detail else s.value for s in signals if s.kind == kind]:
            out[key] = values
    for flag, label in (("has_warning", "warning"), ("has_decision", "decision")):
        if label in out.get("inline_labels", ()):
            out[flag] = True
    return dumps(out)


def paragraphs(text: str, most: int = MAX_TOKENS) -> list[str]:
    """Blank-line blocks gathered until the next would go over ``most`` tokens; a block is never cut."""
    out, held = [], ""
    for block in filter(None, (b.strip() for b in text.split("\n\n"))):
        longer = f"{held}\n\n{block}" if held else block
        if held and tokens(longer) > most:
            out.append(held)
            longer = block
        held = longer
    return [*out, held] if held else out


@dataclass
class Chunk:
    content: str
    heading: str
    hierarchy: list[str]
    index: int
    token_count: int
    embedding_text: str
    signal_meta: str = "{}"


def chunks_of(title: str, raw: str, units: list[Unit], most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP_LINES) -> list[Chunk]:
    """Sections of ``least`` tokens or more, in parts of about ``most``. Overlap comes before what is shown and counted;
    the text that is embedded and stored has none."""
    if not units:
        body = raw.strip()
        n = tokens(body)
        return [Chunk(body, title, [title], 0, n, f"Document: {title}\n\n{body}", "")] if body and n >= least else []
    out: list[Chunk] = []
    for u in units:
        body = u.content.strip()
        if not body or tokens(body) < least:
            continue
        line, meta = signal_line(u.signals), signal_meta(u.signals)
        for part in [body] if tokens(body) <= most else paragraphs(body, most):
            n = tokens(part)
            if n >= least:
                text = f"Document: {title} | Section: {' > '.join(u.hierarchy)}\n\n{part}" + (f"\n{line}" if line else "")
                out.append(Chunk(part, u.title, u.hierarchy, len(out), n, text, meta))
    for before, now in zip(out, out[1:]) if overlap > 0 else ():
        lines = before.content.split("\n")
        if len(lines) > overlap:
            now.content = "\n".join([*lines[-overlap:], now.content])
            now.token_count = tokens(now.content)
    return out


def as_row(p: Parsed, chunks: list[Chunk]) -> dict:
    """A nested row of plain values; open-ended parts as JSON."""
    return {
        "path": p.path, "format": p.format, "title": p.title, "doc_type": p.doc_type, "summary": p.summary, "headings": p.headings,
        "frontmatter": dumps(p.frontmatter), "metadata": dumps(p.metadata), "signal_meta": signal_meta(p.signals),
        "units": [{"kind": u.kind, "path": u.path, "title": u.title, "content": u.content, "line": u.line, "signal_meta": signal_meta(u.signals), "metadata": dumps(u.metadata)} for u in p.units],
        "refs": [{"kind": r.kind, "source": r.source, "target": r.target, "context": r.context, "line": r.line, "metadata": dumps(r.metadata)} for r in p.refs],
        "chunks": [asdict(c) for c in chunks],
    }


SCHEMA = (
    "path string, handler string, error string, content_hash string, format string, title string, doc_type string, summary string, headings array<string>, frontmatter string, metadata string, signal_meta string, "
    "units array<struct<kind string, path string, title string, content string, line int, signal_meta string, metadata string>>, "
    "refs array<struct<kind string, source string, target string, context string, line int, metadata string>>, "
    "chunks array<struct<content string, heading string, hierarchy array<string>, `index` int, token_count int, embedding_text string, signal_meta string>>"
)
