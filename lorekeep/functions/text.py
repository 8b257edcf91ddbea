"""Scalar and array text functions as native column expressions.

Word characters are ASCII classes throughout, so that every regular expression means the same to Spark and to the SQL
that checks it. White space is what Unicode calls so where the reference splits on it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode white space beyond ASCII.
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

ODD_SPACES = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{3000}]"

#: Label and risk names by what is written in bold.
LABELS = {
    "warn": "warning",
    "warning": "warning",
    "caution": "warning",
    "note": "note",
    "info": "note",
    "tip": "note",
    "decision": "decision",
    "important": "important",
    "input": "input",
    "output": "output",
    "example": "example",
    "todo": "todo",
    "fixme": "fixme",
    "default": "default",
    "prerequisite": "prerequisite",
    "requirement": "requirement",
}
RISKS = {
    "deprecated": "deprecated",
    "breaking": "breaking-change",
    "breaking change": "breaking-change",
    "unsafe": "unsafe",
    "experimental": "experimental",
    "unstable": "experimental",
    "do not run": "do-not-run",
    "do-not-run": "do-not-run",
}

#: Language names by file extension.
LANGUAGES = {
    "go": "go",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "rs": "rust",
    "java": "java",
    "rb": "ruby",
    "c": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "h": "c/cpp",
    "hpp": "c/cpp",
    "cs": "csharp",
    "swift": "swift",
    "kt": "kotlin",
    "scala": "scala",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
}

#: Extensions of files that texts refer to, and what surrounds a path in a text.
REFERENCED = "go|ts|tsx|js|jsx|py|rs|java|rb|c|cpp|h|hpp|cs|swift|kt|scala|sh|bash|zsh|yaml|yml|toml|json"
BEFORE, AFTER = r"""(?:^|[\s`"'(])""", r"""(?:$|[\s`"')\]:,])"""
FILE_REFERENCE = BEFORE + r"([a-zA-Z0-9_/.-]+\.(?:" + REFERENCED + r"))" + AFTER
DIRECTORY_REFERENCE = BEFORE + r"([a-zA-Z0-9_][a-zA-Z0-9_/.-]*/)" + AFTER
GLOB_REFERENCE = BEFORE + r"([a-zA-Z0-9_*/.{,}-]*\*[a-zA-Z0-9_*/.{,}-]*)" + AFTER

#: Banners of generated files.
GENERATED_BANNERS = [
    r"(?m)^// Code generated .+ DO NOT EDIT\.\s*$",
    r"(?m)^// @generated(\s|$)",
    r"(?m)^/\* @generated(\s|\*/)",
    r"(?m)^# Generated by .+\. DO NOT EDIT\.\s*$",
    r"(?m)^<!-- Generated by .+ -->\s*$",
]
GENERATED_HEAD = 1024

RATIONALE = r"(?i)\b(TODO|FIXME|HACK|WHY|NOTE)\b:?\s*(.*)$"
ID_PREFIXES = ["doc:", "file:", "sym:", "key:", "ext:", "bufgen:"]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, null for others."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """The number of ``words``. Texts without a character where Unicode's own spaces are take the quick way."""
    t = F.coalesce(text, F.lit(""))
    quick = F.size(F.array_remove(F.split(t, r"\s+"), ""))
    return F.when(t.rlike(ODD_SPACES), F.regexp_count(t, F.lit(f"[^{SPACES}]+"))).otherwise(quick)


def token_estimate(text: Column) -> Column:
    """Words by 0.75, cut to a whole number; one for a text that has no full token."""
    some = (F.octet_length(F.coalesce(text, F.lit(""))) > 0).cast("long")
    return F.greatest(F.floor(word_count(text) / F.lit(0.75)).cast("long"), some)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def matches_patterns(path: Column, patterns: list[str]) -> Column:
    """Whether the path ends like one of the patterns, by what comes with the last dot."""
    ends = lambda p: F.regexp_extract(p, r"(\.[^./]*)$", 1)
    return ends(path).isin(*{m[0] if (m := re.search(r"\.[^./]*$", p)) else "" for p in patterns})


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(lookup(extension(path), LANGUAGES), F.lit("unknown"))


def slug(text: Column, most: int = 60) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")


def word_slug(text: Column, most: int = 50) -> Column:
    """A slug that is cut at a word's end where there is one."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(dashed, 1, most)
    whole = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(dashed) <= most, dashed).when(F.instr(head, "-") > 0, whole).otherwise(head)


def question_shaped(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return t.rlike("^(how|what|why|where|when) ") | t.contains("?")


def answer(detail: Column, most: int = 300, least: int = 200) -> Column:
    """The text, if longer than ``most`` cut behind the last full stop or line end that leaves ``least`` characters."""
    head = F.substring(detail, 1, most)
    at = F.length(head) - F.length(F.regexp_extract(head, r"([^.\n]*)$", 1))
    return F.when(F.length(detail) <= most, detail).when(at > least, F.trim(F.substring(head, F.lit(1), at))).otherwise(head)


def match_query(text: Column) -> Column:
    """A full-text query: each word without operators, quoted, joined by OR."""
    clean = F.translate(text, '"*()^{}[]', "")
    return F.array_join(F.transform(words(clean), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def rationale(line: Column) -> tuple[Column, Column, Column]:
    """(marker, kind, detail) of a line's first note to the reader; marker is empty if there is none."""
    marker = F.lower(F.regexp_extract(line, RATIONALE, 1))
    kind = F.when(marker.isin("todo", "fixme", "hack"), F.lit("todo")).when(marker != "", F.lit("rationale"))
    return marker, kind, F.trim(F.regexp_extract(line, RATIONALE, 2))


def bold_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1))


def signal_lists(text: Column) -> Column:
    """struct(inline_labels, risk_markers, emphasis_terms) of a text's bold terms, each name once, in order."""
    terms = bold_terms(text)
    bare = F.transform(terms, lambda t: F.lower(F.trim(F.regexp_replace(t, r":\s*$", ""))))
    labels = F.array_distinct(F.filter(F.transform(bare, lambda t: lookup(t, LABELS)), lambda x: x.isNotNull()))
    risks = F.array_distinct(F.filter(F.transform(bare, lambda t: lookup(t, RISKS)), lambda x: x.isNotNull()))
    return F.struct(labels.alias("inline_labels"), risks.alias("risk_markers"), F.array_distinct(F.transform(terms, F.trim)).alias("emphasis_terms"))


def has_signal(labels: Column, wanted: str) -> Column:
    return F.array_contains(labels, wanted)


def signal_line(labels: Column, risks: Column) -> Column:
    both = F.concat(labels, risks)
    return F.when(F.size(both) > 0, F.concat(F.lit("Signals: "), F.array_join(both, ", "))).otherwise(F.lit(""))


SIGNAL_META = "inline_labels array<string>, risk_markers array<string>, todos array<string>, rationale array<string>"


def metadata_boost(meta: Column) -> Column:
    """How much a chunk's signals lift it: 0 to 1; 0 for JSON that can't be read."""
    m = F.from_json(meta, SIGNAL_META)
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0))
    high = size(F.filter(m["inline_labels"], lambda x: x.isin("warning", "decision", "important")))
    total = 30 * high + 10 * (size(m["inline_labels"]) - high) + 20 * size(m["risk_markers"]) + 5 * (size(m["todos"]) + size(m["rationale"]))
    return F.least(F.coalesce(total, F.lit(0)), F.lit(100)) / F.lit(100.0)


def is_generated(content: Column) -> Column:
    """Whether one of the first kilobyte's lines is a generator's banner."""
    head = F.decode(F.substring(F.encode(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n", "\n"), "UTF-8"), 1, GENERATED_HEAD), "UTF-8")
    out = F.lit(False)
    for banner in GENERATED_BANNERS:
        out = out | head.rlike(banner)
    return F.coalesce(out, F.lit(False))


def display_id(node_id: Column) -> Column:
    return F.when(node_id.rlike("^(" + "|".join(ID_PREFIXES) + ")."), F.regexp_replace(node_id, "^(" + "|".join(ID_PREFIXES) + ")", "")).otherwise(node_id)


def short_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def package_of(fqn: Column) -> Column:
    return F.when(F.instr(fqn, ".") > 0, F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise(F.lit(""))


def lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def has_path_prefix(path: Column, prefix: Column) -> Column:
    trimmed = F.regexp_replace(prefix, "/+$", "")
    return (trimmed == "") | (path == trimmed) | path.startswith(F.concat(trimmed, F.lit("/")))


def node_radius(degree: Column) -> Column:
    return F.least(F.lit(18.0), F.lit(4.0) + F.lit(2.5) * F.log1p(degree.cast("double")))


def table_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r?\n", " ")


def tag_texts(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def is_diagram(text: Column, info: Column) -> Column:
    """mermaid, plantuml or ascii by a fence's info word; untagged text by its share of box-drawing bytes."""
    tag = F.lower(F.trim(info))
    boxes = F.octet_length(F.regexp_replace(text, r"[^+|<>^v/\\_=\-\x{2500}-\x{257F}\x{2190}-\x{21FF}]", ""))
    dense = (F.octet_length(text) >= 20) & (F.size(F.split(text, "\n")) >= 3) & (boxes > 0.30 * F.octet_length(text))
    return F.when(tag == "mermaid", F.lit("mermaid")).when(tag.isin("plantuml", "puml"), F.lit("plantuml")).when(tag.isin("ascii", "ascii-art"), F.lit("ascii")).when((tag == "") & dense, F.lit("ascii"))
