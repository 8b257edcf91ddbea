"""The handlers by name, and the stage that runs them over files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.sources import code, config, markdown, office
from lorekeep.sources.parsed import Parsed, as_row, chunks_of

HANDLERS: dict[str, Callable[[str, bytes], Parsed]] = {
    "markdown": markdown.parse_markdown,
    "yaml": config.parse_yaml,
    "json": config.parse_json,
    "toml": config.parse_toml,
    "xml": config.parse_xml,
    "properties": config.parse_properties,
    "env": config.parse_env,
    "dockerfile": config.parse_dockerfile,
    "sql": config.parse_sql,
    "docx": office.parse_docx,
    "xlsx": office.parse_xlsx,
    "pptx": office.parse_pptx,
    "pdf": office.parse_pdf,
    "python": code.parse_python,
    "proto": code.parse_proto,
    "sql-ddl": code.parse_sql_definitions,
    "connect-es": code.parse_connect,
    **{name: partial(code.parse_braces, lang=lang) for name, lang in code.LANGUAGES.items()},
}

#: Which handler reads which files.
BY_EXTENSION = {
    ".md": "markdown", ".markdown": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".xml": "xml", ".properties": "properties", ".env": "env", ".dockerfile": "dockerfile",
    ".sql": "sql", ".psql": "sql", ".ddl": "sql", ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".pdf": "pdf", ".go": "go", ".py": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".ts": "javascript", ".tsx": "javascript", ".mts": "javascript", ".cts": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".dart": "dart",
    ".rs": "rust", ".rb": "ruby", ".proto": "proto",
}
BY_NAME = [("Dockerfile", "dockerfile"), ("Dockerfile.*", "dockerfile"), (".env", "env")]
MORE = {".sql": ["sql-ddl"], ".psql": ["sql-ddl"], ".ddl": ["sql-ddl"], ".ts": ["connect-es"], ".js": ["connect-es"]}
NO_CHUNKS = frozenset(("connect-es", "sql-ddl"))
NOT_SECTIONS = frozenset(("stage",))


def parse(handler: str, path: str, data: bytes) -> dict:
    """A row: what the handler found, or the error that it met; one bad file does not end the run."""
    row = {"handler": handler, "error": None, "content_hash": hashlib.sha256(data).hexdigest()}
    try:
        doc = HANDLERS[handler](path, data)
        units = [u for u in doc.units if u.kind not in NOT_SECTIONS]
        for u in units:
            u.hierarchy = u.hierarchy or [doc.title, u.title]
        return row | as_row(doc, [] if handler in NO_CHUNKS else chunks_of(doc.title, doc.raw, units))
    except Exception as e:  # noqa: BLE001
        blank = as_row(Parsed(path, handler, path.rsplit("/", 1)[-1], handler), [])
        return row | blank | {"error": f"{type(e).__name__}: {e}"[:500]}


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content, handler) as nested rows of ``parsed.SCHEMA``, one for each file and handler."""
    from lorekeep.sources.parsed import SCHEMA

    more = F.create_map(*(x for e, hs in MORE.items() for x in (F.lit(e), F.array(*map(F.lit, hs)))))
    ext = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    rows = files.select("path", "content", F.explode(F.concat(F.array("handler"), F.coalesce(more[ext], F.array().cast("array<string>")))).alias("handler"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = ["path", "handler", "error", "content_hash", "format", "title", "doc_type", "summary", "headings", "frontmatter", "metadata", "signal_meta", "units", "refs", "chunks"]
        for b in batches:
            yield pd.DataFrame([parse(h, p, bytes(c)) for p, c, h in zip(b["path"], b["content"], b["handler"], strict=True)], columns=order)

    return rows.mapInPandas(run, SCHEMA)
