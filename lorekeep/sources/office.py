"""Office files as Markdown, with the standard library only; and the place where a PDF reader plugs in."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from typing import Protocol
from xml.etree import ElementTree

from lorekeep.sources.markdown import parse_markdown
from lorekeep.sources.parsed import Parsed, Unit

MOST_BYTES, MOST_ENTRIES = 200 << 20, 10_000
MOST_ROWS, MOST_COLUMNS = 100, 50
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def open_zip(data: bytes) -> zipfile.ZipFile:
    """Within limits of size and entries, so that a small file cannot unpack to a huge one."""
    z = zipfile.ZipFile(io.BytesIO(data))
    if len(z.infolist()) > MOST_ENTRIES or sum(i.file_size for i in z.infolist()) > MOST_BYTES:
        raise ValueError("archive is too large")
    return z


def xml_of(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = xml_of(z, f"{folder}/_rels/{name}.rels")
    if root is None:
        return {}
    return {r.get("Id"): r.get("Target") if r.get("TargetMode") == "External" else posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in root}


def gfm_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    row = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([row(rows[0]), "|" + " --- |" * width, *map(row, rows[1:])]) if rows and width else ""


def docx_markdown(data: bytes) -> str:
    with open_zip(data) as z:
        root, rel = xml_of(z, "word/document.xml"), relations(z, "word/document.xml")
        styles, numbering = xml_of(z, "word/styles.xml"), xml_of(z, "word/numbering.xml")
    if root is None:
        return ""
    names = {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in (styles if styles is not None else []) if s.tag == f"{W}style"}
    bullets: dict[str, bool] = {}
    if numbering is not None:
        kinds = {a.get(f"{W}abstractNumId"): (f.get(f"{W}val") if (f := a.find(f"{W}lvl/{W}numFmt")) is not None else "bullet") for a in numbering.findall(f"{W}abstractNum")}
        for n in numbering.findall(f"{W}num"):
            ref = n.find(f"{W}abstractNumId")
            bullets[n.get(f"{W}numId")] = kinds.get(ref.get(f"{W}val") if ref is not None else "", "bullet") == "bullet"

    def inline(p: ElementTree.Element) -> str:
        out = ""
        for child in p:
            if child.tag == f"{W}r":
                text = "".join((t.text or "") if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else "" for t in child)
                bold = child.find(f"{W}rPr/{W}b")
                out += f"**{text}**" if bold is not None and bold.get(f"{W}val") not in ("0", "false") and text.strip() else text
            elif child.tag == f"{W}hyperlink":
                target = rel.get(child.get(f"{R}id") or "", "")
                out += f"[{inline(child)}]({target})" if target else inline(child)
            elif child.tag in (f"{W}ins", f"{W}smartTag", f"{W}sdt", f"{W}sdtContent"):
                out += inline(child)
        return out

    def paragraph(p: ElementTree.Element) -> str:
        text = inline(p).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        name = names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else ""
        level = re.match(r"(?i)heading\s*(\d)", name or "")
        if text and (level or (name or "").lower() == "title"):
            return "#" * (min(6, int(level[1])) if level else 1) + " " + text.replace("**", "")
        number = p.find(f"{W}pPr/{W}numPr/{W}numId")
        if text and number is not None:
            depth = p.find(f"{W}pPr/{W}numPr/{W}ilvl")
            return "  " * int(depth.get(f"{W}val") if depth is not None else 0) + ("- " if bullets.get(number.get(f"{W}val"), True) else "1. ") + text
        return text

    out = []
    for block in root.find(f"{W}body") if root.find(f"{W}body") is not None else []:
        if block.tag == f"{W}p":
            out.append(paragraph(block))
        elif block.tag == f"{W}tbl":
            out.append(gfm_table([[" ".join(filter(None, map(paragraph, c.findall(f"{W}p")))) for c in r.findall(f"{W}tc")] for r in block.findall(f"{W}tr")]))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(x for x in out if x))


def xlsx_markdown(data: bytes, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> str:
    out = []
    with open_zip(data) as z:
        book, rel = xml_of(z, "xl/workbook.xml"), relations(z, "xl/workbook.xml")
        shared = xml_of(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared] if shared is not None else []
        for sheet in book.iter(f"{S}sheet") if book is not None else ():
            out.append(f"## {sheet.get('name')}\n")
            root = xml_of(z, rel.get(sheet.get(f"{R}id"), ""))
            rows: list[list[str]] = []
            for r in root.iter(f"{S}row") if root is not None else ():
                at = int(r.get("r") or len(rows) + 1)
                rows += [[] for _ in range(at - 1 - len(rows))]
                row: list[str] = []
                for c in r.findall(f"{S}c"):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    column = 0
                    for ch in letters:
                        column = 26 * column + ord(ch) - 64
                    row += [""] * (max(column - 1, 0) - len(row))
                    v = c.find(f"{S}v")
                    text = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                    row.append(strings[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(strings) else {"1": "TRUE", "0": "FALSE"}.get(text, text) if c.get("t") == "b" else text)
                rows.append(row)
            width = min(max(map(len, rows[:most_rows]), default=0), most_columns)
            if width:
                out.append(gfm_table([r[:width] for r in rows[:most_rows]]))
                if len(rows) > most_rows:
                    out.append(f"\n_[truncated: {len(rows) - most_rows} more rows]_")
            out.append("")
    return "\n".join(out)


def pptx_markdown(data: bytes, notes: bool = True) -> str:
    out = []
    with open_zip(data) as z:
        main = "ppt/presentation.xml"
        deck, rel = xml_of(z, main), relations(z, main)
        for n, s in enumerate(deck.iter(f"{P}sldId") if deck is not None else (), 1):
            part = rel.get(s.get(f"{R}id"), "")
            root = xml_of(z, part)
            if root is None:
                continue
            title, body = "", []
            for shape in root.iter(f"{P}sp"):
                ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                lines = [(int((p.find(f"{A}pPr").get("lvl") or 0) if p.find(f"{A}pPr") is not None else 0), "".join(t.text or "" for t in p.iter(f"{A}t")).strip()) for p in shape.iter(f"{A}p")]
                if ph is not None and ph.get("type") in ("title", "ctrTitle") and not title:
                    title = " ".join(t for _, t in lines if t)
                else:
                    body += ["  " * lvl + "- " + t for lvl, t in lines if t]
            out.append(f"## {title or f'Slide {n}'}\n\n" + "\n".join(body))
            if notes:
                for target in relations(z, part).values():
                    if "notesSlide" in target and (page := xml_of(z, target)) is not None:
                        said = [x for sp in page.iter(f"{P}sp") if (ph := sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and ph.get("type") == "body" for p in sp.iter(f"{A}p") if (x := "".join(t.text or "" for t in p.iter(f"{A}t")).strip())]
                        if said:
                            out.append("Notes: " + "\n".join(said))
    return "\n\n".join(out) + "\n"


def _as_markdown(kind: str, convert):
    def parse(path: str, data: bytes) -> Parsed:
        doc = parse_markdown(path, convert(data).encode())
        doc.format = doc.doc_type = kind
        return doc

    return parse


parse_docx, parse_xlsx, parse_pptx = _as_markdown("docx", docx_markdown), _as_markdown("xlsx", xlsx_markdown), _as_markdown("pptx", pptx_markdown)


class PdfReader(Protocol):
    """Reads a PDF as sections (heading, text); tiers are tried in order: structure, bookmarks, font sizes, pages."""

    def structure(self, data: bytes) -> list[tuple[str, str]]: ...
    def bookmarks(self, data: bytes) -> list[tuple[str, str]]: ...
    def fonts(self, data: bytes) -> list[tuple[str, str]]: ...
    def pages(self, data: bytes) -> list[tuple[str, str]]: ...


PDF_READER: PdfReader | None = None
MOST_PDF_BYTES = 200 << 20


def parse_pdf(path: str, data: bytes) -> Parsed:
    if PDF_READER is None:
        raise NotImplementedError("no PDF reader is installed: set lorekeep.sources.office.PDF_READER")
    if len(data) > MOST_PDF_BYTES:
        raise ValueError("PDF is too large")
    doc = Parsed(path, "pdf", posixpath.basename(path), "pdf")
    for tier in (PDF_READER.structure, PDF_READER.bookmarks, PDF_READER.fonts, PDF_READER.pages):
        sections = tier(data)
        if sections:
            doc.units = [Unit("section", h, h, t, hierarchy=[doc.title, h]) for h, t in sections if t.strip()]
            doc.metadata["tier"] = tier.__name__
            break
    return doc
