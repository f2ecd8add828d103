"""DOCX to markdown with the standard library: paragraphs and tables in body order."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_FIELD_URL = re.compile(r'https?://[^\s"]+')


class Relations(dict):
    """Targets by relation id, and which of them are images."""

    def __init__(self, raw: bytes | None) -> None:
        super().__init__()
        self.images: dict[str, str] = {}
        for item in ElementTree.fromstring(raw) if raw else ():
            self[item.get("Id")] = item.get("Target", "")
            if item.get("Type", "").endswith("/image") and item.get("TargetMode") == "External":
                self.images[item.get("Id")] = item.get("Target", "")


def _images(run: ElementTree.Element, relations: Relations) -> str:
    found = (relations.images.get(blip.get(f"{_R}link") or blip.get(f"{_R}embed") or "") for blip in run.iter(f"{_A}blip"))
    return "".join(f"![image]({link})" for link in found if link)


def _run_text(run: ElementTree.Element) -> str:
    parts = []
    for item in run:
        if item.tag == f"{_W}t":
            parts.append(item.text or "")
        elif item.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
        elif item.tag == f"{_W}tab":
            parts.append("\t")
    return "".join(parts)


class Paragraphs:
    """Renders paragraphs; a field's URL waits for the next run with text, in its own paragraph unless compat."""

    def __init__(self, relations: Relations, compat: bool) -> None:
        self.relations, self.compat, self.url = relations, compat, None

    def render(self, paragraph: ElementTree.Element) -> str:
        if not self.compat:
            self.url = None
        parts: list[str] = []
        for item in paragraph:
            if item.tag == f"{_W}hyperlink":
                target = self.relations.get(item.get(f"{_R}id") or "")
                text = "".join(_run_text(r) for r in item.iter(f"{_W}r"))
                parts.append(f"[{text}]({target})" if target and text else text)
            elif item.tag == f"{_W}r":
                parts.append(self._run(item))
        return "".join(parts).strip()

    def _run(self, run: ElementTree.Element) -> str:
        pictures = _images(run, self.relations)
        for field in run.iter(f"{_W}instrText"):
            found = _FIELD_URL.findall(field.text or "")
            if found:
                self.url = found[-1]
        text = _run_text(run)
        if self.compat:
            text = text.strip()
        if text and self.url:
            text, self.url = f"[{text}]({self.url})", None
        return pictures + text


def _cell(cell: ElementTree.Element, relations: Relations) -> str:
    """Non-empty paragraphs, the first of equal ones, joined by a space; a run's image stands for its text."""
    found: dict[str, None] = {}
    for paragraph in cell.iter(f"{_W}p"):
        text = "".join(_images(run, relations) or _run_text(run) for run in paragraph.iter(f"{_W}r")).strip()
        if text:
            found.setdefault(text)
    return " ".join(found)


def _span(cell: ElementTree.Element) -> int:
    span = cell.find(f"{_W}tcPr/{_W}gridSpan")
    return max(1, int(span.get(f"{_W}val", "1"))) if span is not None else 1


def _table(table: ElementTree.Element, relations: Relations) -> str:
    rows = []
    for row in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            cells += [_cell(cell, relations)] + [""] * (_span(cell) - 1)
        rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def to_markdown(content: bytes, compat: bool = False) -> str:
    """Body elements joined by line feeds; a blank paragraph is an empty line of its own."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        relations = Relations(archive.read("word/_rels/document.xml.rels") if "word/_rels/document.xml.rels" in names else None)
    paragraphs, out = Paragraphs(relations, compat), []
    for item in body if body is not None else ():
        if item.tag == f"{_W}p":
            out.append(paragraphs.render(item) or "\n")
        elif item.tag == f"{_W}tbl":
            out.append(_table(item, relations))
    return "\n".join(out)


def build(paragraphs: list[str]) -> bytes:
    """A minimal DOCX of plain paragraphs, for fixtures and round trips."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
