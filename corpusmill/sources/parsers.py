"""Parsers of office files, tables and mail with the standard library: parse(content, filename) -> [(element type, page, text)].

They are for `files.parsed`; PDF, scans and images need libraries that aren't part of this repository and stay plug-ins.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

Element = tuple[str, int, str]
TITLE, TEXT, TABLE, LIST = "Title", "NarrativeText", "Table", "ListItem"


class UnsupportedFormat(ValueError):
    """No parser for files of this kind."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _words(node: ElementTree.Element) -> str:
    """The text runs of a node, tabs and line breaks as such."""
    out = []
    for x in node.iter():
        name = _local(x.tag)
        out.append(x.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out).strip()


def _attribute(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def word_elements(content: bytes) -> list[Element]:
    """Paragraphs and tables in order; page breaks that the writer noted count pages."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))[0]
    out, page = [], 1
    for block in body:
        page += sum(_local(x.tag) == "lastRenderedPageBreak" or _local(x.tag) == "br" and _attribute(x, "type") == "page" for x in block.iter())
        if _local(block.tag) == "tbl":
            rows = [" | ".join(_words(cell) for cell in row if _local(cell.tag) == "tc") for row in block if _local(row.tag) == "tr"]
            out.append((TABLE, page, "\n".join(rows)))
        elif text := _words(block):
            style = next((_attribute(x, "val") for x in block.iter() if _local(x.tag) == "pStyle"), "")
            listed = any(_local(x.tag) == "numPr" for x in block.iter())
            out.append((TITLE if re.match(r"(?i)heading|title", style) else LIST if listed else TEXT, page, text))
    return out


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    """Names that match, in the order of their numbers."""
    return sorted((n for n in archive.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def slide_elements(content: bytes) -> list[Element]:
    """The shapes' paragraphs of each slide; a slide is a page."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for page, name in enumerate(_numbered(archive, r"ppt/slides/slide\d+\.xml"), 1):
            for shape in ElementTree.fromstring(archive.read(name)).iter():
                if _local(shape.tag) == "sp":
                    kind = next((_attribute(x, "type") for x in shape.iter() if _local(x.tag) == "ph"), "")
                    text = "\n".join(filter(None, (_words(p) for p in shape.iter() if _local(p.tag) == "p")))
                    if text:
                        out.append((TITLE if kind in ("title", "ctrTitle") else TEXT, page, text))
                elif _local(shape.tag) == "tbl":
                    rows = [" | ".join(_words(c) for c in row if _local(c.tag) == "tc") for row in shape if _local(row.tag) == "tr"]
                    out.append((TABLE, page, "\n".join(rows)))
    return out


def sheet_elements(content: bytes) -> list[Element]:
    """A table for each sheet that has cells; cells that are left out between others are empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = [_words(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
        for page, name in enumerate(_numbered(archive, r"xl/worksheets/sheet\d+\.xml"), 1):
            rows = []
            for row in (x for x in ElementTree.fromstring(archive.read(name)).iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for cell in row:
                    place = 0
                    for letter in re.match(r"[A-Z]*", _attribute(cell, "r"))[0]:
                        place = 26 * place + ord(letter) - 64
                    cells += [""] * (place - 1 - len(cells))
                    value = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
                    kind = _attribute(cell, "t")
                    cells.append(shared[int(value)] if kind == "s" and value else _words(cell) if kind == "inlineStr" else value)
                if any(cells):
                    rows.append(" | ".join(cells))
            if rows:
                out.append((TABLE, page, "\n".join(rows)))
    return out


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def csv_elements(content: bytes) -> list[Element]:
    text = _decoded(content)
    try:
        dialect = csv.Sniffer().sniff(text[:10_000], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = [" | ".join(cell.strip() for cell in row) for row in csv.reader(io.StringIO(text), dialect) if any(row)]
    return [(TABLE, 1, "\n".join(rows))] if rows else []


class _Lines(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article"}

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_elements(content: bytes) -> list[Element]:
    lines = _Lines()
    lines.feed(_decoded(content))
    return [(TEXT, 1, x) for x in (" ".join(line.split()) for line in "".join(lines.out).split("\n")) if x]


def text_elements(content: bytes) -> list[Element]:
    return [(TEXT, 1, p.strip()) for p in re.split(r"\n\s*\n", _decoded(content)) if p.strip()]


def mail_elements(content: bytes) -> list[Element]:
    """The subject, and the plain body or else the HTML one."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    out = [(TITLE, 1, str(message["subject"]).strip())] if message["subject"] else []
    body = message.get_body(("plain", "html"))
    if body is not None:
        raw = body.get_content().encode()
        out += html_elements(raw) if body.get_content_type() == "text/html" else text_elements(raw)
    return out


PARSERS: dict[str, Callable[[bytes], list[Element]]] = {
    "docx": word_elements, "pptx": slide_elements, "xlsx": sheet_elements, "csv": csv_elements, "tsv": csv_elements, "html": html_elements, "htm": html_elements, "txt": text_elements, "md": text_elements, "eml": mail_elements,
}


def parse(content: bytes, filename: str) -> list[Element]:
    """The elements of a file by its extension."""
    kind = filename.rpartition(".")[2].lower()
    if kind not in PARSERS:
        raise UnsupportedFormat(f"no parser for .{kind} files")
    return PARSERS[kind](content)
