"""File decoders: a DataFrame of (id, content) to one of rows, one file a call.

Each decoder is a per-file helper that ``decoded`` maps over Arrow batches. A file
that can't be decoded becomes a row with its error code, so no file is lost.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pdf import pdf_lines

MOST_BYTES = 64 << 20
ROWS_AT_ONCE = 5_000
BYTES_AT_ONCE = 1 << 20
MOST_MEMBERS = 10_000
MOST_RATIO = 200
MOST_COLUMNS = 1_000
MOST_CELLS = 5_000_000
MOST_FIELD = 100_000


class Rejected(ValueError):
    """A file that breaks a rule; the message is the error code."""


#: What the libraries raise for members that are missing, broken or encrypted.
DAMAGED = (KeyError, IndexError, ValueError, RuntimeError, NotImplementedError, EOFError, OSError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError, expat.ExpatError)


def rows_of(decode: Callable[[bytes], Iterator[tuple]], names: list[str]):
    """Contents (id, content) to frames of the rows of several contents: a frame for each would cost more than decoding it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, found, errors, size = [], [], [], 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(found, columns=names, dtype=object)
            out.insert(0, "id", pd.Series(keys))
            return out.assign(error=pd.Series(errors, dtype=object))

        for pdf in batches:
            for key, content in zip(pdf["id"].tolist(), pdf["content"].tolist(), strict=True):
                try:
                    if content is None:
                        raise Rejected("unavailable")
                    if len(content) > MOST_BYTES:
                        raise Rejected("too_large")
                    rows, error = list(decode(bytes(content))), None
                    if not rows:
                        raise Rejected("no_rows")
                except Rejected as e:
                    rows, error = [(None,) * len(names)], str(e)
                except DAMAGED:
                    rows, error = [(None,) * len(names)], "damaged"
                found += rows
                keys += [key] * len(rows)
                errors += [error] * len(rows)
                size += len(content or b"")
                if len(found) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                    yield frame()
                    keys, found, errors, size = [], [], [], 0
        if found:
            yield frame()

    return run


def decoded(df: DataFrame, decode: Callable[[bytes], Iterator[tuple]], columns: str, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, the columns, error): the rows that ``decode`` yields for each content, or one row with the code of the error."""
    names = [c.split()[0] for c in columns.split(", ")]
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInPandas(rows_of(decode, names), f"id {kind}, {columns}, error string").withColumnRenamed("id", id_col)


def text_of(content: bytes, encodings: tuple[str, ...] = ("utf-8-sig", "cp1251")) -> str:
    for encoding in encodings:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise Rejected("encoding_unsupported")


def delimiter_of(text: str) -> str:
    """The sniffed delimiter of the beginning, else the one that cuts most rows into several and equally many cells."""
    try:
        return csv.Sniffer().sniff(text[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        pass
    scores = []
    for d in ",;\t|":
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=d) if r]
        several = [len(r) for r in rows if len(r) > 1]
        scores.append(((len(several), max((several.count(n) for n in set(several)), default=0), text.count(d)), d))
    scores.sort(reverse=True)
    if not scores[0][0][0]:
        return ","
    if scores[0][0] == scores[1][0]:
        raise Rejected("delimiter_ambiguous")
    return scores[0][1]


def csv_rows(content: bytes, most_rows: int = 1_000_000) -> Iterator[tuple]:
    """(row, cells): strict CSV. The header may have no blank or repeated names; uneven and blank rows stay as they are."""
    text = text_of(content)
    if not text.strip():
        raise Rejected("empty")
    if "\0" in text:
        raise Rejected("nul_byte")
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text), strict=True))
    except csv.Error as e:
        raise Rejected("malformed") from e
    header = [c.strip() for c in rows[0]]
    if not all(header):
        raise Rejected("header_blank")
    if len({c.casefold() for c in header}) < len(header):
        raise Rejected("header_repeated")
    if len(rows) < 2:
        raise Rejected("header_only")
    if len(header) > MOST_COLUMNS or any(len(r) > MOST_COLUMNS for r in rows):
        raise Rejected("too_many_columns")
    if sum(map(len, rows)) > MOST_CELLS:
        raise Rejected("too_many_cells")
    if any(len(c) > MOST_FIELD for r in rows for c in r):
        raise Rejected("field_too_long")
    if len(rows) > most_rows:
        raise Rejected("too_many_rows")
    yield from enumerate(rows)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.cells: list[tuple[int, int, int, str]] = []
        self.table = self.row = self.col = -1
        self.open: list[str] | None = None
        self.hidden = 0

    def close_cell(self) -> None:
        if self.open is not None:
            text = " ".join("".join(self.open).split())
            if text:
                self.col += 1
                self.cells.append((self.table, self.row, self.col, text))
            self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.close_cell()
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self.close_cell()
            self.open = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.open is not None and not self.hidden:
            self.open.append(data)


def html_cells(content: bytes) -> Iterator[tuple]:
    """(table, row, col, text) of the cells that aren't empty, in order."""
    parser = _Tables()
    parser.feed(text_of(content, ("utf-8-sig", "cp1251", "latin-1")))
    parser.close()
    parser.close_cell()
    yield from parser.cells


def xml_events(content: bytes, most_events: int = 1_000_000) -> Iterator[tuple]:
    """(ordinal, depth, type, node_path, name, attribute_name, value) of starts, attributes, texts and ends; declarations of
    types and entities are rejected."""
    out: list[tuple] = []
    path: list[str] = []
    buffer: list[str] = []

    def add(kind: str, name: str | None = None, attribute: str | None = None, value: str | None = None) -> None:
        if len(out) >= most_events:
            raise Rejected("too_many_events")
        out.append((len(out), len(path), kind, "/" + "/".join(path), name, attribute, value))

    def flush() -> None:
        text = "".join(buffer).strip()
        buffer.clear()
        if text:
            add("text", path[-1] if path else None, None, text)

    def start(name: str, attributes: list[str]) -> None:
        flush()
        path.append(name)
        add("start", name)
        for k, v in zip(attributes[::2], attributes[1::2], strict=True):
            add("attribute", name, k, v)

    def end(name: str) -> None:
        flush()
        add("end", name)
        path.pop()

    def refuse(*_) -> None:
        raise Rejected("declaration_forbidden")

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, buffer.append
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise Rejected("malformed") from e
    yield from out


def _archive(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Rejected("malformed") from e


def zip_members(content: bytes) -> Iterator[tuple]:
    """(ordinal, name, disposition, content): each member is promoted, a directory, a sidecar, or blocked with its reason."""
    archive = _archive(content)
    if len(archive.infolist()) > MOST_MEMBERS:
        raise Rejected("too_many_members")
    seen: set[str] = set()
    for i, member in enumerate(archive.infolist()):
        name = member.filename.replace("\\", "/")
        key = name.casefold()
        if member.is_dir():
            disposition = "directory"
        elif "\0" in name or name.startswith("/") or re.match(r"^[A-Za-z]:", name) or ".." in name.split("/"):
            disposition = "blocked:path"
        elif member.flag_bits & 1:
            disposition = "blocked:encrypted"
        elif key in seen:
            disposition = "blocked:collision"
        elif member.file_size > MOST_BYTES or member.file_size > MOST_RATIO * max(1, member.compress_size) and member.file_size > 1 << 20:
            disposition = "blocked:size"
        elif name.endswith(".zip"):
            disposition = "blocked:nested"
        elif name.startswith("__MACOSX/") or name.rsplit("/", 1)[-1] in (".DS_Store", "Thumbs.db"):
            disposition = "sidecar"
        else:
            disposition = "promoted"
        seen.add(key)
        yield i, name, disposition, archive.read(member) if disposition == "promoted" else None


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Rejected("declaration_forbidden")
    return ElementTree.fromstring(data)


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, cell, text, is_formula) of a workbook: shared and inline strings resolved, formulas without a value."""
    archive = _archive(content)
    names = archive.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in _part(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for cell in _part(archive, name).iter(f"{_SHEET}c"):
            formula, value = cell.find(f"{_SHEET}f") is not None, cell.findtext(f"{_SHEET}v")
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            yield name.rsplit("/", 1)[-1], cell.get("r"), None if formula else value, formula


def docx_paragraphs(content: bytes) -> Iterator[tuple]:
    """(ordinal, style, text) of the paragraphs with text."""
    archive = _archive(content)
    if "word/document.xml" not in archive.namelist():
        raise Rejected("no_document")
    ordinal = 0
    for p in _part(archive, "word/document.xml").iter(f"{_WORD}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_WORD}t"))
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        if text.strip():
            yield ordinal, style.get(f"{_WORD}val") if style is not None else None, text
            ordinal += 1


FORMATS = {
    "csv": (csv_rows, "row int, cells array<string>"),
    "html": (html_cells, "table int, row int, col int, text string"),
    "xml": (xml_events, "ordinal long, depth int, type string, node_path string, name string, attribute_name string, value string"),
    "zip": (zip_members, "ordinal int, name string, disposition string, content binary"),
    "xlsx": (xlsx_cells, "sheet string, cell string, text string, is_formula boolean"),
    "docx": (docx_paragraphs, "ordinal int, style string, text string"),
    "pdf": (pdf_lines, "page int, line int, text string"),
}


def read_as(df: DataFrame, kind: str, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """Rows of all contents of a format."""
    decode, columns = FORMATS[kind]
    return decoded(df, decode, columns, id_col, content_col)
