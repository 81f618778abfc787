"""PDF pages of plain text: written from texts, and read back by scanning the text operators of their content streams.

The reader needs no page tree: each content stream is inflated in bounded steps
and scanned token by token. It knows the operators that show text and those that
move to another line; fonts with encodings of their own are read byte by byte.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_A_PAGE = 40
MOST_STREAM = 64 << 20
#: Moves back by so many thousandths of the font size between shown strings are a blank.
BLANK_MOVE = -200

_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<string>\()|<(?P<hex>[0-9A-Fa-f\s]*)>|<<|>>|(?P<array>[\[\]])|/[^\s()<>\[\]{}/%]*|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\s()<>\[\]{}/%])|(?P<word>[^\s()<>\[\]{}/%]+)|.", re.S)
#: Escapes in strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_STRING_PART = re.compile(rb"[^()\\\r]+|\\([0-7]{1,3})|\\(\r\n|[\s\S])|[()]|\r\n?")


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string that begins before ``at``, and where it ends; parentheses nest."""
    out, depth = bytearray(), 1
    for part in _STRING_PART.finditer(data, at):
        token = part[0]
        if part[1]:
            out.append(int(part[1], 8) & 255)
        elif part[2]:
            out += b"" if part[2] in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(part[2], part[2])
        elif token == b")" and depth == 1:
            return bytes(out), part.end()
        else:
            depth += (token == b"(") - (token == b")")
            out += b"\n" if token in (b"\r", b"\r\n") else token
    raise ValueError("a string has no end")


def _text(data: bytes) -> str:
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def shown_lines(content: bytes) -> Iterator[str]:
    """The lines that a content stream shows: operators that move to another line end one."""
    stack: list = []
    array: list | None = None
    line: list[str] | None = None
    at = 0

    def ended() -> Iterator[str]:
        nonlocal line
        if line is not None:
            yield "".join(line)
        line = None

    while at < len(content):
        found = _TOKEN.match(content, at)
        at, kind = found.end(), found.lastgroup
        if kind == "string":
            value, at = _string(content, at)
            (stack if array is None else array).append(value)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", found["hex"])
            (stack if array is None else array).append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif kind == "array":
            if found[0] == b"[":
                array = []
            else:
                stack.append(array or [])
                array = None
        elif kind == "number":
            (stack if array is None else array).append(float(found["number"]))
        elif kind == "word":
            word = found["word"]
            if word in (b"T*", b"'", b'"', b"Tm", b"BT", b"ET") or word in (b"Td", b"TD") and stack and stack[-1] != 0:
                yield from ended()
            if word in (b"Tj", b"'", b'"', b"TJ") and stack:
                shown = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
                line = line or []
                line += [_text(x) if isinstance(x, bytes) else " " if x < BLANK_MOVE else "" for x in shown if isinstance(x, (bytes, float))]
            stack.clear()
    yield from ended()


def pdf_lines(content: bytes) -> Iterator[tuple]:
    """(page, line, text) of the lines of all content streams. What ends inside a stream, or doesn't inflate, is a ValueError."""
    if not content.lstrip().startswith(b"%PDF-"):
        raise ValueError("no PDF")
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    at, page = 0, 0
    while begun := _STREAM.search(content, at):
        end = content.find(b"endstream", begun.end())
        if end < 0:
            raise ValueError("a stream has no end")
        data, at = content[begun.end() : end], end
        if b"/FlateDecode" in begun[1]:
            inflate = zlib.decompressobj()
            data = inflate.decompress(data, MOST_STREAM)
            if inflate.unconsumed_tail or not inflate.eof:
                raise ValueError("a stream is too long or cut off")
        if b"/Type" in begun[1] or b"/Subtype" in begun[1] or b"/Length1" in begun[1]:  # object and reference streams, images, fonts
            continue
        for number, line in enumerate(shown_lines(data)):
            yield page, number, line
        page += 1


def _shown(line: str) -> bytes:
    try:
        plain = line.encode("latin-1")
    except UnicodeEncodeError:
        return b"<FEFF" + line.encode("utf-16-be").hex().upper().encode() + b">"
    if plain[:2] == b"\xfe\xff":
        return b"<FEFF" + line.encode("utf-16-be").hex().upper().encode() + b">"
    return b"(" + re.sub(rb"[()\\]", rb"\\\g<0>", plain).replace(b"\r", b"\\r") + b")"


def pdf_bytes(text: str) -> bytes:
    """A PDF with the lines of the text, LINES_A_PAGE a page."""
    lines = text.split("\n") if text else []
    pages = [lines[i : i + LINES_A_PAGE] for i in range(0, len(lines), LINES_A_PAGE)]
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, own in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        body = zlib.compress(b"BT /F1 10 Tf 12 TL 40 760 Td\n" + b" T*\n".join(_shown(x) + b" Tj" for x in own) + b"\nET")
        objects.append(f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects):
        places.append(len(out))
        out += f"{i + 1} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())


def written(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` (key, text) with content: the PDF of each text; a null text has no pages."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[pdf_bytes(x or "") for x in pdf["text"]])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(write, f"key {kind}, text string, content binary").withColumnsRenamed({"key": key, "text": text})
