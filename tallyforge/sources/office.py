"""Small office files and archives from rows, one file a row: workbooks, text documents, zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(members: list[tuple[str, str | bytes]]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in members:
            out.writestr(zipfile.ZipInfo(name), data)
    return buffer.getvalue()


def workbook(rows: list[list[str]]) -> bytes:
    """A sheet of texts, all shared strings; a text that begins with ``=`` is a formula without a value."""
    texts = {t: i for i, t in enumerate(dict.fromkeys(x for row in rows for x in row if not x.startswith("=")))}
    cell = lambda x, at: f'<c r="{at}"><f>{escape(x[1:])}</f></c>' if x.startswith("=") else f'<c r="{at}" t="s"><v>{texts[x]}</v></c>'
    lines = ("".join(cell(x, f"{chr(65 + j)}{i + 1}") for j, x in enumerate(row)) for i, row in enumerate(rows))
    sheet = f"<worksheet {_SHEET}><sheetData>" + "".join(f"<row>{line}</row>" for line in lines) + "</sheetData></worksheet>"
    shared = f"<sst {_SHEET}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>"
    return archive([("xl/worksheets/sheet1.xml", sheet), ("xl/sharedStrings.xml", shared)])


def document(paragraphs: list[str]) -> bytes:
    """Paragraphs; one that begins with ``# `` is a heading."""
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f"<w:p>{style if p.startswith('# ') else ''}<w:r><w:t>{escape(p.removeprefix('# '))}</w:t></w:r></w:p>" for p in paragraphs)
    return archive([("word/document.xml", f"<w:document {_WORD}><w:body>{body}</w:body></w:document>")])


def written(df: DataFrame, key: str, value: str, make: Callable[[list], bytes]) -> DataFrame:
    """(key, content): the file that ``make`` gives for each row's value, an array."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "content": [make([list(x) if hasattr(x, "tolist") else x for x in value]) for value in pdf["value"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInPandas(write, f"key {kind}, content binary").withColumnRenamed("key", key)
