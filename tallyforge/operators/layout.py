"""Tables from placed words: row bands and column lanes by sweeps over both axes of a page, headers, continuation.

A page, the unit that is laid out, is one row with an array of its words; documents meet only
where a table goes on over pages, and there by one row a page with its cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BANDS, LEAST_SHARE = 3, 0.6
#: Pages that a task lays out at once.
PAGES = 512
AXES = ("y0", "y1", "x0", "x1")


def paged(words: DataFrame, page: list[str]) -> DataFrame:
    """(page columns, words): the words of a page in one row. words: page columns, text, x0, x1, y0, y1."""
    return words.groupBy(*page).agg(F.collect_list(F.struct("text", "x0", "x1", "y0", "y1")).alias("words"))


def swept(page: np.ndarray, low: np.ndarray, high: np.ndarray, gap: float) -> np.ndarray:
    """The number of every word's band on one axis of its page: a band ends where nothing reaches over the next ``gap``. page: ascending."""
    order = np.lexsort((high, np.where(np.isnan(low), -np.inf, low), page))
    low, high = low[order], high[order]
    edges = np.flatnonzero(np.diff(page, prepend=-1, append=-1))
    fresh = np.zeros(len(page), np.int32)
    for a, b in itertools.pairwise(edges):
        fresh[a + 1 : b] = low[a + 1 : b] - np.fmax.accumulate(high[a:b])[:-1] > gap  # equal boxes overlap, so their order doesn't matter
    number = np.cumsum(fresh, dtype=np.int32)
    out = np.empty_like(number)
    out[order] = number - np.repeat(number[edges[:-1]], np.diff(edges))
    return out


def _cells(words: pa.Array, band_gap: float, lane_gap: float) -> list[pa.Array]:
    """For arrays of a page's words: bands, lanes, wide, first, and the arrays band, lane and text of the cells."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    n, page, flat = len(words), np.repeat(np.arange(len(sizes)), sizes), words.flatten()
    y0, y1, x0, x1 = (pc.struct_field(flat, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in AXES)
    band, lane = swept(page, y0, y1, band_gap), swept(page, x0, x1, lane_gap)
    text = pc.struct_field(flat, "text")
    keys = [page, band, lane, *(np.where(np.isnan(k), -np.inf, k) for k in (y0, x0, x1))]
    order = np.lexsort(keys[::-1])
    if len(page) and np.all([k[order][1:] == k[order][:-1] for k in keys], 0).any():
        order = np.lexsort([pc.rank(text, tiebreaker="dense").to_numpy(), *keys[::-1]])
    page, band, lane, text = page[order], band[order], lane[order], text.take(pa.array(order))
    new_band = (np.diff(page, prepend=-1) != 0) | (np.diff(band, prepend=-1) != 0)
    at = np.flatnonzero(new_band | (np.diff(lane, prepend=-1) != 0))
    there = np.concatenate(([0], np.cumsum(text.is_valid().to_numpy(zero_copy_only=False))))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(there[[*at, len(page)]], pa.int32()), text.drop_null().cast(pa.string())), " ")
    page, band, lane, new_band = page[at], band[at], lane[at], new_band[at]
    filled = np.diff([*np.flatnonzero(new_band), len(at)])
    bands, lanes = np.zeros(n, np.int32), np.zeros(n, np.int32)
    np.maximum.at(bands, page, band + 1)
    np.maximum.at(lanes, page, lane + 1)
    wide, first = np.bincount(page[new_band][filled >= 2], minlength=n), np.bincount(page[band == 0], minlength=n)
    ends = pa.array(np.searchsorted(page, np.arange(n + 1)), pa.int32())
    lists = (pa.ListArray.from_arrays(ends, x) for x in (pa.array(band), pa.array(lane), texts))
    return [pa.array(bands), pa.array(lanes), pa.array(wide, pa.int32()), pa.array(first, pa.int32()), *lists]


def _layout(band_gap: float, lane_gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                *own, words = batch.slice(at, PAGES).columns
                names = [*batch.schema.names[:-1], "bands", "lanes", "wide", "first", "band", "lane", "text"]
                yield pa.RecordBatch.from_arrays([*own, *_cells(words, band_gap, lane_gap)], names)

    return lay


def cells(pages: DataFrame, page: list[str], band_gap: float, lane_gap: float) -> DataFrame:
    """(page columns, bands, lanes, wide, first, band, lane, text) of every page. pages: page columns, words (arrays of text, x0, x1, y0, y1).

    Lanes are the stretches of the x axis that the words of the page cover, bands those of the y axis.
    band, lane and text are arrays with an item for each cell, by band and lane; the first ``first``
    cells are band 0, and ``wide`` bands have words in several lanes.
    """
    numbers, lists = "bands int, lanes int, wide int, first int", "band array<int>, lane array<int>, text array<string>"
    schema = T.StructType([pages.schema[c] for c in page] + T.StructType.fromDDL(f"{numbers}, {lists}").fields)
    return pages.select(*page, "words").mapInArrow(_layout(band_gap, lane_gap), schema)


def tabular(found: DataFrame) -> DataFrame:
    """The pages that are tables: two lanes or more, LEAST_BANDS bands or more, most of them with words in several lanes."""
    return found.where((F.col("lanes") >= 2) & (F.col("bands") >= LEAST_BANDS) & (F.col("wide") >= LEAST_SHARE * F.col("bands")))


def projected(words: DataFrame, document: str, page: str, band_gap: float, lane_gap: float) -> DataFrame:
    """``projected_pages`` of single words: document, page, text, x0, x1, y0, y1."""
    return projected_pages(paged(words, [document, page]), document, page, band_gap, lane_gap)


def projected_pages(pages: DataFrame, document: str, page: str, band_gap: float, lane_gap: float) -> DataFrame:
    """(document, table, row, lane, text, header): the cells of all tables, rows numbered through the pages that a table goes on over.

    A page goes on with the table of the page before if both have as many lanes; a first band equal
    to the table's header is a repeated header and no row. header is true in a table's first row.
    pages: a row a page, as of ``paged``; pages without a document or number are none.
    """
    known = pages.where(F.col(document).isNotNull() & F.col(page).isNotNull())
    tables = tabular(cells(known, [document, page], band_gap, lane_gap))
    line = Window.partitionBy(document).orderBy(page)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = (F.lag(page).over(line) == F.col(page) - 1) & (F.lag("lanes").over(line) == F.col("lanes"))
    tables = tables.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("table", F.sum("starts").over(so_far))
    top = F.struct(F.slice("lane", 1, F.col("first")), F.slice("text", 1, F.col("first")))
    header = F.last(F.when(F.col("starts") == 1, top), ignorenulls=True).over(so_far)
    tables = tables.withColumn("repeats", ((F.col("starts") == 0) & (header == top)).cast("int"))
    # rows of the document before the page, then those of them that belong to the tables before
    tables = tables.withColumn("rows", F.sum(F.col("bands") - F.col("repeats")).over(so_far) - F.col("bands") + F.col("repeats"))
    tables = tables.withColumn("before", F.col("rows") - F.last(F.when(F.col("starts") == 1, F.col("rows")), ignorenulls=True).over(so_far))
    placed = tables.select(document, "table", "before", "repeats", F.inline(F.arrays_zip("band", "lane", "text"))).where("NOT (repeats = 1 AND band = 0)")
    row: Column = F.col("before") + F.col("band") - F.col("repeats")
    return placed.select(document, F.col("table").cast("long").alias("table"), row.cast("long").alias("row"), F.col("lane").cast("long").alias("lane"), "text", (row == 0).alias("header"))
