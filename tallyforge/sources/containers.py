"""File listing and container detection in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File formats by MIME type, and by leading bytes in hexadecimal.
MIME_FORMATS = {"text/csv": "csv", "text/plain": "txt", "text/html": "html", "application/xml": "xml", "text/xml": "xml", "application/pdf": "pdf", "application/zip": "zip", "image/png": "png", "image/jpeg": "jpg"}
MAGIC = [("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("504B0708", "zip"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("52494646", "riff"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("EFBBBF3C3F786D6C", "xml"), ("3C3F786D6C", "xml"), ("3C21646F6374797065", "html"), ("3C21444F4354595045", "html"), ("3C68746D6C", "html")]

SUFFIXES = ("csv", "txt", "xml", "html", "htm", "pdf", "zip", "docx", "xlsx", "png", "jpg", "jpeg", "tif", "tiff", "json")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a path; unreadable ones don't stop the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)


def with_missing(listing: DataFrame, read: DataFrame) -> DataFrame:
    """Every listed file with its content, or the status unreadable: none disappears."""
    both = listing.join(read.select("path", "content"), "path", "left")
    return both.withColumn("status", F.when(F.col("content").isNull(), "unreadable").otherwise("available"))


def extension(name: Column, mime: Column) -> Column:
    """The suffix of a name, else the one that the MIME type stands for."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    by_mime = F.element_at(F.create_map(*(F.lit(x) for kv in MIME_FORMATS.items() for x in kv)), F.trim(F.substring_index(F.lower(mime), ";", 1)))
    return F.coalesce(F.when(suffix != "", suffix), by_mime, F.lit("unknown"))


def container(content: Column, suffix: Column) -> Column:
    """struct(format, confidence, basis): by leading bytes, else by a suffix that stands for a format, else unknown. Office files are zips by content."""
    head = F.hex(F.substring(content, 1, 9))
    by_content = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        by_content = F.when(head.startswith(magic), kind).otherwise(by_content)
    office = (by_content == "zip") & suffix.isin("docx", "xlsx")
    named = F.when(F.lower(suffix).isin(*SUFFIXES), F.lower(suffix))
    kind = F.when(office, suffix).otherwise(F.coalesce(by_content, named, F.lit("unknown")))
    confidence = F.when(by_content.isNotNull(), "high").when(named.isNotNull(), "medium").otherwise("low")
    return F.struct(kind.alias("format"), confidence.alias("confidence"), F.when(by_content.isNotNull(), "content").when(named.isNotNull(), "metadata").otherwise("none").alias("basis"))


def machine_readable(kind: Column) -> Column:
    return F.when(kind.isin("csv", "txt", "xml", "xlsx", "html"), "yes").when(kind.isin("pdf", "docx"), "conditional").when(kind.isin("png", "jpg"), "no").otherwise("unknown")


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG from its header; null for others."""
    at = lambda i: F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 4)) == "89504E47", F.struct(at(17).alias("width"), at(21).alias("height")))
