"""Tables written to the shared folder and read back, and the sinks of the engine."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary one; a cluster has to set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="tallyforge-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        base = _OWN["dir"]
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write a whole case as a new immutable version and return its path; readers of older versions aren't disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def xml_rows(row: Column, root: str) -> Column:
    """A struct as an XML element; fields named with a leading underscore are attributes."""
    return F.to_xml(row, {"rowTag": root, "ignoreNullFields": "true"})


def unexpired(df: DataFrame, expires_at: Column, now: Column) -> DataFrame:
    """Rows without an expiry, or with one still to come."""
    return df.where(expires_at.isNull() | (expires_at > now))
