"""Helpers shared by the operators: tables, shared work folders, the fold of a document."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
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


class Shared:
    """A broadcast of an object of bounded size. It is pickled by value, so executors need no copy of this package; a worker unpickles it once."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.sent, "unpickled"):
            self.sent.unpickled = cloudpickle.loads(self.sent.value)
        return self.sent.unpickled


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors. The write's shuffle files go with its end."""
    spark = df.sparkSession
    path, before = f"{work_dir(spark)}/{name}", spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers about BATCH_BYTES at a time. Spark's own bound is 10,000 rows, whatever
    the length of their texts, and workers keep the memory that their largest batch took."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas share no subexpressions, but a lambda's variable is a value."""
    return F.get(F.transform(F.array(value), use), 0)


def learned_fold(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves a remainder other than 1 modulo 3 (null ids: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def hash_sample(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), chosen by a hash of the columns, the same in every run."""
    total = df.count()
    share = min(1.0, rows / max(1, total))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(F.lit(3), *columns), F.lit(1 << 30)) < int(share * (1 << 30)))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be one of the columns (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
