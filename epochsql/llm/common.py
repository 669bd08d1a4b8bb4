"""What the operators share: reading tables, scratch tables in the shared folder, size checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: maximal runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between the JVM and Python at most: documents may be long, and a batch is held several times over.
BATCH_ROWS = 2000


def trim_memory() -> None:
    """Gives the free memory of this Python process back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS at most; at a task's end its worker gives its free memory back.

    The size of batches is a setting of the session; a lower one stays as it is.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def then_trim(batches):
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return df.mapInArrow(then_trim, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where none is set (tests), a local one is made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='epochsql-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and survives a lost executor.

    Those that a returned frame still reads stay in that folder, which is for passing data: clear it by age.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """df as a table of its own; the same plan is never run twice. ``.path`` tells where it lies."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path, **options)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.path = path
        return out

    def drop_all(self) -> None:
        """Everything written here. Call it once no frame made from these tables is read any more."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for x in tables:
            where = jvm.org.apache.hadoop.fs.Path(x.path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as a long, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
