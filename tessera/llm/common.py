"""What the corpus operators share: the cluster's shared folder, written tables, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ship import ship

#: Bytes of Arrow data that a Python worker gets at once; a longer single row still comes whole.
BATCH_BYTES = 4 << 20
ROWS_AT_ONCE = 2000
#: For rows of megabytes: pages and row groups are closed by size after every row, and not only after a hundred.
LONG_ROWS = {f"parquet.{kind}.row.check.{end}": "1" for kind in ("page.size", "block.size") for end in ("min", "max")} | {"parquet.block.size": str(16 << 20)}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of our own, by application; only where the session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine alone, as in tests, our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        app = spark.sparkContext.applicationId
        given = _OWN[app] = _OWN.get(app) or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing but a read.

    The shuffles that made it are let go once it is written. options go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once nothing reads them."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.startswith(shared_dir(spark).replace("file:///", "file:/").rstrip("/")) or path.startswith(shared_dir(spark)):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded(df: DataFrame) -> DataFrame:
    """Keeps the Arrow batches of Python stages planned from here on small, whatever the texts' length; they find us."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, or with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_crc(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, by a modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, most_bytes: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and so many bytes in a string column unless one row alone has more."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        first = held = 0
        for at, n in enumerate(size):
            if at > first and (at - first == rows or held + n > most_bytes):
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += n
        if first < len(size):
            yield batch.slice(first)


def trim() -> None:
    """Gives freed memory back to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
