"""Shared pieces: tables, scratch tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows, in files of at most so many bytes, may be broadcast;
#: beyond either Spark joins by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) is a folder made here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: While a scratch table is written: short Arrow batches, as whole texts are long and several
#: Python workers share what an executor's heap leaves; shuffle files go once the table is there.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with ``conf``, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a small table that one task writes.
FILE_ROWS = 50_000


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs a read, not a recomputation. The
    tables of one application lie in one folder, named by its id. ``rows``, if it is known
    that there are no more, keeps small tables from being written as many tiny files.
    """
    spark = df.sparkSession
    if rows is not None and (parts := rows // FILE_ROWS + 1) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(parts)
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing reads any more."""
    for t in tables:
        if path := _paths.get(id(t)):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows and ``most_bytes`` bytes, else as it is.

    ``df`` should be ``stored`` first: then the count reads Parquet footers only, and
    the bytes are those that the optimizer takes from the files, for the columns read.
    Without the hint Spark takes a shuffle join, whose skewed partitions AQE splits.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes and df.count() <= most else df


def trimmed(run):
    """A function for ``mapInArrow`` that gives the memory it has used back to the system at its end:
    Python workers are used again and again, and those beside them may need it."""

    def held(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return held


def crc_mod(doc_id: int | None, m: int) -> int:
    """crc32 of ``doc_id`` as text, modulo ``m``: the fold of a labelled row."""
    return zlib.crc32(str(doc_id).encode()) % m


def fold(column: str, m: int):
    """The same as a column; a null id has the crc32 of the empty text, 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % m
