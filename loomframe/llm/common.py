"""Small things that the training-data operators share: reading tables, work folders, name-safe columns."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder for a written intermediate table, under the folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (tests on one
    machine) a temporary folder is made and set, so that later calls agree.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = f"file://{tempfile.mkdtemp(prefix='loomframe-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables made by ``stored`` that nothing reads any more."""
    jvm = spark._jvm
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES for this session, unless it says otherwise: texts then cost an executor little beside the work on them."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A new schema with further fields."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


# --- functions of Arrow data on executors

_last_release = 0.0


def _release(at_most_every: float = 0.0) -> None:
    """Gives freed memory back to the system: workers live on between tasks, and what they hold the next stage lacks."""
    global _last_release
    if time.monotonic() - _last_release < at_most_every:
        return
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
    _last_release = time.monotonic()


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim  # noqa: B018  only glibc has it
    except (OSError, AttributeError):
        return None
    return libc


_LIBC = _libc()


def narrow(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``, releasing memory as it goes and at the end of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in work(batches):
                yield out
                _release(1.0)
        finally:
            _release()

    return run


def grouped(work: Callable) -> Callable:
    """``work`` for ``groupBy().applyInArrow``, releasing memory after groups."""

    def run(rows: pa.Table) -> pa.Table:
        out = work(rows)
        _release(0.2)
        return out

    return run


def cogrouped(work: Callable) -> Callable:
    """``work`` for ``cogroup().applyInArrow``, releasing memory after groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        _release(0.2)
        return out

    return run
