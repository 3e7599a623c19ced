"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: maximal runs of other characters than these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\r\x0b\x0c"

#: Rows of an Arrow batch, where the session has Spark's own 10,000: of long texts those are hundreds of MB on either side.
ARROW_ROWS = 1000
#: Bytes of text that are worked on together, but for single texts that are longer.
LOT_BYTES = 1 << 20

_made: list[tuple[weakref.ref, str]] = []

Batches = Iterator[pa.RecordBatch]


def small_batches(spark: SparkSession) -> None:
    """Bounds what is sent to Python workers at once, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet to the shared folder and reads them back; a lost executor loses nothing.

    The folder goes when the session ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((weakref.ref(spark), path))
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._written_to = path
    return table_


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table made by written()."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def lots(batches: Batches, column: int, rows: int) -> Batches:
    """The batches in slices of at most so many rows, and LOT_BYTES of a column of texts or bytes unless one value has more."""
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + LOT_BYTES, side="right"))))
            yield whole.slice(at, to - at)
            at = to


def released() -> None:
    """Gives memory that nothing uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function whose worker collects no cycles meanwhile, and gives its memory back when the task ends: workers serve many stages."""

    def task(batches: Batches) -> Batches:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            released()

    return task


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written(), once all that was read from it is written itself."""
    _delete(df.sparkSession, df._written_to)


@atexit.register
def _clean() -> None:
    for ref, path in _made:
        try:
            _delete(ref(), path)
        except Exception:  # noqa: BLE001 - the session is gone already
            return


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
