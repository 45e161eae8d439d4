"""What the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: blank, tab, line feed, vertical tab, form feed, return.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text, and more that is named, so that further columns, whatever their names, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key for each row, ascending with doc_id; rows without a doc_id come last.

    Unique ids are keys as they are. Else rows are put in order and written once; rows of one doc_id
    then follow one another by the hash of their text.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("n"))).alias("most")).first()
    if (ids["most"] or 0) <= 1:
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    return written(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "keyed")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(*tables: DataFrame | None) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def slices(batch, most_bytes: int = 2_000_000, column: str = "text"):
    """Cuts an Arrow batch into runs of rows whose texts hold about most_bytes, one row at least."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cell = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, one after the other, and where each begins and the last ends.

    A view of Arrow's own memory; null counts as empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return own, at - at[0]


def mapped(df: DataFrame, each: Callable, schema) -> DataFrame:
    """df.mapInArrow, after which a worker gives memory that it no longer needs back to the system.

    Workers serve many jobs; what one of them has held must not be counted against the next.
    """

    def run(batches):
        try:
            yield from each(batches)
        finally:
            released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Gives free memory of Arrow and of the C library back, where the latter can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what is free for later


def with_n_chars(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column of numbers, set to the length of the text."""
    kind = dict(docs.dtypes).get("n_chars")
    return docs.withColumn("n_chars", F.length("text").cast(kind)) if kind in ("int", "bigint") else docs
