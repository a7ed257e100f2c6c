"""Helpers the operators share: the shared folder, written tables, slices of Arrow batches."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a finished query deletes its shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space, the separators of words.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (local tests) a temporary folder of this machine is made and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_heronlake_dir", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="spark-heronlake-")
            spark._heronlake_dir = folder
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage: lost executors cost only the running stage, and the
    size of the table is known to Spark when it plans later joins.  Spark then
    deletes the shuffle files of the write, which nothing reads again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heronlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._heronlake_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._heronlake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its user sets by the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words_column(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def lower_az(text: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of(doc_id: Column) -> Column:
    """CRC-32 of the id as text; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def passed(keep: tuple[str, ...], made: tuple[str, ...]) -> tuple[str, ...]:
    """The kept columns; one with the name of a column that the operator makes (in any case) is left out, so that the made one stands."""
    own = {c.lower() for c in made}
    return tuple(c for c in keep if c.lower() not in own)


def by_bytes(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        import numpy as np

        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + limit, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def chained(first, rest):
    """An iterator that starts with ``first``."""
    return itertools.chain([first], rest)
