"""What the operators of this subpackage share: tables, the shared folder, text slices."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow's own allocator keeps what is freed; what the C library's holds goes back to the system in _trim().
pa.set_memory_pool(pa.system_memory_pool())

#: Characters of text that one numpy pass works on; bounds a worker's memory whatever the batch holds.
SLICE_CHARS = 1_000_000
#: The same for passes that hold many numbers for each character.
SMALL_CHARS = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and there is one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the machines share no folder")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind those that a column has already (in any case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def file_system(uri: str):
    """pyarrow's file system of a place that all machines reach, and the path in it."""
    from pyarrow import fs

    uri = re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "/", uri))
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, outlives an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df.stored_at
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch, which Spark ends at 64 MB too: with texts of a few KB, several MB in the JVM and in the worker.
BATCH_ROWS = 2_000


def bounded(df: DataFrame) -> SparkSession:
    """df's session, with Arrow batches of at most BATCH_ROWS rows, so that a worker's memory is bounded.

    Plans are made when they run, so the setting stays: it is a lower bound of what a session asks for, and changes no
    result."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A table of so many ids at most, of 32 bytes each in a hash table, is broadcast: 8 MB.
BROADCAST_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if a count shows that it has few rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows of one key that a join deals to one task at most, about.
KEY_ROWS = 2_000


def shares_of(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """Of counts(key, n) the keys of more than `rows` rows, stored, and how many tasks they are dealt to (shares)."""
    return stored(counts.where(F.col("n") > rows).select(key, F.ceil(F.col("n") / rows).alias("shares")), "frequent")


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int = KEY_ROWS, frequent: DataFrame | None = None) -> DataFrame:
    """The inner join on key, with the left rows of a frequent key dealt by a hash of column `by` to as many tasks as they
    need, and the right rows of that key sent to each of them. frequent is shares_of() the left rows, if known."""
    if frequent is None:
        frequent = shares_of(left.groupBy(key).agg(F.count("*").alias("n")), key, rows)
    shares, share = free_names([*left.columns, *right.columns], "shares", "share")
    frequent, n = small(frequent.withColumnRenamed("shares", shares)), F.coalesce(shares, F.lit(1).cast("long"))
    dealt = left.join(frequent, key, "left").withColumn(share, F.pmod(F.xxhash64(by), n)).drop(shares)
    copies = right.join(frequent, key, "left").withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop(shares)
    return dealt.join(copies, [key, share]).drop(share)


def slices(batch: pa.RecordBatch, text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `chars` bytes of text; one longer text is a run of its own."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    run = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    _trim()


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on from task to task."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column]) if column.offset else column
    if column.offset:
        column = pa.array(column.to_pylist(), pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, end to end."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
