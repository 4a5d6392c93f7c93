"""Shared folders, written intermediate tables and Arrow batches cut by size."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time.
SLICE_BYTES = 1 << 20
#: Bytes of text for each part of what is gathered from it.
PART_BYTES, PARTS, LARGE_PART_BYTES = 16 << 20, 20_000, 512 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 500

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="recallgrid-")
        atexit.register(__import__("shutil").rmtree, _own_dir.removeprefix("file://"), True)
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; its files go when the driver ends."""
    path = f"{shared_dir(spark)}/recallgrid-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


def written(df: DataFrame, name: str, files: int = 0) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them again.

    Unlike a cached or locally checkpointed frame this survives the loss of any executor. With ``files`` the rows are
    dealt into so many where the session has several times as many partitions: a file costs the same however little is in it.
    """
    path = new_path(df.sparkSession, name)
    if files and 4 * files <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(files)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(docs: DataFrame, text: str) -> int:
    """How many parts what is gathered from texts is dealt into: one for each ``PART_BYTES`` of text, from ``PARTS`` parts on for each
    ``LARGE_PART_BYTES``; as many as the session's shuffle partitions at least."""
    least = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, files_for(docs, text))


def files_for(docs: DataFrame, text: str) -> int:
    """The same by the size of the text alone."""
    n_bytes = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, min(n_bytes // PART_BYTES, PARTS), n_bytes // LARGE_PART_BYTES)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_bytes`` of ``column`` each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def released(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, around which the worker gives memory back, as it stays for tasks of other operators: tables kept by those before
    it begins, and what the allocators hold after its last batch.

    Where the session has Spark's usual 10,000 rows to an Arrow batch, batches become ``BATCH_ROWS``: texts are long.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def released_group(write: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of the rows of one key."""

    def run(table: pa.Table) -> pa.Table:
        forget("")
        try:
            return write(table)
        finally:
            give_back()

    return run


#: What operators keep in a worker from task to task, by operator, and how it is dropped.
_kept: dict[str, Callable[[], None]] = {}


def kept(operator: str, drop: Callable[[], None]) -> None:
    _kept[operator] = drop


def forget(besides: str) -> None:
    """Drop what operators but one keep in this worker."""
    for operator, drop in _kept.items():
        if operator != besides:
            drop()


def give_back() -> None:
    """Return freed memory to the system: of reference cycles, of Arrow, and of the C library where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, nulls as empty, and where each value starts and the last ends."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def row_keys(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Columns that identify a row among its copies: its id (null as the least long) and a hash of its text."""
    return {"_rg_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "_rg_th": F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))}


def keep_rows(docs: DataFrame, chosen: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (``_id``, ``_th``) is among ``chosen``, one row for each pair; columns as they were."""
    from pyspark.sql import Window

    columns = docs.columns
    w = Window.partitionBy("_rg_id", "_rg_th").orderBy("_rg_id")
    keyed = docs.withColumns(row_keys(text=text)).join(chosen.select("_rg_id", "_rg_th").distinct(), ["_rg_id", "_rg_th"], "left_semi")
    return keyed.withColumn("_rg_n", F.row_number().over(w)).where("_rg_n = 1").select(*[F.col(f"`{c}`") for c in columns])
