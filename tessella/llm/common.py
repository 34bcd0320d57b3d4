"""Shared helpers: scratch tables in the cluster's shared folder, Arrow access."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, list[str]] = {}
LOCAL = "/tmp/checkpoints/tessella"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset, a local
    folder serves a local master, whose executor is the driver; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = LOCAL
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_all, spark)
    _SCRATCH.setdefault("paths", []).append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A point in the list of scratch tables, for ``drop_since``."""
    return len(_SCRATCH.get("paths", []))


def drop_since(spark: SparkSession, point: int, *keep: DataFrame) -> None:
    """Delete the scratch tables written since ``point`` but those that ``keep`` reads."""
    kept = {name.rpartition("/")[0].rpartition("/")[2] for df in keep for name in df.inputFiles()}
    paths = _SCRATCH.get("paths", [])
    for path in paths[point:]:
        if path.rpartition("/")[2] not in kept:
            drop_path(spark, path)
    paths[point:] = [p for p in paths[point:] if p.rpartition("/")[2] in kept]


def _drop_all(spark: SparkSession) -> None:
    for path in _SCRATCH.pop("paths", []):
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already at interpreter exit
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and
    a lost executor costs nothing but its running tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that nothing refers to any more; to be
    called once what materialize was given is out of scope."""
    for pause in (0.2, 0.5):  # the first round frees Python's handles, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the size of ``df``; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def give_back() -> None:
    """Return freed memory to the system.  Python workers serve one task after another, and what one
    has freed but kept would count beside what the next one needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def thrifty(run):
    """``run``, a function from batches to batches, that gives memory back when its task ends."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, int64 offsets of length n + 1) of an Arrow string column."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    buffers = array.buffers()
    if len(array) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """Row ranges of about ``most`` bytes of text; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def rows_of_text(batches, key: str = "doc_id"):
    """(keys, bytes, offsets) for runs of about 2 MB of text of ``key``, ``text`` batches.
    A null text has no bytes."""
    for batch in batches:
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False))
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        for i, j in slices(offsets):
            yield keys[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
