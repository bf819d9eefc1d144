"""What executors and the driver share: tables and files under ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of what is not ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, keep: bool = False) -> str:
    """A new folder that the driver and all executors can reach; it goes with the session unless kept.

    The cluster names the parent in ``spark.checkpoint.dir``; where that is unset a local folder
    takes its place on a single machine, as in tests, and a cluster is refused.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/gradeloom-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean  # noqa: BLE001
        pass


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there, and a
    lost executor costs no more than a new read."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go now; else they stay until the driver
    happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(uri: str):
    """pyarrow's file system and path of a URI, on the driver or in a task."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri) if not uri.startswith("file:") else "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it holds, Python workers get so many rows at a time: for what is run inside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class NewFile:
    """A file that appears whole or not at all, so a lost or a repeated task does no harm."""

    def __init__(self, uri: str):
        self.files, self.path = file_system(uri)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.files.open_output_stream(self.own)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.files.move(self.own, self.path)


def write_file(uri: str, data: bytes) -> None:
    out = NewFile(uri)
    out.write(data)
    out.close()


def exists(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type == fs.FileType.File


def read_range(files, path: str, start: int, length: int) -> bytes:
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    # \z, as $ also matches before a last line terminator, and Java knows some that are no gap here
    trimmed = F.regexp_replace(text, rf"^{WORD_GAP}|{WORD_GAP}\z", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, WORD_GAP))
    ).cast("long")


def batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values of 64-bit values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_HELD: list = ["", lambda: None]


def hold(owner: str, drop) -> None:
    """Python workers outlive a stage: what one operator keeps in them (``drop`` lets go of it)
    goes when another operator begins."""
    if _HELD[0] != owner:
        _HELD[1]()
        _HELD[:] = [owner, drop]
        trim()


def trim() -> None:
    """What is freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, drop=lambda: None):
    """A task's function that leaves little behind in a worker that idles after it."""

    def tidied(batches):
        yield from run(batches)
        drop()
        trim()

    return tidied
