"""Helpers that several operators share: table access, shared storage, file systems in tasks."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 512
SPLITS = 4
_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run_folder(spark: SparkSession) -> str:
    """This process's folder below ``spark.checkpoint.dir``; it goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    if root not in _FOLDERS:
        _FOLDERS[root] = f"{root.rstrip('/')}/threadloom-{uuid.uuid4().hex}"
        atexit.register(_delete, _FOLDERS[root])
    return _FOLDERS[root]


def _delete(uri: str) -> None:
    fs, path = open_fs(uri)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(path)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share.

    Where ``spark.checkpoint.dir`` is unset a local session gets a temporary one; on a cluster that is an error.
    """
    return f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows of ``df``: one for ``SPLITS`` partitions of its input (half a gigabyte with
    Spark's own split size), the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions() // SPLITS)


def open_fs(uri: str):
    """(file system, path) for a URI, usable inside a task (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_bytes(uri: str, data: bytes) -> None:
    """Write through a unique temporary name, so that a lost attempt never leaves a half-written file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def slices(batches, rows: int = SLICE_ROWS):
    """Bounded pieces of the Arrow batches that Spark hands to a task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
