"""Where a plan is cut: results that several later steps read."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000


def settled_folder(spark: SparkSession) -> None:
    """Take the folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            own = tempfile.mkdtemp(prefix="threadloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(folder or f"file://{own}")
        atexit.register(_forget, context)


def _forget(context) -> None:
    """What this process left in its checkpoint folder goes with it."""
    with contextlib.suppress(Exception):
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, so that steps after it do not walk what led there again."""
    settled_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that ``settled`` uses."""
    settled_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with gapless numbers from 0 in this order. Ranges of rows are sorted apart; a range's first number is the
    count of the rows before it, from one count a range."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // range_rows)
    at = F.monotonically_increasing_id()
    kept = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return kept.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
