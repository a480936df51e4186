"""Makes this package importable on executors that don't have it installed, and lays small inputs out over all cores."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch in sessions that leave the setting at its default of 64 MiB: each task holds such a batch in the
#: executor's native memory and another in its Python worker.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for each Spark context, and bound the session's Arrow batches."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_extractspark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="extractspark-")) / "extractspark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent).as_posix())
    context.addPyFile(str(target))
    context._extractspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or else of ``setCheckpointDir``, which driver and executors share.

    Where neither is set, a session on one machine (a test) gets a local folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="extractspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def ship_active() -> None:
    """ship for the active session, if there is one: for functions that only see columns."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


#: A table of at most so many bytes a core is dealt out anew before work that takes long for each row.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; a large one as it is.

    A file of one row group is read by one task, and small shuffles end in one partition, whatever is to be done with each
    row. What moves is bounded by the number of cores; a larger table has partitions enough and is never moved.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL * cores else df
