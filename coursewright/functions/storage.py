"""Cutting lineage in a folder that driver and executors share, and clearing what was written there."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Where ``stored`` writes while ``temporary_tables`` is open.
_FOLDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It comes from ``spark.checkpoint.dir``. Only where a local session has
    none, as in tests, is a temporary folder of this machine set; on a cluster
    that would be lost with its machine, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            master = context.master or ""
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = os.path.join(tempfile.gettempdir(), "coursewright-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with ``checkpoint()`` in the shared folder and return the reread frame.

    Spark removes its files once nothing refers to the frame, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints of frames that nothing refers to any more.

    Its cleaner goes by the driver's garbage collection, which a driver with
    little to do rarely runs; loops of many small jobs call this between
    rounds, so that their files do not add up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it; see ``temporary_tables`` for when it goes."""
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_folder(spark) + '/tables'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Everything that ``stored`` writes within goes when the block ends, also after an error.

    Write or collect results inside: a frame that reads such a table is of no
    use afterwards. Gives the folder, which is in the shared one.
    """
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
