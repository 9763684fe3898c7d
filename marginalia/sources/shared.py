"""Tables that several branches of a plan need, kept in the folder that all machines share."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where kept tables go if the session names no folder (tests on one machine).
DEFAULT_SHARED = "/tmp/checkpoints"
#: Bytes of an Arrow batch that goes to a worker while a table is kept; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder, with its scheme. A default is set only where the session names none and one machine does all the work."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(DEFAULT_SHARED)
        path = DEFAULT_SHARED
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int = BATCH_BYTES):
    """Tables written inside have about `most` bytes in an Arrow batch, so a worker's memory doesn't grow with a partition of long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends here, and lost executors lose nothing. Workers get its rows in small batches."""
    path = f"{shared_dir(df.sparkSession)}/marginalia-{kind}-{uuid.uuid4().hex}"
    with batch_bytes(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._is_kept = True
    return found


def kept_once(df: DataFrame, kind: str) -> DataFrame:
    """df itself if it is what kept() returned, so that operators which read a table several times don't each write it again."""
    return df if vars(df).get("_is_kept") else kept(df, kind)


def forget(*tables: DataFrame) -> None:
    """Deletes the files that kept() wrote and that these tables read, and lets go of shuffles behind them; nothing that is still to be computed may need them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        jvm, root = context._jvm, f"{shared_dir(df.sparkSession)}/marginalia-"
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            if path.toString().startswith(root):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # Spark deletes a shuffle's files when its plan is collected
