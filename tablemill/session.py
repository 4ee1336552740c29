"""Where iterative jobs and row numbering may put their intermediate tables.

A cluster names one shared folder in ``spark.checkpoint.dir``. It is read from the session; only
a local session without it (a laptop, the tests) gets a temporary folder of its own.
"""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablemill-"))
    return context.getCheckpointDir().rstrip("/")


#: Paths given out inside each open ``cleared`` block, the innermost one last.
_given: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _given:
        _given[-1].append(path)
    return path


@contextmanager
def cleared(spark: SparkSession):
    """Deletes the intermediate tables of the block when it ends, also by an error.

    Operators return DataFrames that still read those tables, so write or collect results inside the block. Blocks may be
    nested, but not used from several threads at once.
    """
    _given.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in _given.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Unlike a cache it survives lost executors, and readers of it still prune columns and push
    filters down.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, for one round of an iteration.

    A written table rather than ``df.checkpoint()``: a checkpoint keeps the constraints that the
    optimiser derived from its plan, and over some ten rounds these grew until planning took
    a minute. A table also tells its size, so that later joins can be planned by it.
    """
    return written(df, "round")
