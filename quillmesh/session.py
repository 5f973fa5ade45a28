"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a session of our own; a session that is given is never changed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints are deleted when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session for tests, benchmarks and the command line. checkpoint_dir: a folder that all executors share."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).appName("quillmesh").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = shared or os.path.join(tempfile.gettempdir(), "quillmesh-checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and reads it from there, so that its lineage ends and a lost
    executor costs nothing but the tasks it ran.

    A checkpoint keeps the size estimate of the plan it came from. In a loop of joins these estimates multiply until
    arithmetic on them takes longer than the job, so the rows are wrapped anew, with the size unknown; at run time
    adaptive execution sees the real sizes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    saved = df.checkpoint(eager=True)
    rows = saved._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, saved._jdf.schema(), False), spark)


def parallelism(spark: SparkSession) -> int:
    """Partitions for explicit range or hash splits."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
