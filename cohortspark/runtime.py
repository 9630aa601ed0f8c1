"""Session helpers: checkpoints that survive executor loss, and small conveniences."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Jobs that run beside each other in :func:`together`.
WIDTH = 8


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session, setting it when only the conf names it.

    On a cluster the folder has to be shared, so it must come from ``spark.checkpoint.dir``.
    Only a local master (tests, laptops) falls back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The result has no lineage, survives the loss of executors, knows its size (which the planner uses to
    pick join strategies) and, unlike a checkpointed plan, carries no constraints from earlier rounds: in a
    loop those grow until planning takes longer than the work.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`cut` that nothing reads any more, such as the last round's of a loop.

    Sessions without a JVM at hand leave it to whoever clears the checkpoint folder.
    """
    path = getattr(df, "_table_path", None)
    jvm = getattr(df.sparkSession, "_jvm", None)
    if path and jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def together(spark: SparkSession, jobs: list[Callable[[], object]], width: int = WIDTH) -> list:
    """Results of independent jobs, at most ``width`` at a time, in the order given; local properties of the caller hold in each.

    A job that spends its time between small stages leaves cores free, which the others use. With ``spark.scheduler.mode``
    FAIR they share the cluster evenly.
    """
    if len(jobs) < 2 or width < 2:
        return [job() for job in jobs]
    try:
        from pyspark import inheritable_thread_target

        wrapped = [inheritable_thread_target(spark)(job) for job in jobs]
    except (ImportError, TypeError, AttributeError):
        wrapped = jobs
    with ThreadPoolExecutor(min(width, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(job) for job in wrapped]]


def has(df: DataFrame, name: str) -> bool:
    """Plan-time test for an optional column."""
    return name in df.columns


def present(df: DataFrame, names: list[str]) -> list[str]:
    """Wanted columns that exist, in the wanted order."""
    return [name for name in names if name in df.columns]
