"""Continuous ingestion (T1): the index job as a Structured Streaming query.

A source of rows feeds micro-batches; each goes through change detection and becomes one incremental
commit of its changed rows (``IndexStore.commit_delta``), so the cost of a batch follows the batch.
For image files the stream is fed by the distributed walk of the batch run: every start lists the
folder and publishes the files that are new or edited, as (path, modtime), into a spool of small
Parquet files that the stream reads. So it sees what the walk sees: names with a leading dot or
underscore, and files edited in place. What was published once under one modtime is not published
again, whether it succeeded or failed. Bytes are read in the task that recognises them.

A ``trigger(availableNow=True)`` run processes what is there and stops, so it can run as a
scheduled job; the checkpoint makes a restarted run continue after the last committed batch.
Deletions are left to the cleanup of the batch index run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from ..operators import recognise as R
from ..operators import store as ST
from ..session import checkpoint_dir
from ..sources import listing as LS



def ingest_rows(rows: DataFrame, store: ST.IndexStore, checkpoint: str):
    """Run a stream of ``(path, modtime, content)`` texts into ``store``, one commit per batch."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        todo = ST.changed_files(batch, store.current()).select("path", "modtime", "content")
        store.commit_delta(todo)

    return _finish(rows, run, checkpoint)


def _finish(rows: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str):
    q = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


SPOOL_SCHEMA = "path string, modtime long"


def publish_changes(spark: SparkSession, root: str, store: ST.IndexStore, spool: str, per_file: int, exclude: list[str] | None = None,
                    memory: str | None = None) -> int:
    """Append the files under ``root`` that neither the index nor the spool has with their modtime to the
    spool, ``per_file`` paths a file; returns their number. ``memory`` as in ``listing.walk``."""
    listed = LS.list_files(spark, root, exclude=exclude, memory=memory).select("path", "modtime")
    todo = ST.changed_files(listed, store.current()).select("path", "modtime")
    fs, p = store._fs(spool)
    if fs.exists(p):
        todo = todo.join(spark.read.schema(SPOOL_SCHEMA).parquet(spool), ["path", "modtime"], "left_anti")
    checkpoint_dir(spark)
    todo = todo.checkpoint(eager=True)  # the count and the files must agree
    n = todo.count()
    if n:
        todo.repartition(-(-n // per_file)).write.mode("append").option("maxRecordsPerFile", per_file).parquet(spool)
    return n


def ingest_files(spark: SparkSession, root: str, store: ST.IndexStore, make_engine, options: dict | None = None,
                 checkpoint: str | None = None, max_files_per_trigger: int = 900, files_per_task: int = 32,
                 exclude: list[str] | None = None, seconds_per_file: float | None = 600.0, walk_memory: str | None = None):
    """Run the image files under ``root`` into ``store``, at most ``max_files_per_trigger`` per commit.
    Failed files are appended to ``<store>/failures`` (path, modtime, error)."""
    checkpoint = checkpoint or f"{store.base.rstrip('/')}/ingest"
    spool = f"{checkpoint.rstrip('/')}-spool"
    publish_changes(spark, root, store, spool, max_files_per_trigger, exclude, walk_memory)
    fs, p = store._fs(spool)
    if not fs.exists(p):
        return None  # nothing was ever found
    files = spark.readStream.schema(SPOOL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(spool)

    def run(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():  # a spool file of a task that had no paths
            return
        # a batch that runs again after a crash leaves out what it has committed
        todo = LS.spread(ST.changed_files(batch, store.current()).select("path", "modtime"), files_per_task)
        checkpoint_dir(spark)
        # the commit reads the results several times: no engine runs twice for a file
        res = R.recognise_files(todo, make_engine, options, seconds_per_file).checkpoint(eager=True)
        R.failed(res).write.mode("append").parquet(f"{store.base.rstrip('/')}/failures")
        store.commit_delta(R.succeeded(res))

    return _finish(files, run, checkpoint)
