"""Runs over the items of a folder that go on where they were stopped: results by (run_id, record_id), without doubled or recomputed ones.

The items are a file stream in micro-batches, whose checkpoint knows which are done. A batch leaves out the items that the run has results for already, and writes its own to a folder
named by its number; a batch that was broken off is written over when it runs again, so it has results once. The checkpoint and the results belong to the run, so that
a new session, or another driver, goes on with them. Jobs of a run are one job group, and ``cancel`` ends them on the executors; the batch that it broke off is the only one that will run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

STATUSES = ("completed", "failed")


class ResumableRun:
    """``process`` takes the items of a batch, and gives rows with ``id_column`` and more: each is the result of that record in the run.

    ``path``: the run's folder, in the storage that the cluster shares. Items that ``process`` gives no row for are ``failed``, and are tried again only by another run."""

    def __init__(self, spark: SparkSession, run_id: str, items: str, schema: T.StructType, process: Callable[[DataFrame], DataFrame], path: str, *, id_column: str = "id", files_per_batch: int = 1):
        if not run_id or "/" in run_id:
            raise ValueError("a run needs a name without slashes")
        self.spark, self.run_id, self.items, self.schema, self.process = spark, run_id, items, schema, process
        self.id, self.files, self.base = id_column, files_per_batch, f"{path}/{run_id}"

    def _done(self) -> DataFrame | None:
        written = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/results/batch=*/_SUCCESS")
        found = written.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(written) or []
        batches = [x.getPath().getParent().toString() for x in found]  # those that were written to the end
        return self.spark.read.option("basePath", f"{self.base}/results").parquet(*batches) if batches else None

    def _batch(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.sparkContext.setJobGroup(self.group, f"run {self.run_id}, batch {number}", interruptOnCancel=True)
        todo = batch.dropDuplicates([self.id])
        done = self._done()
        if done is not None:
            todo = todo.join(done.where(F.col("batch") != number).select(F.col("record_id").alias(self.id)), self.id, "left_anti")
        out = self.process(todo)
        kept = [c for c in out.columns if c != self.id]
        at = f"{self.base}/results/batch={number}"
        result = out.select(F.lit(self.run_id).alias("run_id"), F.col(self.id).alias("record_id"), F.lit("completed").alias("status"), F.struct(*kept).alias("result"))
        result.write.mode("overwrite").option("compression", "zstd").parquet(at)
        there = spark.read.schema(result.schema).parquet(at)  # so that nothing is computed twice to see what is missing
        failed = todo.join(there.select(F.col("record_id").alias(self.id)), self.id, "left_anti").select(F.lit(self.run_id).alias("run_id"), F.col(self.id).alias("record_id"), F.lit("failed").alias("status"))
        failed.unionByName(there.limit(0), allowMissingColumns=True).write.mode("append").option("compression", "zstd").parquet(at)

    @property
    def group(self) -> str:
        return f"run-{self.run_id}"

    def start(self) -> StreamingQuery:
        """Begins the run, or goes on with it; the query ends when no items are left."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.items)
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()

    def complete(self) -> DataFrame:
        """Runs to the end, and gives the results."""
        self.start().awaitTermination()
        return self.results()

    def cancel(self, query: StreamingQuery) -> None:
        """Ends the run's jobs; what was written stays, and ``start`` goes on from there."""
        self.spark.sparkContext.cancelJobGroup(self.group)
        query.stop()

    def results(self) -> DataFrame:
        """run_id, record_id, status, result, batch: one row for each item so far."""
        done = self._done()
        if done is None:
            raise ValueError(f"the run {self.run_id} has no results yet")
        return done

    def progress(self, total: int | None = None) -> DataFrame:
        """status, items; what of ``total`` isn't there yet is `queued`."""
        counts = self.results().groupBy("status").agg(F.count(F.lit(1)).alias("items"))
        if total is None:
            return counts
        rest = counts.agg((F.lit(total) - F.coalesce(F.sum("items"), F.lit(0))).cast("long").alias("items")).where("items > 0")
        return counts.unionByName(rest.select(F.lit("queued").alias("status"), "items"))
