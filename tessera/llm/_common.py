"""What the operators of this subpackage share: the shared folder, written tables, token rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset on one machine (tests), a new one that is set there. A cluster without it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Written tables in the shared folder. A lost executor loses none of them; ``drop`` removes what is no longer read, ``close`` all of an operator's, and
    ``close_all`` those of all operators, once their results are read."""

    open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.names: list[str] = []  # of tables in the catalogue
        Scratch.open.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again: its lineage is cut here."""
        self.count += 1
        path, conf = f"{self.base}/{self.count}", self.spark.conf
        before = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")  # what was shuffled for the table is of no use once it is written
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def write_dealt(self, df: DataFrame, by: str, *apart: str) -> DataFrame:
        """As ``write``, dealt by a column over as many buckets as shuffles have tasks, so that grouping by it shuffles nothing; ``apart``: columns whose values have files of their own."""
        self.count += 1
        path, name = f"{self.base}/{self.count}", f"tessera_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.bucketBy(parts(self.spark), by).partitionBy(*apart).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        if hasattr(df, "_scratch_table"):
            self.spark.sql(f"drop table if exists {df._scratch_table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # type: ignore[attr-defined]
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in Scratch.open:
            Scratch.open.remove(self)

    @classmethod
    def close_all(cls) -> None:
        for scratch in list(cls.open):
            scratch.close()


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(spark: SparkSession) -> int:
    """Tasks for a repartition by hand: as many as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attached(rows: DataFrame, counts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``counts`` (key, n: its number of rows, and more) by ``key``, without a task for the rows of a very common key.

    Keys with over 1 / (4 x tasks) of all ``total`` rows, of which there are fewer than 4 x tasks, are broadcast; the others are shuffled."""
    most = 4 * parts(rows.sparkSession)
    hot, cold = counts.where(F.col("n") * most > total), counts.where(F.col("n") * most <= total)
    there = rows.join(F.broadcast(hot), key)
    return there.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
