"""The Spark session that the library expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessera", **settings: str) -> SparkSession:
    """A session with the library's settings; ``settings`` go on top, with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> None:
    """Sees to it that checkpoints have a folder: the one that ``spark.checkpoint.dir`` names, or, on one machine only, a new one."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


class Tables:
    """Tables that an operator writes on its way, in the folder that ``spark.checkpoint.dir`` names; a lost executor loses none of them.

    ``drop`` removes one that is no longer read, ``close`` all of them; ``close_all`` those of all operators, once their results are read. On one machine without the setting they go to a folder that ends with the session."""

    open: ClassVar[list[Tables]] = []

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base, self.count = spark, f"{base}/{name}-{uuid.uuid4().hex[:12]}", 0
        Tables.open.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as written and read again: its lineage ends here."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path  # type: ignore[attr-defined]
        return out

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *written: DataFrame) -> None:
        for df in written:
            self._remove(df._written_at)  # type: ignore[attr-defined]

    def close(self) -> None:
        self._remove(self.base)
        if self in Tables.open:
            Tables.open.remove(self)

    @classmethod
    def close_all(cls) -> None:
        for tables in list(cls.open):
            tables.close()
