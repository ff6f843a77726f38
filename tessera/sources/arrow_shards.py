"""Arrow IPC shards as one table: a task for each range of record batches, columns by the union of the shards' schemas, and pins that executors check.

A first job has a task for each shard, which hashes the file, compares the pin, and reads the schema and the rows of each batch; only these come to the driver. The scan's partitions
are then ranges of batches of about ``ROWS`` rows, which start at a known ordinal. A file of the stream format has no index: one task passes its batches on, one after the other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

ROWS, PIECE = 100_000, 4 << 20
ORIGIN = T.StructType([T.StructField(n, k) for n, k in (("shard", T.IntegerType()), ("file", T.StringType()), ("row", T.LongType()), ("sha256", T.StringType()), ("split", T.StringType()), ("group", T.StringType()))])


@dataclass(frozen=True)
class Shard:
    """A file of the release, in its place: ``sha256`` is the pin, ``split`` and ``group`` go on to its rows."""

    path: str
    sha256: str
    split: str | None = None
    group: str | None = None


def _opened(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(name)


def _reader(file: pa.NativeFile) -> tuple[pa.Schema, int | None, Any]:
    """(schema, number of batches or None for a stream, reader)."""
    try:
        reader = pa.ipc.open_file(file)
        return reader.schema, reader.num_record_batches, reader
    except pa.ArrowInvalid:
        file.seek(0)
        reader = pa.ipc.open_stream(file)
        return reader.schema, None, reader


def _inspected(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for r in pdf.itertuples():
            digest = hashlib.sha256()
            with _opened(r.path) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
                if digest.hexdigest() != r.sha256:
                    raise ValueError(f"the shard {r.path} differs from its pin")
                file.seek(0)
                schema, batches, reader = _reader(file)
                rows = [reader.get_batch(i).num_rows for i in range(batches)] if batches is not None else [b.num_rows for b in reader]
            yield pd.DataFrame({"shard": [r.shard], "rows": [rows], "indexed": [batches is not None], "fields": [schema.serialize().to_pybytes()]})


@dataclass
class Range(InputPartition):
    shard: int
    path: str
    first: int
    last: int
    row: int
    ordinal: int
    indexed: bool


class ArrowShards(DataSource):
    """Options: ``plan`` (the ranges and the shards, as JSON) and ``fields`` (the Arrow schema, hexadecimal)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self) -> T.StructType:
        fields = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(self.options["fields"]))))
        return T.StructType(fields.fields).add("origin", ORIGIN).add("ordinal", T.LongType())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(self.options)


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        plan = json.loads(options["plan"])
        self.shards, self.ranges, self.fields = plan["shards"], plan["ranges"], options["fields"]

    def partitions(self) -> list[InputPartition]:
        return [Range(**r) for r in self.ranges]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        target = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(self.fields)))
        shard, row, ordinal = self.shards[partition.shard], partition.row, partition.ordinal
        with _opened(partition.path) as file:
            _, _, reader = _reader(file)
            batches = (reader.get_batch(i) for i in range(partition.first, partition.last)) if partition.indexed else reader
            for b in batches:
                n = b.num_rows
                columns = [b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(n, f.type) for f in target]
                same = lambda x, kind: pa.array([x] * n, kind)  # noqa: E731, B023
                parts = [same(partition.shard, pa.int32()), same(shard["path"], pa.string()), pa.array(range(row, row + n), pa.int64()), same(shard["sha256"], pa.string()), same(shard["split"], pa.string()), same(shard["group"], pa.string())]
                origin = pa.StructArray.from_arrays(parts, names=["shard", "file", "row", "sha256", "split", "group"])
                yield pa.RecordBatch.from_arrays([*columns, origin, pa.array(range(ordinal, ordinal + n), pa.int64())], names=[*target.names, "origin", "ordinal"])
                row, ordinal = row + n, ordinal + n


def read_arrow_shards(spark: SparkSession, shards: list[Shard], *, rows_per_task: int = ROWS) -> DataFrame:
    """The rows of all shards in order, with ``origin`` and the global ``ordinal``. A shard that differs from its pin is refused, as are columns of types that have no common one."""
    if not shards or any(len(s.sha256) != 64 for s in shards):
        raise ValueError("shards need paths and SHA-256 pins")
    table = spark.createDataFrame([(i, s.path, s.sha256) for i, s in enumerate(shards)], "shard int, path string, sha256 string")
    found = table.repartition(len(shards), "shard").mapInPandas(_inspected, "shard int, rows array<long>, indexed boolean, fields binary")
    found = sorted(found.collect())  # a number for each batch
    try:
        fields = pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(bytes(r["fields"]))).remove_metadata() for r in found], promote_options="permissive")
    except (pa.ArrowTypeError, pa.ArrowInvalid) as e:
        raise ValueError(f"the shards' columns have no common type: {e}") from e
    if clash := {"origin", "ordinal"} & set(fields.names):
        raise ValueError(f"the shards have columns of their own named {sorted(clash)}")
    ranges, ordinal = [], 0
    for r in found:
        row = first = start = 0
        for i, n in enumerate(r["rows"]):
            row += n
            if i + 1 == len(r["rows"]) or r["indexed"] and row - start >= rows_per_task:
                ranges.append({"shard": r["shard"], "path": shards[r["shard"]].path, "first": first, "last": i + 1, "row": start, "ordinal": ordinal + start, "indexed": r["indexed"]})
                first, start = i + 1, row
        ordinal += row
    spark.dataSource.register(ArrowShards)
    plan = json.dumps({"shards": [vars(s) for s in shards], "ranges": ranges})
    return spark.read.format("arrow_shards").option("plan", plan).option("fields", fields.serialize().to_pybytes().hex()).load()


def _pinned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for r in pdf.itertuples():
            digest = hashlib.sha256()
            with _opened(r.path) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            if digest.hexdigest() != r.sha256:
                raise ValueError(f"the shard {r.path} differs from its pin")
            yield pd.DataFrame({"shard": [r.shard]})


def read_parquet_shards(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """As ``read_arrow_shards``, of Parquet files, which tasks split and prune as usual: a row's ordinal is its index in its file and the rows of the files before. Pins are checked by a task for each file, before any row is read."""
    if not shards or any(len(s.sha256) != 64 for s in shards):
        raise ValueError("shards need paths and SHA-256 pins")
    table = spark.createDataFrame([(i, s.path, s.sha256) for i, s in enumerate(shards)], "shard int, path string, sha256 string")
    table.repartition(len(shards), "shard").mapInPandas(_pinned, "shard int").count()
    rows = spark.read.option("mergeSchema", True).parquet(*[s.path for s in shards])
    if clash := {"origin", "ordinal"} & set(rows.columns):
        raise ValueError(f"the shards have columns of their own named {sorted(clash)}")
    plain = lambda p: "/" + p.split(":", 1)[1].lstrip("/") if p.startswith("file:") else p
    qualified = {}
    for i, s in enumerate(shards):
        where = spark._jvm.org.apache.hadoop.fs.Path(s.path)
        qualified[plain(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())] = i
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    counts = {r["file"]: r["count"] for r in rows.groupBy(file.alias("file")).count().collect()}  # a row for each file, from the footers
    places, first = [], 0
    for path, i in qualified.items():
        places.append((path, i, shards[i].path, shards[i].sha256, shards[i].split, shards[i].group, first))
        first += counts.get(path, 0)
    names = spark.createDataFrame(places, "_file string, shard int, file string, sha256 string, split string, group string, first long")  # a row for each file
    out = rows.select("*", file.alias("_at"), F.col("_metadata.row_index").alias("row")).join(F.broadcast(names), F.col("_at") == F.col("_file"))
    return out.select(*[f"`{c}`" for c in rows.columns], F.struct("shard", "file", "row", "sha256", "split", "group").alias("origin"), (F.col("first") + F.col("row")).alias("ordinal"))


def write_arrow_shards(rows: DataFrame, path: str, *, split: str | None = None) -> list[Shard]:
    """``rows`` as Arrow IPC files of the partitions, in their order, with their pins. ``path`` is a folder that driver and executors share; a task that runs again writes a file of its own."""
    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    where.create_dir(base, recursive=True)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        assert context is not None
        name = f"{path}/part-{context.partitionId():05}-{context.taskAttemptId()}.arrow"
        to, local = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))
        writer = None
        with to.open_output_stream(local) as file:
            for b in it:
                writer = writer or pa.ipc.new_file(file, b.schema)
                writer.write_batch(b)
            if writer:
                writer.close()
        if writer:
            digest = hashlib.sha256()
            with to.open_input_stream(local) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [name], "sha256": [digest.hexdigest()]})

    written = rows.mapInArrow(write, "part int, path string, sha256 string").collect()  # a row for each partition
    return [Shard(r["path"], r["sha256"], split) for r in sorted(written)]
