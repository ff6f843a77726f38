"""Fixed-layout binary files (image benchmarks) to rows: each file is decoded by the task that reads it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fixed(spark: SparkSession, path: str, record: int, label_bytes: int = 1, header: int = 0) -> DataFrame:
    """path, ordinal, label (the last of the label bytes), pixels of files of records of ``record`` bytes: label, then pixels."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                body = memoryview(data)[header:]
                if len(body) % record:
                    raise ValueError(f"{name}: not a whole number of records")
                for start in range(0, len(body), record * 1000):
                    rows = [bytes(body[i : i + record]) for i in range(start, min(start + record * 1000, len(body)), record)]
                    first = start // record
                    yield pd.DataFrame({"path": name, "ordinal": range(first, first + len(rows)), "label": [r[label_bytes - 1] if label_bytes else -1 for r in rows], "pixels": [r[label_bytes:] for r in rows]})

    return files.mapInPandas(decode, "path string, ordinal long, label int, pixels binary")


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, pixels of IDX files of bytes: two zeros, type 8, the number of dimensions, their sizes, then the data."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                if data[:3] != b"\0\0\x08":
                    raise ValueError(f"{name}: not an IDX file of bytes")
                sizes = [int.from_bytes(data[4 + 4 * i : 8 + 4 * i], "big") for i in range(data[3])]
                each, at = 1, 4 + 4 * len(sizes)
                for s in sizes[1:]:
                    each *= s
                if len(data) != at + each * sizes[0]:
                    raise ValueError(f"{name}: its size isn't that of its header")
                for start in range(0, sizes[0], 1000):
                    n = min(1000, sizes[0] - start)
                    yield pd.DataFrame({"path": name, "ordinal": range(start, start + n), "pixels": [bytes(data[at + i * each : at + (i + 1) * each]) for i in range(start, start + n)]})

    return files.mapInPandas(decode, "path string, ordinal long, pixels binary")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).select("*", F.col("_metadata.file_name").alias("origin_file"))
