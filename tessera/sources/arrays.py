"""Array files in ranges of items, so that one large file is many tasks: NumPy's .npy and MATLAB's version 5; and bundles of ids and vectors, as array files with pins.

Only headers are read on the driver. An item is a step along the axis that the file keeps apart: the first one of a .npy in C order, the last one of a MATLAB array, which is kept by columns. A compressed MATLAB variable
can't be entered in the middle: one task inflates it, and hands its items on as they come.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.snapshot import write_text

BYTES, PIECE = 8 << 20, 4 << 20
ITEMS = "path string, name string, ordinal long, shape array<int>, items array<double>"


def opened(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(name)


@dataclass(frozen=True)
class Variable:
    """Where an array's numbers are: ``items`` items of ``shape`` from the byte ``at`` on; ``packed``: inflated bytes from there on, of which ``skip`` come before the numbers."""

    path: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    items: int
    at: int
    order: str = "C"
    packed: int = 0
    skip: int = 0

    @property
    def each(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) * np.dtype(self.dtype).itemsize


def npy_variable(path: str) -> Variable:
    """The array of a .npy file, from its header."""
    with opened(path) as file:
        magic = np.lib.format.read_magic(file)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if magic == (1, 0) else np.lib.format.read_array_header_2_0)(file)
        at, size = file.tell(), file.size()
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"{path}: an array of {dtype}, not of numbers")
    if fortran and len(shape) > 1:
        raise ValueError(f"{path}: rows aren't together in an array that is kept by columns")
    items = shape[0] if shape else 1
    if size != at + int(np.prod(shape, dtype=np.int64)) * dtype.itemsize:
        raise ValueError(f"{path}: its size isn't that of its header")
    return Variable(path, "", dtype.str, tuple(shape[1:]), items, at)


# Fixed values of the format: data types by number, array classes that hold numbers.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
COMPRESSED, MATRIX, NUMERIC = 15, 14, range(6, 16)


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, bytes, where they begin, where the next element is)."""
    kind, size = (int(x) for x in np.frombuffer(data[at : at + 8], f"{order}u4"))
    if kind >> 16:  # up to four bytes within the tag
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + -(-size // 8) * 8


def _head(data: bytes, order: str) -> tuple[str, tuple[int, ...], str, int, int] | None:
    """(name, dimensions, dtype, where the numbers begin, their bytes) of a matrix's first bytes; None if it isn't one of real numbers."""
    _, _, at, after = _tag(data, 0, order)
    flags = int(np.frombuffer(data[at : at + 4], f"{order}u4")[0])
    if flags & 0xFF not in NUMERIC or flags >> 11 & 1:
        return None
    _, size, at, after = _tag(data, after, order)
    dims = tuple(int(x) for x in np.frombuffer(data[at : at + size], f"{order}i4"))
    _, size, at, after = _tag(data, after, order)
    name = data[at : at + size].decode("ascii")
    kind, size, at, _ = _tag(data, after, order)
    return name, dims, f"{order}{KINDS[kind]}", at, size


def mat_variables(path: str) -> list[Variable]:
    """The arrays of real numbers of a MATLAB 5 file."""
    out = []
    with opened(path) as file:
        header = file.read(128)
        if header[126:128] not in (b"IM", b"MI"):
            raise ValueError(f"{path}: not a MATLAB 5 file")
        order, at, end = "<" if header[126:128] == b"IM" else ">", 128, file.size()
        while at + 8 <= end:
            file.seek(at)
            kind, size = (int(x) for x in np.frombuffer(file.read(8), f"{order}u4"))
            first = file.read(min(size, PIECE if kind == COMPRESSED else 4096))
            packed = 0
            if kind == COMPRESSED:
                first, packed = zlib.decompressobj().decompress(first, 4096), size
                kind, first, inside = int(np.frombuffer(first[:4], f"{order}u4")[0]), first[8:], 8
            if kind == MATRIX and (found := _head(first, order)):
                name, dims, dtype, start, held = found
                if held != int(np.prod(dims, dtype=np.int64)) * np.dtype(dtype).itemsize:
                    raise ValueError(f"{path}: {name} hasn't as many numbers as its dimensions say")
                out.append(Variable(path, name, dtype, dims[:-1], dims[-1], at + 8 if packed else at + 8 + start, "F", packed, inside + start if packed else 0))
            at += 8 + (size if packed else -(-size // 8) * 8)
    return out


def _inflated(v: Variable) -> Iterator[bytes]:
    """The numbers of a compressed variable, in pieces of whole items."""
    inflate, held, skip, left = zlib.decompressobj(), b"", v.skip, v.each * v.items
    step = max(v.each, BYTES // max(v.each, 1) * v.each)
    with opened(v.path) as file:
        file.seek(v.at)
        rest = v.packed
        while left and (piece := file.read(min(PIECE, rest))):
            rest -= len(piece)
            while piece and left:
                more = inflate.decompress(piece, BYTES)
                piece = inflate.unconsumed_tail
                more, skip = more[skip:], max(skip - len(more), 0)
                held += more[: left - len(held)]
                while len(held) >= min(step, left) and left:
                    take = min(step, left)
                    yield held[:take]
                    held, left = held[take:], left - take


def read_arrays(spark: SparkSession, variables: list[Variable], *, bytes_per_task: int = BYTES) -> DataFrame:
    """path, name, ordinal, shape, items: each item of the arrays as its numbers, in the order of the axes. A task reads a range of items of about ``bytes_per_task``."""
    ranges = []
    for i, v in enumerate(variables):
        step = v.items if v.packed else max(bytes_per_task // max(v.each, 1), 1)
        ranges += [(i, first, min(first + step, v.items)) for first in range(0, v.items, max(step, 1))]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                v, first = variables[r.v], r.first
                if v.packed:
                    pieces: Iterator[bytes] = _inflated(v)
                else:
                    with opened(v.path) as file:
                        file.seek(v.at + v.each * first)
                        pieces = iter([file.read(v.each * (r.last - first))])
                for piece in pieces:
                    n = len(piece) // v.each if v.each else r.last - first
                    data = np.frombuffer(piece, v.dtype).reshape((n, *v.shape[:: -1 if v.order == "F" else 1]))
                    if v.order == "F" and len(v.shape) > 1:
                        data = data.transpose(0, *range(len(v.shape), 0, -1))
                    yield pd.DataFrame({"path": v.path, "name": v.name, "ordinal": range(first, first + n), "shape": [list(v.shape)] * n, "items": list(data.reshape(n, -1).astype(np.float64))})
                    first += n

    tasks = spark.createDataFrame(ranges, "v int, first long, last long")  # a row for each task
    return tasks.repartition(max(len(ranges), 1)).mapInPandas(read, ITEMS)


def read_npy(spark: SparkSession, paths: list[str], **options: int) -> DataFrame:
    return read_arrays(spark, [npy_variable(p) for p in paths], **options)


def read_mat(spark: SparkSession, path: str, **options: int) -> DataFrame:
    return read_arrays(spark, mat_variables(path), **options)


def write_bundle(rows: DataFrame, path: str, *, dtype: str = "<f4") -> None:
    """Rows (ord, id, vector) as a bundle: for each partition a .npy file of vectors and a list of ids, and a manifest with counts and pins. ``path`` is a folder that driver and executors share.

    Vectors that are missing, of different lengths or not finite are refused, as are ids that occur twice."""
    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if where.get_file_info(base).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    if twice := rows.groupBy("id").count().where("count > 1").head(1):
        raise ValueError(f"the id {twice[0][0]} is there twice")
    where.create_dir(base, recursive=True)

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        assert context is not None
        parts = [p for p in it if len(p)]
        if not parts:
            return
        name = f"part-{context.partitionId():05}-{context.taskAttemptId()}"
        size = len(parts[0]["vector"].iloc[0])
        ids, place = [], [int(parts[0]["ord"].iloc[0])]
        files: dict[str, tuple[str, int]] = {}

        def put(file_name: str, data: bytes) -> None:
            to, local = fs.FileSystem.from_uri(f"{path}/{file_name}") if "://" in path else (fs.LocalFileSystem(), f"{base}/{file_name}")
            with to.open_output_stream(local) as file:
                file.write(data)
            files[file_name] = (hashlib.sha256(data).hexdigest(), len(data))

        held = []
        for p in parts:
            if any(v is None or len(v) != size for v in p["vector"]):
                raise ValueError("a vector is missing, or of another length")
            x = np.stack(p["vector"].to_numpy()).astype(dtype)
            if not np.isfinite(x).all():
                raise ValueError("a vector isn't finite")
            held.append(x)
            ids += [str(i) for i in p["id"]]
        out = io.BytesIO()
        np.save(out, np.concatenate(held))
        put(f"{name}.npy", out.getvalue())
        put(f"{name}.json", json.dumps(ids).encode())
        yield pd.DataFrame({"first": place, "rows": [len(ids)], "dim": [size], "vectors": [f"{name}.npy"], "ids": [f"{name}.json"], "pins": [json.dumps({k: v[0] for k, v in files.items()})]})

    ordered = rows.select("ord", "id", "vector").repartitionByRange("ord").sortWithinPartitions("ord")
    done = sorted(ordered.mapInPandas(write, "first long, rows long, dim int, vectors string, ids string, pins string").collect())  # a row for each partition
    if len({r["dim"] for r in done}) > 1:
        raise ValueError("vectors of different lengths")
    write_text(rows.sparkSession, f"{path}/manifest.json", json.dumps({"kind": "bundle", "rows": sum(r["rows"] for r in done), "dim": done[0]["dim"] if done else 0, "parts": [{"rows": r["rows"], "vectors": r["vectors"], "ids": r["ids"], "pins": json.loads(r["pins"])} for r in done]}))


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, vector of a bundle. A file that isn't what the manifest pins, or has another number of rows, is refused by the task that reads it."""
    m = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    if m.get("kind") != "bundle":
        raise ValueError(f"{path} isn't a bundle")
    parts, first = [], 0
    for p in m["parts"]:
        parts.append((first, p["rows"], p["vectors"], p["ids"], p["pins"][p["vectors"]], p["pins"][p["ids"]]))
        first += p["rows"]
    dim = m["dim"]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                found = []
                for name, pin in ((r.vectors, r.vectors_pin), (r.ids, r.ids_pin)):
                    with opened(f"{path}/{name}") as file:
                        data = file.read()
                    if hashlib.sha256(data).hexdigest() != pin:
                        raise ValueError(f"{name} differs from its pin")
                    found.append(data)
                x, ids = np.load(io.BytesIO(found[0]), allow_pickle=False), json.loads(found[1])
                if x.shape != (r.rows, dim) or len(ids) != r.rows:
                    raise ValueError(f"{r.vectors} hasn't as many rows as the manifest says")
                yield pd.DataFrame({"ord": range(r.first, r.first + r.rows), "id": ids, "vector": list(x.astype(np.float64))})

    table = spark.createDataFrame(parts, "first long, rows long, vectors string, ids string, vectors_pin string, ids_pin string")
    return table.repartition(max(len(parts), 1)).mapInPandas(read, "ord long, id string, vector array<double>")
