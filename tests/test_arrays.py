"""Array files in ranges, and bundles."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays


def items(df):
    return {(r.name, r.ordinal): (r.shape, r["items"]) for r in df.collect()}


def test_npy_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(103, 4, 3)).astype(">f4"), np.arange(7, dtype=np.uint16)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", y)
    df = arrays.read_npy(spark, [str(tmp_path / "x.npy"), f"file://{tmp_path}/y.npy"], bytes_per_task=500)
    assert df.rdd.getNumPartitions() == 12
    rows = df.collect()
    by = {(r.path[-5:], r.ordinal): r for r in rows}
    assert len(rows) == 110 and all(by["x.npy", i].shape == [4, 3] and by["x.npy", i]["items"] == x[i].astype(float).ravel().tolist() for i in range(103))
    assert [by["y.npy", i]["items"] for i in range(7)] == [[float(i)] for i in range(7)]
    np.save(tmp_path / "f.npy", np.asfortranarray(rng.normal(size=(3, 4))))
    np.save(tmp_path / "s.npy", np.array(["a"]))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "x.npy").read_bytes()[:-1])
    for bad in ("f.npy", "s.npy", "cut.npy"):
        with pytest.raises(ValueError):
            arrays.read_npy(spark, [str(tmp_path / bad)])


def matrix(name, x, order, packed):
    def element(kind, data):
        if len(data) <= 4:
            return np.array([len(data) << 16 | kind], f"{order}u4").tobytes() + data.ljust(4, b"\0")
        return np.array([kind, len(data)], f"{order}u4").tobytes() + data + b"\0" * (-len(data) % 8)

    kind = {"f8": 9, "u1": 2, "i4": 5}[x.dtype.str[1:]]
    cls = {9: 6, 2: 9, 5: 12}[kind]
    body = element(6, np.array([cls, 0], f"{order}u4").tobytes()) + element(5, np.array(x.shape, f"{order}i4").tobytes()) + element(1, name.encode()) + element(kind, x.astype(x.dtype.newbyteorder(order)).tobytes(order="F"))
    whole = np.array([14, len(body)], f"{order}u4").tobytes() + body
    if packed:
        whole = zlib.compress(whole)
        whole = np.array([15, len(whole)], f"{order}u4").tobytes() + whole
    return whole


@pytest.mark.parametrize("order", ["<", ">"])
def test_mat_in_ranges(spark, tmp_path, order, monkeypatch):
    monkeypatch.setattr(arrays, "BYTES", 600)
    monkeypatch.setattr(arrays, "PIECE", 256)
    rng = np.random.default_rng(2)
    x, y, z = rng.integers(0, 255, size=(4, 5, 3, 41)).astype("u1"), rng.normal(size=(6, 90)), rng.integers(-9, 9, size=(2, 1)).astype("i4")
    cell = np.array([14, 8], f"{order}u4").tobytes() + np.array([6, 8], f"{order}u4").tobytes()[:8]
    head = b"MATLAB 5.0".ljust(124, b" ") + np.array([0x0100], f"{order}u2").tobytes() + (b"IM" if order == "<" else b"MI")
    (tmp_path / "a.mat").write_bytes(head + matrix("X", x, order, False) + matrix("packed_y", y, order, True) + matrix("z", z, order, False))
    df = arrays.read_mat(spark, str(tmp_path / "a.mat"), bytes_per_task=300)
    got = items(df)
    assert df.rdd.getNumPartitions() == 9 + 1 + 1 and len(got) == 41 + 90 + 1 and len(cell) == 16
    assert all(got["X", i] == ([4, 5, 3], x[..., i].astype(float).ravel().tolist()) for i in range(41))
    assert all(got["packed_y", i] == ([6], y[:, i].tolist()) for i in range(90))
    assert got["z", 0] == ([2], z[:, 0].astype(float).tolist())
    (tmp_path / "b.mat").write_bytes(b"x" * 200)
    with pytest.raises(ValueError):
        arrays.read_mat(spark, str(tmp_path / "b.mat"))


def test_bundles(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("é"), "id").alias("id"), F.array(F.col("id") * 0.5, F.lit(-1.0)).alias("vector")).repartition(4)
    path = str(tmp_path / "b")
    arrays.write_bundle(rows, path)
    got = sorted(arrays.read_bundle(spark, path).collect())
    assert [(r.ord, r.id, r.vector) for r in got] == [(i, f"é{i}", [i * 0.5, -1.0]) for i in range(300)]
    with pytest.raises(ValueError, match="exists"):
        arrays.write_bundle(rows, path)
    manifest = json.loads((tmp_path / "b" / "manifest.json").read_text())
    name = manifest["parts"][0]["vectors"]
    data = bytearray((tmp_path / "b" / name).read_bytes())
    data[-1] ^= 1
    (tmp_path / "b" / name).write_bytes(data)
    with pytest.raises(Exception, match="differs from its pin"):
        arrays.read_bundle(spark, path).collect()
    with pytest.raises(ValueError, match="twice"):
        arrays.write_bundle(rows.union(rows.limit(1)), str(tmp_path / "c"))
    for i, bad in enumerate((F.array(F.lit(float("nan")), F.lit(0.0)), F.lit(None).cast("array<double>"), F.array(F.lit(0.0)))):
        with pytest.raises(Exception, match="finite|missing|lengths"):
            arrays.write_bundle(rows.withColumn("vector", F.when(F.col("ord") == 7, bad).otherwise(F.col("vector"))), str(tmp_path / f"d{i}"))
