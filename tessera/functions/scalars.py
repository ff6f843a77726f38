"""Scalar expressions: FNV-1a ranks, tagged categories, canonical strata, vectors and geometry."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a with 32 bits.
FNV_BASIS, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 0xFFFFFFFF
MAX_EXACT = 2**53


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 0 to 2^32 - 1; null for null."""
    raw = F.hex(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    steps = F.sequence(F.lit(0), F.octet_length(text) - 1)
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(FNV_MASK))
    return F.when(F.octet_length(text) > 0, F.aggregate(steps, F.lit(FNV_BASIS).cast("long"), step)).when(text.isNotNull(), F.lit(FNV_BASIS).cast("long"))


def seeded_rank(id_column: Column, seed: int) -> Column:
    return fnv1a(F.concat(F.lit(f"{seed}:"), id_column))


def tag_string(c: Column) -> Column:
    return F.concat(F.lit("s:"), c)


def tag_number(c: Column) -> Column:
    return F.concat(F.lit("n:"), c.cast("double").cast("string"))


def tag_boolean(c: Column) -> Column:
    return F.when(c, F.lit("b:1")).when(~c, F.lit("b:0"))


def tag(value: Any) -> str:
    """The tagged form of a literal, as the expressions above make it."""
    if isinstance(value, bool):
        return f"b:{int(value)}"
    if isinstance(value, str):
        return f"s:{value}"
    return f"n:{number(value)!r}"


def json_field(source_json: Column, path: list[str], prediction_json: Column | None = None) -> Column:
    """A field of a record as a variant. A prediction that is there overrides the source's value, even if it is an explicit null; one that is absent doesn't.

    An explicit JSON null is a variant that isn't SQL NULL (``F.is_variant_null``), and so differs from an absent field."""
    at = "$" + "".join(f"[{json.dumps(p, ensure_ascii=False)}]" for p in path)
    get = lambda c: F.try_variant_get(F.try_parse_json(c), at, "variant")
    return get(source_json) if prediction_json is None else F.coalesce(get(prediction_json), get(source_json))


def json_stratum(field: Column) -> Column:
    """A variant as a stratum: JSON text; an explicit null is ``null``, an absent field is missing."""
    return F.when(F.is_variant_null(field), F.lit("null")).otherwise(F.to_json(field))


def number(value: Any) -> float:
    """A finite number that a double holds exactly enough; booleans aren't numbers."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{value!r} is not a number")
    if isinstance(value, int) and abs(value) > MAX_EXACT:
        raise ValueError(f"{value} is too large for a number; use a string")
    if not math.isfinite(value):
        raise ValueError(f"{value} is not finite")
    return float(value)


def payload(c: Column) -> Column:
    """A tagged category without its tag."""
    return F.substring(c, 3, 1 << 30)


def stratum(c: Column, dtype: str) -> Column:
    """The stratum of a value: its canonical JSON; null for a missing one reads ``null``."""
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    if dtype == "category":
        own = F.when(c.startswith("s:"), quoted(payload(c))).when(c == "b:1", "true").when(c == "b:0", "false").otherwise(payload(c))
    elif dtype in ("number", "boolean"):
        own = c.cast("string")
    else:
        own = quoted(c)
    return F.coalesce(own, F.lit("null"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, 0 at least; 1 where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0) - dot(a, b) / n, F.lit(0.0)))


def euclidean_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y)
    return norm(d)


def finite(v: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """x, y, width and height to corners within the image; null without area."""
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    left, top, right, bottom = clamp(x, width), clamp(y, height), clamp(x + w, width), clamp(y + h, height)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")))


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd test, behind one of the bounding box."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
            odd = odd != (crosses & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1)))
    return F.coalesce(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & odd, F.lit(False))


def nearest_point(points: DataFrame, x: float, y: float, radius: float, id_column: str = "id") -> DataFrame:
    """The point (id, x, y) nearest to a place, within the radius; equal distances go to the smaller id. Each task keeps one."""
    gap = F.hypot(F.col("x") - x, F.col("y") - y)
    near = points.where(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)).withColumn("distance", gap)
    return near.where(F.col("distance") <= radius).orderBy("distance", id_column).limit(1)


def json_literal(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)
