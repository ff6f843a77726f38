"""Native subsets of a population: by the modality of assets, by groups of classes; and how large strata are."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of a subset, and the largest class number, at most.
MAX_GROUPS, MAX_CLASS = 32, 10_000
MODALITIES = ("image", "audio", "video")


@dataclass(frozen=True)
class ClassGroup:
    """A named range of classes, both ends included."""

    name: str
    start: int
    end: int


def with_modality(records: DataFrame, modality: str, assets: str = "assets") -> DataFrame:
    """The records that have an asset of this modality; those with a null or empty list have none."""
    if modality not in MODALITIES:
        raise ValueError(f"unknown modality {modality}")
    return records.where(F.exists(assets, lambda a: a["modality"].eqNullSafe(F.lit(modality))))


def _checked(groups: list[ClassGroup]) -> list[ClassGroup]:
    if not 1 <= len(groups) <= MAX_GROUPS:
        raise ValueError(f"1 to {MAX_GROUPS} groups")
    for g in groups:
        if not 1 <= len(g.name) <= 256 or not all(isinstance(x, int) and not isinstance(x, bool) for x in (g.start, g.end)) or not 0 <= g.start <= g.end <= MAX_CLASS:
            raise ValueError(f"invalid group {g}")
    by_start = sorted(groups, key=lambda g: g.start)
    for a, b in zip(by_start, by_start[1:], strict=False):
        if b.start <= a.end:
            raise ValueError(f"{a.name} and {b.name} overlap")
    return groups


def with_class_groups(rows: DataFrame, field: str, groups: list[ClassGroup], *, provenance: str = "", name: str = "class_group") -> DataFrame:
    """The rows whose class is in a group, with the group as a struct: id (place among ``groups``), name, native_label, start, end, source_field, provenance.

    The column must be of whole numbers; a null class is in no group. An existing column isn't overwritten."""
    if name in rows.columns:
        raise ValueError(f"{name} exists already")
    if dict(rows.dtypes)[field] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{field} isn't a column of whole numbers")
    value = F.col(field)
    each = [F.when(value.between(g.start, g.end), F.struct(F.lit(i).alias("id"), F.lit(g.name).alias("name"), value.cast("long").alias("native_label"), F.lit(g.start).alias("start"), F.lit(g.end).alias("end"), F.lit(field).alias("source_field"), F.lit(provenance).alias("provenance"))) for i, g in enumerate(_checked(groups))]
    return rows.withColumn(name, F.coalesce(*each)).where(F.col(name).isNotNull())


def population(rows: DataFrame, selected: Column, expected_source: int, expected_selected: int) -> int:
    """The size of a subset, refused unless the source and the subset have the declared sizes; one pass counts both."""
    if not 1 <= expected_selected <= expected_source:
        raise ValueError("a subset has a declared size from 1 to that of its source")
    got = rows.agg(F.count(F.lit(1)).alias("source"), F.count_if(F.coalesce(selected, F.lit(False))).alias("selected")).first()
    if (got["source"], got["selected"]) != (expected_source, expected_selected):
        raise ValueError(f"the source has {got['source']} rows and the subset {got['selected']}; {expected_source} and {expected_selected} were declared")
    return got["selected"]


def strata(rows: DataFrame, stratum: str, declared: list[str]) -> DataFrame:
    """stratum, population of each declared stratum, with 0 for those without rows, and of all others together (null)."""
    known = F.when(F.col(stratum).isin(declared), F.col(stratum))
    counts = rows.groupBy(known.alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(x) for x in [*declared, None]])).alias("stratum")
    return rows.sparkSession.range(1).select(names).join(F.broadcast(counts), F.col("stratum").eqNullSafe(F.col("_s")), "left").select("stratum", F.coalesce("n", F.lit(0)).alias("population"))


def in_any_group(field: str, groups: list[ClassGroup]) -> Column:
    """Whether a row's class is in a group, as a condition for ``population``."""
    return reduce(lambda a, b: a | b, [F.col(field).between(g.start, g.end) for g in _checked(groups)])
