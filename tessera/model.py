"""Fields, snapshots, queries and content-addressed ids."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "ne", "in", "contains", "gt", "gte", "lt", "lte", "is_null")
DTYPES = ("string", "category", "number", "boolean", "array", "object")
NAMESPACES = ("source", "prediction", "human")


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks; non-finite numbers are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_id(value: Any, prefix: str = "") -> str:
    return prefix + hashlib.sha256(canonical(value).encode()).hexdigest()[:24]


def record_id(dataset: Column, release: Column, unit: str, source_id: Column) -> Column:
    """``dataset:unit:`` and 24 hex digits of a hash of the four parts."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\\/", "/")
    parts = F.concat(F.lit("["), F.concat_ws(",", *[F.substring(q, F.lit(2), F.length(q) - 2) for q in map(quoted, (dataset, release, F.lit(unit), source_id))]), F.lit("]"))
    return F.concat(dataset, F.lit(f":{unit}:"), F.substring(F.sha2(parts, 256), 1, 24))


@dataclass(frozen=True)
class Field:
    """A registered field. ``column`` is where the snapshot holds it; categories hold tagged scalars (see ``functions.scalars``)."""

    id: str
    dtype: str
    column: str
    ops: tuple[str, ...] = OPS
    kinds: frozenset[str] = frozenset()  #: kinds of scalars in a category: s, n, b

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValueError(f"unknown dtype {self.dtype}")
        head = self.id.partition(".")[0]
        if self.column != self.id and "." in self.id and head not in NAMESPACES:
            raise ValueError(f"field {self.id} is in no known namespace")


#: Fields that each snapshot has besides its registered ones.
BASE = {n: Field(n, "string", n) for n in ("id", "dataset_id", "release_id", "snapshot_id", "unit", "text", "question")}


@dataclass(frozen=True)
class Snapshot:
    """An immutable table of records: ``id``, ``row_ordinal``, ``search_text`` and the columns of its fields."""

    records: DataFrame
    fields: dict[str, Field]
    snapshot_id: str
    unit: str = "example"
    population_scope: str = "complete"
    count: int | None = None
    max_record_bytes: int = 0  #: of the records as JSON; 0 if nobody measured it

    @property
    def columns(self) -> dict[str, Field]:
        have = set(self.records.columns)
        return {**{k: f for k, f in BASE.items() if k in have}, **self.fields}

    def with_fields(self, records: DataFrame, fields: dict[str, Field]) -> Snapshot:
        return replace(self, records=records, fields={**self.fields, **fields})


@dataclass(frozen=True)
class Query:
    snapshot_id: str
    unit: str = "example"
    population_scope: str = "complete"
    filter: dict[str, Any] | None = None
    search: str = ""
    sort: tuple[dict[str, str], ...] = ()
    limit: int = 100
    cursor: str | None = None
    sample: dict[str, Any] | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit must be 1 to 1000")
        if len(self.sort) > 4:
            raise ValueError("at most 4 sort keys")
        if len(self.search) > 4000:
            raise ValueError("search text is too long")

    def fingerprint(self) -> str:
        return content_id({k: v for k, v in self.__dict__.items() if k not in ("cursor",)} | {"sort": list(self.sort)})

    def cursor_at(self, offset: int) -> str:
        return base64.urlsafe_b64encode(canonical({"offset": offset, "query": self.fingerprint()}).encode()).decode()

    def offset(self) -> int:
        """Where the page starts; a cursor of another query is refused."""
        if not self.cursor:
            return 0
        try:
            at = json.loads(base64.urlsafe_b64decode(self.cursor))
            ok = at["query"] == self.fingerprint() and isinstance(at["offset"], int) and at["offset"] >= 0
        except (ValueError, KeyError, TypeError):
            ok = False
        if not ok:
            raise ValueError("the cursor is not of this query")
        return at["offset"]


@dataclass(frozen=True)
class Page:
    """A page of rows and what is known of the population that it is from."""

    rows: DataFrame
    matched_count: int
    sampled_count: int
    offset: int
    returned_count: int
    cursor: str | None
    warnings: tuple[str, ...] = field(default_factory=tuple)
