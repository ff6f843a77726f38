"""From native columns to fields: roles by name, nested paths, templates, joined parts and choices."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that a column of a role has, the first that is there counts.
ROLES = {"text": ("text", "sentence", "caption", "content"), "question": ("question", "Question"), "choices": ("choices", "options", "Options")}


def roles(columns: list[str], given: dict[str, str] | None = None) -> dict[str, str | None]:
    """The column of each role: as given, if there is such a column, or by name."""
    given = given or {}
    return {role: given[role] if given.get(role) in columns else next((n for n in names if n in columns), None) for role, names in ROLES.items()}


def nested(schema: T.StructType, path: str) -> Column:
    """The field at a dotted path through structs and maps; null where a step isn't one. A column of the whole name comes first."""
    if path in schema.names:
        return F.col(f"`{path}`")
    head, *rest = path.split(".")
    if head not in schema.names:
        return F.lit(None).cast("string")
    out, kind = F.col(f"`{head}`"), schema[head].dataType
    for step in rest:
        if isinstance(kind, T.StructType) and step in kind.names:
            out, kind = out[step], kind[step].dataType
        elif isinstance(kind, T.MapType):
            out, kind = F.try_element_at(out, F.lit(step)), kind.valueType
        else:
            return F.lit(None).cast("string")
    return out


def templated(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced by the value as text. A name without a column is refused; a missing value makes the whole null."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 and piece not in values:
            raise ValueError(f"the template names {piece}, which isn't a field")
        if i % 2 or piece:
            parts.append(values[piece].cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def stem(c: Column, separator: str = "_", width: int | None = None) -> Column:
    """What is ahead of the first separator, filled with zeros to the width; a longer one stays as it is."""
    if width is not None and not 1 <= width <= 20:
        raise ValueError("a stem's width is 1 to 20")
    first = F.get(F.split(c.cast("string"), re.escape(separator)), F.lit(0))
    return first if width is None else F.when(F.length(first) >= width, first).otherwise(F.lpad(first, width, "0"))


def without_prefix(path: Column, prefix: str) -> Column:
    """The path behind the prefix; a path without it is an error."""
    return F.when(path.isNull() | F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(F.raise_error(F.concat(F.lit("a path lacks its prefix: "), path)).cast("string"))


def media_variants(variants: list[dict], values: dict[str, Column]) -> tuple[Column, Column]:
    """(references, absent conditions) of a record's variants: each has a ``condition`` and a ``template``, and ``absent_when`` (field, values) says where it isn't there."""
    there, gone = [], []
    for v in variants:
        absent = F.coalesce(values[v["absent_when"]["field"]].isin(v["absent_when"]["values"]), F.lit(False)) if v.get("absent_when") else F.lit(False)
        there.append(F.when(~absent, F.struct(templated(v["template"], values).alias("ref"), F.lit(v["condition"]).alias("condition"))))
        gone.append(F.when(absent, F.lit(v["condition"])))
    return F.array_compact(F.array(*there)), F.array_compact(F.array(*gone))


def joined_parts(parts: Column, separator: str = "", item: str | None = None) -> Column:
    """An ordered list of texts, or of their field ``item``, as one text; a null part is an error."""
    texts = F.transform(parts, lambda p: p[item]) if item else parts
    whole = F.array_join(texts, separator)
    return F.when(F.exists(texts, lambda t: t.isNull()), F.raise_error(F.lit("a part of the text is missing")).cast("string")).otherwise(whole)


def choices(columns: list[str] | Column, correct: int | None = None) -> tuple[Column, Column]:
    """(choices, correct index): named columns or a list column as a list of texts. An index that is declared must be in the list."""
    options = F.array(*[F.col(f"`{c}`").cast("string") for c in columns]) if isinstance(columns, list) else columns
    if correct is None:
        return options, F.lit(None).cast("int")
    if correct < 0 or isinstance(columns, list) and correct >= len(columns):
        raise ValueError("the declared choice isn't in the list")
    return options, F.when(F.size(options) > correct, F.lit(correct)).otherwise(F.raise_error(F.lit("the declared choice isn't in the list")).cast("int"))


def mapped(rows: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``text``, ``question`` and ``choices`` from the columns of these roles."""
    of = roles(rows.columns, given)
    cast = {"text": "string", "question": "string", "choices": "array<string>"}
    return reduce(lambda df, r: df.withColumn(r, (F.col(f"`{of[r]}`") if of[r] else F.lit(None)).cast(cast[r])), cast, rows)
