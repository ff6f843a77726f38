"""Filter trees to Catalyst expressions.

A leaf is ``{"field_id", "op", "value"}``, a node ``{"and": [...]}``, ``{"or": [...]}`` or ``{"not": ...}``. The logic has two
values: a leaf over a missing value is false (``is_null`` aside), so its negation is true.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import number, payload, tag
from tessera.model import OPS, Field

MAX_DEPTH, MAX_NODES, MAX_JSON, MAX_VALUES = 8, 64, 16_000, 1_000
NODES = ("and", "or", "not")


def validate(tree: dict | None, fields: dict[str, Field]) -> None:
    """Refuses trees that are too deep, too large, or name unknown fields, operations or keys; the whole tree, before any of it is used."""
    if tree is None:
        return
    if len(json.dumps(tree, default=str)) > MAX_JSON:
        raise ValueError("the filter is too long")
    seen, stack = 0, [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        seen += 1
        if depth > MAX_DEPTH or seen > MAX_NODES:
            raise ValueError(f"a filter has at most {MAX_NODES} nodes in {MAX_DEPTH} levels")
        if not isinstance(node, dict):
            raise ValueError("a filter node must be an object")
        kind = next((k for k in NODES if k in node), None)
        if kind:
            below = [node[kind]] if kind == "not" else node[kind]
            if len(node) > 1 or not isinstance(below, list) or not below:
                raise ValueError(f"'{kind}' takes operands and nothing else")
            stack += [(b, depth + 1) for b in below]
        else:
            _validate_leaf(node, fields)


def _validate_leaf(leaf: dict[str, Any], fields: dict[str, Field]) -> None:
    if extra := set(leaf) - {"field_id", "op", "value"}:
        raise ValueError(f"unknown keys {sorted(extra)}")
    field, op, value = fields.get(leaf.get("field_id")), leaf.get("op"), leaf.get("value")
    if field is None:
        raise ValueError(f"unknown field {leaf.get('field_id')}")
    if op not in OPS or op not in field.ops:
        raise ValueError(f"{field.id} has no operation {op}")
    if op == "is_null" and not isinstance(value, bool):
        raise ValueError("is_null takes true or false")
    if op == "in" and not (isinstance(value, list) and len(value) <= MAX_VALUES):
        raise ValueError(f"in takes a list of at most {MAX_VALUES}")
    if op == "contains" and not isinstance(value, str):
        raise ValueError("contains takes a text")


def compile_filter(tree: dict | None, fields: dict[str, Field]) -> Column:
    validate(tree, fields)
    return F.lit(True) if tree is None else _compile(tree, fields)


def _compile(node: dict, fields: dict[str, Field]) -> Column:
    if "and" in node:
        return reduce(lambda a, b: a & b, [_compile(n, fields) for n in node["and"]])
    if "or" in node:
        return reduce(lambda a, b: a | b, [_compile(n, fields) for n in node["or"]])
    if "not" in node:
        return ~_compile(node["not"], fields)
    return _leaf(fields[node["field_id"]], node["op"], node.get("value"))


def _operand(field: Field, value: Any) -> Any:
    """The literal in the form of the field's column; a value of another type is refused."""
    if field.dtype == "category":
        if not isinstance(value, (bool, str, int, float)):
            raise ValueError(f"{field.id}: {value!r} is not a scalar")
        return tag(value)
    if field.dtype == "number":
        return number(value)
    if field.dtype == "boolean" and isinstance(value, bool) or field.dtype == "string" and isinstance(value, str):
        return value
    raise ValueError(f"{field.id} is a {field.dtype}; {value!r} is not")


def _leaf(field: Field, op: str, value: Any) -> Column:
    c = F.col(f"`{field.column}`")
    if op == "is_null":
        return c.isNull() if value else c.isNotNull()
    if field.dtype in ("array", "object"):
        raise ValueError(f"{field.id} is structured; only is_null applies")
    if op == "in":
        values = [_operand(field, v) for v in value if v is not None]
        return F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)
    if value is None:
        return F.lit(False)
    if op == "contains":
        if field.dtype not in ("string", "category"):
            raise ValueError(f"{field.id}: contains applies to text")
        text = payload(c) if field.dtype == "category" else c
        found = F.contains(F.lower(text), F.lower(F.lit(value)))
        return F.coalesce(c.startswith("s:") & found if field.dtype == "category" else found, F.lit(False))
    wanted = _operand(field, value)
    if op in ("eq", "ne"):
        return F.coalesce(c == F.lit(wanted) if op == "eq" else c != F.lit(wanted), F.lit(False))
    if field.dtype == "boolean":
        raise ValueError(f"{field.id}: booleans have no order")
    if field.dtype == "category":
        c = orderable(field)
        kind = "n" if isinstance(value, (int, float)) and not isinstance(value, bool) else "s" if isinstance(value, str) else "b"
        if kind == "b" or field.kinds - {kind}:
            raise ValueError(f"{field.id}: {value!r} can't be compared with its values")
        wanted = number(value) if kind == "n" else value
    compare = {"gt": c > F.lit(wanted), "gte": c >= F.lit(wanted), "lt": c < F.lit(wanted), "lte": c <= F.lit(wanted)}[op]
    return F.coalesce(compare, F.lit(False))


def orderable(field: Field) -> Column:
    """What to sort or compare a field by; categories of mixed kinds and structured fields are refused."""
    c = F.col(f"`{field.column}`")
    if field.dtype in ("array", "object"):
        raise ValueError(f"{field.id} is structured and has no order")
    if field.dtype != "category":
        return c
    if len(field.kinds) > 1:
        raise ValueError(f"{field.id} has values of several kinds and no order")
    return payload(c).try_cast("double") if field.kinds == {"n"} else payload(c)
