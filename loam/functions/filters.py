"""The portable filter language, compiled to Catalyst expressions.

A filter is a dictionary with operators first: ``{"eq": {field: value}}``, likewise ``ne``, ``in``, ``nin``,
``gt``, ``gte``, ``lt`` and ``lte``; ``{"exists": field}``, ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}``.
Several operators, or several fields below one, mean all of them. As a short form a key that is no
operator is a field: ``{field: value}`` and ``{field: {op: value}}``.
Logic is two-valued: a comparison with a missing field is false, also ``ne`` and ``nin``, and
``not`` turns that false into true. Types do not mix: true never equals 1.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte")
NEGATED = {"eq": "ne", "ne": "eq", "in": "nin", "nin": "in", "gt": "lte", "lte": "gt", "lt": "gte", "gte": "lt"}
Filter = dict[str, Any]


class FilterError(ValueError):
    """A filter that cannot be understood."""


def _scalar(value: Any) -> Any:
    if isinstance(value, bool | int | float | str):
        return value
    raise FilterError(f"not a text, number or truth value: {value!r}")


def _operand(op: str, field: str, value: Any) -> tuple:
    """The node of one comparison, its operand checked."""
    if op not in COMPARISONS:
        raise FilterError(f"unknown comparison {op}")
    if op not in ("in", "nin"):
        return (op, field, _scalar(value))
    if not isinstance(value, list | tuple) or not value:
        raise FilterError(f"{op} takes a list that is not empty")
    return (op, field, [_scalar(v) for v in value])


def _short_form(field: str, value: Any) -> list[tuple]:
    """``{field: value}`` and ``{field: {op: value, ...}}``."""
    if not isinstance(value, dict):
        return [_operand("eq", field, value)]
    if not value:
        raise FilterError(f"no comparison for {field}")
    present = [("exists", field) if wanted else ("not", ("exists", field)) for op, wanted in value.items() if op == "exists"]
    return present + [_operand(op, field, v) for op, v in value.items() if op != "exists"]


def _clause(key: str, body: Any) -> list[tuple]:
    """Nodes of one entry of a filter; all of them must hold."""
    if key in ("and", "or"):
        if not isinstance(body, list) or not body:
            raise FilterError(f"{key} takes a list that is not empty")
        parts = [parse(part) for part in body if part]
        return [] if not parts else parts if len(parts) == 1 else [(key, parts)]
    if key == "not":
        if not body:
            raise FilterError("not takes a filter")
        return [("not", parse(body))]
    if key == "exists":
        fields = [body] if isinstance(body, str) else body
        if not isinstance(fields, list | tuple) or not fields or not all(isinstance(f, str) for f in fields):
            raise FilterError("exists takes a field or a list of fields")
        return [("exists", f) for f in fields]
    if key in COMPARISONS:
        if not isinstance(body, dict) or not body:
            raise FilterError(f"{key} takes a dictionary of fields and values")
        return [_operand(key, field, value) for field, value in body.items()]
    return _short_form(key, body)


def parse(filter_: Filter | None) -> tuple:
    """A tree of ('and'|'or', children), ('not', child), ('exists', field) and (op, field, value)."""
    if not filter_:
        return ("and", [])
    if not isinstance(filter_, dict):
        raise FilterError(f"a filter is a dictionary, not {type(filter_).__name__}")
    nodes = [node for key, body in filter_.items() for node in _clause(key, body)]
    return nodes[0] if len(nodes) == 1 else ("and", nodes)


def to_dict(node: tuple) -> Filter:
    """A tree as a filter again, operators first; the empty filter for the empty tree."""
    kind = node[0]
    if kind in ("and", "or"):
        return {kind: [to_dict(n) for n in node[1]]} if node[1] else {}
    if kind == "not":
        return {"not": to_dict(node[1])}
    return {"exists": node[1]} if kind == "exists" else {kind: {node[1]: node[2]}}


def conjunction(*filters: Filter | None) -> Filter | None:
    """All of several filters; missing ones are left out."""
    given = [f for f in filters if f]
    return None if not given else given[0] if len(given) == 1 else {"and": given}


def fields_of(filter_: Filter | None) -> set[str]:
    def walk(node: tuple) -> set[str]:
        if node[0] in ("and", "or"):
            return set().union(*map(walk, node[1])) if node[1] else set()
        return walk(node[1]) if node[0] == "not" else {node[1]}

    return walk(parse(filter_))


def without_not(node: tuple, negate: bool = False, not_exists: bool = True) -> tuple:
    """Push negations down to the comparisons, for stores that have none; missing fields then differ.

    A store without ``not_exists`` cannot tell missing fields at all, which is an error.
    """
    kind = node[0]
    if kind == "not":
        return without_not(node[1], not negate, not_exists)
    if kind in ("and", "or"):
        flipped = {"and": "or", "or": "and"}[kind] if negate else kind
        return (flipped, [without_not(n, negate, not_exists) for n in node[1]])
    if not negate:
        return node
    if kind == "exists" and not not_exists:
        raise FilterError("this store cannot ask for a missing field")
    return ("not", node) if kind == "exists" else (NEGATED[kind], *node[1:])


def _kind(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


def _kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    return "string" if isinstance(data_type, T.StringType) else "other"


def _compare(column: Column, data_type: T.DataType, op: str, value: Any) -> Column:
    """Null where the field is missing, or false."""
    if op in ("in", "nin"):
        fitting = [v for v in value if _kind(v) == _kind_of(data_type)]
        found = column.isin(fitting) if fitting else F.lit(False)
        return found if op == "in" else column.isNotNull() & ~found
    if _kind(value) != _kind_of(data_type):
        return column.isNotNull() if op == "ne" else F.lit(False)
    if op not in ("eq", "ne") and _kind(value) == "boolean":
        return F.lit(False)
    return {"eq": column == value, "ne": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]


def condition(filter_: Filter | None, schema: T.StructType, exact: bool = True) -> Column:
    """The filter as a condition that is never null; a field the schema lacks is missing in every row.

    ``m_<key>`` is the entry ``key`` of a column ``metadata``, a user's own fields.

    With ``exact`` off, comparisons outside of ``not`` may be null instead of false. That keeps the same
    rows in a filter, and leaves them in the form the Parquet reader understands.
    """
    types = {f.name: f.dataType for f in schema.fields}

    def build(node: tuple, exact: bool) -> Column:
        kind = node[0]
        if kind == "not":
            return ~build(node[1], True)
        if kind in ("and", "or"):
            parts = [build(n, exact) for n in node[1]]
            return reduce(lambda a, b: a & b if kind == "and" else a | b, parts) if parts else F.lit(True)
        field = node[1]
        if field in types:
            column, data_type = F.col(f"`{field}`"), types[field]
        elif field.startswith("m_") and isinstance(types.get("metadata"), T.MapType):
            column, data_type = F.col("metadata")[field[2:]], types["metadata"].valueType
        else:
            return F.lit(False)
        if kind == "exists":
            return column.isNotNull()
        compared = _compare(column, data_type, kind, node[2])
        return F.coalesce(compared, F.lit(False)) if exact else compared

    return build(parse(filter_), exact)


def where(df: DataFrame, filter_: Filter | None) -> DataFrame:
    """Rows that satisfy the filter; simple comparisons reach the Parquet reader."""
    return df.filter(condition(filter_, df.schema, exact=False))
