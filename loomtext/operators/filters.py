"""The metadata filter language: a mapping compiled to a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the keys that filters may use.
KEYS = ("source_id", "source_path", "doc_type", "dialect", "register", "license")


class FilterError(ValueError):
    """A filter that can't be compiled."""


def compile_filter(where: dict | None) -> Column:
    """``{key: value}`` and ``{key: {"$op": value}}``, joined by and; ``$and`` and ``$or`` take lists.

    ``$ne`` and ``$nin`` keep rows without the key. Keys are checked at every depth.
    """
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise FilterError(f"{key} takes a list")
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [compile_filter(x) for x in value]))
        elif key not in KEYS:
            raise FilterError(f"unknown filter key {key!r}")
        else:
            ops = value if isinstance(value, dict) else {"$eq": value}
            parts += [_compare(F.col(key), op, x) for op, x in ops.items()]
    return reduce(lambda a, b: a & b, parts)


def _compare(c: Column, op: str, x: object) -> Column:
    if op in ("$in", "$nin"):
        got = F.coalesce(c.isin(list(x)), F.lit(False))
        return got if op == "$in" else ~got
    if op == "$eq":
        return c.eqNullSafe(x)
    if op == "$ne":
        return ~c.eqNullSafe(x)
    compare = {"$gt": c > x, "$gte": c >= x, "$lt": c < x, "$lte": c <= x}
    if op not in compare:
        raise FilterError(f"unknown operator {op!r}")
    return F.coalesce(compare[op], F.lit(False))
