"""Filter expressions compiled to columns: conditions, AND as tuple, OR as list."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 10
_BINARY = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
OPERATORS = (*_BINARY, "in", "contains", "is_null", "is_not_null")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if self.op == "in" and not isinstance(self.value, list | tuple | set | frozenset):
            raise ValueError("in needs a list, tuple or set")

    def column(self) -> Column:
        c = F.col(self.field)
        if self.op in _BINARY:
            return _BINARY[self.op](c, F.lit(self.value))  # with null: neither true nor false, as in SQL
        if self.op == "in":
            return c.isin(*self.value)
        if self.op == "contains":
            return c.like(f"%{self.value}%")  # % and _ in the value stay wildcards
        return c.isNull() if self.op == "is_null" else c.isNotNull()


Expression = Condition | tuple | list


def depth(expr: Any) -> int:
    parts = expr.values() if isinstance(expr, Mapping) else expr if isinstance(expr, tuple | list) else ()
    return 1 + max(map(depth, parts), default=0)


def compile_filter(expr: Expression | None, fields: set[str] | None = None) -> Column:
    """A column for an expression; none of it means all rows.  Fields outside ``fields`` are an error."""
    if expr is None or (isinstance(expr, tuple | list) and not expr):
        return F.lit(True)
    if depth(expr) > MAX_DEPTH:
        raise ValueError(f"filters nest deeper than {MAX_DEPTH}")
    if isinstance(expr, Condition):
        if fields is not None and expr.field not in fields:
            raise ValueError(f"unknown field {expr.field!r}")
        return expr.column()
    join = operator.and_ if isinstance(expr, tuple) else operator.or_
    return functools.reduce(join, (compile_filter(e, fields) for e in expr))


def parse_filters(filters: Mapping[str, Any] | None) -> tuple[Condition, ...]:
    """``{field: value}`` or ``{field: {"operator": op, "value": v}}``, all of which must hold."""
    out = []
    for field, spec in (filters or {}).items():
        if isinstance(spec, Mapping):
            if "operator" not in spec:
                raise ValueError(f"the filter on {field!r} has no operator")
            out.append(Condition(field, spec["operator"], spec.get("value")))
        else:
            out.append(Condition(field, "eq", spec))
    return tuple(out)


#: Which Python types a field of a Spark type takes.
_VALUES = {"string": (str,), "bigint": (int,), "int": (int,), "double": (int, float), "float": (int, float), "boolean": (bool,)}


def check_values(expr: Expression, dtypes: Mapping[str, str]) -> None:
    """An error for a value that doesn't fit its field's type."""
    if isinstance(expr, tuple | list):
        for e in expr:
            check_values(e, dtypes)
        return
    values = expr.value if expr.op == "in" else () if expr.op.startswith("is_") else (expr.value,)
    allowed = _VALUES.get(dtypes.get(expr.field, ""), (object,))
    if any(v is not None and (not isinstance(v, allowed) or (isinstance(v, bool) and bool not in allowed)) for v in values):
        raise ValueError(f"a value for {expr.field!r} has the wrong type")


def visible_to(user_id: int | None, is_admin: bool = False, field: str = "user_id") -> Column:
    """Tenancy: administrators see all, users their own rows, and nobody else any."""
    if is_admin:
        return F.lit(True)
    return F.lit(False) if user_id is None else F.col(field) == user_id


def project(df, columns: list[str]):
    """The named columns that exist."""
    return df.select(*(c for c in columns if c in df.columns))
