"""Predicates in conjunctive normal form: one IR for Columns, SQL text, planning and indexes.

A query is an AND of clauses, a clause an OR of conditions. No clause means every row; an empty clause means no row.
A NULL attribute fails every condition.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("=", "<", "<=", ">", ">=")
Value = str | float | int


@dataclass(frozen=True)
class Condition:
    attr: str
    op: str
    value: Value

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown comparison {self.op!r}")

    def column(self) -> Column:
        c, v = F.col(self.attr), F.lit(self.value)
        return {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]

    def sql(self) -> str:
        v = "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else repr(self.value)
        return f"{self.attr} {self.op} {v}"


Clause = tuple[Condition, ...]


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = ()
    hint: str | None = field(default=None, compare=False)

    def column(self) -> Column:
        return reduce(and_, (reduce(or_, (c.column() for c in clause), F.lit(False)) for clause in self.clauses), F.lit(True))

    def sql(self) -> str:
        return " AND ".join("(" + " OR ".join(c.sql() for c in clause) + ")" if clause else "FALSE" for clause in self.clauses) or "TRUE"

    def attrs(self) -> list[str]:
        return list(dict.fromkeys(c.attr for clause in self.clauses for c in clause))

    def __and__(self, other: Query) -> Query:
        return Query(self.clauses + other.clauses, self.hint or other.hint)


def equals(attr: str, value: Value) -> Query:
    return Query(((Condition(attr, "=", value),),))


def one_of(attr: str, values: Iterable[Value]) -> Query:
    """IN: one clause of equalities; no values match no row."""
    return Query((tuple(Condition(attr, "=", v) for v in values),))


def between(attr: str, lo: Value, hi: Value) -> Query:
    """Half-open [lo, hi): two clauses."""
    return Query(((Condition(attr, ">=", lo),), (Condition(attr, "<", hi),)))


def any_of(*conditions: Condition) -> Query:
    return Query((tuple(conditions),))


def parse_filters(text: str, columns: dict[str, str]) -> Query:
    """The filter JSON of a trace's read: {"filters": [{"attr", "op": eq | in | range, ...}], "hint": attr}.

    columns: name -> role (equality or range); names match without regard to case. Unknown names and ops raise.
    """
    data = json.loads(text)
    filters = data["filters"] if isinstance(data, dict) else data
    names = {c.lower(): c for c in columns}
    out = Query()
    for f in filters:
        if (attr := names.get(str(f["attr"]).lower())) is None:
            raise ValueError(f"unknown attribute {f['attr']!r}")
        if f["op"] == "eq":
            out &= equals(attr, f["value"])
        elif f["op"] == "in":
            out &= one_of(attr, f["values"])
        elif f["op"] == "range":
            out &= between(attr, f["lo"], f["hi"])
        else:
            raise ValueError(f"unknown op {f['op']!r}")
    hint = data.get("hint") if isinstance(data, dict) else None
    return Query(out.clauses, names.get(str(hint).lower()) if hint else None)


def check_roles(query: Query, columns: dict[str, str]) -> None:
    """A range condition on an attribute declared for equality raises."""
    for clause in query.clauses:
        for c in clause:
            if c.op != "=" and columns.get(c.attr) != "range":
                raise ValueError(f"{c.attr} is declared {columns.get(c.attr)!r}, not range")


@dataclass(frozen=True)
class Bounds:
    lo: Value | None = None
    lo_open: bool = False
    hi: Value | None = None
    hi_open: bool = False

    def narrowed(self, c: Condition) -> Bounds:
        """The tightest of the bounds and one more condition."""
        lo, lo_open, hi, hi_open = self.lo, self.lo_open, self.hi, self.hi_open
        if c.op in ("=", ">", ">="):
            is_open = c.op == ">"
            if lo is None or c.value > lo or c.value == lo and is_open:
                lo, lo_open = c.value, is_open
        if c.op in ("=", "<", "<="):
            is_open = c.op == "<"
            if hi is None or c.value < hi or c.value == hi and is_open:
                hi, hi_open = c.value, is_open
        return Bounds(lo, lo_open, hi, hi_open)

    def empty(self) -> bool:
        return self.lo is not None and self.hi is not None and (self.lo > self.hi or self.lo == self.hi and (self.lo_open or self.hi_open))

    def query(self, attr: str) -> Query:
        if self.lo is not None and self.lo == self.hi:
            return equals(attr, self.lo)
        out = Query()
        if self.lo is not None:
            out &= Query(((Condition(attr, ">" if self.lo_open else ">=", self.lo),),))
        if self.hi is not None:
            out &= Query(((Condition(attr, "<" if self.hi_open else "<=", self.hi),),))
        return out


def normalize(query: Query) -> Query:
    """Single-condition clauses become the tightest bounds of their attribute; repeated clauses go; a contradiction gives the empty clause."""
    bounds: dict[str, Bounds] = {}
    rest: list[Clause] = []
    for clause in query.clauses:
        if not clause:
            return Query(((),), query.hint)
        if len(clause) == 1:
            c = clause[0]
            bounds[c.attr] = bounds.get(c.attr, Bounds()).narrowed(c)
        elif clause not in rest:
            rest.append(tuple(dict.fromkeys(clause)))
    if any(b.empty() for b in bounds.values()):
        return Query(((),), query.hint)
    out = Query(hint=query.hint)
    for attr, b in bounds.items():
        out &= b.query(attr)
    return Query(out.clauses + tuple(rest), query.hint)
