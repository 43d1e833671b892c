"""Filter trees: nested and/or groups of typed conditions, from plain dicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.names import event_name, provider_category
from ..functions.times import event_time
from ..operators.rules import Unsupported, java_regex

FIELDS = {"level": "enum", "category": "enum", "eventId": "number", "timestamp": "date", "provider": "text", "channel": "text", "computer": "text", "file": "text", "eventName": "text", "eventData": "text"}
NUMBER_OPS = {"eq": Column.__eq__, "neq": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}


def _target(c: dict) -> Column:
    plain = {"eventId": "event_id", "timestamp": "ts"}
    match c["field"]:
        case "category":
            return provider_category()
        case "eventName":
            return event_name(F.col("event_id"), F.col("provider"))
        case "eventData":
            return field(c["key"]) if c.get("key") else F.lit(None).cast("string")
        case f:
            return F.col(plain.get(f, f))


def _text(op: str, actual: Column, value: str) -> Column:
    a = F.coalesce(actual, F.lit(""))
    if op in ("exists", "empty"):
        return (a != "") if op == "exists" else (a == "")
    if value == "":
        return F.lit(True)
    if op == "regex":
        try:
            return a.rlike(java_regex(value, {"i"}))
        except Unsupported:
            return F.lit(True)
    a, v = F.lower(a), value.lower()
    return {"contains": lambda: a.contains(v), "notContains": lambda: ~a.contains(v), "equals": lambda: a == v, "notEquals": lambda: a != v, "startsWith": lambda: a.startswith(v)}[op]()


def _bound(text: str | None) -> Column:
    return event_time(F.lit(text or ""))


def _date(op: str, t: Column, value: str | None, value2: str | None) -> Column:
    """before is <, after is >=, between has both ends; a bound that is no time is no constraint."""
    t, lo, hi = F.date_trunc("MILLISECOND", t), _bound(value), _bound(value2)
    test = {"before": lambda: lo.isNull() | (t < lo), "after": lambda: lo.isNull() | (t >= lo), "between": lambda: (lo.isNull() | (t >= lo)) & (hi.isNull() | (t <= hi))}[op]()
    return t.isNotNull() & F.coalesce(test, F.lit(False))


def condition(c: dict) -> Column:
    kind, value = FIELDS[c["field"]], c.get("value", "")
    if kind == "text":
        return _text(c["op"], _target(c), value)
    if kind == "date":
        return _date(c["op"], _target(c), value, c.get("value2"))
    if kind == "enum":
        if not c.get("values"):
            return F.lit(True)
        member = F.coalesce(_target(c).cast("string").isin([str(v) for v in c["values"]]), F.lit(False))
        return ~member if c["op"] == "notIn" else member
    try:
        n = float(int(value, 16) if value.strip().lower().startswith("0x") else value)
    except ValueError:
        return F.lit(True)
    return F.coalesce(NUMBER_OPS[c["op"]](_target(c).cast("double"), F.lit(n)), F.lit(False))


def tree_column(node: dict) -> Column:
    """node: a condition {field, op, value...}, or {combinator: and|or, children: [...]}; an empty group is true."""
    if "children" not in node:
        return condition(node)
    parts = [tree_column(x) for x in node["children"]]
    return reduce(Column.__and__ if node["combinator"] == "and" else Column.__or__, parts) if parts else F.lit(True)


def filter_tree(events: DataFrame, node: dict) -> DataFrame:
    return events.where(tree_column(node))
