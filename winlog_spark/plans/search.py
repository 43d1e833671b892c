"""Structured search: OR of AND groups of clauses, as a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import LABELS, decode_value, decoded_text
from ..functions.fields import as_column, glob, number
from ..functions.names import EVENT_NAMES, event_name
from ..operators.rules import Unsupported, java_regex

# Names of header fields, and names that stand for several EventData fields.
HEADER_FIELDS = {
    "eventid": "eventid",
    "id": "eventid",
    "event_id": "eventid",
    "level": "level",
    "provider": "provider",
    "source": "provider",
    "channel": "channel",
    "log": "channel",
    "computer": "computer",
    "host": "computer",
    "file": "file",
    "name": "name",
    "record": "record",
    "recordid": "record",
}
MULTI_FIELDS = {
    "logonid": ["targetlogonid", "subjectlogonid", "logonid"],
    "process": ["newprocessname", "image"],
    "parent": ["parentprocessname", "parentimage"],
    "processguid": ["processguid", "parentprocessguid", "sourceprocessguid", "targetprocessguid"],
}
COMPARISONS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


@dataclass(frozen=True)
class Clause:
    """value within field, or anywhere in the event where field is None; cmp compares numbers."""

    value: str
    field: str | None = None
    negate: bool = False
    cmp: str | None = None


def haystack(ed: str | Column = "ed") -> Column:
    """Everything that free text can hit, in lower case."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    values = F.transform(as_column(ed), lambda p: F.coalesce(p["value"], F.lit("")))
    head = F.array(*[empty(F.col(c)) for c in ("event_id", "provider", "channel", "computer", "file")], empty(event_name(F.col("event_id"), F.col("provider"))))
    return F.lower(F.array_join(F.concat(head, values, F.array(decoded_text(ed))), "\u0001"))


def free_text(value: str, ed: str | Column = "ed") -> Column:
    """Whether the haystack holds a text, told from its parts.

    Names and labels come from tables, so most texts can be seen to be in none of them; then nothing is decoded.
    """
    needle = value.lower()
    if not needle:
        return F.lit(True)
    if "\u0001" in needle or "," in needle:
        # it may reach from one part into the next
        return haystack(ed).contains(needle)
    has = lambda c: F.coalesce(F.lower(c.cast("string")).contains(needle), F.lit(False))
    hit = reduce(Column.__or__, [has(F.col(c)) for c in ("event_id", "provider", "channel", "computer", "file")])
    hit = hit | F.exists(as_column(ed), lambda p: has(p["value"]))
    if any(needle in n.lower() for t in EVENT_NAMES.values() for n in t.values()):
        hit = hit | has(event_name(F.col("event_id"), F.col("provider")))
    return hit | has(decoded_text(ed)) if any(needle in label.lower() for label in LABELS) else hit


def header_text(kind: str, name: Column | None = None) -> Column:
    """A header field as text; name: a column with the events' names, instead of the built-in ones."""
    c = {"eventid": F.col("event_id"), "level": F.col("level"), "record": F.col("record_id")}.get(kind)
    if kind == "name":
        c = event_name(F.col("event_id"), F.col("provider")) if name is None else name
    return F.coalesce((F.col(kind) if c is None else c).cast("string"), F.lit(""))


def _value_test(c: Clause):
    if c.cmp:
        want = number(F.lit(c.value))
        return lambda v: F.coalesce(COMPARISONS[c.cmp](number(v), want), F.lit(False))
    if "*" in c.value:
        return lambda v: glob(v, c.value)
    return lambda v: F.lower(v) == c.value.lower()


def decoded_pairs(ed: str | Column = "ed", names: list[str] | None = None) -> Column:
    """Pairs, or those of some names, with what they mean: (name in lower case, value, meaning); made once where many clauses look at them."""
    some = as_column(ed) if names is None else F.filter(as_column(ed), lambda p: F.lower(p["name"]).isin(names))
    return F.transform(some, lambda p: F.struct(F.lower(p["name"]).alias("name"), p["value"].alias("value"), decode_value(p["name"], p["value"]).alias("meaning")))


def clause_column(c: Clause, hay: Column | None = None, pairs: Column | None = None, names: Column | None = None) -> Column:
    """True or false for every event, never null: an absent field doesn't match, so a negated clause on it does."""
    if c.field is None:
        hit = free_text(c.value) if hay is None else hay.contains(c.value.lower())
    else:
        name, test = c.field.lower(), _value_test(c)
        if name in HEADER_FIELDS:
            hit = test(header_text(HEADER_FIELDS[name], names))
        else:
            keys = MULTI_FIELDS.get(name, [name])
            named = F.filter(decoded_pairs() if pairs is None else pairs, lambda p: p["name"].isin(keys))
            hit = F.exists(named, lambda p: F.coalesce(test(p["value"]), F.lit(False)) | F.coalesce(test(p["meaning"]), F.lit(False)))
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if c.negate else hit


def groups_column(groups: list[list[Clause]], hay: Column | None = None, pairs: Column | None = None, names: Column | None = None) -> Column:
    """OR of ANDs; no groups select everything. Clauses on header fields come first in a group, as they are cheap and reach the scan."""
    if not groups:
        return F.lit(True)
    cheap = lambda c: c.field is None or c.field.lower() not in HEADER_FIELDS
    return reduce(Column.__or__, [reduce(Column.__and__, [clause_column(c, hay, pairs, names) for c in sorted(g, key=cheap)], F.lit(True)) for g in groups])


_TERM = re.compile(r'(?P<neg>-)?(?:(?P<field>[A-Za-z_][\w.]*):)?(?P<cmp>>=|<=|>|<)?(?:"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<bare>\S+))')


def clauses(text: str) -> list[list[Clause]]:
    """Short form: terms, field:value, field:>n, -negated, "quoted", OR between groups."""
    groups: list[list[Clause]] = [[]]
    for m in _TERM.finditer(text):
        if m["bare"] == "OR" and not m["field"] and not m["neg"]:
            groups.append([])
            continue
        value = m["bare"] if m["quoted"] is None else re.sub(r"\\(.)", r"\1", m["quoted"])
        cmp = m["cmp"] if m["field"] else None
        groups[-1].append(Clause(value if cmp or not m["cmp"] else m["cmp"] + value, m["field"], bool(m["neg"]), cmp))
    return [g for g in groups if g]


def _pair_names(groups: list[list[Clause]]) -> list[str]:
    """The names of pairs that clauses look at, in lower case."""
    fields = {c.field.lower() for g in groups for c in g if c.field and c.field.lower() not in HEADER_FIELDS}
    return sorted({n for f in fields for n in MULTI_FIELDS.get(f, [f])})


def search(events: DataFrame, groups: list[list[Clause]] | str) -> DataFrame:
    """The events that a search selects.

    What the clauses on header fields leave is filtered first, at the scan where it can be. The other clauses look at the
    pairs that they name, which are decoded once for all of them. Where events have a column event_name, clauses on the
    name look at it.
    """
    own = F.col("event_name") if "event_name" in events.columns else None
    groups = clauses(groups) if isinstance(groups, str) else groups
    head = [[c for c in g if c.field and c.field.lower() in HEADER_FIELDS] for g in groups]
    out = events.where(groups_column(head, names=own)) if all(head) else events
    if head == groups:
        return out
    names = _pair_names(groups)
    with_pairs = out.withColumn("_pairs", decoded_pairs(names=names)) if names else out
    # as a generator, which keeps the pairs from being put into the predicate once for each clause
    kept = F.explode(F.filter(F.array(F.lit(True)), lambda _: groups_column(groups, pairs=F.col("_pairs"), names=own)))
    return with_pairs.withColumn("_kept", kept).select(events.columns)


def regex_search(events: DataFrame, pattern: str) -> DataFrame:
    """Events whose haystack a pattern hits, in any case; a pattern that does not compile hits none."""
    try:
        read = java_regex(pattern, {"i"})
    except Unsupported:
        return events.where(F.lit(False))
    return events.where(haystack().rlike(read))
