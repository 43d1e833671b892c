"""Large rule packs: rules as rows of a table instead of expressions of a plan.

Whatever the number of rules, the plan is the same few joins with tables made of the pack, and no event is shuffled. Each
value of a rule is an atom (field, kind, text). A rule has a gate, a list of atoms of which a match has at least one, and
each of these stands in an index under a key: a whole value, a beginning, an end, or for contained text its rarest n-gram.
The values of an event are taken apart into the same kinds of key, so that events meet rules by hash joins; what meets is
decided on the event's own values, from the atoms in the rule's row.
"""

from __future__ import annotations

import itertools
import re
from functools import cached_property, reduce

try:
    from re import _constants as _sre
    from re import _parser
except ImportError:  # pragma: no cover
    _parser = None

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import exploded, keyword_text, signed_number
from .rules import CLASSIC, DERIVED, HEADER, MAPPED, Rule, _escape, _norm, _unescape, check_entry, encoded, event_field, field_test, java_regex, like_pattern, may_be_classic, operand, prepared, truth, windash

#: Rules with more selections than this are left to the expression path.
MOST_SELECTIONS = 10
#: Tables made of a pack are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
#: Rules without a gate are tried as expressions on the events of their kinds, if there are no more of them.
MOST_OPEN = 50
#: Length of the pieces that contained texts are looked up by; shorter texts stand under themselves.
GRAM = 4
#: Modifiers whose tests are made of a value and a text alone, whatever the rule.
PLAIN = {"contains", "startswith", "endswith", "all", "re", "i", "m", "s", "exists", "gt", "gte", "lt", "lte", "windash", "base64", "base64offset", "wide", "utf16", "utf16le", "utf16be"}
NATIVE = "4688:"

Atom = tuple[str, str, str]
#: (field, way, text): way is = for a whole value, ^ for a beginning, $ for an end, ~ for a piece.
Key = tuple[str, str, str]


class _Unfit(Exception):
    pass


def grams(text: str) -> list[str]:
    n = min(GRAM, len(text))
    return list(dict.fromkeys(text[i : i + n] for i in range(len(text) - n + 1)))


def chunk_of(kind: str, text: str) -> str:
    """What a lower-case value must contain for an atom to hold: the text, the longest piece of a pattern between its wildcards, the longest run of plain characters of an expression."""
    if kind == "like":
        return max((re.sub(r"!(.)", r"\1", x) for x in re.findall(r"(?:!.|[^%_!])+", text)), key=len, default="")
    if kind == "re":
        return _plain_run(text)
    return text if kind == "contains" else ""


def end_of(kind: str, text: str) -> str | None:
    """What a lower-case value must end with for a pattern with wildcards to hold, if it says."""
    last = re.search(r"(?:!.|[^%_!])+$", text) if kind == "like" else None
    return re.sub(r"!(.)", r"\1", last[0]) if last else None


def _plain_run(pattern: str) -> str:
    """The longest run of ASCII characters that every match of a regular expression has, in lower case; empty if none is seen."""
    try:
        parsed = _parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, AttributeError, RecursionError, OverflowError):
        return ""
    runs, now = [], ""
    for op, value in parsed:
        if op is _sre.LITERAL and 0 < value < 128:
            now += chr(value)
        else:
            runs.append(now)
            now = ""
    return max([*runs, now], key=len).lower()


class Pack:
    """Rules turned into rows. counts: how often keys occur, as key_counts measures; without them the length of texts has to do."""

    def __init__(self, rules: list[Rule], counts: dict[Key, int] | None = None):
        self.rules, self.counts = rules, counts
        self.tests: dict[tuple, tuple[int, object]] = {}
        self.rows, self.left = [], []
        for r in rules:
            # a rule whose targets map fields differently is one row for each mapping
            for profile in dict.fromkeys(p for _, _, p in r.targets):
                try:
                    self.rows.append(self._row(r, profile))
                except _Unfit:
                    self.left.append((r, profile))
        for row in self.rows:
            row["gate"] = self._gate(row)

    # --- atoms

    def _field(self, name: str | None, profile: str | None) -> str:
        n = _norm(name or "")
        return NATIVE + n if profile and n in MAPPED else n

    def _entry(self, key: str | None, value: object, profile: str | None) -> list[list[Atom]]:
        """Groups of atoms that must all have one that holds."""
        name, *mods = (key or "").split("|")
        kinds, items = check_entry(name or None, mods, value)
        if not items:
            return [[]]
        if not kinds <= PLAIN:
            return [[("", "test", str(self.tests.setdefault((key, repr(value), profile), (len(self.tests), value))[0]))]]
        field = self._field(name, profile)
        if "exists" in kinds:
            return [[(field, "exists", str(str(items[0]).lower() == "true").lower())]]
        each = [[(field, k, t) for k, t in self._atoms(name, kinds, x)] for x in items]
        return each if "all" in kinds else [[a for g in each for a in g]]

    @staticmethod
    def _atoms(name: str, kinds: set[str], x: object) -> list[tuple[str, str]]:
        """Alternatives (kind, text) for one value of an entry."""
        if x is None:
            return [("null", "")]
        if op := kinds & {"gt", "gte", "lt", "lte"}:
            return [(min(op), repr(operand(x)))]
        if "re" in kinds:
            return [("re", java_regex(str(x), kinds))]
        texts = [str(x).lower() if isinstance(x, bool) else str(x)]
        texts = [t for s in texts for t in windash(s)] if "windash" in kinds else texts
        wildcards = not kinds & {"base64", "base64offset"}
        texts = texts if wildcards else [t for s in texts for t in encoded(s, kinds)]
        ends = kinds & {"contains", "startswith", "endswith"} | ({"contains"} if not name else set())
        inside = "contains" in ends or len(ends) > 1
        kind = "contains" if inside else {"startswith": "prefix", "endswith": "suffix"}[min(ends)] if ends else "exact"
        out = []
        for t in texts:
            pattern, wild = like_pattern(t) if wildcards else (_escape(t), False)
            if not wild:
                out.append((kind, _unescape(pattern).lower()))
            else:
                before, after = kind in ("contains", "suffix"), kind in ("contains", "prefix")
                out.append(("like", ("%" if before and not pattern.startswith("%") else "") + pattern.lower() + ("%" if after and not pattern.endswith("%") else "")))
        if isinstance(x, int | float) and not isinstance(x, bool) and not ends:
            out.append(("num", repr(float(x))))
        return out

    def _selection(self, spec: object, profile: str | None) -> list[list[list[Atom]]]:
        """Alternatives, each a list of groups."""
        if isinstance(spec, dict):
            return [[g for k, v in spec.items() for g in self._entry(k, v, profile)]]
        if isinstance(spec, list) and spec and all(isinstance(x, dict) for x in spec):
            return [a for x in spec for a in self._selection(x, profile)]
        return [self._entry(None, spec, profile)]

    def _row(self, r: Rule, profile: str | None) -> dict:
        detection = r.spec["detection"]
        names = [k for k in detection if k != "condition"]
        if len(names) > MOST_SELECTIONS:
            raise _Unfit
        conditions = detection["condition"] if isinstance(detection["condition"], list) else [detection["condition"]]
        holds = truth(conditions, names)
        accepted = [m for m in range(1 << len(names)) if holds([bool(m >> i & 1) for i in range(len(names))])]
        selections = [self._selection(detection[n], profile) for n in names]
        needed = [i for i in range(len(names)) if accepted and all(m >> i & 1 for m in accepted)]
        return {"rule": r, "profile": profile, "accepted": accepted, "selections": selections, "needed": needed}

    # --- gates

    def keys(self, atom: Atom) -> list[Key]:
        """Keys of which any may stand for the atom in the index; none if it can't be looked up."""
        field, kind, text = atom
        if field == "eventid" and kind == "num":
            return [(field, "=", str(int(float(text))))] if float(text).is_integer() else []
        if kind == "exact":
            return [(field, "=", text)]
        if kind in ("prefix", "suffix"):
            return [(field, "^" if kind == "prefix" else "$", text)] if text else []
        chunk = chunk_of(kind, text)
        return [(field, "~", g) for g in grams(chunk)] if chunk else []

    def _seen(self, key: Key) -> tuple[float, float]:
        """How often a key is seen, and a guess for keys that are seen alike: short texts and header fields are common."""
        guess = (1000 if key[0] in ("eventid", "channel", "provider_name", "level") else 1) / len(key[2] or " ")
        return (self.counts.get(key, 0) if self.counts is not None else 0.0, guess)

    def _cost(self, atom: Atom) -> tuple[float, float]:
        seen, guess = min(map(self._seen, self.keys(atom)))
        return seen, 1 / len(chunk_of(*atom[1:])) if chunk_of(*atom[1:]) else guess

    def _gate(self, row: dict) -> list[Atom] | None:
        """Atoms of which a match has at least one: the groups that are rarest, of a needed selection, or of all where one of them must hold."""
        total = lambda group: tuple(map(sum, zip(*map(self._cost, group), strict=True))) or (0, 0)
        # the id of an event is no news where the rule's kinds of event are narrowed to it anyway
        indexed = lambda group: all(map(self.keys, group))
        best = [[min((g for g in alternative if indexed(g)), key=total, default=None) for alternative in s] for s in row["selections"]]
        open_to = lambda s: sorted({a for g in best[s] for a in g}) if None not in best[s] else None
        row["also"] = also = {}
        for s, groups in zip(row["selections"], best, strict=True):
            for alternative, group in zip(s, groups, strict=True):
                for a in group or ():
                    also.setdefault(a, set()).add(self._also(a, group, alternative))
        options = [g for g in map(open_to, row["needed"]) if g is not None]
        if not options and 0 not in row["accepted"]:
            each = [open_to(s) for s in range(len(best)) if any(m >> s & 1 for m in row["accepted"])]
            options = [sorted({a for g in each for a in g})] if each and None not in each else []
        return min(options, key=total) if options else None

    @staticmethod
    def _also(atom: Atom, group: list[Atom], alternative: list[list[Atom]]) -> str | None:
        """The longest text that another group of the alternative wants in the same value, if there is one."""
        inner = {"exact", "prefix", "suffix"}
        others = [g[0] for g in alternative if g is not group and len(g) == 1 and g[0][0] == atom[0]]
        return max((t if k in inner else chunk_of(k, t) for _, k, t in others), key=lambda x: (len(x), x), default="") or None

    # --- tables

    @cached_property
    def kinds_of_event(self) -> list[list[tuple[str | None, int | None]]]:
        """For each row the (channel, event id) that it is for; None is any."""
        out = []
        for row in self.rows:
            mine = []
            for channel, ids, profile in row["rule"].targets:
                if profile == row["profile"]:
                    need = row["rule"].event_ids if not profile else None
                    wanted = ids if need is None else tuple(need) if ids is None else tuple(set(ids) & need)
                    mine += [(channel, i) for i in (wanted if wanted is not None else (None,))]
            out.append(mine)
        return out

    @cached_property
    def index(self) -> list[tuple]:
        """(field, way, text, chunk, n, channel, event_id, also, end): the keys of all gates; chunk and also are what the value must contain besides, end what it must end with."""
        out = []
        for n, row in enumerate(self.rows):
            for atom in row["gate"] or ():
                key = min(self.keys(atom), key=self._seen)
                chunk = chunk_of(*atom[1:]) if key[1] == "~" else None
                also = row["also"][atom]
                for text in [None] if None in also else sorted(also):
                    out += [(*key, chunk if chunk != key[2] else None, n, c, i, text, end_of(*atom[1:])) for c, i in self.kinds_of_event[n]]
        return out

    @cached_property
    def plain_open(self) -> list[Rule]:
        """Rules without a gate that go the way of expressions, one projection for all."""
        some = {row["rule"].id: row["rule"] for row in self.rows if row["gate"] is None}
        return list(some.values()) if len(some) <= MOST_OPEN else []

    @cached_property
    def open_rows(self) -> list[tuple[int, str | None, int | None]]:
        return [] if self.plain_open else [(n, c, i) for n, row in enumerate(self.rows) if row["gate"] is None for c, i in self.kinds_of_event[n]]

    @cached_property
    def specs(self) -> pa.Table:
        atom = pa.struct([("f", pa.string()), ("k", pa.string()), ("t", pa.string())])
        nested = pa.list_(pa.list_(pa.list_(pa.list_(atom))))
        made = [[[[[dict(zip("fkt", a, strict=True)) for a in g] for g in alt] for alt in s] for s in row["selections"]] for row in self.rows]
        tests = [[int(a[2]) for s in row["selections"] for alt in s for g in alt for a in g if a[1] == "test"] for row in self.rows]
        return pa.table({"n": pa.array(range(len(self.rows)), pa.int32()), "rule_id": [row["rule"].id for row in self.rows], "selections": pa.array(made, nested), "accepted": pa.array([row["accepted"] for row in self.rows], pa.list_(pa.int32())), "tests": pa.array(tests, pa.list_(pa.int32()))})

    @cached_property
    def fields(self) -> set[str]:
        return {a[0] for row in self.rows for s in row["selections"] for alt in s for g in alt for a in g if a[1] != "test"}

    @cached_property
    def classic(self) -> set[str]:
        return {_norm(f) for r in self.rules if may_be_classic(r) for f in r.fields}

    @cached_property
    def channels(self) -> set[str | None]:
        return {c for r in self.rules for c, _, _ in r.targets}


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """A table made of the pack: broadcast if its number of rows, which is known, is small enough; else Spark decides."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, zip(*rows, strict=True), strict=True)}))


def _with_values(events: DataFrame, pack: Pack) -> DataFrame:
    """Prepared events of the pack's channels with _vals: (field, v) of the fields that the pack looks at, of a repeated name the first."""
    rows = prepared(events)
    if None not in pack.channels:
        rows = rows.where(F.col("_channel").isin(sorted(pack.channels)))
    used = pack.fields
    plain = sorted(f for f in used if f and not f.startswith(NATIVE))
    extra = [(f, event_field(f, classic=f in pack.classic)) for f in plain if f in HEADER or f in DERIVED or f in pack.classic]
    extra += [(f, F.when((F.col("event_id") == 4688) & (F.col("_channel") == "security"), event_field(f.removeprefix(NATIVE), "security4688"))) for f in sorted(used) if f.startswith(NATIVE)]
    extra += [("", keyword_text())] if "" in used else []
    own = [f for f in plain if f not in {x for x, _ in extra}]
    first = F.transform("ed", lambda p, i: F.when(F.get("_names", i).isin(own) & (F.array_position(F.col("_names"), F.get("_names", i)) == i + 1), F.struct(F.get("_names", i).alias("field"), p["value"].alias("v"))))
    parts = [F.filter(first, lambda x: x.isNotNull())] if own else []
    parts += [F.array(*[F.struct(F.lit(f).alias("field"), c.alias("v")) for f, c in extra])] if extra else []
    made = F.filter(F.concat(*parts), lambda x: x["v"].isNotNull()) if parts else F.array().cast("array<struct<field:string,v:string>>")
    return rows.withColumn("_vals", made)


def event_keys(rows: DataFrame, keys: set[Key]) -> DataFrame:
    """rows once for each key (_f, _way, _text) of its values, of the ways and lengths that the given keys have; _v is the value in lower case."""
    spark = rows.sparkSession
    ways = sorted({(f, way, len(text) if way != "=" else 0) for f, way, text in keys})
    cuts = bounded(table(spark, ways, "_f string, _way string, _n int"), len(ways))
    n, v = F.col("_n"), F.col("_v")
    piece = F.array()
    for size in sorted({k for _, way, k in ways if way == "~"}):
        # all pieces of a length by one pass of a look-ahead over the value
        piece = F.when(n == size, F.regexp_extract_all(v, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))).otherwise(piece.cast("array<string>"))
    way = F.col("_way")
    texts = F.when(way == "=", F.array(v)).when(way == "^", F.array(F.substring(v, F.lit(1), n))).when(way == "$", F.array(F.expr("right(_v, _n)"))).otherwise(F.array_distinct(piece.cast("array<string>")))
    single = exploded(rows, F.col("_vals"), "_x").select("*", F.col("_x.field").alias("_f"), F.lower("_x.v").alias("_v")).drop("_x")
    return exploded(single.join(cuts, "_f").where((way == "=") | (F.length("_v") >= n)), texts, "_text").drop("_n")


def key_counts(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(field, way, text, n): in how many events each key that a gate could stand under occurs; keys that never do are left out.

    What is measured once, on all events or a part of them, can be kept as a table beside the events and serves any
    pack whose keys are in it. It decides which atoms are looked up, never which rows come out.
    """
    pack = Pack(rules)
    keys = {k for row in pack.rows for s in row["selections"] for alt in s for g in alt for a in g for k in pack.keys(a)}
    rows = _with_values(events, pack).select("_vals")
    if not keys:
        return rows.select(*[F.lit("").alias(c) for c in ("field", "way", "text")], F.lit(0).alias("n")).where(F.lit(False))
    wanted = bounded(table(rows.sparkSession, sorted(keys), "_f string, _way string, _text string"), len(keys))
    met = event_keys(rows, keys).join(wanted, ["_f", "_way", "_text"])
    return met.groupBy(F.col("_f").alias("field"), F.col("_way").alias("way"), F.col("_text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def compile_pack(rules: list[Rule], counts: DataFrame | None = None) -> Pack:
    """A pack that can be run again and again. counts: of key_counts, a row for each key of the pack at most that comes to the driver."""
    if counts is None:
        return Pack(rules)
    pack = Pack(rules)
    keys = {k for row in pack.rows for s in row["selections"] for alt in s for g in alt for a in g for k in pack.keys(a)}
    if not keys:
        return pack
    wanted = bounded(table(counts.sparkSession, sorted(keys), "field string, way string, text string"), len(keys))
    known = counts.join(wanted, ["field", "way", "text"]).groupBy("field", "way", "text").agg(F.sum("n").alias("n")).collect()
    return Pack(rules, {(r.field, r.way, r.text): r.n for r in known})


def candidates(events: DataFrame, pack: Pack) -> DataFrame:
    """Prepared events with n, once for each row of the pack whose gate opens (and kind of event fits) and each key that opens it.

    _may: whether the value that opened it has what the rule wants in it besides; if not, the rule can't match this way.
    """
    spark, rows = events.sparkSession, _with_values(events, pack)
    parts = []
    if pack.index:
        gates = bounded(table(spark, pack.index, "_f string, _way string, _text string, _chunk string, n int, _c string, _i int, _also string, _end string"), len(pack.index))
        met = event_keys(rows, {k[:3] for k in pack.index}).join(gates, ["_f", "_way", "_text"])
        fits = (F.col("_c").isNull() | (F.col("_c") == F.col("_channel"))) & (F.col("_i").isNull() | (F.col("_i") == F.col("event_id")))
        met = met.where(fits & (F.col("_chunk").isNull() | F.col("_v").contains(F.col("_chunk"))))
        may = (F.col("_also").isNull() | F.col("_v").contains(F.col("_also"))) & (F.col("_end").isNull() | F.col("_v").endswith(F.col("_end")))
        parts.append(met.select(*rows.columns, "n", may.alias("_may")))
    # rules without a gate are met by the kind of event alone: by channel and id, by either, or by none
    for channel, event_id in ((True, True), (True, False), (False, True), (False, False)):
        some = [x for x in pack.open_rows if (x[1] is not None) == channel and (x[2] is not None) == event_id]
        if some and (channel or event_id):
            free = bounded(table(spark, some, "n int, _c string, _i int"), len(some))
            same = [F.col("_c") == F.col("_channel")] * channel + [F.col("_i") == F.col("event_id")] * event_id
            parts.append(rows.join(free, reduce(Column.__and__, same)).select(*rows.columns, "n", F.lit(True).alias("_may")))
        elif some:
            parts.append(rows.withColumn("n", F.explode(F.array(*[F.lit(n) for n, _, _ in some]))).withColumn("_may", F.lit(True)))
    return reduce(DataFrame.unionByName, parts) if parts else rows.withColumns({"n": F.lit(0), "_may": F.lit(True)}).where(F.lit(False))


def _holds(atom: Column, values: Column, tests: Column) -> Column:
    """Whether an atom holds on an event's values (a map)."""
    v, t, k = F.try_element_at(values, atom["f"]), atom["t"], atom["k"]
    low, number = F.lower(v), lambda: signed_number(v)
    of = {
        "exact": low == t,
        "contains": low.contains(t),
        "prefix": low.startswith(t),
        "suffix": low.endswith(t),
        "like": F.call_function("like", low, t, F.lit("!")),
        "re": F.call_function("rlike", v, t),
        "num": number() == t.cast("double"),
        "gt": number() > t.cast("double"),
        "gte": number() >= t.cast("double"),
        "lt": number() < t.cast("double"),
        "lte": number() <= t.cast("double"),
        "exists": v.isNotNull() == (t == "true"),
        "null": v.isNull() | (v == ""),
        "test": F.array_contains(tests, t.try_cast("int")),
    }
    out = F.lit(False)
    for kind, test in reversed(of.items()):
        out = F.when(k == kind, test).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _decided(values: Column, tests: Column) -> Column:
    """Whether the selections' truth values, as bits, are among the accepted ones."""
    true = lambda s: F.exists(s, lambda alternative: F.forall(alternative, lambda group: F.exists(group, lambda a: _holds(a, values, tests))))
    bits = F.aggregate(F.transform("selections", lambda s, i: F.when(true(s), F.call_function("shiftleft", F.lit(1), i.cast("int"))).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return F.array_contains("accepted", bits)


def detect_packed(events: DataFrame, rules: list[Rule] | Pack, counts: DataFrame | None = None) -> DataFrame:
    """(rule_id, g): the same as detect, for packs of hundreds or thousands of rules, or a Pack made of them before.

    The tables made of the pack are broadcast: their size is that of the pack, not of the data. Events stay where they
    are; what is shuffled is a row for each match, as an event can meet a rule by several keys.
    """
    from .detect import detect

    spark, pack = events.sparkSession, rules if isinstance(rules, Pack) else compile_pack(rules, counts)
    spec = bounded(spark.createDataFrame(pack.specs), len(pack.rows)) if pack.rows else None
    found = []
    if spec is not None:
        met = candidates(events, pack).where("_may").drop("_may").join(spec, "n")
        flags = []
        for (key, _, profile), (i, value) in pack.tests.items():
            # tests that are no matter of a value and a text, tried only for rules that have them
            name, *mods = (key or "").split("|")
            flags.append(F.when(F.array_contains("tests", i), F.when(field_test(name or None, mods, value, profile, bool(pack.classic)), i)))
        for k in range(0, len(flags), 40):
            met = met.withColumn(f"_t{k}", F.array_compact(F.array(*flags[k : k + 40])))
        tests = [F.col(f"_t{k}") for k in range(0, len(flags), 40)]
        held = F.concat(*tests) if tests else F.array().cast("array<int>")
        # the map is made once for each candidate
        decided = F.get(F.transform(F.array(F.map_from_entries("_vals")), lambda m: _decided(m, held)), F.lit(0))
        found.append(met.where(decided).select("rule_id", "g"))
    if rest := {r.id: r for r in [*[r for r, _ in pack.left], *pack.plain_open]}:
        found.append(detect(events, list(rest.values()), gated=False))
    if not found:
        return events.select(F.lit("").alias("rule_id"), "g").where(F.lit(False))
    return reduce(DataFrame.unionByName, found).distinct()


def synthetic_pack(n: int) -> list[dict]:
    """n rules of the shapes that published packs have, over made-up values, for load tests: half of them on process creation.

    Of fifty, one asks for all of several texts, one has wildcards, one a regular expression and one a number; of 250, one
    has nothing that a gate could be made of.
    """
    out = []
    tools = [f"tool{i}" for i in range(400)]
    for i, (a, b) in zip(range(n), itertools.cycle(itertools.product(range(97), range(89))), strict=False):
        process = i % 2 == 0
        selection = {"Image|endswith": [f"\\{tools[i % 400]}.exe", f"\\alt{i}.exe"], "CommandLine|contains": [f" --opt{a} ", f"-x{b}", f"/key{i}"]} if process else {"EventID": [4624, 4625, 4688, 7045][i % 4], "TargetUserName": [f"user{i}", f"svc{a}"]}
        detection = {"selection": selection, "filter": {"ParentImage|startswith" if process else "IpAddress|startswith": f"C:\\ok{b}" if process else f"172.{b}."}, "condition": "selection and not filter"}
        special = {
            0: {"CommandLine|contains|all": ["net user", f"user{i % 150}", "/add"]},
            10: {"CommandLine": f"*tool.exe --n ?{i // 50 % 10}"},
            20: {"CommandLine|re": rf"--n {i // 50 % 10}\d$"},
            31: {"EventID": 4624, "LogonType|gte": 3 + i // 50 % 9, "TargetUserName|endswith": f"{i // 50 % 10}"},
        }.get(i % 50)
        special = {"IpAddress|exists": False, "LogonType|gte": i // 250} if i % 250 == 41 else special
        detection = {"selection": special, "condition": "selection"} if special else detection
        out.append({"id": f"load-{i}", "title": f"load {i}", "level": "low", "logsource": {"product": "windows", "category": "process_creation"} if process else {"product": "windows", "service": "security"}, "detection": detection})
    return out
