"""Running many detection rules over many events."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import canonical_channel, exploded
from .logsource import targets
from .rules import LEVELS, MAPPED, SPECIAL, Rule, Unsupported, _norm, compile_rule, event_field, like_pattern, may_be_classic, prepared, rule_columns

#: Rules whose predicates share one projection; more in one make code that Spark no longer compiles well.
GROUP = 50
#: A pack of more rules is run as rows of a table instead of expressions; both ways give the same rows.
PACKED_FROM = 200


def compile_rules(specs: list[dict]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules that can run, and (id, reason) of those that can't. Of rules with the same id the first counts."""
    rules, skipped, seen = [], [], set()
    for spec in specs:
        key = str(spec.get("id") or spec.get("title"))
        if str(spec.get("status", "")).lower() in ("deprecated", "unsupported"):
            skipped.append((key, f"status {spec['status']}"))
        elif key in seen:
            skipped.append((key, "duplicate id"))
        else:
            try:
                rules.append(compile_rule(spec))
                seen.add(key)
            except Unsupported as e:
                skipped.append((key, str(e)))
    return rules, skipped


def skipped_table(spark: SparkSession, skipped: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(skipped, "rule_id string, reason string")


def skipped_reach(events: DataFrame, specs: list[dict]) -> DataFrame:
    """(rule_id, reason_kind, events): what is not looked at because rules can't run: the events of the kinds that each skipped rule is for.

    reason_kind is `log source` where the kinds themselves are not known, else `rule`. Events are counted by kind first,
    so what meets the rules is a row for each kind of event.
    """
    skipped = {key for key, _ in compile_rules(specs)[1]}
    rows = []
    for spec in {str(s.get("id") or s.get("title")): s for s in specs if str(s.get("id") or s.get("title")) in skipped}.values():
        found, why = targets(spec.get("logsource") or {})
        key, kind = str(spec.get("id") or spec.get("title")), "log source" if why else "rule"
        rows += [(key, kind, c, i) for c, ids, _ in found for i in (ids or (None,))] or [(key, kind, "", -1)]
    kinds = events.groupBy(canonical_channel().alias("_channel"), "event_id").agg(F.count(F.lit(1)).alias("n"))
    table = events.sparkSession.createDataFrame(rows, "rule_id string, reason_kind string, c string, i int")
    fits = (F.col("c").isNull() | (F.col("c") == F.col("_channel"))) & (F.col("i").isNull() | (F.col("i") == F.col("event_id")))
    return table.join(kinds, fits, "left").groupBy("rule_id", "reason_kind").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def buckets(rules: list[Rule]) -> dict[tuple, list[Rule]]:
    """Rules by (channel, event ids, profile) of each of their targets, narrowed to the ids that the detection requires."""
    out = defaultdict(list)
    for r in rules:
        for channel, ids, profile in r.targets:
            need = r.event_ids if ids is None else frozenset(ids) if r.event_ids is None or profile else frozenset(ids) & r.event_ids
            if need is None or need:
                out[channel, need and tuple(sorted(need)), profile].append(r)
    return dict(out)


def _of_kind(channel: str | None, ids: tuple[int, ...] | None) -> Column:
    test = F.col("event_id").isin(*ids) if ids else F.lit(True)
    return test & (F.col("_channel") == channel) if channel else test


def _matches(rows: DataFrame, rules: list[Rule], only: Column | None = None) -> DataFrame:
    """(rule_id, g) of the prepared rows that each rule's predicate holds on; only: a set of rule ids that is looked into for each row.

    A selection is tried on the kinds of event that its rule is for, and on no other row.
    """
    selections, flags = {}, []
    for j, r in enumerate(rules):
        kinds = defaultdict(list)
        for channel, ids, profile in buckets([r]):
            kinds[profile].append(_of_kind(channel, ids))
        held = F.lit(False)
        for k, (profile, tests) in enumerate(kinds.items()):
            kind = reduce(Column.__or__, tests)
            columns, text = rule_columns(r, profile, f"r{j}_{k}_")
            selections |= {n: F.when(kind, c).otherwise(F.lit(False)) for n, c in columns.items()} | {f"r{j}_{k}": kind}
            held = held | (F.col(f"r{j}_{k}") & F.expr(text))
        flags.append(F.when(held if only is None else F.array_contains("_only", r.id) & held, r.id))
    base = [F.col("g")] if only is None else [F.col("g"), only.alias("_only")]
    tried = rows.select(*base, *[c.alias(n) for n, c in selections.items()]).select("g", F.array_compact(F.array(*flags)).alias("_found"))
    return exploded(tried, F.col("_found"), "rule_id").select("rule_id", "g")


# --- literal gates -------------------------------------------------------------


def gate(rule: Rule) -> list[tuple[str, str, str]] | None:
    """Literals (field, kind, literal) of which a matching event must have at least one, or None if there is no such list.

    Taken from one selection that the condition surely needs: an entry whose values are plain text without `all`.
    """
    detection = rule.spec["detection"]
    conditions = detection["condition"] if isinstance(detection["condition"], list) else [detection["condition"]]
    found = []
    for c in conditions:
        words = c.replace("(", " ( ").replace(")", " ) ").split()
        low = [w.lower() for w in words]
        if "or" in low or "(" in low or "of" in low:
            return None
        needed = [w for i, w in enumerate(words) if low[i] not in ("and", "not") and (i == 0 or low[i - 1] != "not")]
        best = None
        for name in needed:
            spec = detection.get(name)
            for key, value in spec.items() if isinstance(spec, dict) else ():
                literals = _literals(key, value)
                if literals and (best is None or min(len(x[2]) for x in literals) > min(len(x[2]) for x in best)):
                    best = literals
        if best is None:
            return None
        found += best
    return found


def _literals(key: str, value: object) -> list[tuple[str, str, str]] | None:
    name, *mods = key.split("|")
    kind = {(): "exact", ("contains",): "contains", ("startswith",): "prefix", ("endswith",): "suffix"}.get(tuple(m.lower() for m in mods))
    items = value if isinstance(value, list) else [value]
    if kind is None or not name or name.lower().replace(" ", "") in ("eventid", "channel") or not items or not all(isinstance(x, str) and x and not like_pattern(x)[1] and "\\\\" not in x for x in items):
        return None
    return [(name.lower(), kind, x.lower()) for x in items]


def _candidates(rows: DataFrame, rules: list[Rule], gates: dict[str, list], profile: str | None) -> DataFrame:
    """(g, rule_id) of the rules with a gate that opens on the row.

    Exact, prefix and suffix literals are equal to a value or its end, so they meet by hash joins; contained ones by one
    join on the distinct literals. The literals are those of the rule pack, not of the data, and are broadcast.
    """
    spark, parts, classic = rows.sparkSession, [], any(map(may_be_classic, rules))
    atoms = defaultdict(set)
    for r in rules:
        for f, kind, lit in gates[r.id]:
            atoms[f, kind].add((lit, r.id))
    for (f, kind), pairs in atoms.items():
        table = F.broadcast(spark.createDataFrame(sorted(pairs), "lit string, rule_id string"))
        # an element of an array, since a test of the value itself would be pushed down to the scan and make it once more
        value = exploded(rows.select("g", F.array(F.lower(event_field(f, profile, classic))).alias("_v")), F.col("_v"), "v").select("g", "v")
        if kind == "contains":
            parts.append(value.join(table, F.col("v").contains(F.col("lit"))).select("g", "rule_id"))
            continue
        lengths = sorted({len(lit) for lit, _ in pairs})
        cut = {"exact": lambda n: F.col("v"), "prefix": lambda n: F.substring("v", 1, n), "suffix": lambda n: F.expr(f"right(v, {n})")}[kind]
        keys = F.array_distinct(F.array(*[cut(n) for n in (lengths if kind != "exact" else [0])]))
        parts.append(exploded(value, keys, "lit").join(table, "lit").select("g", "rule_id"))
    return reduce(DataFrame.unionByName, parts)


def detect(events: DataFrame, rules: list[Rule], gated: bool | None = None) -> DataFrame:
    """(rule_id, g), one row per rule and event that it matches.

    What rules look at is made once for each event, and events of kinds that no rule is for go first. Rules are tried in
    projections of GROUP rules, each on its own kinds of event; up to that many need one pass over the input and no
    shuffle. With gated, each row first gets the list of rules whose literals it has, and only these are tried on it.
    Large packs go to detect_packed, unless gated says which way. All ways give the same rows.
    """
    if gated is None and len(rules) > PACKED_FROM:
        from .packed import detect_packed

        return detect_packed(events, rules)
    kinds = buckets(rules)
    if not kinds:
        return events.select(F.lit("").alias("rule_id"), "g").where(F.lit(False))
    rows = prepared(events).where(reduce(Column.__or__, [_of_kind(c, i) for c, i in dict.fromkeys((c, i) for c, i, _ in kinds)]))
    if not gated:
        return reduce(DataFrame.unionByName, [_matches(rows, rules[i : i + GROUP]) for i in range(0, len(rules), GROUP)])
    parts, opened = [], []
    gates = {r.id: g for r in rules if (g := gate(r))}
    for (channel, ids, profile), some in kinds.items():
        if held := [r for r in some if r.id in gates]:
            opened.append(_candidates(rows.where(_of_kind(channel, ids)), held, gates, profile))
    if opened:
        lists = reduce(DataFrame.unionByName, opened).groupBy("g").agg(F.collect_set("rule_id").alias("_c"))
        held = [r for r in rules if r.id in gates]
        parts += [_matches(rows.join(lists, "g"), held[i : i + GROUP], F.col("_c")) for i in range(0, len(held), GROUP)]
    rest = [r for r in rules if r.id not in gates]
    parts += [_matches(rows, rest[i : i + GROUP]) for i in range(0, len(rest), GROUP)]
    return reduce(DataFrame.unionByName, parts)


# --- what matches are shown with --------------------------------------------------


def tactics_of(tags: Column) -> Column:
    own = F.transform(F.filter(tags, lambda t: F.lower(t).startswith("attack.")), lambda t: F.substring(F.lower(t), 8, 1000))
    return F.transform(F.filter(own, lambda t: ~t.rlike(r"^t\d{4}(\.\d{3})?$") & ~t.rlike(r"^[gs]\d{4}$")), lambda t: F.replace(t, F.lit("_"), F.lit("-")))


def techniques_of(tags: Column) -> Column:
    own = F.transform(F.filter(tags, lambda t: F.lower(t).startswith("attack.")), lambda t: F.substring(F.lower(t), 8, 1000))
    return F.transform(F.filter(own, lambda t: t.rlike(r"^t\d{4}(\.\d{3})?$")), F.upper)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Metadata of the rules: id, title, level, status, author, tags, techniques, tactics, attribution."""
    rows = [(r.id, r.title, r.level, r.spec.get("status"), (r.spec.get("author") or "").strip() or "unknown author", [str(t) for t in r.spec.get("tags") or []], r.spec.get("source"), r.spec.get("path"), r.fields) for r in rules]
    t = spark.createDataFrame(rows, "rule_id string, title string, level string, status string, author string, tags array<string>, source string, path string, fields array<string>")
    return t.withColumns({"techniques": techniques_of(F.col("tags")), "tactics": tactics_of(F.col("tags")), "attribution": F.concat(F.lit("Rule by "), F.col("author"), F.coalesce(F.concat(F.lit(", "), F.col("source")), F.lit("")))})


def with_rule_url(rules: DataFrame, base_url: str) -> DataFrame:
    """rules with url: where a pack publishes them; base_url ends before the rule's path."""
    return rules.withColumn("url", F.when(F.col("path").isNotNull(), F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("path"))))


def level_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[x for i, v in enumerate(LEVELS) for x in (F.lit(v), F.lit(i))]), level)


def rule_results(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with a match and their number of events: gravest level first, then most events, then title."""
    n = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("events"))
    return n.join(rules, "rule_id").orderBy(level_rank(F.col("level")), F.desc("events"), "title", "rule_id")


def run_totals(events: DataFrame, matches: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: rules evaluated, rules matched, events, events matched."""
    m = matches.agg(F.countDistinct("rule_id").alias("rules_matched"), F.countDistinct("g").alias("events_matched"))
    return m.join(events.agg(F.count(F.lit(1)).alias("events"))).withColumn("rules", F.lit(len(rules)))


def narrowed(matches: DataFrame, rules: DataFrame, levels: list[str] = (), tactic: str | None = None, text: str = "") -> DataFrame:
    """Matches of rules of these levels, with this tactic, whose title holds the text."""
    r = rules.where(F.col("level").isin(list(levels))) if levels else rules
    r = r.where(F.array_contains("tactics", tactic)) if tactic else r
    r = r.where(F.lower("title").contains(text.lower())) if text else r
    return matches.join(r.select("rule_id"), "rule_id", "left_semi")


def level_counts(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """(level, rules, events): rules and different events matched on each level."""
    return matches.join(rules.select("rule_id", "level"), "rule_id").groupBy("level").agg(F.countDistinct("rule_id").alias("rules"), F.countDistinct("g").alias("events"))


def first_events(matches: DataFrame, events: DataFrame, n: int = 200) -> DataFrame:
    """(rule_id, g, ts, rank): the first n events of each rule by time."""
    timed = matches.join(events.select("g", "ts"), "g")
    return timed.withColumn("rank", F.row_number().over(Window.partitionBy("rule_id").orderBy("ts", "g"))).where(F.col("rank") <= n)


def key_fields(matches: DataFrame, events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, g, key_fields): name=value of the fields that the rule tests and the event has, joined by ` | `.

    A rule's fields are a list in its row, looked up in the event, so the plan is one join whatever the pack. Of an event
    only the values that some rule names are moved.
    """
    rows = [(r.id, [(f, _norm(f)) for f in r.fields], any(p for _, _, p in r.targets)) for r in rules]
    table = matches.sparkSession.createDataFrame(rows, "rule_id string, _fields array<struct<name:string,key:string>>, _native boolean")
    used = sorted({k for _, fs, _ in rows for _, k in fs})
    own = {k: event_field(k) for k in used if k in SPECIAL}
    mapped = {k: F.when(F.col("event_id") == 4688, event_field(k, "security4688")) for k in used if k in MAPPED}
    as_map = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)]) if m else F.lit(None).cast("map<string,string>")
    named = F.transform("ed", lambda p, i: F.when(F.get("_names", i).isin(used), F.struct(F.get("_names", i).alias("key"), p["value"].alias("value"))))
    pairs = F.filter(named, lambda x: x.isNotNull())
    joined = matches.join(prepared(events).select("g", pairs.alias("_pairs"), as_map(own).alias("_own"), as_map(mapped).alias("_mapped")), "g").join(table, "rule_id")

    def text(f: Column) -> Column:
        pair = F.get(F.filter("_pairs", lambda p: p["key"] == f["key"]), F.lit(0))["value"]
        value = F.coalesce(F.when(F.col("_native"), F.try_element_at("_mapped", f["key"])), F.try_element_at("_own", f["key"]), pair)
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(f["name"], F.lit("="), value))

    return joined.select("rule_id", "g", F.array_join(F.filter(F.transform("_fields", text), lambda x: x.isNotNull()), " | ").alias("key_fields"))


def rule_targets(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, level, channel, event_id): the kinds of event that rules are made for; null is any."""
    rows = [(r.id, r.level, c, i) for r in rules for c, ids, _ in r.targets for i in (ids or r.event_ids or [None])]
    return spark.createDataFrame(rows, "rule_id string, level string, channel string, event_id int")


def rules_per_event_type(event_types: DataFrame, targets: DataFrame) -> DataFrame:
    """(channel, event_id, level, rules) for a table of event types; rules that target a whole channel are left out."""
    t = targets.where("channel is not null and event_id is not null").select(F.col("rule_id"), F.col("level"), F.col("channel").alias("_c"), F.col("event_id").alias("_i"))
    e = event_types.select("channel", "event_id").distinct()
    return e.join(t, (F.lower("channel") == F.col("_c")) & (F.col("event_id") == F.col("_i"))).groupBy("channel", "event_id", "level").agg(F.countDistinct("rule_id").alias("rules"))
