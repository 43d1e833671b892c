"""Detection rules: structured specs compiled to Columns.

A rule is a dict as read from YAML: id, title, level, logsource, detection. Selections become boolean columns and the
condition text, with each selection's name put in place of its column, is parsed by Spark SQL itself.
"""

from __future__ import annotations

import base64
import ipaddress
import itertools
import re
from dataclasses import dataclass, field as dc_field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import canonical_channel, classic_field, compact_name, data_blob, hash_of, keyword_text, process_field, signed_number
from .logsource import Target, targets

LEVELS = ("critical", "high", "medium", "low", "informational")
MODIFIERS = {"contains", "startswith", "endswith", "all", "cased", "re", "i", "m", "s", "exists", "gt", "gte", "lt", "lte", "cidr", "fieldref", "base64", "base64offset", "utf16le", "wide", "utf16be", "utf16", "windash"}
#: Fields that are more than a pair of the event: header columns, parts of others, and names that 4688 has its own fields for.
HEADER = ("eventid", "channel", "provider_name", "eventrecordid", "computer", "computername", "level")
DERIVED = ("md5", "sha1", "sha256", "imphash", "data")
SPECIAL = HEADER + DERIVED
MAPPED = ("image", "parentimage", "processid", "parentprocessid", "logonid", "integritylevel", "user")
CLASSIC = "windows powershell"
#: Conditions over more selections than this are not worked out as a table.
MOST_TABLE = 12
DASHES = ("-", "/", "–", "—", "―")


class Unsupported(ValueError):
    """Why a rule cannot run."""


@dataclass
class Rule:
    id: str
    title: str
    level: str
    spec: dict
    targets: list[Target]
    event_ids: frozenset[int] | None
    fields: list[str] = dc_field(default_factory=list)


def normal_level(level: object) -> str:
    x = str(level or "").lower()
    return x if x in LEVELS else "informational"


def _norm(name: str) -> str:
    return re.sub(r"\s+", "", name.lower())


def prepared(events: DataFrame) -> DataFrame:
    """events with what all rules look at, made once: `_names` (of the pairs, normalised) and `_channel`."""
    return events.withColumns({"_names": F.transform("ed", lambda p: compact_name(p["name"])), "_channel": canonical_channel()})


def _pair(name: str) -> Column:
    """The value of the first pair of a name, on prepared events."""
    return F.get("ed", F.array_position("_names", name).cast("int") - 1)["value"]


def event_field(name: str, profile: str | None = None, classic: bool = True) -> Column:
    """The value of a rule's field on a prepared event, null if absent; classic: whether lines of classic PowerShell events are fields too."""
    n = _norm(name)
    if profile == "security4688" and (mapped := process_field(n, _pair)) is not None:
        return mapped
    header = {"eventid": F.col("event_id").cast("string"), "channel": F.col("channel"), "provider_name": F.col("provider"), "eventrecordid": F.col("record_id").cast("string")}
    if n in header:
        return header[n]
    options = [_pair(n)]
    if n == "data":
        options.append(data_blob())
    if n in ("computer", "computername"):
        options.append(F.col("computer"))
    if n == "level":
        options.append(F.col("level").cast("string"))
    if n in ("md5", "sha1", "sha256", "imphash"):
        options.append(hash_of(n, _pair("hashes")))
    if classic:
        options.append(F.when(F.col("_channel") == CLASSIC, classic_field(n)))
    return F.coalesce(*options)


# --- values -----------------------------------------------------------------


def like_pattern(value: str) -> tuple[str, bool]:
    """A value with * and ? (escaped by a backslash) as a LIKE pattern with escape !, and whether it has wildcards."""
    out, wild = [], False
    for m in re.finditer(r"\\([*?\\])|(.)", value, re.S):
        if m[1] is not None:
            out.append(_escape(m[1]))
        elif m[2] in "*?":
            wild = True
            out.append("%" if m[2] == "*" else "_")
        else:
            out.append(_escape(m[2]))
    return "".join(out), wild


def _escape(text: str) -> str:
    return re.sub(r"([!%_])", r"!\1", text)


def _unescape(pattern: str) -> str:
    return re.sub(r"!([!%_])", r"\1", pattern)


def windash(value: str) -> list[str]:
    at = [m.start() for m in re.finditer(r"(?<![0-9A-Za-z_])[-/](?=[0-9A-Za-z_])", value)]
    if not at:
        return [value]
    combos = [(d,) * len(at) for d in DASHES] if len(at) > 4 else itertools.product(DASHES, repeat=len(at))
    out = [value]
    for dashes in combos:
        text = list(value)
        for i, d in zip(at, dashes, strict=True):
            text[i] = d
        out.append("".join(text))
    return list(dict.fromkeys(out if len(at) <= 4 else out[1:]))


def encoded(value: str, mods: set[str]) -> list[str]:
    kind = "utf-16-le" if mods & {"utf16le", "wide"} else "utf-16-be" if "utf16be" in mods else "utf-16-le" if "utf16" in mods else "utf-8"
    raw = (b"\xff\xfe" if "utf16" in mods and not mods & {"utf16le", "wide", "utf16be"} else b"") + value.encode(kind)
    if "base64offset" not in mods:
        return [base64.b64encode(raw).decode()]
    # of each shift only the characters that neighbours cannot change
    whole = [base64.b64encode(b" " * i + raw).decode() for i in range(3)]
    return [w[(0, 2, 3)[i] : (None, -3, -2)[(len(raw) + i) % 3]] for i, w in enumerate(whole)]


def java_regex(pattern: str, mods: set[str]) -> str:
    flags = {m for m in "ims" if m in mods}
    if inline := re.match(r"\(\?([imsx]+)\)", pattern):
        flags |= set(inline[1]) - {"x"}
        pattern = pattern[inline.end() :]
    pattern = re.sub(r"\(\?P<([A-Za-z_]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"\(\?P=([A-Za-z_]\w*)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", pattern)
    try:
        re.compile(re.sub(r"\\k<(\w+)>", r"(?P=\1)", re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)))
    except re.error as e:
        raise Unsupported(f"regular expression {pattern!r} does not compile: {e}") from None
    return (f"(?{''.join(sorted(flags))})" if flags else "") + pattern


def network(text: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    try:
        return ipaddress.ip_network(text, strict=False)
    except ValueError:
        raise Unsupported(f"{text} is no network") from None


def _let(x: Column, use) -> Column:
    """use(x), with x made once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _v6_digits(v: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in lower case, null if it is none; the last two groups may be an IPv4 address."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    tail = rf"^(.*:){octet}\.{octet}\.{octet}\.{octet}$"
    part = lambda i: F.regexp_extract(v, tail, i)
    pair = lambda i: F.lower(F.hex(part(i).try_cast("int") * 256 + part(i + 1).try_cast("int")))
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda x: x != "")

    def whole(halves: Column) -> Column:
        first, second = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        gap = 8 - F.size(first) - F.size(second)
        return F.when(F.size(halves) == 2, F.when(gap > 0, F.concat(first, F.array_repeat(F.lit("0"), gap), second))).when(F.size(halves) == 1, first)

    def digits(w: Column) -> Column:
        fine = lambda x: (F.size(x) == 8) & F.forall(x, lambda y: y.rlike("^[0-9a-f]{1,4}$"))
        joined = lambda x: F.when(fine(x), F.array_join(F.transform(x, lambda y: F.lpad(y, 4, "0")), ""))
        return F.when(~w.rlike("^:[^:]|[^:]:$|:::"), _let(whole(F.split(w, "::")), joined))

    return _let(F.when(v.rlike(tail), F.concat(part(1), pair(2), F.lit(":"), pair(4))).otherwise(v), digits)


def cidr(value: Column, text: str) -> Column:
    """Whether an address lies in a network, in expressions; mapped addresses, brackets and zones included."""
    net = network(text)
    v = F.regexp_replace(F.lower(F.trim(value)), r"^\[|\](?=$)|%.*$", "")
    if net.version == 6:
        want, n = f"{int(net.network_address):032x}", net.prefixlen

        def inside(digits: Column) -> Column:
            test = digits.startswith(want[: n // 4])
            nibble = F.conv(F.substring(digits, n // 4 + 1, 1), 16, 10).cast("int")
            return test & (F.shiftright(nibble, 4 - n % 4) == int(want[n // 4], 16) >> (4 - n % 4)) if n % 4 else test

        return F.coalesce(F.when(value.contains(":"), _let(v, lambda x: _let(_v6_digits(x), inside))), F.lit(False))
    v = F.regexp_replace(v, "^::ffff:(?=[0-9.]+$)", "")
    parts = F.split(v, r"\.")
    n = reduce(lambda a, i: a * 256 + F.get(parts, F.lit(i)).try_cast("long"), range(4), F.lit(0).cast("long"))
    low = int(net.network_address)
    return F.coalesce(v.rlike(r"^(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])(\.(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])){3}$") & F.when(v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), n.between(low, low + net.num_addresses - 1)), F.lit(False))


# --- selections ---------------------------------------------------------------


def _text_test(v: Column, pattern: str, mods: set[str], wild: bool) -> Column:
    """pattern is a LIKE pattern in the case that v is in."""
    plain = _unescape(pattern) if not wild else None
    if plain is not None:
        if "contains" in mods:
            return v.contains(plain)
        if "startswith" in mods and "endswith" in mods:
            return v.contains(plain)
        if "startswith" in mods:
            return v.startswith(plain)
        if "endswith" in mods:
            return v.endswith(plain)
        return v == plain
    before = "%" if mods & {"contains", "endswith"} and not pattern.startswith("%") else ""
    after = "%" if mods & {"contains", "startswith"} and not pattern.endswith("%") else ""
    return F.call_function("like", v, F.lit(before + pattern + after), F.lit("!"))


def check_entry(name: str | None, mods: list[str], value: object) -> tuple[set[str], list]:
    """Modifiers and values of one entry, or Unsupported with the reason; plain Python, so that large packs are checked fast."""
    kinds = {m.lower() for m in mods}
    if "expand" in kinds:
        raise Unsupported("values of `expand` come from placeholders, which a spec does not hold")
    if unknown := kinds - MODIFIERS:
        raise Unsupported(f"unknown modifier {sorted(unknown)[0]} of {name or 'keywords'}")
    items = value if isinstance(value, list) else [value]
    if any(isinstance(x, dict | list) for x in items):
        raise Unsupported("a value is nested; only single values and flat lists are tested")
    if name is None and kinds & {"exists", "fieldref"}:
        raise Unsupported(f"keywords cannot take {min(kinds & {'exists', 'fieldref'})}")
    if "exists" in kinds:
        return kinds, items
    for x in items:
        if x is None:
            if name is None:
                raise Unsupported("a keyword is null")
        elif op := kinds & {"gt", "gte", "lt", "lte"}:
            try:
                operand(x)
            except ValueError:
                raise Unsupported(f"{min(op)} needs a number, {x!r} is none") from None
        elif "cidr" in kinds:
            network(str(x))
        elif "re" in kinds:
            java_regex(str(x), kinds)
        elif kinds & {"utf16le", "wide", "utf16be", "utf16"} and not kinds & {"base64", "base64offset"}:
            raise Unsupported("utf16 text is looked for inside base64 only")
    return kinds, items


def operand(x: object) -> float:
    return float(int(str(x), 16) if re.match(r"(?i)^\s*-?0x", str(x)) else str(x))


def check_selection(spec: object) -> None:
    if isinstance(spec, dict):
        if not spec:
            raise Unsupported("a selection has no entries")
        for k, v in spec.items():
            check_entry(k.split("|")[0] or None, k.split("|")[1:], v)
    elif isinstance(spec, list) and spec and all(isinstance(x, dict) for x in spec):
        for x in spec:
            check_selection(x)
    else:
        check_entry(None, [], spec)


def field_test(name: str | None, mods: list[str], value: object, profile: str | None = None, classic: bool = True) -> Column:
    """One entry `name|mods: value(s)` of a selection; name None searches the keyword text. Never null."""
    kinds, items = check_entry(name, mods, value)
    if not items:
        return F.lit(False)
    v = keyword_text() if name is None else event_field(name, profile, classic)
    if "exists" in kinds:
        return v.isNotNull() if str(items[0]).lower() == "true" else v.isNull()
    tests = [F.coalesce(_value_test(v, name, kinds, x, profile, classic), F.lit(False)) for x in items]
    plain = not kinds and name is not None and all(isinstance(x, str) and not like_pattern(x)[1] for x in items)
    if plain and len(items) > 1:
        return F.coalesce(F.lower(v).isin([_unescape(like_pattern(x)[0]).lower() for x in items]), F.lit(False))
    return reduce(Column.__and__ if "all" in kinds else Column.__or__, tests)


def _value_test(v: Column, name: str | None, kinds: set[str], x: object, profile: str | None, classic: bool) -> Column:
    if x is None:
        return v.isNull() | (v == "")
    if op := kinds & {"gt", "gte", "lt", "lte"}:
        n, a = operand(x), signed_number(v)
        return {"gt": a > n, "gte": a >= n, "lt": a < n, "lte": a <= n}[min(op)]
    if "cidr" in kinds:
        return cidr(v, str(x))
    if "re" in kinds:
        return v.rlike(java_regex(str(x), kinds))
    if "fieldref" in kinds:
        a, b = F.lower(v), F.lower(event_field(str(x), profile, classic))
        return a.contains(b) if "contains" in kinds else a.startswith(b) if "startswith" in kinds else a.endswith(b) if "endswith" in kinds else a == b
    texts = [str(x).lower() if isinstance(x, bool) else str(x)]
    if "windash" in kinds:
        texts = [t for s in texts for t in windash(s)]
    wildcards = not kinds & {"base64", "base64offset"}
    if not wildcards:
        texts = [t for s in texts for t in encoded(s, kinds)]
    mods = kinds | ({"contains"} if name is None else set())
    read = v if "cased" in kinds else F.lower(v)
    tests = []
    for t in texts:
        pattern, wild = like_pattern(t) if wildcards else (_escape(t), False)
        tests.append(_text_test(read, pattern if "cased" in kinds else pattern.lower(), mods, wild))
    if isinstance(x, int | float) and not isinstance(x, bool) and not mods & {"contains", "startswith", "endswith"}:
        tests.append(signed_number(v) == float(x))
    return reduce(Column.__or__, tests)


def selection(spec: object, profile: str | None = None, classic: bool = True) -> Column:
    """A map is the AND of its entries, a list of maps their OR, anything else keywords."""
    if isinstance(spec, dict):
        order = sorted(spec.items(), key=lambda kv: _norm(kv[0].split("|")[0]) not in ("eventid", "channel"))
        return reduce(Column.__and__, [field_test(k.split("|")[0] or None, k.split("|")[1:], v, profile, classic) for k, v in order])
    if isinstance(spec, list) and spec and all(isinstance(x, dict) for x in spec):
        return reduce(Column.__or__, [selection(x, profile, classic) for x in spec])
    return field_test(None, [], spec)


# --- conditions ---------------------------------------------------------------

_WORD = re.compile(r"\(|\)|[^\s()|]+|\|")


def _names(pattern: str, selections: list[str]) -> list[str]:
    if pattern.lower() == "them":
        return [s for s in selections if not s.startswith("_")]
    return [s for s in selections if re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), s)]


def rewritten(condition: str, selections: list[str], prefix: str = "s") -> str:
    """The condition as SQL text over columns prefix0, prefix1 ... of the selections, `n of` expanded; Spark parses the rest.

    What is no well-formed condition is Unsupported: operands and operators must take turns, parentheses must pair up.
    """
    if "|" in condition:
        raise Unsupported("aggregation: the condition counts or groups events, a rule is about one")
    words, out, i, depth, open_ = _WORD.findall(condition), [], 0, 0, True
    ref = {s: f"{prefix}{k}" for k, s in enumerate(selections)}
    while i < len(words):
        w = words[i].lower()
        if w == "near":
            raise Unsupported("near: the condition relates events in time, a rule is about one")
        if w in ("and", "or", ")") and open_:
            raise Unsupported(f"{words[i]} at place {i + 1} of the condition follows no selection")
        if w not in ("and", "or", ")") and not open_:
            raise Unsupported(f"{words[i]} at place {i + 1} of the condition follows a selection without and, or")
        depth += (w == "(") - (w == ")")
        if depth < 0:
            raise Unsupported("a parenthesis of the condition is closed but not opened")
        step = 1
        if i + 2 < len(words) and words[i + 1].lower() == "of" and (w in ("all", "any") or w.isdigit()):
            names = _names(words[i + 2], selections)
            if not names:
                raise Unsupported(f"{words[i + 2]} stands for no selection")
            cols = [ref[n] for n in names]
            if w == "all":
                out.append("(" + " AND ".join(cols) + ")")
            elif w in ("any", "1"):
                out.append("(" + " OR ".join(cols) + ")")
            else:
                out.append("(" + " + ".join(f"CAST({c} AS INT)" for c in cols) + f" >= {int(w)})")
            step = 3
        elif w in ("and", "or", "not", "(", ")"):
            out.append(w.upper())
        elif words[i] in ref:
            out.append(ref[words[i]])
        else:
            raise Unsupported(f"unknown selection {words[i]}")
        open_ = w in ("and", "or", "not", "(")
        i += step
    if not out:
        raise Unsupported("the condition is empty")
    if depth or open_:
        raise Unsupported("a parenthesis of the condition is not closed" if depth else "the condition ends before its last selection")
    return " ".join(out)


def _required_ids(spec: object) -> frozenset[int] | None:
    """Event ids that a selection asks for, None if any."""
    if isinstance(spec, list) and spec and all(isinstance(x, dict) for x in spec):
        each = [_required_ids(x) for x in spec]
        return None if None in each else frozenset().union(*each)
    if isinstance(spec, dict):
        for k, v in spec.items():
            if _norm(k) == "eventid":
                try:
                    return frozenset(int(x) for x in (v if isinstance(v, list) else [v]))
                except (TypeError, ValueError):
                    return None
    return None


def truth(conditions: list[str], names: list[str]):
    """A function from selections' truth values to the condition's: the SQL text, with its operators in lower case, is Python too.

    rewritten lets nothing through but column names, and, or, not, parentheses, counts and sums of its own.
    """
    text = " or ".join(f"({rewritten(c, names, 'x_')})" for c in conditions)
    text = re.sub(r"CAST\((x_\d+) AS INT\)", r"int(\1)", text)
    code = compile(re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[1].lower(), text), "condition", "eval")
    allowed = {f"x_{i}" for i in range(len(names))} | {"int"}
    if not set(code.co_names) <= allowed:
        raise Unsupported("the condition holds more than selections")
    return lambda v: bool(eval(code, {"__builtins__": {}, "int": int}, {f"x_{i}": x for i, x in enumerate(v)}))  # noqa: S307


def possible_ids(conditions: list[str], selections: dict[str, object]) -> frozenset[int] | None:
    """Event ids on which one of the conditions can hold, None if on any, whatever way they are nested.

    On an event of some id, selections that ask for other ids are false and all others may be either. Which ids an event
    may have is read off the truth table: an id counts if the condition can hold then, and if it can for an id that no
    selection names, any id will do. Selections that ask for the same ids move together only where that is certain, so
    the answer never leaves out an id on which the rule matches. More than MOST_TABLE selections give None.
    """
    names = list(selections)
    asked = [_required_ids(selections[n]) for n in names]
    if all(a is None for a in asked) or len(names) > MOST_TABLE:
        return None
    holds = truth(conditions, names)

    def can(event_id: int | None) -> bool:
        free = [i for i, a in enumerate(asked) if a is None or event_id in a]
        for values in itertools.product((True, False), repeat=len(free)):
            row = [False] * len(names)
            for i, v in zip(free, values, strict=True):
                row[i] = v
            if holds(row):
                return True
        return False

    if can(None):
        return None
    return frozenset(i for i in frozenset().union(*[a for a in asked if a is not None]) if can(i))


def compile_rule(spec: dict) -> Rule:
    """A checked rule, or Unsupported with the reason."""
    for key, why in (("correlation", "a correlation of other rules"), ("action", "one part of a collection of rules")):
        if spec.get(key):
            raise Unsupported(why)
    if spec.get("filter") and not spec.get("detection"):
        raise Unsupported("a filter for other rules")
    for key in ("title", "detection", "logsource"):
        if not spec.get(key):
            raise Unsupported(f"missing {key}")
    found, why = targets(spec["logsource"])
    if why:
        raise Unsupported(why)
    detection = spec["detection"]
    if "timeframe" in detection:
        raise Unsupported("a timeframe spans several events")
    selections = {k: v for k, v in detection.items() if k != "condition"}
    conditions = detection.get("condition")
    if not conditions:
        raise Unsupported("missing condition")
    conditions = conditions if isinstance(conditions, list) else [conditions]
    fields = [k.split("|")[0] for s in selections.values() for m in (s if isinstance(s, list) else [s]) if isinstance(m, dict) for k in m]
    for s in selections.values():
        check_selection(s)
    for c in conditions:
        rewritten(str(c), list(selections))
    ids = possible_ids([str(c) for c in conditions], selections)
    return Rule(str(spec.get("id") or spec["title"]), spec["title"], normal_level(spec.get("level")), spec, found, ids, list(dict.fromkeys(f for f in fields if f)))


def rule_columns(rule: Rule, profile: str | None, prefix: str = "s") -> tuple[dict[str, Column], str]:
    """The selections as boolean columns, by their names prefix0, prefix1 ..., and the condition over them as SQL text."""
    detection = rule.spec["detection"]
    names = [k for k in detection if k != "condition"]
    conditions = detection["condition"] if isinstance(detection["condition"], list) else [detection["condition"]]
    text = " OR ".join(f"({rewritten(c, names, prefix)})" for c in conditions)
    return {f"{prefix}{i}": selection(detection[n], profile, may_be_classic(rule)) for i, n in enumerate(names)}, text


def may_be_classic(rule: Rule) -> bool:
    """Whether the rule is tried on classic PowerShell events."""
    return any(c in (None, CLASSIC) for c, _, _ in rule.targets)
