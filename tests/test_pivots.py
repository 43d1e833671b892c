"""Pivots by key and by time against brute force, with keys and moments that very many events share."""

import random
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_events import T0, events

from winlog_spark.operators import facets, hunts, pivots
from winlog_spark.plans import search
from winlog_spark.schema import SECURITY, SYSMON


def process(key, **head):
    return (1, SYSMON, [("ProcessGuid", key), ("ParentProcessGuid", f"{key}-p"[:3])], head)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(2)
    return events(spark, *[process(rng.choice(["{a}", "{b}", "{C}", "-", " {c} ", ""]), ts=None if i == 7 else T0 + timedelta(seconds=rng.choice([0, 0, 5, 300, 301, 900, 5000])), computer=rng.choice(["h", "k", None])) for i in range(90)])


@pytest.mark.parametrize("limits", [{}, {"MOST_PAIRS": 10**9, "KEY_ROWS": 3, "SALTS": 2}])
def test_keys_against_brute_force(some, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(pivots, k, v)
    centres = some.where("g % 4 = 0")
    keys = {r.g: set(r.k) for r in some.select("g", pivots.keys_of("processguid").alias("k")).collect()}
    own = {g for g in keys if g % 4 == 0}
    want = {(c, g) for c in own for g in keys if keys[c] & keys[g]}
    assert {tuple(r) for r in pivots.same_key(centres, some, "processguid").collect()} == want
    members = pivots.key_members(centres, some, "processguid").collect()
    n = {k: (sum(k in keys[g] for g in own), sum(k in keys[g] for g in keys)) for k in set().union(*keys.values())}
    n = {k: v for k, v in n.items() if v[0]}
    assert sorted((r.key, r.g, r.centre, r.centres, r.events) for r in members) == sorted((k, g, c, *n[k]) for k in n for c, of in ((True, own), (False, keys)) for g in of if k in keys[g])
    assert {(r.key, r.centres, r.events) for r in pivots.key_classes(centres, some, "processguid").collect()} == {(k, *v) for k, v in n.items()}
    # what is beyond the limit has no pairs, and all its members
    few = {tuple(r) for r in pivots.same_key(centres, some, "processguid", most_pairs=min(a * b for a, b in n.values())).collect()}
    assert few < want and few


def test_a_key_that_all_events_share(spark):
    n, m = 60_000, 6_000
    e = spark.range(n).select(F.col("id").alias("g"), F.array(F.struct(F.lit("ProcessGuid").alias("name"), F.lit("{hot}").alias("value"))).alias("ed"))
    c = e.where(f"g < {m}")
    assert [tuple(r) for r in pivots.key_classes(c, e, "processguid").collect()] == [("{hot}", m, n)]
    members = pivots.key_members(c, e, "processguid")
    assert members.count() == n + m and members.where("centre").count() == m
    assert pivots.same_key(c, e, "processguid").count() == 0


@pytest.mark.parametrize("by", [(), ("computer",)])
@pytest.mark.parametrize("seconds", [1, 300, 4000])
def test_near_against_brute_force(some, by, seconds):
    centres = some.where("g % 5 = 0")
    rows = [(r.g, r.ts, tuple(r[x] for x in by)) for r in some.select("g", "ts", *by).collect()]
    near = [(c, e) for c, ct, cb in rows if c % 5 == 0 for e, et, eb in rows if ct and et and abs((ct - et).total_seconds()) <= seconds and cb == eb and None not in cb]
    assert {tuple(r) for r in pivots.near_in_time(centres, some, seconds, by).collect()} == set(near)
    out = pivots.events_near(centres, some, seconds, by)
    assert sorted(r.g for r in out.collect()) == sorted({e for _, e in near}) and out.columns == some.columns
    assert {r.centre: r.events for r in pivots.counts_near(centres, some, seconds, by, tasks=3).collect()} == Counter(c for c, _ in near)


def test_bursts_do_not_multiply(spark):
    n, m = 50_000, 2_000
    e = spark.range(n).select(F.col("id").alias("g"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 997).alias("ts"), F.lit("h").alias("computer"))
    c = e.where(f"g < {m}")
    assert pivots.events_near(c, e, 60, ("computer",)).count() == n
    assert pivots.counts_near(c, e, 60, ("computer",)).agg(F.count("*").alias("n"), F.min("events").alias("lo"), F.max("events").alias("hi")).first() == (m, n, n)
    assert pivots.time_spans(c, 60).count() == 1


@pytest.mark.parametrize("stretch", [2, 100_000])
def test_spans_are_disjoint(some, monkeypatch, stretch):
    monkeypatch.setattr(pivots, "SPAN_BUCKETS", stretch)
    for seconds in (1, 150, 400):
        by = defaultdict(list)
        for r in some.where("ts is not null").collect():
            by[r.computer].append(r.ts)
        want = []
        for host, times in by.items():
            for t in sorted(times):
                if want and want[-1][0] == host and (t - want[-1][2]).total_seconds() <= 2 * seconds:
                    want[-1][2] = t
                else:
                    want.append([host, t, t])
        w = timedelta(seconds=seconds)
        got = {(r.computer, r.start, r.end) for r in pivots.time_spans(some, seconds, ("computer",)).collect()}
        assert got == {(h, a - w, b + w) for h, a, b in want}


def test_places_do_not_write_the_pairs(some):
    for by in ("time", "level", "computer", "name"):
        for falling in (False, True):
            place = {r.g: r.place for r in pivots.places(some, pivots.sort_parts(by, falling), tasks=4).collect()}
            assert [g for g, _ in sorted(place.items(), key=lambda x: x[1])] == [r.g for r in pivots.ordered(some, by, falling).select("g").collect()]
    written = next(x for x in pivots.places(some, pivots.sort_parts("time"))._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LogicalRDD" in x)
    assert "ed#" not in written and written.count("#") == 3


def test_value_lists_in_order_of_first_sight(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(10**6), [(rng.choice(["A", "a", "B", "Hot", None]), rng.choice([None, "", *map(str, range(30))])) for _ in range(rng.randrange(5))] + [("Unique", str(i))]) for i in range(300)]
    rows = list({g: p for g, p in rows}.items())
    e = spark.createDataFrame(rows, "g long, ed array<struct<name:string,value:string>>").repartition(7)
    for n, m in ((200, 100), (3, 4)):
        names, values = {}, defaultdict(dict)
        for _, p in sorted(rows):
            for name, value in p:
                if name is not None:
                    names.setdefault(name)
                    if value:
                        values[name.lower()].setdefault(value)
        want = {(k, v) for k in list(names)[:n] for v in list(values[k.lower()])[:m]}
        assert {tuple(r) for r in facets.value_lists(e, n, m).collect()} == want
    assert facets.value_lists(e.limit(0)).count() == 0


def test_hunt_rows_equal_the_predicates(spark):
    from conftest import DATA

    from winlog_spark.queries import ev

    queries = ["EventID:4625 -LogonType:3", "CommandLine:*who*mi*", "CommandLine:*", "-CommandLine:*net*", "whoami", "process:*\\cmd.exe OR EventID:1102", "LogonType:>4 LogonType:<=10", 'SubStatus:"Wrong password"', "name:*logon*", "level:2 channel:security", "CommandLine:*%*", "computer:WS-1 -level:4", "EventID:46*", "TargetUserName:user4", "OR", "ImagePath:*_*", "IpAddress:10.0.1.* -IpAddress:*.3", "LogonType:>=0x3", "-EventID:4624 -EventID:4625"]
    pack = [hunts.Hunt(f"q{i}", "c", "t", q, q) for i, q in enumerate(queries)] + hunts.PACK
    for e in (ev(spark, str(DATA)).where("g % 3 = 0"), events(spark, (4624, SECURITY, [("LogonType", "3"), ("logontype", "10"), ("CommandLine", None)]), (1, None, [("Image", "C:\\x\\CMD.EXE"), ("NewProcessName", "")], {"level": None}))):
        for h, c in hunts.hunt_predicates(pack[: len(queries)]):
            assert {r.g for r in hunts.hunt_hits(e, [h]).collect()} == {r.g for r in e.where(c).collect()}, h.query
        got = Counter(r.hunt_id for r in hunts.hunt_hits(e, pack).collect())
        assert {r.hunt_id: r.n for r in hunts.hunt_counts(e, pack).collect()} == {h.id: got[h.id] for h in pack}
    assert hunts.hunt_hits(e, []).count() == 0


def test_each_hunt_selects_its_events_and_no_others(spark):
    """For each alternative of a hunt an event that has all it asks for, and for each of its clauses one that has all others but not that."""
    made, wanted = [], []

    def fill(c):
        return str(int(c.value) + 1) if c.cmp == ">" else c.value.replace("*", "x")

    for h in hunts.PACK:
        for group in search.clauses(h.query):
            must = [c for c in group if not c.negate]
            for left_out in [None, *group]:
                head, pairs = {"provider": None, "level": None}, defaultdict(list)
                event_id = 0
                for c in must:
                    kind = search.HEADER_FIELDS.get(c.field.lower())
                    value = fill(c) if c is not left_out else "0" if kind == "eventid" else "~"
                    if kind == "eventid":
                        event_id = int(value)
                    elif kind:
                        head[kind] = value
                    elif c is not left_out:
                        pairs[search.MULTI_FIELDS.get(c.field.lower(), [c.field])[0]].append(value)
                if left_out is not None and left_out.negate:
                    pairs[left_out.field].append(fill(left_out))
                provider = head.pop("provider")
                # clauses on one field are met by one value, which holds them all
                ed = [(n, " ".join(v)) for n, v in pairs.items()] if h.id not in AMBIGUOUS else [(n, x) for n, v in pairs.items() for x in v]
                made.append((event_id, provider, ed, head))
                wanted.append((h.id, left_out is None))
    e = events(spark, *made)
    got = {(r.hunt_id, r.g) for r in hunts.hunt_hits(e).collect()}
    for g, (hunt, hit) in enumerate(wanted):
        assert ((hunt, g) in got) == hit, (hunt, hit, made[g])


#: Hunts with two clauses on one field, met by two values in this test.
def test_hunts_are_looked_up_by_the_id_of_an_event_before_its_provider():
    pack = hunts.HuntPack([hunts.Hunt("a", "c", "t", "EventID:4625 Provider:*Security-Auditing", "a"), hunts.Hunt("b", "c", "t", "EventID:1 CommandLine:*whoami*", "b"), hunts.Hunt("c", "c", "t", "-EventID:1 CommandLine:whoami", "c")])
    assert [(k[:3], k[4:]) for k in pack.index if k[4] == 0] == [((hunts.EVENT_ID, "=", "4625"), (0, "4625"))]
    assert {k[4:] for k in pack.index} == {(0, "4625"), (1, "1"), (2, None)}


AMBIGUOUS = {h.id for h in hunts.PACK for g in search.clauses(h.query) if len({c.field for c in g}) < len(g)}
