"""The set join, vector codes and the filter audit against brute force, and on awkward rows."""

import hashlib
import math
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EXTRA, ROWS, SCHEMA, WORD, as_rows, brute_components, near_group

from winlog_spark.llm import audit, setjoin, vectors


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "node", "band", "role", "h1", "mask", "part", "good", "_t"]])


# --- 11 vector codes -----------------------------------------------------------------


@pytest.mark.parametrize("m", [1, 2, 4, 8, 16])
def test_transform_keeps_scaled_distances(m):
    rng = np.random.default_rng(m)
    x = rng.integers(-50, 50, (20, m))
    t = vectors.walsh_hadamard(x)
    assert ((t[:10] - t[10:]) ** 2).sum(axis=1).tolist() == (m * ((x[:10] - x[10:]) ** 2).sum(axis=1)).tolist()
    rows = vectors.walsh_hadamard(np.eye(m, dtype=np.int64))[:, vectors.sequency_order(m)].T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(m))


@pytest.mark.parametrize(("width", "size"), [(1, 5), (3, 40), (8, 4096), (8, 2), (5, 1 << 45)])
def test_nearest_is_exact(width, size):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-size, size + 1, (300, width)), rng.integers(-size, size + 1, (16, width))
    entries[7] = entries[3]
    parts[5] = entries[7]
    code, error = vectors.nearest(parts, entries)
    for p, c, e in zip(parts.tolist(), code.tolist(), error.tolist(), strict=True):
        all_errors = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in entries.tolist()]
        assert (e, c) == (min(all_errors), all_errors.index(min(all_errors)))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    w = -(-max(len(v) for _, v in kept) // parts)
    cut = lambda v: [[math.floor(4096 * x) for x in (v + [0.0] * (w * parts - len(v)))[j * w : (j + 1) * w]] for j in range(parts)]
    first = {}
    for i, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = list(zip(*[cut(v) for v in list(first.values())[:entries]], strict=True))
    books = [list(b) for b in books]
    data = [(i, cut(v)) for i, v in kept]
    near = lambda p, b: min((sum((x - y) ** 2 for x, y in zip(p, e, strict=True)), c) for c, e in enumerate(b))
    for _ in range(rounds):
        for j in range(parts):
            by = defaultdict(list)
            for _, p in data:
                by[near(p[j], books[j])[1]].append(p[j])
            books[j] = [[sum(x) // len(by[c]) for x in zip(*by[c], strict=True)] if c in by else e for c, e in enumerate(books[j])]
    done = []
    for i, p in data:
        found = [near(p[j], books[j]) for j in range(parts)]
        done.append((i, [c for _, c in found], [d for d, _ in found]))
    return sorted(done, key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["plain", "few", "odd", "huge", "none"])
def test_codes_equal_the_plain_version(spark, kind):
    rng = random.Random(kind)
    rows = [(rng.randrange(10**6), [rng.gauss(0, 0.2) for _ in range(24)]) for _ in range(5 if kind == "few" else 120)]
    if kind == "odd":
        rows += [(None, rows[0][1]), (3, None), (4, [None] * 24), (5, [math.nan] * 24), (6, [math.inf] + [0.0] * 23), (7, []), (8, [0.5] * 27), (9, [1.0]), rows[1], rows[1], (rows[2][0], rows[3][1])]
    if kind == "huge":
        rows += [(1, [1e5, -1e5] * 12), (2, [2e5, 1e4] * 12)]
    if kind == "none":
        rows = [(1, None), (2, [math.nan])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    books = vectors.learn_codebooks(df)
    want, digest = plain_codes(rows)
    got = vectors.compress(df, books).collect()
    assert sorted(((r.vec_id, r.code, r.part_errors) for r in got), key=repr) == want
    assert books.sha256() == digest or not want
    if kind == "plain":
        back = vectors.decompress(vectors.compress(df, books, keep=("embedding",)), books).collect()
        for r in back:
            assert abs(sum((math.floor(4096 * a) - 4096 * b) ** 2 for a, b in zip(r.embedding, r.approximation, strict=True)) - sum(r.part_errors)) < 1e-3


# --- 12 set join ---------------------------------------------------------------------------------


def copies(rng, bases, each, length, most, vocabulary=400, own=6):
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
        for _ in range(each):
            copy = base[:]
            for _ in range(rng.randrange(most)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(own)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("cheap", "hot"), [(1, 1000), (0, 3)])
def test_set_join_around_the_limit(spark, monkeypatch, cheap, hot):
    """Groups whose members are mostly just under the limit, by whole segments and by deletions, with hot keys dealt."""
    monkeypatch.setattr(setjoin, "CHEAP", cheap)
    monkeypatch.setattr(setjoin, "HOT", hot)
    rng = random.Random(5)
    texts = copies(rng, 2, 120, 90, 6) + copies(rng, 30, 3, 40, 3, own=10**6)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    want = brute_components(rows, 4, 80)
    assert got == want and len({c for _, _, c in want}) > 20


def test_set_join_does_not_try_a_group_against_itself(spark, monkeypatch):
    """Copies beyond the limit don't meet every member of their group."""
    met = []
    for name in ("_met", "_sharing_rare"):
        if first := getattr(setjoin, name, None):
            monkeypatch.setattr(setjoin, name, lambda *args, first=first: (met.append(first(*args).count()), first(*args))[1])
    rows = near_group(2)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 5, 80)
    assert sum(met) < 10 * len(rows)


@pytest.mark.parametrize(("spare", "cheap"), [(6, 1), (0, 0)])
def test_set_join_of_small_sets(spark, monkeypatch, spare, cheap):
    """Sets of a few shingles of a small vocabulary, of which many share segments; without spare segments many have too few."""
    monkeypatch.setattr(setjoin, "SPARE", spare)
    monkeypatch.setattr(setjoin, "CHEAP", cheap)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 26)))) for i in range(260)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), k=2, percent=70).collect()}
    assert got == brute_components(rows, 2, 70)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_every_similar_pair_meets(percent):
    """The pigeonhole itself: similar sets of any two sizes meet in a band whose segments are enough for what either asks for, and that is more than they can differ in."""
    low, m = setjoin.band_bounds(percent), setjoin.band_segments(percent)
    band = lambda n: int(np.searchsorted(low, n, side="right")) - 1
    for n in [*range(1, 300), 1000, 5000, 77_777]:
        for y in {n, n - 1, -(-n * percent // 100), low[band(n)], low[band(n)] - 1}:
            if 0 < y <= n and y * 100 >= percent * n:
                assert band(y) in (band(n), band(n) - 1)
                differ = setjoin.distance(n + y, percent)
                asks = [setjoin.distance(y + y * 100 // percent, percent) + 1, setjoin.distance(n + n * 100 // percent, percent) + 1 if band(y) == band(n) else setjoin.distance(n + int(low[band(n)]) - 1, percent) + 1]
                assert all(differ < a <= m[band(y)] - setjoin.SPARE for a in asks)


def test_sketches_do_not_overstate():
    rng = np.random.default_rng(3)
    for n, edits in ((1, 1), (50, 5), (400, 60), (400, 200)):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[edits:], rng.integers(0, 1 << 62, edits).astype(np.uint64)]))
        words, at = setjoin.sketches([x, y], np.array([2048, 2048]))
        a, b = words[: at[1]], words[at[1] :]
        differ = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64).tolist())
        assert len(a) == len(b) == 32 and differ <= len(set(x.tolist()) ^ set(y.tolist())) and (edits < 5 or differ > 0.7 * 2 * edits)


def test_set_join_on_awkward_rows(spark, clash):
    out = as_rows(setjoin.similar_sets(clash).select("doc_id", "n_shingles", "component_id"))
    assert len(out) == len(ROWS)
    assert {(1, 1, 1), (2, 1, 1), (3, 0, 3), (8, 1, 8), (9, 1, 8), (None, 1, None), (6, 1, 6)} <= set(out)
    assert setjoin.similar_sets(clash.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h"), (2, "A b c d e f"), (0, "g h")], "doc_id long, text string")
    assert as_rows(setjoin.similar_sets(same).select("doc_id", "n_shingles", "class_id", "component_id")) == [(0, 1, 0, 0), (1, 1, 0, 0), (1, 2, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1)]


# --- 13 filter audit -------------------------------------------------------------------------------


def plain_audit(rows, labels):
    fails, parts = [], defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        fails.append("".join(k for k, v in f.items() if v))
        parts[lang or ""].append((fails[-1], (i, "q") in labels, (i, "t") in labels))
    out = []
    for part, docs in parts.items():
        mine, by = [], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in left if own in d[0]]
                left = [d for d in left if own not in d[0]]
                by[own] += len(gone)
                mine.append((part, order, step, len(left), len(gone), sum(own in d[0] and bool(before & set(d[0])) for d in docs), sum(d[0] == own for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, by[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def test_audit_equals_running_every_order(spark, clash):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "Ab " * 300, "x " * 210 + "%", " ".join(map(str, range(rng.choice([50, 205])))), "É" * 40 + "Q", "WORDS " * 200, "a|b"]), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(40), *range(10), None]]
    marked = {(i, "q") for i, q, _ in labels if i is not None and q == 1} | {(i, "t") for i, _, t in labels if i is not None and t == 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("good", F.lit(1))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.failure_masks(docs, table))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, marked)
    assert audit.audit(audit.failure_masks(docs.limit(0), table)).count() == 0
    out = audit.audit(audit.failure_masks(clash, table.limit(0)))
    assert out.count() == 600 * 4 and out.where("good_lost + toxic_lost > 0").count() == 0


def test_segment_keys_are_written_short(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x y"), (3, "")], "doc_id long, text string")
    keyed = setjoin._keyed(docs, "doc_id", "text", 5, 80)
    keys = {r.key for r in setjoin._each_key(keyed.withColumnRenamed("h1", "node")).collect()}
    sets = list(setjoin.shingle_sets(*(lambda t: (np.frombuffer(t, np.uint8), np.array([0, len(t)])))(b"a b c d e f g h i j k l m n"), 5))
    band = int(np.searchsorted(setjoin.band_bounds(80), len(sets[0]), side="right")) - 1
    m = setjoin.band_segments(80)[[band]]
    _, full_keys, full, _ = setjoin.segment_keys(sets, np.array([band]), m)
    assert {int(k) >> 24 for k in full_keys[full]} <= keys and all(0 <= k < 1 << 40 for k in keys)
