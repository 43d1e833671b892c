"""Quality scores and languages of a whole table against plain versions, worked out one document at a time."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import FOLD, WORD

from winlog_spark.llm import common, langid, quality


def trigrams(text):
    out = Counter()
    letters = [b if 97 <= b < 123 or b >= 128 else 32 for b in text.translate(FOLD).encode()]
    ext = [32, *letters, 32]
    for a, b, c in zip(ext, ext[1:], ext[2:], strict=False):
        if (a, b) != (32, 32) and (b, c) != (32, 32):
            out[((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 20] += 1
    return out


def mixture(counts, prob, allowed, rounds):
    """Plain expectation-maximisation over a list of languages: their shares, and the log-likelihood."""
    pi = {k: 1 / len(allowed) for k in allowed}
    n = max(sum(counts.values()), 1)
    for _ in range(rounds):
        new = dict.fromkeys(allowed, 0.0)
        for s, c in counts.items():
            total = sum(pi[k] * prob[k][s] for k in allowed)
            for k in allowed:
                new[k] += c * pi[k] * prob[k][s] / total / n
        whole = sum(v + 1e-12 for v in new.values())
        pi = {k: (v + 1e-12) / whole for k, v in new.items()}
    return pi, sum(c * math.log(sum(pi[k] * prob[k][s] for k in allowed)) for s, c in counts.items())


def test_languages_of_a_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("learn", common.crc_bucket(F.col("doc_id"), 3) != 1).orderBy("doc_id").collect()
    table = defaultdict(Counter)
    for r in rows:
        if r.learn and r.lang is not None:
            table[r.lang].update(trigrams(r.text or ""))
    names = sorted(table)
    whole = {k: sum(table[k].values()) + 0.5 * langid.BUCKETS for k in names}
    prob = {k: [(table[k][s] + 0.5) / whole[k] for s in range(langid.BUCKETS)] for k in names}
    got = {r.doc_id: r for r in langid.op9_langid(spark, str(DATA)).collect()}
    assert len(got) == len(rows)
    odd = 0
    for r in rows[:120]:
        counts = trigrams(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        ranked = sorted(names, key=lambda k, full=mixture(counts, prob, names, langid.EM_ROUNDS)[0]: -full[k])
        single = {k: sum(c * math.log(prob[k][s]) for s, c in counts.items()) for k in names}
        best = max(names, key=lambda k: (single[k], -names.index(k)))
        chosen, ll, size = {best: 1.0}, single[best], 1
        step = langid.PENALTY * 0.5 * math.log(max(sum(counts.values()), 2))
        for m in range(2, len(names) + 1):
            pi, more = mixture(counts, prob, ranked[:m], langid.EM_ROUNDS)
            if more <= ll + step * (m - size):
                break
            chosen, ll, size = pi, more, m
        pred = max(names, key=lambda k: (chosen.get(k, 0), -names.index(k)))
        # where a likelihood stands at the penalty to a hair, single precision may fall on the other side
        odd += (got[r.doc_id].lang_pred, got[r.doc_id].n_langs) != (pred, size) or abs(got[r.doc_id].score - chosen[pred]) > 5e-3
    assert odd <= 1


def plain_features(text):
    raw, low = (text or ""), (text or "").translate(FOLD)
    data, size = low.encode(), max(len(low.encode()), 1)
    found = WORD.findall(low)
    x = np.zeros(quality.WORD_BUCKETS + quality.STATS)
    for w in found:
        h, _ = common.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        x[int(h[0]) % quality.WORD_BUCKETS] += 1
    x[: quality.WORD_BUCKETS] = np.sqrt(x[: quality.WORD_BUCKETS] / max(len(found), 1))
    share = lambda chars: sum(b in chars.encode() for b in data) / size
    lines = data.count(b"\n") + 1
    stats = [sum("A" <= c <= "Z" for c in raw) / size, share("0123456789"), share(".,;:"), share("!?"), share("$%&*#"), share("|"), share("<>{}[]=/\\"), share("@_-+"), sum(b >= 128 for b in data) / size, share(" \t"), share("\n") * 20]
    stats += [sum(97 <= b < 123 for b in data) / size, share("aeiou"), math.log1p(len(raw)) / 10, math.log1p(len(found)) / 10, size / max(len(found), 1) / 10, len(set(found)) / max(len(found), 1), math.log1p(len(found) / lines) / 5]
    x[quality.WORD_BUCKETS :] = np.clip(stats, 0, 4)
    return x


def test_quality_of_a_table(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels.where(common.crc_bucket(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r for r in quality.op3_quality(spark, str(DATA)).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert len(got) == len(rows)
    pair = model.factors.astype(float) @ model.factors.astype(float).T
    for r in rows[:100]:
        z = (plain_features(r.text) - model.mean.astype(float)) / model.scale.astype(float)
        # every pair of features once
        pairs = sum(z[i] * (pair[i, i + 1 :] @ z[i + 1 :]) for i in range(len(z)))
        p = 1 / (1 + math.exp(-max(-30, min(30, model.bias + float(z @ model.linear.astype(float)) + pairs))))
        assert abs(got[r.doc_id].score - p) < 2e-3 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3), (r.doc_id, got[r.doc_id].score, p)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
