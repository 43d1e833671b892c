"""Language-model scoring by context-tree weighting over bytes, beside a unigram word base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tally, blocks, checkpointed, counted, crc_bucket, documents, words

#: Bytes of context.
DEPTH = 5
#: Nodes of contexts of this many bytes and more are weighted apart for each context of so many bytes; those above, at
#: most 65,791, are sent to all tasks.
TOP = 2
#: Scores of grams that hold this share of the texts' bytes are sent to all tasks, at most 1 / GRAM_SHARE of them; others are joined.
GRAM_SHARE = 2.5e-7
#: Grams that a task works on at once (those of one context of TOP bytes stay together).
CHUNK = 1 << 17
#: Words that hold this share of the training tokens are sent to all tasks, at most 1 / WORD_SHARE of them; others are joined.
WORD_SHARE = 5e-7
WORD, GRAM = 0, 1
#: Grams have keys from 0 below DOCS, words negative ones; DOCS itself counts the texts.
DOCS = 1 << 8 * (DEPTH + 1)
TRAIN, SCORED = 1, 2
_BITS = np.uint64((1 << 63) - 1)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte with the DEPTH bytes before it, a zero byte ending each text and zeros before it; and where texts begin."""
    n, size = len(off) - 1, np.diff(off)
    begin = off[:-1] + np.arange(n)  # of each text among its codes
    inner = np.ones(len(data) + n, bool)
    inner[off[1:] + np.arange(n)] = False
    one = np.zeros(DEPTH + len(inner), np.uint8)
    one[DEPTH:][inner] = data
    code = np.zeros(len(inner), np.int64)
    for i in range(0, DEPTH + 1, 2):  # two bytes at a time
        two = one[i : i + len(code)].astype(np.uint16) << 8 | one[i + 1 : i + 1 + len(code)] if i < DEPTH else one[i : i + len(code)]
        code <<= 16 if i < DEPTH else 8
        code |= two
    for i in range(DEPTH):  # what precedes a text is another's
        code[begin[size >= i] + i] &= (1 << 8 * (i + 1)) - 1
    return code, begin


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As common.words, with keys that no gram has."""
    w, at = words(data, off)
    return ~(w & _BITS).view(np.int64), at


def train_counts(docs: DataFrame, train: DataFrame | Column, text: str = "text") -> DataFrame:
    """(key, n, times): how often each word, and each gram of DEPTH + 1 bytes, occurs in the training texts; times: each gram in docs.

    train: other rows, or the condition on docs that training rows fulfil, by which each text is taken apart once for both.
    """
    if isinstance(train, Column):
        some = docs.select(F.col(text).alias("text"), F.when(train, TRAIN | SCORED).otherwise(SCORED).alias("role"))
    else:
        some = docs.select(F.col(text).alias("text"), F.lit(SCORED).alias("role")).unionByName(train.select(F.col(text).alias("text"), F.lit(TRAIN).alias("role")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(kind, keys, n):
            """Grams come with their text's role in the lowest bits."""
            if kind == WORD:
                return rows_out(keys, n, np.zeros(len(keys), np.int64))
            code, role = keys >> 2, keys & 3
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
            return rows_out(code[at], *(np.add.reduceat(np.where(role & of, n, 0), at) if len(at) else n for of in (TRAIN, SCORED)))

        def rows_out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["key", "n", "times"])

        tallies, docs_seen = {WORD: Tally(), GRAM: Tally()}, 0
        for rows, data, off in blocks(batches):
            role = rows.column("role").to_numpy().astype(np.int64)
            learnt = (role & TRAIN) > 0
            docs_seen += int(learnt.sum())
            w, at = word_keys(data, off)
            codes = grams(data, off)[0] << 2 | np.repeat(role, np.diff(off) + 1)
            for kind, keys in ((WORD, w[np.repeat(learnt, np.diff(at))]), (GRAM, codes)):
                for full in tallies[kind].add(*counted(keys)):
                    yield batch(kind, *full)
        for kind, tally in tallies.items():
            yield batch(kind, *tally.merged())
        yield rows_out(np.array([DOCS]), np.array([docs_seen]), np.zeros(1))

    parts = some.mapInArrow(count, "key long, n long, times long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def is_gram(key: Column) -> Column:
    return (key >= 0) & (key < DOCS)


class Known:
    """Values of integer keys, none of them DOCS, found by a hash of the key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - len(keys).bit_length() - 1)
        slot = self.slots(keys)
        order = np.argsort(slot)
        self.first = np.searchsorted(slot[order], np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)
        self.keys, self.values = np.append(keys[order], DOCS), np.append(values[order], np.zeros(1, values.dtype))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, 0 if it isn't known, and whether it is."""
        slot = self.slots(keys)
        at = self.first[slot]  # of an empty slot, another's first key, which is not the one sought
        met = self.keys[at] == keys
        value = np.where(met, self.values[at], 0)
        left = np.flatnonzero(~met)
        at, end = at[left] + 1, self.first[slot[left] + 1]
        while len(left := left[more := at < end]):
            at, end = at[more], end[more]
            hit = self.keys[at] == keys[left]
            value[left[hit]], met[left[hit]] = self.values[at[hit]], True
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return value, met


def node_key(depth: int, context: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return np.int64(depth) << 56 | context << 8 | prefix


def node_counts(code: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, zeros and ones of every node of top to DEPTH bytes of context: a context and the bits of the next byte so far."""
    keys, zeros, ones = [], [], []
    for d in range(DEPTH, top - 1, -1):
        code, n = counted(code & ((1 << 8 * (d + 1)) - 1), n)
        context, byte = code >> 8, code & 255
        for k in range(8):
            u, inv = np.unique(node_key(d, context, 1 << k | byte >> (8 - k)), return_inverse=True)
            bit = byte >> (7 - k) & 1
            keys.append(u)
            zeros.append(np.bincount(inv, n * (1 - bit), len(u)))
            ones.append(np.bincount(inv, n * bit, len(u)))
    return np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)


def parents(key: np.ndarray) -> np.ndarray:
    """The nodes with a context shorter by its first byte, of nodes of one depth."""
    d = key >> 56
    return node_key(d - 1, (key >> 8) & ((np.int64(1) << 8 * (d - 1)) - 1), key & 255)


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows that come in order of a column, in tables of at least CHUNK rows (but the last) that part no group."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            t = pa.Table.from_batches(held)
            cut = int(np.searchsorted(t.column(by).to_numpy(), t.column(by)[-1].as_py()))
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after moving x above 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.where(x < 8, np.log(x), 0)
        x = np.where(x < 8, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-probability that the Krichevsky-Trofimov estimator gives to a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - 2 * 0.5723649429247001


class ContextTrees:
    """A weighted context tree for each node of the byte's binary decomposition.

    P(s) = KT(s) / 2 + KT(rest of s) * product of P(child) / 2, where the children are the contexts one byte longer that
    are kept and the rest is what the node has seen beyond them. Predicting, each node mixes its own estimate with what
    the longer context says by the share of KT(s) / 2 in P(s).

    Nodes may be those of a range of depths only: top to bottom, where total is the logarithm of P at the bottom, if that
    has contexts below it.
    """

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, top: int = 0, bottom: int = DEPTH, total: np.ndarray | None = None):
        order = np.argsort(key)
        given = None if total is None else total[order]
        self.key, zeros, ones = key[order], zeros[order].astype(np.float64), ones[order].astype(np.float64)
        size = len(key)
        depth = self.key >> 56
        inner_zeros, inner_ones, inner = np.zeros(size), np.zeros(size), np.zeros(size)
        weight, rest = np.ones(size), np.full(size, 0.5)
        log_kt = _log_kt(zeros, ones) if size else zeros
        for d in range(bottom, top - 1, -1):
            at = np.flatnonzero(depth == d)
            rz, ro = zeros[at] - inner_zeros[at], ones[at] - inner_ones[at]
            split = np.where(inner_zeros[at] + inner_ones[at] > 0, _log_kt(rz, ro) + inner[at], log_kt[at])
            total = given[at] if d == bottom and given is not None else np.logaddexp(log_kt[at], split) - np.log(2)
            weight[at] = np.where(inner_zeros[at] + inner_ones[at] > 0, np.exp(log_kt[at] - np.log(2) - total), 1)
            rest[at] = (ro + 0.5) / (rz + ro + 1)
            if d == top:
                self.tops = self.key[at], zeros[at], ones[at], total
            else:
                to = np.searchsorted(self.key, parents(self.key[at]))
                for sums, x in ((inner_zeros, zeros[at]), (inner_ones, ones[at]), (inner, total)):
                    sums += np.bincount(to, x, size)
        self.one = ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
        self.weight, self.rest = weight.astype(np.float32), rest.astype(np.float32)

    def above(self, lower: ContextTrees) -> ContextTrees:
        """The nodes of less than TOP bytes of context of this, and those of lower."""
        out, n = object.__new__(ContextTrees), np.searchsorted(self.key, TOP << 56)
        for name in ("key", "one", "weight", "rest"):
            setattr(out, name, np.concatenate([getattr(self, name)[:n], getattr(lower, name)]))
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram code, given those before it."""
        out = np.zeros(len(codes))
        byte = codes & 255
        for k in range(8):
            prefix = 1 << k | byte >> (8 - k)
            p, left, last = np.zeros(len(codes)), np.ones(len(codes)), np.full(len(codes), 0.5)
            alive = np.arange(len(codes))
            for d in range(DEPTH + 1):
                if not len(alive) or not len(self.key):
                    break
                want = node_key(d, codes[alive] >> 8 & ((1 << 8 * d) - 1), prefix[alive])
                at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                hit = self.key[at] == want
                alive, at = alive[hit], at[hit]
                p[alive] += left[alive] * self.weight[at] * self.one[at]
                left[alive] *= 1 - self.weight[at]
                last[alive] = self.rest[at]
            p += left * last
            out += np.log10(np.where(byte >> (7 - k) & 1, p, 1 - p))
        return out


def gram_scores(counts: DataFrame) -> DataFrame:
    """(key, times, value): each different gram of the texts to score, how often it occurs there, and log10 of its last byte given those before it, by the train_counts of the training texts."""
    both = counts.where(is_gram(F.col("key")))
    ends = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)).alias("ends")
    grouped = checkpointed(both.select("key", "n", "times", ends).repartition("ends").sortWithinPartitions("ends"))

    def lower(t: pa.Table) -> ContextTrees:
        code, n = t.column("key").to_numpy(), t.column("n").to_numpy()
        return ContextTrees(*node_counts(code[n > 0], n[n > 0], TOP), top=TOP)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "ends"):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in lower(t).tops], names=["key", "zeros", "ones", "total"])

    # what the nodes above need of those of TOP bytes: sums over their last bits, of which there are few
    tops = grouped.mapInArrow(weigh, "key long, zeros double, ones double, total double").toArrow()
    key, zeros, ones, total = (tops.column(c).to_numpy() for c in ("key", "zeros", "ones", "total"))
    keys, z, o, p = [key], [zeros], [ones], [total]
    for _ in range(TOP):
        key, inv = np.unique(parents(keys[-1]), return_inverse=True)
        keys.append(key)
        z.append(np.bincount(inv, z[-1], len(key)))
        o.append(np.bincount(inv, o[-1], len(key)))
        p.append(np.zeros(len(key)))
    upper = counts.sparkSession.sparkContext.broadcast(ContextTrees(*map(np.concatenate, (keys, z, o)), bottom=TOP, total=np.concatenate(p)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "ends"):
            times = t.column("times").to_numpy()
            code = t.column("key").to_numpy()[times > 0]
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times[times > 0]), pa.array(upper.value.above(lower(t)).log10(code))], names=["key", "times", "value"])

    return checkpointed(grouped.mapInArrow(score, "key long, times long, value double"))


def lm_scores(docs: DataFrame, train: DataFrame | Column, id: str = "doc_id", text: str = "text", node_share: float = GRAM_SHARE, word_share: float = WORD_SHARE) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    train: the training texts, or the condition that they fulfil among docs, which are then read once less.
    Tasks count words and grams of the training texts and of docs, Spark adds them up; these tables grow with the corpus
    and stay distributed. Every node of the context trees counts. Nodes whose contexts end in the same TOP bytes are
    weighted by one task, which returns those of TOP bytes; from these come the few nodes above, and with them each
    distinct gram of docs gets its score. Only scores of grams that hold node_share of the bytes of docs and counts of
    words that hold word_share of the training tokens are sent to all tasks; rarer ones are joined, with the same result.
    Null text counts as empty: one end token, one end byte. With no training rows every bit has probability 1/2 and every
    count is 0. Words are told apart by 63 bits of hash. Repeated rows are scored each for itself, and so are rows of one id or of none.
    Very long texts are read whole. docs without rows gives no rows; other columns, whatever their names, are not read.
    """
    counts = checkpointed(train_counts(docs, train, text))
    key = F.col("key")
    size = counts.agg(F.sum(F.when(key == DOCS, F.col("n"))), F.sum(F.when(key < 0, F.col("n"))), F.count(F.when(key < 0, 1)), F.sum("times")).first()
    n_docs, n_words, different, n_bytes = (x or 0 for x in size)
    n_train = n_words + n_docs
    vocabulary = different + (n_docs > 0)
    grams_of = gram_scores(counts)
    often = grams_of.where(F.col("times") >= node_share * n_bytes).select("key", "value").toArrow()
    floor = max(1, word_share * n_train)
    frequent = counts.where((key < 0) & (F.col("n") >= floor)).select("key", "n").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast([Known(t.column("key").to_numpy(), t.column(c).to_numpy()) for t, c in ((often, "value"), (frequent, "n"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, frequent = shared.value

        def rows_out(row, ids, key, times, own):
            return pa.RecordBatch.from_arrays([pa.array(row), ids, pa.array(key), pa.array(times), own], names=["row", "id", "key", "times", "own"])

        def joined_later(rows, row, doc, keys):
            """A row for each text and rare key."""
            order = np.lexsort((doc, keys))
            doc, keys = doc[order], keys[order]
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]))
            return rows_out(row[doc[at]], pa.nulls(len(at), rows.column("id").type), keys[at], np.diff(at, append=len(keys)), pa.nulls(len(at), pa.list_(pa.float64())))

        for rows, data, off in blocks(batches):
            row = rows.column("row").to_numpy()
            codes, begin = grams(data, off)
            value, met = often.find(codes)
            value = np.add.reduceat(value, begin)
            rare = np.flatnonzero(~met)
            yield joined_later(rows, row, np.searchsorted(begin, rare, "right") - 1, codes[rare])
            w, at = word_keys(data, off)
            doc = np.repeat(np.arange(len(row)), np.diff(at))
            c, hit = frequent.find(w)
            base = np.bincount(doc, np.log10(c + 1.0), len(row)) + np.log10(n_docs + 1.0)
            known = np.bincount(doc[hit], minlength=len(row)) + (n_docs > 0)
            # a row's own sums go along under a key that no gram or word has
            own = np.stack([np.diff(off), np.diff(at) + 1, known, base, value], axis=1).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
            yield rows_out(row, rows.column("id"), DOCS + row, np.zeros(len(row), np.int64), lists)
            yield joined_later(rows, row, doc[~hit], w[~hit])

    kind = docs.select(id).schema[0].dataType.simpleString()
    numbered = docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    parts = numbered.mapInArrow(score, f"row long, id {kind}, key long, times long, own array<double>")
    rare = counts.where((key < 0) & (F.col("n") < floor)).select("key", F.log10(F.col("n") + 1).alias("v"))
    rare = rare.unionByName(grams_of.where(F.col("times") < node_share * n_bytes).select("key", F.col("value").alias("v")))
    joined = parts.join(rare, "key", "left")
    n_bytes_of, n_tokens, known, base_of, value_of = (F.coalesce(F.col("own")[i], F.lit(0.0)) for i in range(5))
    word, gain = F.col("v").isNotNull() & (key < 0), F.coalesce(F.col("times") * F.col("v"), F.lit(0.0))
    out = joined.groupBy("row").agg(
        F.max("id").alias("id"), F.sum(n_bytes_of).alias("bytes"),
        F.sum(n_tokens).cast("long").alias("n_tokens"), F.sum(known + F.when(word, F.col("times")).otherwise(0)).cast("long").alias("n_known"),
        F.sum(base_of + F.when(word, gain).otherwise(0.0)).alias("base"), F.sum(value_of + F.when(word, 0.0).otherwise(gain)).alias("score"))
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n_train + vocabulary + 1)))
    bits = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("bytes") + 1)
    return out.select(F.col("id").alias(id), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def mixed(base: Column, tree: Column) -> Column:
    """log10 of half the base's probability and half the trees', so never more than log10(2) below either.

    The base tells unknown words from known ones only, while the trees spell them. Both give at most the probability of the
    text as a sequence of V words and the one class of unknown words, and so does their mean.
    """
    high, low = F.greatest(base, tree), F.least(base, tree)
    return high + F.log10(1 + F.pow(F.lit(10.0), low - high)) - F.log10(F.lit(2.0))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = lm_scores(docs, crc_bucket(F.col("doc_id"), 7) != 2)
    held = (crc_bucket(F.col("doc_id"), 7) == 2).alias("held_out")
    score = mixed(F.col("base_score"), F.col("score"))
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"), "bits_per_byte", F.col("score").alias("tree_score"))
