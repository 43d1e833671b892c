"""Repeated lines and passages across documents: hashed units or word windows, of which the earliest occurrence stays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, member_bits, mix, powers, salt_of, stored, with_groups, with_member, word_spans

#: Words of the shortest unit that is compared.
MIN_WORDS = 25
_UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n](?:[^\n]|\n(?!\s*\n))*")}
_GAP = re.compile(r"[ \t-\r]+")
_FOLD = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def units(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit of at least min_words words: id, row (a hash of id and text), start and length in characters of the original text, digest of the normalised unit.

    Normalised: A-Z lower-cased, runs of blanks made one, none at the ends.
    """
    kind = docs.select(id).schema[0].dataType.simpleString()
    pattern = _UNITS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, length, n, digest = [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for m in pattern.finditer(t or ""):
                    norm = _GAP.sub(" ", m[0].translate(_FOLD)).strip(" ")
                    words = norm.count(" ") + 1
                    if norm and words >= min_words:
                        at.append(i)
                        start.append(m.start())
                        length.append(m.end() - m.start())
                        n.append(words)
                        digest.append(hashlib.blake2b(norm.encode(), digest_size=16).digest())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("row").take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n, pa.int32()), pa.array(digest, pa.binary())], names=["id", "row", "start", "length", "n_words", "digest"])

    return docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("row"), F.col(text).alias("text")).mapInArrow(cut, f"id {kind}, row long, start long, length long, n_words int, digest binary")


def repeated_units(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """The units to remove: id, row, start, length, n_words, first_id, first_start, copies.

    Occurrences rank by (id, start); the earliest stays, all later ones are returned with their place in the original
    text. Digests are grouped over all documents; a very common unit is dealt over many tasks by a salt, and only
    digests move, not text. Null texts have no units; a null id ranks last. Repeated rows of the same id and text tie,
    and none of them is an earlier occurrence than the others, so the unit stays in each of them. Rows of one id with
    different texts are told apart by row. A very long text is cut whole, in the task that reads it. An empty table gives
    no rows; other columns of docs, whatever their names, are not read.
    """
    found = units(docs, id, text, unit, min_words).withColumn("_rank", F.struct(F.col("id").isNull().alias("n"), "id", "start"))
    among = with_groups(found, ["digest"], {"_first": ("min", "_rank"), "copies": ("count", "_rank")}, salt_of("id", "start"), F.col("copies") > 1, "inner")
    out = among.where(F.col("_first") < F.col("_rank"))
    return out.select(F.col("id").alias(id), "row", "start", "length", "n_words", F.col("_first.id").alias("first_id"), F.col("_first.start").alias("first_start"), "copies")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, each text without its later occurrences; columns as they are. unit: line, paragraph (one line break goes with each), or passage.

    What goes are the spans of repeated_units or repeated_passages, by id and text: each text of an id loses its own, and
    rows without an id theirs; repeated rows lose the same. Texts without a span, which a bounded bitmap shows in most
    cases, stay where they are; only the others are shuffled, once. Null and empty texts stay. The spans of one very long
    text are a list in its row. No rows in, no rows out.
    """
    found = repeated_passages(docs, id, text, min_words) if unit == "passage" else repeated_units(docs, id, text, unit, min_words)
    spans = stored(found.select(F.col("row").alias("__row"), F.array("start", "length").alias("s")).distinct())
    lists = spans.groupBy("__row").agg(F.array_sort(F.collect_list("s")).alias("__spans"))
    breaks = unit != "passage"

    @F.pandas_udf("string")
    def cut(t: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for x, todo in zip(t, spans, strict=True):
            parts, at = [], 0
            for start, length in todo:
                parts.append(x[at:start])
                at = start + length
                at += breaks and at < len(x) and x[at] == "\n"
            out.append("".join([*parts, x[at:]]))
        return pd.Series(out, dtype=object)

    row = F.xxhash64(docs[id], docs[text])
    marked = with_member(docs.withColumn("__row", row), F.col("__row"), member_bits(spans, "__row"), "__in")
    joined = marked.where("__in").join(lists, "__row", "left")
    some = joined.where("__spans is not null").withColumn(text, cut(F.col(text), F.col("__spans"))).select(docs.columns)
    return marked.where("not __in").select(docs.columns).unionByName(joined.where("__spans is null").select(docs.columns)).unionByName(some)


def _window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """63-bit hashes of all runs of k words, given the hashes of the words."""
    if len(w) < k:
        return np.zeros(0, np.int64)
    up, down = powers(len(w) + 1)
    run = np.zeros(len(w) + 1, np.uint64)
    np.cumsum((w | np.uint64(1)) * up[: len(w)], out=run[1:])
    return (mix((run[k:] - run[:-k]) * down[: len(w) - k + 1]) >> np.uint64(1)).view(np.int64)


def _windows(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of texts in one block: word starts and ends in bytes, where each text's words begin; the first word of each window of k words, its text, its hash and its anchor.

    The anchor is the place of the least hash among the window's runs of (k + 1) // 2 words. It depends on the words of
    the window only, so equal windows have equal anchors at the same place.
    """
    w, at, s, e = word_spans(data, off)
    short = (k + 1) // 2
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    key = _window_hashes(w, k)
    x = np.flatnonzero(doc[: len(key)] == doc[k - 1 :]) if len(key) else np.zeros(0, np.int64)
    if not len(x):
        return s, e, at, x, x, x, x
    least = np.lib.stride_tricks.sliding_window_view(_window_hashes(w, short), k - short + 1).argmin(axis=1)
    return s, e, at, x, doc[x], key[x], x + least[x]


def _marked(rows: pa.RecordBatch, name: str, at: np.ndarray) -> np.ndarray:
    """Whether each word of the block is listed by its place within its text in the list column."""
    out = np.zeros(at[-1] + 1, bool)
    lists = rows.column(name)
    doc = pa.compute.list_parent_indices(lists).to_numpy()
    out[at[doc] + pa.compute.list_flatten(lists).to_numpy()] = True
    return out


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The passages to remove, wherever in a text they stand: id, row (a hash of id and text), start and length in characters, n_words.

    A window of min_words words (A-Z lower-cased, whatever blanks between them) is repeated if it occurs earlier, by
    (id, place). Overlapping and adjacent repeated windows make one passage, so a passage ends where the next word is not
    part of a repeated window. A text that repeats itself with an overlap keeps the part before its second window.

    First an anchor of each window is counted; a window can only be repeated if its anchor is. The places of anchors
    that occur once go back to their rows, and all windows of the other anchors are grouped by hash; the places of first
    occurrences go back likewise, and what is left is repeated. Groups are only counted or reduced to their least place,
    before they are shuffled too, so no hot key meets in one task. Null texts have no windows; a null id ranks last.
    Repeated rows of the same id and text tie, and the passage stays in each of them. Windows are told apart by 63 bits.
    A very long text is read whole by one task. An empty table gives no rows; other columns of docs, whatever their
    names, are not read.
    """
    kind = docs.select(id).schema[0].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.xxhash64(id, text).alias("row"), F.col(text).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in blocks(batches):
            w, at, _, _ = word_spans(data, off)
            _, _, at, x, doc, _, anchor = _windows(data, off, min_words)
            new = np.flatnonzero(np.diff(anchor, prepend=-1))
            key = _window_hashes(w, (min_words + 1) // 2)[anchor[new]]
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(doc[new])), pa.array((anchor - at[doc])[new].astype(np.int32)), pa.array(key)], names=["row", "pos", "key"])

    def candidates(b: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        s, e, at, x, doc, key, anchor = _windows(data, off, min_words)
        some = np.flatnonzero(~_marked(b, "single", at)[anchor])
        return s, e, at, x[some], doc[some], key[some]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in blocks(batches):
            _, _, at, x, doc, key = candidates(b, data, off)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("row").take(take), pa.array((x - at[doc]).astype(np.int32)), pa.array(key)], names=["id", "row", "pos", "key"])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in blocks(batches):
            s, e, at, x, doc, _ = candidates(b, data, off)
            later = ~_marked(b, "first", at)[x]
            x, doc = x[later], doc[later]
            begin = np.flatnonzero((np.diff(x, prepend=-min_words - 1) > min_words) | (np.diff(doc, prepend=-1) != 0))
            end = np.append(begin[1:], len(x))[: len(begin)] - 1
            char = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            doc, a, z = doc[begin], x[begin], x[end] + min_words - 1
            start = char[s[a]] - char[off[doc]]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), b.column("row").take(pa.array(doc)), pa.array(start), pa.array(char[e[z]] - char[off[doc]] - start), pa.array((z - a + 1).astype(np.int32))], names=["id", "row", "start", "length", "n_words"])

    found = rows.select("row", "text").mapInArrow(anchors, "row long, pos int, key long")
    # where an anchor occurs once, the least row and place are its own
    once = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos")).where("n = 1")
    single = once.groupBy("row").agg(F.collect_list("pos").alias("single"))
    narrowed = rows.join(single.hint("merge"), "row", "left")
    of = narrowed.select("id", "row", "text", "single").mapInArrow(windows, f"id {kind}, row long, pos int, key long")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "row", "pos")
    least = of.groupBy("key").agg(F.min(place).alias("p")).select("p.row", "p.pos")
    first = least.groupBy("row").agg(F.collect_list("pos").alias("first"))
    out = narrowed.join(first.hint("merge"), "row", "left").select("id", "row", "text", "single", "first").mapInArrow(passages, f"id {kind}, row long, start long, length long, n_words int")
    return out.withColumnRenamed("id", id)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("row")


OP8_PASSAGES_SQL = f"""
WITH c AS (SELECT doc_id, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS j FROM c),
o AS (SELECT doc_id, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY j) - length(w) - 1)::BIGINT AS start, j FROM p),
w AS (SELECT doc_id, start, start + length(w) AS stop, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM o WHERE w <> ''),
g AS (SELECT doc_id, i, start, string_agg(w, ' ') OVER f AS win, max(stop) OVER f AS stop, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
r AS (SELECT doc_id, i, start, stop, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, i) AS nth FROM g WHERE n = {MIN_WORDS}),
q AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS}, true)::INT AS new FROM r WHERE nth > 1),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM q)
SELECT doc_id, min(start) AS start, max(stop) - min(start) AS length, (max(i) - min(i) + {MIN_WORDS})::INT AS n_words FROM k GROUP BY doc_id, run
"""


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(documents(spark, sf_dir)).drop("row").withColumnRenamed("first_id", "first_doc_id")


OP8_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT doc_id, t, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1)::BIGINT AS start, length(t)::BIGINT AS length,
             trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
u AS (SELECT *, (length(norm) - length(replace(norm, ' ', '')) + 1)::INT AS n_words FROM o WHERE norm <> ''),
r AS (SELECT doc_id, start, length, n_words, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start, count(*) OVER (PARTITION BY norm) AS copies
      FROM u WHERE n_words >= {MIN_WORDS} WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, start))
SELECT * FROM r WHERE NOT (doc_id = first_doc_id AND start = first_start)
"""
