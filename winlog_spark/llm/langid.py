"""Language identification as a mixture of languages within each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .common import blocks, crc_bucket, documents

#: Buckets of hashed letter trigrams.
BUCKETS = 4096
EM_ROUNDS = 12
#: Gain in log-likelihood that each further language of a set must bring, in units of log(trigrams) / 2.
PENALTY = 4.0
#: A document is kept if one language makes up this much of it.
LEAST_SHARE = 0.5
ROWS = 512

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigram_counts(data: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Documents x buckets: how often each hashed trigram of letters and word edges occurs."""
    n = len(off) - 1
    ext = np.full(len(data) + 2 * n, 32, dtype=np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))
    letter = _LETTER[data]
    ext[np.arange(len(data)) + 2 * doc + 1] = np.where(letter, data, 32)
    owner = np.repeat(np.arange(n), np.diff(off) + 2)
    if len(ext) < 3:
        return np.zeros((n, buckets), np.float32)
    code = ext[:-2] << 16 | ext[1:-1] << 8 | ext[2:]
    ok = (owner[:-2] == owner[2:]) & ((ext[:-2] != 32) | (ext[1:-1] != 32)) & ((ext[1:-1] != 32) | (ext[2:] != 32))
    slot = ((code[ok] * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(buckets)))).astype(np.int64)
    return np.bincount(owner[:-2][ok] * buckets + slot, minlength=n * buckets).reshape(n, buckets).astype(np.float32)


def pieces(batches: Iterator[pa.RecordBatch], text: str | int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for rows, data, off in blocks(batches, text):
        for i in range(0, rows.num_rows, ROWS):
            j = min(i + ROWS, rows.num_rows)
            yield rows.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each bucket in each, from all rows whose lang is not null.

    Tasks add up trigram counts by language; what reaches the driver is one number per language and bucket, whatever the
    corpus. Null texts count as empty, repeated rows each for themselves; from an empty table no language is learned.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, data, off in pieces(batches, "text"):
            langs = np.asarray(rows.column("lang").to_pylist(), dtype=object)
            counts = trigram_counts(data, off, buckets)
            for one in set(langs):
                sums[one] = sums.get(one, 0) + counts[langs == one].sum(axis=0, dtype=np.float64)
        for one, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], names=["lang", "bucket", "n"])

    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    counted = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    names = sorted(found["lang"].unique())
    table = np.full((len(names), buckets), 0.5)
    table[[names.index(x) for x in found["lang"]] if len(names) else [], found["bucket"].to_numpy(dtype=int)] += found["n"].to_numpy(dtype=float)
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if len(names) else table


def _em(counts: np.ndarray, prob: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages (documents x languages), and the log-likelihood under them."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        ratio = counts / np.maximum(pi @ prob, 1e-30)
        pi = pi * (ratio @ prob.T) / n
        pi = np.where(allowed > 0, pi, 0) + 1e-12 * allowed
        pi /= pi.sum(axis=1, keepdims=True)
    return pi, (counts * np.log(np.maximum(pi @ prob, 1e-30))).sum(axis=1, dtype=np.float64)


def infer(counts: np.ndarray, logp: np.ndarray, rounds: int = EM_ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its proportion, size of the selected set) for each document.

    Expectation-maximisation over all languages ranks them by proportion. Sets grow along this ranking, each refitted,
    for as long as the log-likelihood rises by more than the penalty.
    """
    prob = np.exp(logp).astype(np.float32)
    n_docs, n_langs = len(counts), len(prob)
    full, _ = _em(counts, prob, np.ones((n_docs, n_langs), np.float32), rounds)
    rank = np.argsort(-full, axis=1, kind="stable")
    single = counts.astype(np.float64) @ logp.T
    first = single.argmax(axis=1)
    best, best_ll = np.zeros_like(full), single.max(axis=1)
    best[np.arange(n_docs), first] = 1
    step = penalty * 0.5 * np.log(np.maximum(counts.sum(axis=1), 2))
    size, growing = np.ones(n_docs, np.int64), np.arange(n_docs)
    for m in range(2, n_langs + 1):
        allowed = np.zeros((len(growing), n_langs), np.float32)
        np.put_along_axis(allowed, rank[growing, :m], 1, axis=1)
        pi, ll = _em(counts[growing], prob, allowed, rounds)
        better = ll > best_ll[growing] + step[growing] * (m - size[growing])
        won = growing[better]
        best[won], best_ll[won], size[won] = pi[better], ll[better], m
        growing = won
        if not len(growing):
            break
    return best.argmax(axis=1), best.max(axis=1), size


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (the language's share of the document) and n_langs (size of the selected set), each name after `prefix`.

    A text that is null or has no letter is `und` with score 0; so is every text if the model knows no language. Equal
    likelihoods go to the language first by code point. Every row is judged by its own text, so repeated ids, repeated
    rows and null ids are rows like others; the columns of docs go along as they are, and prefix keeps clear of their
    names. A very long text is a block of its own, of which only counts are held. An empty table gives no rows.
    """
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "n_langs")]
    at, letters_at = docs.columns.index(text), f"{prefix}letters"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for rows, data, off in pieces(batches, at):
            letters = np.asarray(rows.column(rows.num_columns - 1).to_pylist(), dtype=bool)
            lang, score, size = np.full(len(letters), "und", dtype=object), np.zeros(len(letters)), np.zeros(len(letters), np.int32)
            if len(names) and letters.any():
                got, share, many = infer(trigram_counts(data, off)[letters], table)
                lang[letters], score[letters], size[letters] = np.asarray(names, dtype=object)[got], np.clip(share, 0, 1), many
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(size)], names=[*rows.schema.names[:-1], *added])

    schema = StructType([*docs.schema.fields, *(StructField(c, kind) for c, kind in zip(added, (StringType(), DoubleType(), IntegerType()), strict=True))])
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], _has_letter(F.col(text)).alias(letters_at)).mapInArrow(predict, schema)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, n_langs, as with_language gives them."""
    return with_language(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), model).select(F.col("id").alias(id), "lang_pred", "score", "n_langs")


def keep_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs of which one language that the model knows makes up at least least_share; columns as they are.

    What goes: texts that are null or empty or have no letter, and mixtures in which no language reaches the share. Each
    row is kept or goes by its own text, whatever its id. No row is shuffled.
    """
    judged = with_language(docs, model, text, "__")
    return judged.where((F.col("__lang_pred") != "und") & (F.col("__score") >= least_share)).drop("__lang_pred", "__score", "__n_langs")


def _has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model from the rows that may be learned from."""
    return fit_languages(docs.where(crc_bucket(F.col("doc_id"), 3) != 1))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, learned(docs))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_langs")
