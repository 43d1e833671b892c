"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_bucket, documents, words

WORD_BUCKETS = 1024
RANK = 8
#: Labelled rows that the fit reads at most, drawn by hash.
SAMPLE = 6000
THRESHOLD = 0.3
STATS = 18
ROWS = 1024


def features(data: np.ndarray, off: np.ndarray, raw_upper: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Documents x (WORD_BUCKETS + STATS): hashed word frequencies, then statistics of the text and its length."""
    n, size = len(off) - 1, np.maximum(np.diff(off), 1).astype(np.float64)
    w, at = words(data, off)
    many = np.diff(at)
    doc = np.repeat(np.arange(n), many)
    tf = np.bincount(doc * WORD_BUCKETS + (w % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    tf = np.sqrt(tf / np.maximum(many, 1)[:, None])
    owner = np.repeat(np.arange(n), np.diff(off))
    share = lambda mask: np.bincount(owner[mask], minlength=n) / size
    byte = lambda text: np.isin(data, np.frombuffer(text, np.uint8))
    distinct = np.unique(doc.astype(np.uint64) << np.uint64(44) | w >> np.uint64(20))
    kinds = np.bincount((distinct >> np.uint64(44)).astype(np.int64), minlength=n)
    lines = share(byte(b"\n")) * size + 1
    cols = [
        raw_upper / size, share((data >= 48) & (data < 58)), share(byte(b".,;:")), share(byte(b"!?")), share(byte(b"$%&*#")), share(byte(b"|")), share(byte(b"<>{}[]=/\\")), share(byte(b"@_-+")),
        share(data >= 128), share(byte(b" \t")), share(byte(b"\n")) * 20, share((data >= 97) & (data < 123)), share(byte(b"aeiou")),
        np.log1p(n_chars) / 10, np.log1p(many) / 10, size / np.maximum(many, 1) / 10, kinds / np.maximum(many, 1), np.log1p(many / lines) / 5,
    ]
    return np.concatenate([tf, np.clip(np.stack(cols, axis=1), 0, 4)], axis=1).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rows, data, off in blocks(batches):
        upper = rows.column("upper").to_numpy(zero_copy_only=False).astype(np.float64)
        chars = rows.column("chars").to_numpy(zero_copy_only=False).astype(np.float64)
        for i in range(0, rows.num_rows, ROWS):
            j = min(i + ROWS, rows.num_rows)
            yield rows.slice(i, j - i), features(data[off[i] : off[j]], off[i : j + 1] - off[i], upper[i:j], chars[i:j])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All pairs <v_i, v_j> x_i x_j come from half of (sum v x)^2 - sum v^2 x^2, so scoring is linear in the features."""
        z = (x - self.mean) / self.scale
        pairs = 0.5 * ((z @ self.factors) ** 2 - (z**2) @ (self.factors**2)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.bias + z @ self.linear + pairs, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 30, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss with weight decay. With one class only, or no rows, the score is constant."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(axis=0), 0.02) * np.sqrt(np.where(np.arange(d) < WORD_BUCKETS, 16, 1)) if len(x) else np.ones(d)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    m = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(d, np.float32), np.zeros((d, rank), np.float32), mean.astype(np.float32), scale.astype(np.float32))
    if len(set(y.tolist())) < 2:
        return m
    m.factors = rng.normal(0, 0.01, (d, rank)).astype(np.float32)
    z = ((x - m.mean) / m.scale).astype(np.float32)
    first = [np.zeros(1), np.zeros(d), np.zeros((d, rank))]
    second = [np.zeros(1), np.zeros(d), np.zeros((d, rank))]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 256):
            b = z[order[i : i + 256]]
            inner = b @ m.factors
            p = 1 / (1 + np.exp(-np.clip(m.bias + b @ m.linear + 0.5 * (inner**2 - (b**2) @ (m.factors**2)).sum(axis=1), -30, 30)))
            g = (p - y[order[i : i + 256]]) / len(b)
            grads = [np.array([g.sum()]), b.T @ g + decay * m.linear, b.T @ (g[:, None] * inner) - m.factors * ((b**2).T @ g)[:, None] + decay * m.factors]
            step += 1
            now = [np.array([m.bias]), m.linear, m.factors]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                now[k] = now[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            m.bias, m.linear, m.factors = float(now[0][0]), now[1].astype(np.float32), now[2].astype(np.float32)
    return m


def _prepared(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.length(t).cast("long").alias("chars"), F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("upper"))


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most `sample` labelled rows, those of least hash of the id; null labels and ids don't count."""
    drawn = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("id"), "id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _featured(batches):
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["id", "y", "x"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    found = _prepared(docs, id, text).join(F.broadcast(drawn), "id").mapInArrow(extract, f"id {kind}, y int, x binary").limit(sample).toPandas().sort_values("id")
    x = np.stack([np.frombuffer(bytes(v), np.float16) for v in found["x"]]).astype(np.float32) if len(found) else np.zeros((0, WORD_BUCKETS + STATS), np.float32)
    return fit(x, found["y"].to_numpy(dtype=np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, score (0 to 1), predicted.

    Null text is scored as the empty one. Each row is scored for itself, so repeated rows and ids with several texts have
    a row each, equal texts equal scores; a null id is kept. A score at the threshold counts as 1. Very long texts are
    read whole, one at a time. A model of no labelled rows scores all alike. An empty table gives no rows; other columns
    of docs, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _featured(batches):
            p = shared.value.probability(x).astype(np.float64)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return _prepared(docs, id, text).mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", id)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0))
    return score_quality(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
