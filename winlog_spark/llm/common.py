"""Pieces that several corpus operators share: text expressions, skew-safe grouping and byte blocks for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A hot key is spread over this many tasks before its rows meet their group's values.
SALTS = 128
#: Text bytes that an Arrow task works on at once (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; Arrow batches are bounded by bytes, since some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the cluster's shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the session's spark.checkpoint.dir; only where that is unset, as in tests, a warehouse subfolder is used.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder of checkpoints and read again.

    Like checkpointed, but Spark knows the size of what was written; a checkpoint keeps the estimate of its query, which
    multiplies over joins and, in a loop, soon has thousands of digits.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    at = f"{shared}/stored-{uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def tasks_for(rows: int, each: int = 50_000) -> int:
    return max(8, -(-rows // each))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """Tells rows of one id with different texts apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def salt_of(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def with_groups(rows: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str]], salt: Column, having: Column | None = None, how: str = "left", tasks: int | None = None) -> DataFrame:
    """rows with aggregates of their group, without bringing a group's rows into one task.

    aggs: name -> (min | max | sum | count, column). Rows are first aggregated by (keys, salt), those by keys; the totals
    go back along (keys, salt), so a key that holds a third of all rows is dealt over SALTS tasks. Keys must not be null.
    tasks: for a table known to be small, how many tasks its aggregates are worked on by.
    """
    fn = {"min": F.min, "max": F.max, "sum": F.sum, "count": lambda c: F.count(F.lit(1))}
    again = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    salted = rows.withColumn("_salt", salt)
    few = lambda df: df.coalesce(tasks) if tasks else df
    part = few(salted.groupBy(*keys, "_salt").agg(*[fn[f](c).alias(n) for n, (f, c) in aggs.items()]))
    total = few(part.groupBy(*keys).agg(*[again[f](n).alias(n) for n, (f, _) in aggs.items()]))
    if having is not None:
        total = total.where(having)
    back = few(part.select(*keys, "_salt").join(total, list(keys)))
    return salted.join(back, [*keys, "_salt"], how).drop("_salt")


def member_bits(ids: DataFrame, col: str, bits: int = 23) -> DataFrame:
    """(bucket, words): 2**bits slots in which the slot of each value's hash is set, 64 to a long, at most 2**(bits-3) bytes whatever the input.

    It only narrows what is read further: a value that shares a slot by chance is sorted out later by an exact join.
    """
    slot = F.pmod(F.xxhash64(col), F.lit(1 << bits))
    found = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bitmap"))

    def as_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([np.frombuffer(x, "<i8") for x in b.column("bitmap").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("bucket"), words], names=["bucket", "words"])

    return checkpointed(found.mapInArrow(as_longs, "bucket long, words array<long>"))


def with_member(rows: DataFrame, key: Column, bitmap: DataFrame, name: str, bits: int = 23) -> DataFrame:
    """rows with a boolean column: whether the slot of the key is set in a bitmap of member_bits, which is bounded and broadcast."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    of = bitmap.select(F.col("bucket").alias("__bucket"), F.col("words").alias("__words"))
    found = rows.withColumn("__slot", slot).join(F.broadcast(of), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
    bit = F.expr("shiftrightunsigned(__words[CAST(bitmap_bit_position(__slot) DIV 64 AS INT)], CAST(bitmap_bit_position(__slot) % 64 AS INT)) & 1")
    return found.withColumn(name, F.coalesce(bit != 0, F.lit(False))).drop("__slot", "__bucket", "__words")


def without_rows(docs: DataFrame, gone: DataFrame, id: str, text: str) -> DataFrame:
    """docs without the rows whose id and text are in gone(id, text_hash); a null id is never in it.

    Rows that a bounded bitmap shows not to be in gone stay where they are, so that few texts are shuffled.
    """
    gone = checkpointed(gone.select(F.col(id).alias("__id"), "text_hash").distinct())
    bitmap = member_bits(gone.select(F.xxhash64("__id", "text_hash").alias("k")), "k")
    marked = with_member(docs, F.xxhash64(docs[id], text_hash(docs[text])), bitmap, "__in")
    some = marked.where("__in").drop("__in")
    left = some.join(gone, (some[id] == gone["__id"]) & (text_hash(some[text]) == gone["text_hash"]), "left_anti")
    return marked.where("not __in").drop("__in").unionByName(left)


def blocks(batches: Iterator[pa.RecordBatch], text: str | int = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their texts' bytes with A-Z lower-cased, offsets) for slices of at most BLOCK_BYTES, a null text being empty."""
    for batch in batches:
        arr = batch.column(text).fill_null("").cast(pa.large_string())
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        _, offs, data = arr.buffers()
        off = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, side="right")) - 1)
            j = min(j, len(arr), i + 4096)
            yield batch.slice(i, j - i), _FOLD[raw[off[i] : off[j]]], off[i : j + 1] - off[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        base = np.full(n, _BASE)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inverse)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and for each document where its words begin (one entry more at the end)."""
    return word_spans(data, off)[:2]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words, and the first byte of each word and the byte after its last."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = _INK[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = ink[edge]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = ink[edge]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[e] - run[s]) * down[s]), np.searchsorted(s, off), s, e


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs (or the sums of n)."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")  # quick on keys made of a few sorted parts
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], (np.add.reduceat(n[order], at) if len(at) else np.zeros(0)).astype(np.int64)


class Tally:
    """Counts by integer key that are merged whenever they exceed a bound; what doesn't fit is handed on early."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held, self.parts = most, 0, []

    def add(self, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > self.most:
            one = self.merged()
            if len(one[0]) > self.most // 2:
                self.parts, self.held = [], 0
                yield one
            else:
                self.parts, self.held = [one], len(one[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))
