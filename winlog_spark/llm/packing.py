"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its positions (headers, separators, a kernel launch).
OVERHEAD = 32
ROWS_PER_SHARD = 1024


def pack_sizes(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin of each size, its offset there, and the final length of each bin. Every size is from 1 to max(lengths).

    Sizes go by falling length into the open bin with the least room that holds them. Where none does, that length is
    opened whose cost per expected content is least: the size itself plus as much of the still unplaced sizes that can
    fit. At the end each bin is cut to the least permitted length that holds its contents.
    """
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    s = sizes[order]
    below = np.concatenate([np.cumsum(s[::-1])[::-1], [0]])  # below[i]: sum of s[i:]
    falling = -s
    where, offset = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    room: list[tuple[int, int]] = []  # (free positions, bin), sorted
    used: list[int] = []
    cap: list[int] = []
    for i, x in enumerate(s.tolist()):
        at = bisect_left(room, (x, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            best = None
            for c in lengths:
                if c < x:
                    continue
                rest = int(below[max(i + 1, int(np.searchsorted(falling, -(c - x), side="left")))])
                price = (c + overhead) / (x + min(c - x, rest))
                if best is None or price < best[0]:
                    best = (price, c)
            b, free = len(cap), best[1]
            cap.append(best[1])
            used.append(0)
        where[order[i]], offset[order[i]] = b, used[b]
        used[b] += x
        if free > x:
            insort(room, (free - x, b))
    return where, offset, [next(c for c in lengths if c >= u) for u in used]


def best_fit_pack(docs: DataFrame, size: str, key: list[str], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per piece: the columns of key, piece, start, size, bin, bin_offset, bin_length.

    docs has a column `size` (long) and key columns that name a document. A document longer than the greatest length is
    cut into full pieces, which fill a bin each, and one remainder; pieces are dealt by hash into shards of about
    rows_per_shard documents, and each shard is packed by itself, so a task holds a bounded number of sizes and no text. Documents of size 0 (null counts as 0) give one row with bin null. Equal sizes are taken in order of
    key, so a rerun gives the same bins; repeated rows are packed once each, and a null key is a document like others. A very
    long document is its size only. An empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    most = max(lengths)
    shards = max(1, -(-docs.count() // rows_per_shard))
    slim = docs.select(*key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"))
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / most)).cast("int"))))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * most).withColumn("size", F.least(F.lit(most), F.col("_n") - F.col("start"))).drop("_n")
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64(*key, "piece"), F.lit(shards)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, "piece", "size"], kind="stable", ignore_index=True)
        shard, size = pdf.pop("_shard"), pdf["size"].to_numpy()
        where, offset, length = pack_sizes(size[size > 0], lengths, overhead)
        out = pd.DataFrame({"bin": None, "bin_offset": pd.array([pd.NA] * len(pdf), dtype="Int64"), "bin_length": pd.array([pd.NA] * len(pdf), dtype="Int32")}, index=pdf.index, dtype=None)
        at = np.flatnonzero(size > 0)
        out.loc[at, "bin"] = [f"{shard[0]}/{b}" for b in where]
        out.loc[at, "bin_offset"], out.loc[at, "bin_length"] = offset, np.asarray(length, dtype=np.int32)[where]
        return pd.concat([pdf, out], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_shard")
    return pieces.groupBy("_shard").applyInPandas(pack, f"{kept}, bin string, bin_offset long, bin_length int")


def sequences(docs: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences themselves: bin, bin_length, n_words, text (pieces in order, words joined by one blank).

    A bin holds at most bin_length words, so collecting its pieces is bounded. key must name one document: rows without
    it have no sequence, and an id with several texts would give pieces of each. Documents without words are in no bin. A
    very long text stands in several bins. Pieces of a bin come by offset, which are all different. Without rows there are
    no sequences; other columns, whatever their names, are not read.
    """
    cut = packed.where("bin is not null").join(docs.select(F.col(key), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})")).alias("_w")), key)
    cut = cut.select("bin", "bin_length", "size", F.struct("bin_offset", F.array_join(F.slice("_w", (F.col("start") + 1).cast("int"), F.col("size").cast("int")), " ").alias("t")).alias("p"))
    return cut.groupBy("bin", "bin_length").agg(F.sum("size").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), " ").alias("text"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return best_fit_pack(docs.select("doc_id", word_count(F.col("text")).alias("n_words")), "n_words", ["doc_id"])
