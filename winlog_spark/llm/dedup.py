"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lower_ascii, member_bits, salt_of, text_hash, with_groups, with_member, without_rows

#: Characters whose hash is the second step.
PREFIX = 64
#: The bitmap of surviving groups has 2**GROUP_BITS bits (1 MB).
GROUP_BITS = 23


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """Per row: id, text_hash, n_bytes, digest, keep_id (the id of the row that stays), group_size, kept.

    1. Rows are counted by length and prefix hash, which moves 16 bytes a row; groups of one are done.
    2. The groups that survive set bits in a bitmap of bounded size. Only rows whose bit is set have their full
       normalised text hashed (digest is null for others, unless digest_all asks for it). No text is ever shuffled.
    3. Rows of equal length and digest form a group, however they came by; its greatest id stays. Hot groups are dealt
       over many tasks by a salt.

    Null text counts as empty, and equal texts are those that agree after lower-casing A-Z. Rows that repeat the id that
    stays are all kept: nothing tells them apart. Where a group has no id but null, keep_id is null and its rows stay.
    Rows of one id with different texts belong to different groups; text_hash tells them apart. An empty table gives no
    rows; other columns of docs, whatever their names, are not read. A very long text is hashed where it is read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    head = docs.select(F.col(id).alias("id"), text_hash(t).alias("text_hash"), t.alias("_t"), F.octet_length(t).cast("long").alias("n_bytes"))
    head = head.withColumn("_group", F.xxhash64("n_bytes", lower_ascii(F.substring("_t", 1, PREFIX))))
    survivors = head.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    head = with_member(head, F.col("_group"), member_bits(survivors, "_group", GROUP_BITS), "_in", GROUP_BITS)
    full = F.sha2(lower_ascii(F.col("_t")).cast("binary"), 256)
    hashed = head.select("id", "text_hash", "n_bytes", "_in", (full if digest_all else F.when(F.col("_in"), full)).alias("digest"))
    alone = hashed.where(~F.col("_in")).select("id", "text_hash", "n_bytes", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    among = with_groups(hashed.where("_in"), ["n_bytes", "digest"], {"keep_id": ("max", "id"), "group_size": ("count", "id")}, salt_of("id"))
    out = among.select("id", "text_hash", "n_bytes", "digest", "keep_id", "group_size").unionByName(alone)
    return out.select(F.col("id").alias(id), "text_hash", "n_bytes", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows of equal text that have a smaller id than another; columns as they are.

    Rows go by their own verdict, so of one id with different texts only the copy of another text goes. Repeats of the
    row that stays all stay, and so do rows without an id.
    """
    return without_rows(docs, exact_dedup(docs, id, text).where("not kept"), id, text)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
