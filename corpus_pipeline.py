"""A corpus pipeline: language ID, exact and near duplicates, source mixing and packing, each stage a table for the next."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlog_spark.llm import dedup, langid, mixing, neardup, packing
from winlog_spark.llm.common import documents, word_count


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which no language makes up half: no text, no letter, or a mixture without a main language.

    Null and empty texts go, whatever their id. Each row is judged by its own text, repeats alike, so an id that occurs
    with several texts loses only those that are rejected. Ties go to the first language by code point. Very long texts
    are judged whole. No rows in, no rows out; further columns go along, whatever their names.
    """
    return langid.keep_languages(docs, langid.learned(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z) the row of the greatest id stays.

    Null and empty texts are equal to each other. Rows that repeat the id and text that stay are all kept (a tie that
    nothing breaks); rows without an id stay. Of an id with several texts only the duplicate text goes. Very long texts are hashed whole. No rows in, no rows out; further columns go along.
    """
    return dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, over any number of links, that of the smallest id stays.

    Null, empty and blank texts and rows without an id are linked with nothing and stay. Rows that repeat an id and text
    stay or go together; of an id with several texts each goes by its own links. Very long texts count whole. No rows
    in, no rows out; further columns go along.
    """
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document may go, be cut at a block's end, or come again, up to three times.

    Documents without words are not taken. A null source is a source like others, the last. Each row goes by its own
    take, whatever other rows share its id. Equal quotients go to the smaller source or shard. Very long texts are sources of blocks like
    others. No rows in, no rows out; further columns go along.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in pieces of at most the greatest length, each with its bin.

    Documents without words have one row with bin null. Equal sizes go by id; repeated rows are packed once each, a null
    id like others. Very long texts give full pieces and a remainder. No rows in, no rows out; of further columns none.
    """
    return packing.best_fit_pack(docs.select("doc_id", word_count(F.col("text")).alias("n_words")), "n_words", ["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Language ID and packing have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written to the shared checkpoint folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{shared}/pipeline-{uuid4().hex}"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
