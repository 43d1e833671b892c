"""Extendible hashing of documents into shards under a byte limit, with DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents

#: Bytes a shard may hold.
LIMIT = 1 << 20
#: Bits of the hash, and how many the directory is deepened by at a time.
BITS, STEP = 60, 6


def _leaves(cells: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """Of cells(cell at depth bits, bytes, n, lo, hi): the directory (cell, depth, prefix, shard_bytes, shard_docs), open ones at depth included.

    A bucket is done if it fits, or if no further bit can split it (one row, or equal hashes); then so are all below it,
    and the shards are the done buckets whose parent is not. Sums go upwards STEP levels at a time, each from the level
    below, and cells look for their shard on the levels only that have one, so no prefix gathers all cells.
    """
    level, tables, at, low = cells.withColumnRenamed("cell", "p"), [], depth, depth + 1
    sums = [F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    while low > top:
        high, low = low - 1, max(top, at - STEP)
        up = level.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("p", F.expr(f"shiftright(p, {at} - d)"))
        tables.append(checkpointed(up.groupBy("d", "p").agg(*sums)))
        level, at = tables[-1].where(F.col("d") == low).drop("d"), low
    buckets = reduce(DataFrame.unionByName, tables).withColumn("done", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
    parents = buckets.where("done").select((F.col("d") + 1).alias("d"), F.col("p").alias("up"))
    shards = buckets.where(F.col("done") | (F.col("d") == depth)).withColumn("up", F.expr("shiftright(p, 1)")).join(parents, ["d", "up"], "left_anti")
    shards = checkpointed(shards.select("d", "p", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_docs"), (~F.col("done")).alias("open")))
    found = sorted(r.d for r in shards.select("d").distinct().collect())
    of = cells.select("cell", F.explode(F.array(*[F.lit(d) for d in found]) if found else F.array().cast("array<int>")).alias("d")).withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
    return of.join(shards, ["d", "p"]).withColumnsRenamed({"d": "depth", "p": "prefix"})


def extendible_shards(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, depth, shard (the hash prefix as bits, '' at depth 0), shard_bytes, shard_docs, fits.

    Rows are summed into the cells of a directory deep enough for the whole input; each level's buckets follow from the
    cells, and a row's bucket is the first on its way down that fits the limit. Cells that are still too large get
    further bits, read for their rows alone, until all fit. A row larger than the limit ends alone in its shard, and rows
    of one id, which no bit tells apart, stay together; fits is false for such shards. Null text has 0 bytes; a null id
    hashes as the empty text. Repeated rows share their id's shard; a very long text counts by its bytes and is not
    moved. An empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), h.alias("_h"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, top, todo, done = min(BITS, STEP + max(0, ceil(log2(max(1, total / limit))))), 0, rows, None
    while True:
        keyed = todo.withColumn("cell", F.shiftright("_h", BITS - depth))
        cells = checkpointed(keyed.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi")))
        directory = _leaves(cells, top, depth, limit)
        placed = keyed.join(directory, "cell").drop("cell")
        part = placed.where("not open").drop("open")
        done = part if done is None else done.unionByName(part)
        if depth == BITS or directory.where("open").isEmpty():
            break
        todo = placed.where("open").select(*rows.columns)
        top, depth = depth + 1, min(BITS, depth + STEP)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return done.select(id, "n_bytes", "depth", bits.alias("shard"), "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, id: str = "doc_id", **options) -> None:
    """docs as one folder of Parquet files for each shard, the shard's rows brought together first: they fit its byte limit.

    Rows of one id, and rows without an id, stay together in one shard, each written once. Very long texts are written
    whole. Without rows an empty folder is written; a column of docs named shard is replaced.
    """
    shard = extendible_shards(docs, id, **options).select(id, "shard").dropDuplicates([id])
    docs = docs.drop("shard")
    docs.join(shard, docs[id].eqNullSafe(shard[id])).drop(shard[id]).repartition("shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(documents(spark, sf_dir))


OP7_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents),
b AS (SELECT t.d AS depth, h >> ({BITS} - t.d)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS one
      FROM d, range(0, {BITS + 1}) t(d) GROUP BY t.d, h >> ({BITS} - t.d)::INT),
f AS (SELECT d.doc_id, d.n_bytes, d.h, b.depth, b.prefix, b.shard_bytes, b.shard_docs, row_number() OVER (PARTITION BY d.doc_id, d.h ORDER BY b.depth) AS r
      FROM d JOIN b ON b.prefix = d.h >> ({BITS} - b.depth)::INT AND (b.shard_bytes <= {LIMIT} OR b.one OR b.depth = {BITS}))
SELECT doc_id, n_bytes, depth::INT AS depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth::INT) END AS shard, shard_bytes, shard_docs, shard_bytes <= {LIMIT} AS fits
FROM f WHERE r = 1
"""
