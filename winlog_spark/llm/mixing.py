"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, text_hash, word_count

#: Tokens of a block, the unit that is apportioned.
BLOCK = 64
WEIGHTS = (5, 2, 1)
#: No source or document is taken more often.
MOST_REPEATS = 3
ROWS_PER_SHARD = 512
#: A source's blocks go to groups of so many shards first, then to the shards of each, so that no window grows with the table.
SHARDS_PER_GROUP = 4096
SEED = "mix-1"


def _hash(salt: str, id: Column) -> Column:
    """60 bits of md5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def apportion(parties: DataFrame, within: list[str], party: str, share: str, seats: str) -> DataFrame:
    """parties with `quota`: how many of the group's seats each gets by highest quotients share / (2 s + 1).

    within: columns that name the group; seats is the same on all its rows. A divisor that surely hands out no more than
    all seats gives most of them at once; the few that remain go by rank among the next quotients, of which a group of n
    parties has at most 3 n. Equal quotients go to the smaller party. Parties with share 0 get none.
    """
    g = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_n", F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(g)).withColumn("_all", F.sum(share).over(g))
    p = p.withColumn("_sure", F.when((F.col("_all") > 0) & (F.col(seats) * 2 > F.col("_n")), F.greatest(F.lit(0), F.ceil(F.col(share) / F.col("_all") * (F.col(seats) - F.col("_n") / 2.0) - 0.5))).otherwise(0).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    p = p.withColumn("_tries", F.when((F.col(share) > 0) & (F.col("_left") > 0), F.least(F.col("_left"), F.ceil(F.col(share) / F.col("_all") * F.col("_n")) + 2)).otherwise(0).cast("int"))
    q = p.select(*within, party, share, "_sure", "_left", F.explode(F.sequence(F.lit(0), F.col("_tries"))).alias("_s"))
    order = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    q = q.where("_s > 0").withColumn("_rank", F.row_number().over(order.orderBy(F.desc(F.col(share) / (2 * (F.col("_sure") + F.col("_s")) - 1)), party, "_s")))
    won = q.where("_rank <= _left").groupBy(*within, party).agg(F.count(F.lit(1)).alias("_won"))
    return p.join(won, [*within, party], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_n", "_all", "_sure", "_left", "_tries", "_won")


def targets(sources: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: `weight` (by code point, null last, repeating) and `target`.

    Targets share the sum of all sizes by weight, but stop at `most` times their source's size; what is over is shared
    by weight among the rest. Sources fill up by rising cap per weight, so the level follows from running sums. The
    table has one row per source, not per document.
    """
    one = Window.partitionBy(F.lit(0))
    s = sources.withColumn("_r", F.row_number().over(one.orderBy(F.col(source).asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.col(size) * most).withColumn("_all", F.sum(size).over(one))
    rising = one.orderBy(F.col("_cap") / F.col("weight"), "_r")
    s = s.withColumn("_caps", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_rest", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in this order, that does not reach its cap sets the level for itself and all after it
    s = s.withColumn("_free", F.col("_cap") * F.col("_rest") > F.col("weight") * (F.col("_all") - F.col("_caps")))
    s = s.withColumn("_at", F.row_number().over(rising))
    s = s.withColumn("_level", F.min(F.when(F.col("_free"), F.struct("_at", "_caps", "_rest"))).over(one))
    free = F.col("_level").isNotNull() & (F.col("_at") >= F.col("_level._at"))
    s = s.withColumn("target", F.when(free, (F.col("weight") * (F.col("_all") - F.col("_level._caps"))).cast("double") / F.col("_level._rest").cast("double")).otherwise(F.col("_cap").cast("double")))
    return s.drop("_r", "_at", "_cap", "_all", "_caps", "_rest", "_free", "_level")


def _mix(docs: DataFrame, id: str, source: str, text: str, weights: tuple[int, ...], block: int, seed: str, carry: Column | None = None) -> DataFrame:
    """Per row: id, source, text_hash, size, source_size, target, taken, and what is carried along."""
    size = docs.select(F.col(id), F.col(source), text_hash(F.col(text)).alias("text_hash"), word_count(F.col(text)).alias("size"), *([carry.alias("_carried")] if carry is not None else []))
    k = max(1, -(-docs.count() // ROWS_PER_SHARD))
    slim = size.withColumn("_src", F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(F.col(source), F.lit("")))).withColumn("_shard", F.pmod(_hash("shard", F.col(id)), F.lit(k)))
    shards = slim.groupBy("_src", "_shard").agg(F.sum("size").alias("shard_size"))
    sources = targets(shards.groupBy("_src").agg(F.sum("shard_size").alias("source_size")), "_src", "source_size", weights)
    sources = sources.withColumn("_seats", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block))
    sources = apportion(sources, [], "_src", "target", "_seats").withColumn("_quota", F.least(F.col("quota"), F.ceil(F.col("source_size") * MOST_REPEATS / block))).drop("quota", "_seats")
    shards = shards.withColumn("_group", F.floor(F.col("_shard") / SHARDS_PER_GROUP))
    groups = shards.groupBy("_src", "_group").agg(F.sum("shard_size").alias("_size")).join(sources, "_src")
    groups = apportion(groups, ["_src"], "_group", "_size", "_quota").select("_src", "_group", "source_size", "target", F.col("quota").alias("_quota"))
    quotas = apportion(shards.join(groups, ["_src", "_group"]), ["_src", "_group"], "_shard", "shard_size", "_quota")
    quotas = quotas.withColumn("_take", F.least(F.col("quota") * block, F.col("shard_size") * MOST_REPEATS))
    # words cut off at a shard's limit go to shards of its group with room, those with most room first
    quotas = quotas.withColumn("_room", F.col("shard_size") * MOST_REPEATS - F.col("_take"))
    group = Window.partitionBy("_src", "_group")
    filled = group.orderBy(F.desc("_room"), "_shard").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_quota") * block - F.sum("_take").over(group) - F.coalesce(F.sum("_room").over(filled), F.lit(0))
    quotas = quotas.withColumn("_take", F.col("_take") + F.greatest(F.lit(0), F.least(F.col("_room"), left)))
    quotas = quotas.withColumn("_times", F.when(F.col("shard_size") > 0, F.floor(F.col("_take") / F.col("shard_size"))).otherwise(0))
    quotas = quotas.withColumn("_over", F.col("_take") - F.col("_times") * F.col("shard_size")).select("_src", "_shard", "source_size", "target", "_times", "_over")
    drawn = Window.partitionBy("_src", "_shard").orderBy(_hash(seed, F.col(id)), id, "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.join(quotas, ["_src", "_shard"]).withColumn("_before", F.coalesce(F.sum("size").over(drawn), F.lit(0)))
    taken = F.col("_times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_over") - F.col("_before")))
    return out.select(id, source, "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["_carried"] if carry is not None else []))


def mix_sources(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """Per row: id, source, text_hash, size, source_size, target, taken (words the mix takes, repeats counted).

    The words of all documents make up blocks of `block` tokens. Sources get whole blocks by highest quotients of their
    targets; a source's blocks are dealt by the same rule to groups of its shards and to the shards (hash of the id), by
    their sizes. A shard gives at most MOST_REPEATS times its words; what its blocks hold beyond that is taken from shards
    of the group that have room. In a shard the documents stand in an order drawn by the seed; all are taken as often as
    the quota goes over the whole shard, and the words that remain are the first in this order, so at most one document
    a shard is taken in part.

    A shard holds a source's rows of one hash, so that a source with a third of all rows is spread like any other, and no
    text moves. Null text has size 0, and such rows are taken 0 times; null is a source like others. Repeated rows stand
    side by side, each with its own words; of one id with several texts or sources each has its own too. Equal quotients
    go to the smaller source, group or shard. A very long text is counted, not moved. Sources are ranked and filled up in
    one task: they are to be some thousands at most, not hosts or users. An empty table gives no rows; other columns of
    docs, whatever their names, are not read.
    """
    return _mix(docs, id, source, text, weights, block, seed)


def mixed_documents(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The documents that the mix takes, with docs' columns: a row for each time a text is taken, and one with its first words where it is taken in part.

    Each row goes along with its own take, so rows that share an id, whatever their texts and sources, and rows without one
    come out as often as the mix takes them.
    """
    each = _mix(docs, id, source, text, weights, block, seed, F.struct(*[F.col(c) for c in docs.columns])).where("taken > 0")
    each = each.select("_carried", "size", F.explode(F.sequence(F.col("taken"), F.lit(1).cast("long"), -F.col("size"))).alias("left"))
    of = F.col("_carried")[text]
    words = F.array_join(F.slice(F.regexp_extract_all(of, F.lit(f"({WORD})")), 1, F.col("left").cast("int")), " ")
    made = F.when(F.col("left") >= F.col("size"), of).otherwise(words)
    column = {text: made} | ({"n_chars": F.length(made).cast("long")} if "n_chars" in docs.columns else {})
    return each.select(*[column.get(c, F.col("_carried")[c]).alias(c) for c in docs.columns])


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, quotients taken one by one; for tables of one group of shards, at most SHARDS_PER_GROUP * ROWS_PER_SHARD rows."""
    h = "CAST(('0x' || substr(md5('{}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT)"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         {h.format('shard')} % (SELECT greatest(1, (count(*) + {ROWS_PER_SHARD - 1}) // {ROWS_PER_SHARD}) FROM {table}) AS shard,
         {h.format(SEED)} AS draw
  FROM {table}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS r FROM d GROUP BY source),
s1 AS MATERIALIZED (SELECT source, r, source_size, [5, 2, 1][((r - 1) % 3 + 1)::INT]::BIGINT AS weight, {MOST_REPEATS} * source_size AS cap, (SELECT sum(size)::BIGINT FROM d) AS total FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
              (sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest,
              row_number() OVER (ORDER BY cap / weight, r) AS q FROM s1),
lvl AS (SELECT * FROM s2 WHERE cap::HUGEINT * rest > weight::HUGEINT * (total - caps) ORDER BY q LIMIT 1),
s3 AS MATERIALIZED (SELECT s2.source, s2.r, s2.source_size, s2.total,
       CASE WHEN lvl.q IS NOT NULL AND s2.q >= lvl.q THEN CAST(s2.weight * (s2.total - lvl.caps) AS DOUBLE) / CAST(lvl.rest AS DOUBLE) ELSE CAST(s2.cap AS DOUBLE) END AS target
       FROM s2 LEFT JOIN lvl ON true),
seat AS (SELECT r, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, r, k) AS pos
         FROM s3, range(1, (SELECT total // {BLOCK} + 1 FROM s1 LIMIT 1)) t(k) WHERE target > 0 AND k <= target / {BLOCK} + (SELECT count(*) FROM s1) + 2),
s4 AS MATERIALIZED (SELECT s3.*, least((SELECT count(*) FROM seat WHERE seat.r = s3.r AND pos <= s3.total // {BLOCK}), CAST(ceil(source_size * {MOST_REPEATS} / {BLOCK}) AS BIGINT)) AS quota FROM s3),
sh AS MATERIALIZED (SELECT s4.r, d.shard, s4.quota, sum(d.size)::BIGINT AS shard_size, any_value(s4.source_size) AS source_size, any_value(s4.target) AS target
       FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source GROUP BY s4.r, d.shard, s4.quota),
seat2 AS (SELECT r, shard, quota, row_number() OVER (PARTITION BY r ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS pos
          FROM sh, range(1, (SELECT max(quota) + 1 FROM sh)) t(k) WHERE shard_size > 0 AND k <= quota),
won AS (SELECT r, shard, count(*) AS n FROM seat2 WHERE pos <= quota GROUP BY r, shard),
q0 AS (SELECT sh.*, least(coalesce(won.n, 0) * {BLOCK}, {MOST_REPEATS} * shard_size) AS first_take FROM sh LEFT JOIN won USING (r, shard)),
q1 AS (SELECT *, {MOST_REPEATS} * shard_size - first_take AS room, quota * {BLOCK} - sum(first_take) OVER (PARTITION BY r) AS left_over FROM q0),
q AS (SELECT *, first_take + CAST(greatest(0, least(room, left_over - coalesce(sum(room) OVER (PARTITION BY r ORDER BY room DESC, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take FROM q1),
q2 AS (SELECT *, CASE WHEN shard_size > 0 THEN take // shard_size ELSE 0 END AS times FROM q),
x AS (SELECT d.doc_id, d.size, q2.source_size, q2.target, q2.times, q2.take - q2.times * q2.shard_size AS over_,
             coalesce(sum(d.size) OVER (PARTITION BY q2.r, d.shard ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source JOIN q2 ON q2.r = s4.r AND q2.shard = d.shard)
SELECT doc_id, size, source_size, target, CAST(times * size + greatest(0, least(size, over_ - before)) AS BIGINT) AS taken FROM x
"""


OP4_SQL = mix_sql()
