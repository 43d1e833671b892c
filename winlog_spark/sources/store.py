"""Events kept as a table for triage: laid out for pruning by channel, day and log, with an index of texts by file."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import canonical_channel, exploded
from ..plans.search import HEADER_FIELDS, Clause, clauses, haystack, search
from ..plans.timewin import in_range
from ..schema import EVENTS

#: Partition columns: the channel in lower case, the day in UTC, the log's name.
LAYOUT = ("channel_key", "day", "log")
#: Pieces of text are noted in 2**INDEX_BITS slots for each file (32 KB).
INDEX_BITS = 18
PIECE = 3
#: If more files may hold a text, the whole table is read.
MOST_FILES = 10_000
NO_DAY = "none"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def laid_out(events: DataFrame) -> DataFrame:
    """events with the partition columns, dealt by ranges of them and of event id, so that a hot day or log is several files, each of few ids."""
    day = F.coalesce(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd"), F.lit(NO_DAY))
    rows = events.select(*EVENTS.names).withColumns({"channel_key": canonical_channel(), "day": day, "log": F.coalesce("file", F.lit(""))})
    return rows.repartitionByRange(*LAYOUT, "event_id", "g").sortWithinPartitions(*LAYOUT, "event_id", "ts")


def save_events(events: DataFrame, table: str) -> None:
    """Writes events into a table; logs that it holds already are replaced, and other logs' partitions are not touched.

    Their partitions are dropped before the new ones are added, so a write that failed can be done again. The names of
    the logs written come to the driver, a row for each log.
    """
    spark = events.sparkSession
    if not spark.catalog.tableExists(table):
        laid_out(events).write.format("parquet").partitionBy(*LAYOUT).saveAsTable(table)
        return
    for row in events.select(F.coalesce("file", F.lit("")).alias("log")).distinct().collect():
        remove_log(spark, table, row.log)
    laid_out(events).write.mode("append").insertInto(table)


def partitions_of(spark: SparkSession, table: str, log: str) -> list[dict[str, str]]:
    """The partitions of one log, as the catalog has them; no data is read."""
    shown = spark.sql(f"SHOW PARTITIONS {table} PARTITION (log = {_quoted(log or '__HIVE_DEFAULT_PARTITION__')})").collect()
    return [dict(part.split("=", 1) for part in row[0].split("/")) for row in shown]


def remove_log(spark: SparkSession, table: str, log: str) -> int:
    """Drops the partitions of one log, with their files; how many there were."""
    found = partitions_of(spark, table, log)
    specs = [", ".join(f"PARTITION ({', '.join(f'{k} = {_quoted(unquote(v))}' for k, v in p.items())})" for p in found[i : i + 500]) for i in range(0, len(found), 500)]
    for spec in specs:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {spec}")
    return len(found)


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The events of a table, with the partition columns."""
    return spark.table(table)


def _asked(groups: list[list[Clause]], header: str) -> list[str] | None:
    """The values of a header field that all groups ask for, of which an event must have one; None if some group asks for none."""
    out = []
    for g in groups:
        exact = [c.value for c in g if c.field and HEADER_FIELDS.get(c.field.lower()) == header and not c.negate and not c.cmp and "*" not in c.value]
        if not exact:
            return None
        out.append(exact[0])
    return out


def pruning(groups: list[list[Clause]], start: datetime | None = None, end: datetime | None = None) -> Column:
    """What a search and a range of times say of partitions and of event ids, as filters that reach the scan."""
    test = F.lit(True)
    channels, ids = (_asked(groups, h) if groups else None for h in ("channel", "eventid"))
    if channels is not None:
        test = test & F.col("channel_key").isin([c.lower() for c in channels])
    if ids is not None and all(i.isdigit() and len(i) < 10 for i in ids):
        test = test & F.col("event_id").isin([int(i) for i in ids])
    if start is not None:
        test = test & (F.col("day") >= start.strftime("%Y-%m-%d"))
    if end is not None:
        test = test & (F.col("day") <= end.strftime("%Y-%m-%d"))
    return test & (F.col("day") != NO_DAY) if start is not None or end is not None else test


def search_stored(spark: SparkSession, table: str, query: str | list[list[Clause]], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The events of a table that a search selects between two moments (UTC): partitions by channel and day, row groups by event id, then the search itself."""
    groups = clauses(query) if isinstance(query, str) else query
    rows = stored(spark, table).where(pruning(groups, start, end))
    if start is not None or end is not None:
        rows = rows.where(in_range(start or datetime(1601, 1, 1), end or datetime(9999, 12, 30)))
    return search(rows, groups).select(*EVENTS.names)


# --- texts ---------------------------------------------------------------------------


def _pieces(text: Column) -> Column:
    """The different pieces of PIECE characters of a text, by one pass of a look-ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1)))


def _slot(piece: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(1 << bits))


def text_index(events: DataFrame, bits: int = INDEX_BITS) -> DataFrame:
    """(file, bucket, bitmap, bits): for each data file the slots of all pieces of its events' haystacks; events are read from files.

    A file is read by a few tasks, each of which hands on its bitmaps only. Other files' rows need not be indexed anew
    when a log is added: its index is appended.
    """
    pieces = exploded(events.select(F.col("_metadata.file_path").alias("file"), _pieces(haystack()).alias("_pieces")), F.col("_pieces"), "piece")
    slots = pieces.select("file", _slot(F.col("piece"), bits).alias("slot"))
    return slots.groupBy("file", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")).withColumn("bits", F.lit(bits))


def files_with(index: DataFrame, text: str) -> DataFrame | None:
    """(file): the files that may hold a text, all that do and some that don't; None if it is too short to tell."""
    needle = text.lower()
    pieces = sorted({needle[i : i + PIECE] for i in range(len(needle) - PIECE + 1)})
    if not pieces:
        return None
    asked = index.sparkSession.createDataFrame([(x,) for x in pieces], "piece string")
    slot = F.pmod(F.xxhash64("piece"), F.expr("shiftleft(1L, bits)"))
    met = index.join(F.broadcast(asked), F.col("bucket") == F.bitmap_bucket_number(slot))
    byte = F.expr("substring(bitmap, CAST(bitmap_bit_position(_slot) DIV 8 AS INT) + 1, 1)")
    hit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, CAST(bitmap_bit_position(_slot) % 8 AS INT))")) != 0
    return met.withColumn("_slot", slot).where(hit).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(pieces)).select("file")


def search_texts(spark: SparkSession, table: str, index: DataFrame, text: str) -> tuple[DataFrame, int | None]:
    """The events of a table whose haystack holds a text, and how many files are read for it (None: all).

    Names of files come to the driver, at most MOST_FILES and one. Files are left out before the scan; what is read is
    tested exactly, so the events are those of a search without the index.
    """
    found = files_with(index, text)
    names = [] if found is None else [r.file for r in found.limit(MOST_FILES + 1).collect()]
    if found is None or len(names) > MOST_FILES:
        rows, n = stored(spark, table), None
    elif not names:
        rows, n = stored(spark, table).where(F.lit(False)), 0
    else:
        rows, n = spark.read.schema(EVENTS).parquet(*map(unquote, names)), len(names)
    return search(rows.select(*EVENTS.names), [[Clause(text)]]), n
