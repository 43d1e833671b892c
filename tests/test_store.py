"""The event table: what a search prunes, what removing a log touches, and files left out by the index of texts."""

from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F
from test_events import T0, events

from winlog_spark.plans import search, timewin
from winlog_spark.schema import SECURITY, SYSMON
from winlog_spark.sources import store


@pytest.fixture(scope="module")
def table(spark):
    rows = [(4624 + i % 3, SECURITY, [("User", f"u{i}")], {"channel": "Security", "file": f"log{i % 4}.evtx", "ts": T0 + timedelta(hours=9 * i)}) for i in range(40)]
    rows += [(1, SYSMON, [("CommandLine", f"run{i}")], {"channel": "Microsoft-Windows-Sysmon/Operational", "file": "it's a log%.evtx", "ts": None if i == 3 else T0 + timedelta(days=i)}) for i in range(9)]
    name = f"events_{uuid4().hex}"
    store.save_events(events(spark, *rows), name)
    return name


def as_set(df):
    return {tuple(map(str, r)) for r in df.select("g", "event_id", "channel", "ts", "file", "ed").collect()}


@pytest.mark.parametrize("query", ["channel:security EventID:4625", "EventID:4624 OR EventID:1", "channel:Security OR u7", "run3", "-EventID:4624 channel:*sysmon*", "EventID:4624 channel:security OR EventID:4626 channel:security"])
@pytest.mark.parametrize("days", [None, (1, 6)])
def test_pruned_search_is_the_search(spark, table, query, days):
    start, end = (T0 + timedelta(days=d) for d in days) if days else (None, None)
    want = search.search(spark.table(table), query)
    want = timewin.between(want, start, end) if days else want
    assert as_set(store.search_stored(spark, table, query, start, end)) == as_set(want)


def test_filters_reach_the_scan(spark, table):
    plan = store.search_stored(spark, table, "channel:security EventID:4625", datetime(2024, 3, 1), datetime(2024, 3, 4))._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "channel_key#" in scan.split("PartitionFilters")[1].split("]")[0] and "day#" in scan.split("PartitionFilters")[1] and "EqualTo(event_id,4625)" in scan.split("PushedFilters")[1]


def test_a_log_is_removed_and_replaced_alone(spark, table):
    before = spark.table(table)
    kept = as_set(before.where("file <> 'log2.evtx'"))
    files = lambda log: {r[0] for r in spark.table(table).where(F.col("log") == log).select("_metadata.file_path").distinct().collect()}
    others = files("log1.evtx")
    mine = before.where("file = 'log2.evtx'").drop(*store.LAYOUT).collect()
    n = store.remove_log(spark, table, "log2.evtx")
    assert n and as_set(spark.table(table)) == kept and files("log1.evtx") == others and not store.partitions_of(spark, table, "log2.evtx")
    again = spark.createDataFrame(mine[:4], before.drop(*store.LAYOUT).schema)
    store.save_events(again, table)
    store.save_events(again.limit(3), table)
    assert spark.table(table).where("file = 'log2.evtx'").count() == 3 and files("log1.evtx") == others
    store.remove_log(spark, table, "it's a log%.evtx")
    assert spark.table(table).where("event_id = 1").count() == 0 and store.remove_log(spark, table, "no such log") == 0


def test_files_without_a_text_are_not_read(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("g"), F.col("id").alias("record_id"), F.lit(T0).alias("ts"), F.lit(4).cast("byte").alias("level"), F.lit(1).alias("event_id"), F.lit(SYSMON).alias("provider"), F.lit("Microsoft-Windows-Sysmon/Operational").alias("channel"), F.lit("h").alias("computer"), F.format_string("log%03d", F.floor(F.col("id") / 20)).alias("file"), F.array(F.struct(F.lit("CommandLine").alias("name"), F.when(F.col("id") % 977 == 5, "Needle-in-hay").otherwise(F.concat(F.lit("word "), F.col("id"))).alias("value"))).alias("ed"))
    name = f"texts_{uuid4().hex}"
    store.save_events(rows, name)
    index = store.text_index(spark.table(name)).cache()
    total = spark.table(name).select("_metadata.file_path").distinct().count()
    assert total >= 200
    for text, most in (("needle", 0.05), ("NEEDLE-in", 0.05), ("nowhere to be found", 0.0), ("word 1234", 0.2), ("rd", None), ("", None)):
        out, n = store.search_texts(spark, name, index, text)
        assert as_set(out) == as_set(search.search(spark.table(name), [[search.Clause(text)]])), text
        assert (n is None) == (most is None) and (n is None or n <= most * total)


def test_text_index_makes_each_text_once(spark, tmp_path):
    events(spark, (1, SECURITY, [("CommandLine", "whoami")])).write.parquet(str(tmp_path / "e"))
    index = store.text_index(spark.read.parquet(str(tmp_path / "e")))
    assert "size(" not in index._jdf.queryExecution().optimizedPlan().toString() and index.count() > 0
