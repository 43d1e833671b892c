"""From some events to others: by key, by time, by missing counterpart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import field, values
from ..functions.names import event_name
from ..plans.search import MULTI_FIELDS

#: Memberships of one key are counted by so many tasks.
SALTS = 64
#: Pairs that one key may give before it is answered by its members alone.
MOST_PAIRS = 10_000_000
#: Events of one key that a task pairs with the key's centres.
KEY_ROWS = 100_000
#: Events of one time bucket are dealt over so many tasks.
BURST_SALTS = 16
#: Buckets of a stretch in which overlapping windows are made one before stretches are.
SPAN_BUCKETS = 100_000

#: Logon ids that tell nothing.
IDLE_LOGONS = ("", "-", "0x0", "0x3e7")


def keys_of(kind: str) -> Column:
    """The different keys of an event: its logon ids or process GUIDs, in lower case."""
    skip = IDLE_LOGONS if kind == "logonid" else ("", "-")
    return F.array_distinct(F.filter(F.transform(values(MULTI_FIELDS[kind]), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & ~v.isin(*skip)))


def _keyed(centres: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """(key, g, centre): each membership once, of centres and of events; an event that is a centre too has a row as each."""
    rows = centres.select("g", F.explode(keys_of(kind)).alias("key"), F.lit(True).alias("centre"))
    return rows.unionByName(events.select("g", F.explode(keys_of(kind)).alias("key"), F.lit(False).alias("centre"))).distinct()


def key_members(centres: DataFrame, events: DataFrame, kind: str = "logonid") -> DataFrame:
    """(key, g, centre, centres, events): the centres and events of each key that some centre and some event has, each membership once.

    This is the whole answer of a pivot in rows that grow with the input, not with the product: the events of a centre are
    the rows of its keys. centres and events are the key's numbers of them. Memberships are counted by (key, salt), then by
    key, and the totals go back along (key, salt), so a key that very many events share is dealt over SALTS tasks.
    """
    rows = _keyed(centres, events, kind).withColumn("_s", F.pmod(F.xxhash64("g"), F.lit(SALTS)))
    part = rows.groupBy("key", "_s").agg(F.count_if("centre").alias("_c"), F.count_if(~F.col("centre")).alias("_e"))
    total = part.groupBy("key").agg(F.sum("_c").alias("centres"), F.sum("_e").alias("events")).where("centres > 0 and events > 0")
    return rows.join(part.select("key", "_s").join(total, "key"), ["key", "_s"]).select("key", "g", "centre", "centres", "events")


def key_classes(centres: DataFrame, events: DataFrame, kind: str = "logonid") -> DataFrame:
    """(key, centres, events): how many centres and events share each key."""
    rows = _keyed(centres, events, kind)
    return rows.groupBy("key").agg(F.count_if("centre").alias("centres"), F.count_if(~F.col("centre")).alias("events")).where("centres > 0 and events > 0")


def same_key(centres: DataFrame, events: DataFrame, kind: str = "logonid", most_pairs: int | None = MOST_PAIRS) -> DataFrame:
    """(centre, g): events that share a key with a centre event, on whatever computer, pair by pair.

    Pairs are made of the keys that give at most most_pairs of them (None: of all). Keys beyond that are answered without
    pairs: key_members has all their centres and events. Centres of a key are copied to as many tasks as its events need.
    """
    rows = key_members(centres, events, kind)
    rows = rows if most_pairs is None else rows.where(F.col("centres") * F.col("events") <= most_pairs)
    tasks = F.floor(F.col("events") / KEY_ROWS).cast("int")
    c = rows.where("centre").select("key", F.col("g").alias("centre"), F.explode(F.sequence(F.lit(0), tasks)).alias("_t"))
    e = rows.where("not centre").select("key", "g", F.pmod(F.xxhash64("g"), tasks + 1).cast("int").alias("_t"))
    return c.join(e, ["key", "_t"]).select("centre", "g").distinct()


def near_in_time(centres: DataFrame, events: DataFrame, seconds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """(centre, g): events within ± seconds of each centre, pair by pair.

    Both sides are put in buckets of that width; a centre looks into its own and the two beside it, so this is an
    equi-join with an exact test, not a product. by: columns that must agree too, such as computer. Where many centres
    stand close together the pairs are many; events_near and counts_near answer without them.
    """
    width = F.lit(seconds * 1_000_000)
    t = F.unix_micros("ts")
    c = centres.where("ts is not null").select(F.col("g").alias("centre"), t.alias("_ct"), *[F.col(x) for x in by], F.explode(F.sequence(F.floor(t / width) - 1, F.floor(t / width) + 1)).alias("_b"))
    e = events.where("ts is not null").select("g", t.alias("_t"), *[F.col(x) for x in by], F.floor(t / width).alias("_b"))
    return c.join(e, ["_b", *by]).where(F.abs(F.col("_t") - F.col("_ct")) <= width).select("centre", "g")


def time_spans(centres: DataFrame, seconds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., start, end): the windows of ± seconds around the centres, those that overlap or touch made one.

    Centres within a bucket of that width overlap anyway, so each bucket is summed up as its first and last centre before
    anything is ordered: what is ordered is a row for each bucket with a centre, whatever the number of centres.
    """
    width = seconds * 1_000_000
    w = F.lit(width)
    t = F.unix_micros("ts")
    buckets = centres.where("ts is not null").groupBy(*by, F.floor(t / w).alias("_b")).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    order = Window.partitionBy(*by, F.floor(F.col("_b") / SPAN_BUCKETS)).orderBy("_b")
    # islands within stretches of SPAN_BUCKETS buckets first, then over the stretches' islands
    for last in (False, True):
        within = Window.partitionBy(*by).orderBy("_lo") if last else order
        new = F.coalesce(F.col("_lo") - F.lag("_hi").over(within) > 2 * width, F.lit(True))
        step = buckets.withColumn("_i", F.sum(new.cast("int")).over(within))
        keys = [*by, "_i"] if last else [*by, F.floor(F.col("_b") / SPAN_BUCKETS).alias("_stretch"), "_i"]
        buckets = step.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return buckets.select(*by, F.timestamp_micros(F.col("_lo") - w).alias("start"), F.timestamp_micros(F.col("_hi") + w).alias("end"))


def events_near(centres: DataFrame, events: DataFrame, seconds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """The events within ± seconds of any centre, each once, with their columns.

    A centre in an event's own bucket of that width is near; of the bucket before only the last centre counts, of the one
    after only the first. So events meet one row for each bucket, which holds those times: nothing multiplies. Rows of a
    bucket are copied for SALTS tasks, over which a burst of events is dealt.
    """
    width = F.lit(seconds * 1_000_000)
    t = F.unix_micros("ts")
    c = centres.where("ts is not null").groupBy(*by, F.floor(t / width).alias("_b")).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    around = c.select(*by, F.explode(F.array(*[F.struct((F.col("_b") + d).alias("_b"), F.lit(d == 0).alias("_own"), F.when(F.lit(d == 1), F.col("_hi")).alias("_before"), F.when(F.lit(d == -1), F.col("_lo")).alias("_after")) for d in (-1, 0, 1)])).alias("x"))
    around = around.groupBy(*by, F.col("x._b").alias("_b")).agg(F.max("x._own").alias("_own"), F.max("x._before").alias("_before"), F.min("x._after").alias("_after"))
    around = around.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BURST_SALTS - 1).cast("long"))))
    e = events.where("ts is not null").withColumns({"_t": t, "_b": F.floor(t / width), "_s": F.pmod(F.xxhash64("g"), F.lit(BURST_SALTS))})
    near = F.col("_own") | F.coalesce(F.col("_t") - F.col("_before") <= width, F.lit(False)) | F.coalesce(F.col("_after") - F.col("_t") <= width, F.lit(False))
    return e.join(around, [*by, "_b", "_s"]).where(near).select(*events.columns)


def counts_near(centres: DataFrame, events: DataFrame, seconds: int = 300, by: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """(centre, events): how many events are within ± seconds of each centre, from running sums, without pairs.

    Events are counted by time first. With these counts stand two marks for each centre, at the ends of its window; all
    are sorted in ranges, and the sum up to the second mark less that up to the first is the centre's number.
    """
    width = F.lit(seconds * 1_000_000)
    t = F.unix_micros("ts")
    known = [F.col(x).isNotNull() for x in by]
    keep = lambda df: df.where(reduce(Column.__and__, known, F.col("ts").isNotNull()))
    counted = keep(events).groupBy(*by, t.alias("_t")).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_sign": F.lit(0), "centre": F.lit(None).cast("long"), "_row": F.lit(None).cast("long")})
    c = keep(centres).select("*", t.alias("_ct"))
    ends = F.explode(F.array(F.struct((F.col("_ct") - width - 1).alias("_t"), F.lit(-1).alias("_sign")), F.struct((F.col("_ct") + width).alias("_t"), F.lit(1).alias("_sign"))))
    marks = c.select(*by, F.col("g").alias("centre"), ends.alias("x")).select(*by, "x._t", "x._sign", "centre").withColumns({"_n": F.lit(0).cast("long"), "_row": F.lit(None).cast("long")})
    rows = counted.unionByName(marks).drop("_row")
    # at one time events come before marks
    order = [*[F.col(x) for x in by], F.col("_t"), F.abs("_sign"), F.col("centre"), F.col("_sign")]
    summed = running(rows, order, "_n", "_sum", tasks)
    return summed.where("_sign <> 0").groupBy("centre").agg(F.sum(F.col("_sign") * F.col("_sum")).alias("events"))


SORT_KEYS = {"record": "record_id", "time": "ts", "eventId": "event_id", "provider": "provider", "channel": "channel", "computer": "computer", "file": "file"}


def sort_parts(by: str = "time", descending: bool = False) -> list[tuple[Column, str]]:
    """One of nine fields, then g, each with its direction. An event without a level sorts as 99, other missing values as the least; ties go by g, falling when the sort does."""
    key = {"level": F.coalesce(F.col("level").cast("int"), F.lit(99)), "name": F.coalesce(event_name(F.col("event_id"), F.col("provider")), F.lit(""))}.get(by)
    key = F.col(SORT_KEYS[by]) if key is None else key
    return [(key, "desc_nulls_last"), (F.col("g"), "desc")] if descending else [(key, "asc_nulls_first"), (F.col("g"), "asc")]


def sort_keys(by: str = "time", descending: bool = False) -> list[Column]:
    return [getattr(value, how)() for value, how in sort_parts(by, descending)]


def ordered(events: DataFrame, by: str = "time", descending: bool = False) -> DataFrame:
    return events.orderBy(*sort_keys(by, descending))


def _shared_folder(df: DataFrame) -> None:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")


def _ranges(rows: DataFrame, keys: list[Column], tasks: int | None) -> DataFrame:
    """rows sorted in ranges of about equal counts, with their range _p and place within it _i; checkpointed, since these depend on the partitions."""
    _shared_folder(rows)
    done = rows.repartitionByRange(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys).checkpoint()
    return done.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))


def _before(placed: DataFrame, total: Column) -> DataFrame:
    """(_p, _before): the totals of all ranges before each; a row for each range."""
    size = placed.groupBy("_p").agg(total.alias("_n"))
    return size.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def running(rows: DataFrame, keys: list[Column], value: str, name: str, tasks: int | None = None) -> DataFrame:
    """rows with the sum of a column up to and with each row in an order; no task sees more than a range of it."""
    placed = _ranges(rows, keys, tasks)
    own = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    before = _before(placed, F.sum(value))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_p", "_i", "_own", "_before")


def places(rows: DataFrame, keys: list[tuple[Column, str]], id: str = "g", name: str = "place", tasks: int | None = None) -> DataFrame:
    """(id, place): the place of each row in an order, from 0; keys as sort_parts gives them.

    Only the id and what the order looks at are sorted and written, however wide the rows are. Ranges of about equal counts
    are numbered each for itself, so no task sees more than a range.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = rows.select(F.col(id), *[value.alias(n) for n, (value, _) in zip(names, keys, strict=True)])
    placed = _ranges(narrow, [getattr(F.col(n), how)() for n, (_, how) in zip(names, keys, strict=True)], tasks)
    return placed.join(F.broadcast(_before(placed, F.count(F.lit(1)))), "_p").select(id, (F.col("_before") + F.col("_i")).alias(name))


def in_order(rows: DataFrame, keys: list[Column], name: str = "place", tasks: int | None = None) -> DataFrame:
    """rows with their place in an order, from 0, for rows that have no id to join places by: whole rows are sorted and written."""
    placed = _ranges(rows, keys, tasks)
    return placed.join(F.broadcast(_before(placed, F.count(F.lit(1)))), "_p").select((F.col("_before") + F.col("_i")).alias(name), *[c for c in rows.columns if c != name])


def promoted(events: DataFrame, names: list[str]) -> DataFrame:
    """events with a column for the first value of each name."""
    return events.withColumns({n: field(n) for n in names})


def promoted_names(events: DataFrame, most: int = 12) -> DataFrame:
    """(name, pos): EventData names in the order they are first seen, if all events have one id; else none."""
    first = events.select("g", "event_id", F.posexplode("ed").alias("p", "pair")).groupBy(F.col("pair.name").alias("name")).agg(F.min(F.struct("g", "p")).alias("at"))
    one = events.agg(F.countDistinct("event_id").alias("_n")).where("_n = 1").select(F.lit(1).alias("_one"))
    return first.join(F.broadcast(one)).orderBy("at").limit(most).select("name", F.col("at.p").alias("pos"))


def unknown_types(events: DataFrame, reference: DataFrame) -> DataFrame:
    """(channel, event_id, n): kinds of event that a reference table (channel, event_id) has no entry for."""
    seen = events.groupBy(F.lower("channel").alias("channel"), "event_id").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(reference.select(F.lower("channel").alias("channel"), "event_id"), ["channel", "event_id"], "left_anti")


def merged(logs: list[DataFrame]) -> DataFrame:
    """Logs one after the other, in order; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
