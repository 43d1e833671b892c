"""Logon sessions rebuilt from the logon ids in events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import LOGON_TYPES
from ..functions.fields import account, blank, field, literal_map
from ..functions.times import millis_between

# The EventData names of logon ids, well-known sessions and accounts of the system.
LOGON_KEYS = ("targetlogonid", "subjectlogonid", "logonid")
SYSTEM_IDS = ("0x3e7", "0x3e5", "0x3e4")
SYSTEM_USERS = ("system", "local service", "network service", "anonymous logon")
HIDDEN_ACTIVITY = (4624, 4634, 4647, 4672)


def _id(v: Column) -> Column:
    return F.lower(F.trim(v))


def _last_id(name: str) -> Column:
    v = field(name, "last")
    return F.when(~blank(v), _id(v))


def logon_ids(events: DataFrame) -> DataFrame:
    """events with logon_id, a row for each different logon id of an event; of a repeated name the last value counts."""
    ids = F.array_distinct(F.filter(F.array(*[_last_id(k) for k in LOGON_KEYS]), lambda v: v.isNotNull() & (v != "0x0")))
    return events.withColumn("logon_id", F.explode(ids))


def _opt(name: str) -> Column:
    v = field(name, "last")
    return F.when(~blank(v), v)


def halves(events: DataFrame) -> DataFrame:
    """One row per (computer, logon id), before linked ones are merged.

    All facts are partial aggregates, so the session of the system, which most events belong to, is summed up before it
    is shuffled. Which of several rows counts is decided by g.
    """
    e = logon_ids(events.withColumn("computer", F.coalesce("computer", F.lit(""))))
    target, subject = _last_id("TargetLogonId"), _last_id("SubjectLogonId")
    linked = _last_id("TargetLinkedLogonId")
    elevated = F.when(field("ElevatedToken", "last") == "%%1842", True).when(field("ElevatedToken", "last") == "%%1843", False)
    e = e.select(
        "computer", "logon_id", "g", "ts", "event_id",
        F.when((F.col("event_id") == 4624) & (target == F.col("logon_id")), F.struct(F.col("ts").alias("start"), account("Target").alias("user"), field("LogonType", "last").alias("logon_type"), _opt("IpAddress").alias("source_ip"), _opt("WorkstationName").alias("workstation"), _opt("AuthenticationPackageName").alias("auth_package"), F.when(linked != "0x0", linked).alias("linked_logon_id"), elevated.alias("elevated"))).alias("logon"),
        ((F.col("event_id") == 4672) & F.coalesce(subject == F.col("logon_id"), F.lit(False))).alias("admin"),
        F.when(F.col("event_id").isin(4634, 4647) & (target == F.col("logon_id")), F.struct("ts", (-F.col("g")).alias("o"), F.col("event_id").alias("id"))).alias("logoff"),
        F.when((subject == F.col("logon_id")) & (account("Subject") != ""), F.struct("g", account("Subject").alias("user"))).alias("subject"),
    )
    by_id = e.groupBy("computer", "logon_id", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("g").alias("first_g"),
        F.min(F.when(F.col("logon").isNotNull(), F.struct("g", "logon"))).alias("logon"), F.bool_or("admin").alias("admin"), F.max("logoff").alias("logoff"), F.min("subject").alias("subject"),
    )
    s = by_id.groupBy("computer", "logon_id").agg(
        F.sum("n").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_g").alias("first_g"),
        F.min("logon").alias("logon"), F.bool_or("admin").alias("admin"), F.max("logoff").alias("logoff"), F.min("subject").alias("subject"),
        F.collect_list(F.when(F.col("event_id").isNotNull(), F.struct(F.col("event_id").alias("id"), "n"))).alias("ids"),
    )
    facts = "logon.logon."
    return s.select(
        "computer", "logon_id", *[F.col(facts + c).alias(c) for c in ("start", "user", "logon_type", "source_ip", "workstation", "auth_package", "linked_logon_id", "elevated")],
        "admin", F.col("logoff.ts").alias("end"), F.col("logoff.id").alias("end_event_id"), F.col("subject.user").alias("subject_user"), "first_seen", "last_seen", "events", "ids", "first_g",
    )


def sessions(events: DataFrame) -> DataFrame:
    """Logon sessions, the two linked halves of an elevated logon made one.

    Halves that name each other are a pair; the one kept is not the limited one, else the one seen first. Counts and
    spans are merged. background marks sessions of the system, of services and of machine accounts.
    """
    h = halves(events)
    mine = h.where("linked_logon_id is not null").select("computer", F.col("logon_id").alias("_a"), F.col("linked_logon_id").alias("_b"))
    other = mine.select(F.col("computer").alias("_c"), F.col("_a").alias("_x"), F.col("_b").alias("_y"))
    pairs = mine.join(other, (F.col("computer") == F.col("_c")) & (F.col("_a") == F.col("_y")) & (F.col("_b") == F.col("_x")) & (F.col("_a") != F.col("_b")))
    pairs = pairs.select("computer", F.col("_a").alias("logon_id"), F.least("_a", "_b").alias("_pair"))
    h = h.join(pairs, ["computer", "logon_id"], "left").withColumn("_pair", F.coalesce("_pair", "logon_id"))
    limited = F.coalesce(~F.col("elevated"), F.lit(False))
    order = F.struct(limited, F.col("first_g"))
    pick = lambda c: F.min_by(c, order).alias(c)
    m = h.groupBy("computer", "_pair").agg(
        *[pick(c) for c in ("logon_id", "user", "subject_user", "logon_type", "source_ip", "workstation", "auth_package", "linked_logon_id", "elevated", "first_g")],
        F.bool_or("admin").alias("admin"), F.min("start").alias("start"), F.max_by("end_event_id", F.when(F.col("end").isNotNull(), F.struct("end", ~limited))).alias("end_event_id"), F.max("end").alias("end"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"), F.flatten(F.collect_list("ids")).alias("_ids"), F.transform(F.array_sort(F.collect_list(F.struct(limited.alias("l"), "first_g", "logon_id"))), lambda x: x["logon_id"]).alias("logon_ids"),
    )
    ids = F.array_distinct(F.transform("_ids", lambda x: x["id"]))
    summed = F.transform(ids, lambda i: F.struct(i.alias("id"), F.aggregate(F.filter("_ids", lambda x: x["id"] == i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))
    ranked = F.transform(F.array_sort(F.transform(summed, lambda x: F.struct((-x["n"]).alias("o"), x["id"].alias("id")))), lambda x: F.struct(x["id"].alias("id"), (-x["o"]).alias("n")))
    user = F.when(F.coalesce(F.col("user"), F.lit("")) != "", F.col("user")).otherwise(F.coalesce("subject_user", F.lit("")))
    m = m.withColumn("user", user).withColumn("event_ids", ranked).withColumn("logon_type_label", F.try_element_at(literal_map(LOGON_TYPES), F.col("logon_type")))
    m = m.withColumn("background", background()).withColumn("duration_ms", millis_between(F.coalesce("start", "first_seen"), F.coalesce("end", "last_seen")))
    return m.drop("_pair", "_ids", "subject_user")


def background() -> Column:
    name = F.lower(F.element_at(F.split("user", r"\\"), -1))
    return F.col("logon_id").isin(*SYSTEM_IDS) | F.coalesce(F.col("logon_type").isin("0", "5"), F.lit(False)) | (name == "") | name.isin(*SYSTEM_USERS) | name.endswith("$") | name.rlike(r"^(dwm|umfd)-\d+$")


def ordered(found: DataFrame, by: str = "start", background: bool = True) -> DataFrame:
    """by start, duration or events; background sessions may be left out."""
    out = found if background else found.where("not background")
    key = {"start": F.coalesce("start", "first_seen").asc(), "duration": F.desc("duration_ms"), "events": F.desc("events")}[by]
    return out.orderBy(key, "first_g")


def activity() -> Column:
    """A session's event ids without those of logon and logoff."""
    return F.filter("event_ids", lambda x: ~x["id"].isin(*HIDDEN_ACTIVITY))


def session_events(found: DataFrame, events: DataFrame, same_computer: bool = True) -> DataFrame:
    """(session, g): the events of each session by its logon ids; on its own computer, unless the loose form is asked for."""
    keys = found.select(F.concat_ws("|", "computer", "logon_id").alias("session"), F.col("computer").alias("_c"), F.explode("logon_ids").alias("logon_id"))
    e = logon_ids(events.select("g", F.coalesce("computer", F.lit("")).alias("computer"), "ed")).select("g", "computer", "logon_id")
    out = keys.join(e, "logon_id")
    return (out.where("_c = computer") if same_computer else out).select("session", "g").distinct()
