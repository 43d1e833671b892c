"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import sys
import time
from datetime import datetime
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from winlog_spark.operators import detect, facets, findings, hunts, packed, pivots, sessions, timeline  # noqa: E402
from winlog_spark.plans import search, timewin  # noqa: E402
from winlog_spark.queries import SPECS, ev  # noqa: E402


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    one = ev(spark, sf)
    # the published load has 200,000 events: the table twice
    load = one.unionByName(one.withColumn("g", F.col("g") + 1_000_000_000)).repartition(cpus).persist()
    n_events = load.count()
    pack = detect.compile_rules(packed.synthetic_pack(2395))[0]
    ours = detect.compile_rules(SPECS)[0]
    start, end = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
    queries = {
        "rules_2395": lambda: packed.detect_packed(load, pack).groupBy("rule_id").count(),
        "rules_24": lambda: detect.detect(load, ours).groupBy("rule_id").count(),
        "failed_logons_by_source": lambda: facets.top_values(timewin.between(search.search(one, "EventID:4625"), start, end), "IpAddress", n=20),
        "search": lambda: search.search(one, "whoami OR IpAddress:10.0.1.*").agg(F.count("*")),
        "facets": lambda: facets.facets(one),
        "timeline": lambda: timeline.timeline(one),
        "findings": lambda: findings.finding_counts(one),
        "hunts": lambda: hunts.hunt_counts(one),
        "sessions": lambda: sessions.sessions(one),
        "near_in_time": lambda: pivots.near_in_time(one.where("event_id = 1102"), one, 300, ("computer",)).agg(F.count("*")),
    }
    took = {}
    for name, make in queries.items():
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    # once more, and with the pack's tables and the counts of keys that are kept with the data
    counts = packed.key_counts(one.where("pmod(xxhash64(g), 10) = 0"), pack)
    kept = packed.compile_pack(pack, counts)
    for name, run in (("rules_2395_warm", queries["rules_2395"]), ("rules_2395_kept_pack_warm", lambda: packed.detect_packed(load, kept).groupBy("rule_id").count())):
        again = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - again, 3)
    total = sum(v for k, v in took.items() if not k.endswith("_warm"))
    rate = {k: round(n_events / took[q]) for k, q in (("events_per_sec_cold", "rules_2395"), ("events_per_sec_warm", "rules_2395_warm"))}
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": took, "sf": sf, "cpus": cpus, "rule_load": {"events": n_events, "rules": len(pack)} | rate}))


if __name__ == "__main__":
    main()
