"""Time the headline queries: ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from screenwright.operators import analytics
from screenwright.operators.detectors import add_text_columns
from screenwright.operators.org_policy import detect_org_keywords
from screenwright.operators.prepare import prepare_requests, with_org_key
from screenwright.plans.screening import Options, audit, screen
from verification import bindings
from verification.queries import QUERIES, audit_table

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPORTS = ("a3_by_tool", "a5_top_users", "a6_summary", "a8_user_stats", "a9_recent_logs", "a11_used_logs_by_user",
           "r3_running_counters", "r5_windowed_actions")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    requests, dims = bindings.requests(spark, SF), bindings.dims(spark, SF)

    def policies():
        keyed = with_org_key(prepare_requests(requests), dims.users, salt_by="request_id")
        return detect_org_keywords(add_text_columns(keyed), dims.policies).select("request_id", "_found_org")

    runs = {
        "screen_core": lambda: drain(screen(requests, dims)),
        "screen_core_reuse": lambda: drain(screen(requests, dims, reuse=True)),
        "screen_extended": lambda: drain(screen(requests, dims, Options(profile="extended"))),
        "audit_core": lambda: drain(audit(requests, dims)),
        "org_policies": lambda: drain(policies()),
        "audit_table_write": lambda: audit_table(spark, SF),
    }
    runs |= {name: (lambda name=name: drain(QUERIES[name](spark, SF))) for name in REPORTS}
    # One small run first, so that the first timing is not mostly class loading.
    drain(audit(requests.filter("request_id LIKE 'g%'"), dims))
    timings = {}
    rows = requests.count()
    characters = requests.agg(F.sum(F.length("prompt"))).first()[0]
    for name, run in runs.items():
        start = time.time()
        run()
        timings[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", SF)
    print(json.dumps({
        "metric": "screening_and_reports_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale.group(1)) if scale else SF,
        "rows": rows, "characters": characters,
        "rows_per_sec": {n: round(rows / timings[n]) for n in ("screen_core", "screen_extended", "audit_core")},
    }))


if __name__ == "__main__":
    main()
