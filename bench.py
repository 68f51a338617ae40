"""Benchmark: build the curated tables once, then time every registered query.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (timed runs per query after one warm-up, default 3), BENCH_ONLY
(comma-separated name prefixes). Prints ONE JSON line:
{"metric": "sum_query_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed completely with the ``noop`` sink (no rows collected to
the driver). ``pipeline_materialize`` is the time to run the sensor pipeline and
the order-line build once and write the eleven tables as parquet.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    scratch = tempfile.mkdtemp(prefix="coldlake-bench-", dir="/tmp")
    os.environ.setdefault("COLDLAKE_SCRATCH", scratch)

    from coldlake.session import local_session
    from coldlake.plans import registry
    from coldlake.plans.catalog import DIM_TABLES, SALES_TABLES, SENSOR_TABLES

    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENTLOG"):
        # stage and task times for inspection, written to the scratch folder
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch})
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), extra=extra)

    # warm-up outside the timed stages: JIT and codegen of the same plans on the smallest data
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and warm_dir != sf_dir:
        registry.catalog_for(spark, warm_dir).materialize()
    for t in ("events", "lineitem", "orders", "customer", "part", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    cat = registry.catalog_for(spark, sf_dir)
    if os.environ.get("BENCH_PIPELINE_WARMUP", "1") == "1":
        # one untimed run at this size (HotSpot compiles the hot loops on the larger data)
        registry.Catalog(spark, sf_dir).materialize()
    t0 = time.perf_counter()
    cat.materialize(SENSOR_TABLES + DIM_TABLES)
    timings["pipeline_sensor"] = round(time.perf_counter() - t0, 3)
    t1 = time.perf_counter()
    cat.materialize(SALES_TABLES)
    timings["pipeline_sales"] = round(time.perf_counter() - t1, 3)
    timings["pipeline_materialize"] = round(time.perf_counter() - t0, 3)
    stages = ("pipeline_sensor", "pipeline_sales", "pipeline_materialize")

    qs = registry.queries()
    for name, fn in qs.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        runs = []
        for i in range(repeat + 1):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t)
        timings[name] = round(statistics.median(runs), 3)

    total = round(sum(v for k, v in timings.items() if k not in stages), 3)
    c_total = round(sum(v for k, v in timings.items() if k.startswith("C")), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_query_median_sec", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir, "n_queries": len(timings) - len(stages),
                      "pipeline_sec": timings["pipeline_materialize"],
                      "sensor_pipeline_plus_C_sec": round(timings["pipeline_sensor"] + c_total, 3),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
