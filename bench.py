"""Benchmark the headline queries.

Runs each registered query of ``HEADLINE`` (without the oracle-compare output
snapping) on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``: one warm-up run, then ``$BENCH_REPEAT`` timed runs
(median).  Every run is a full execution through the ``noop`` sink (all rows
produced, nothing collected).  Rows read, shuffle and spill bytes come from
Spark's event log of the timed runs.  Prints ONE JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "basic_ts", "basic_ts_passband", "fluxfactor", "maxpoint_gap", "maxpoint_window", "fluxdiff_passband",
    "timegrouper", "time_from_peak", "lightcurve_summary", "series_general", "series_cadence",
    "folds", "weighted_logloss", "sequences", "periodogram",
]
#: timed as well, but not part of the headline sum
MORE = [
    "assemble_features", "template_fit", "cross_correlation", "discrete_correlation", "lagged_product", "stream_rates",
]


def task_totals(folder: str, windows: dict[str, tuple[float, float]]) -> dict[str, dict[str, int]]:
    """Per query, the sums over the tasks that started within its window (milliseconds)."""
    out = {n: {"rows_in": 0, "shuffle_bytes": 0, "spill_bytes": 0} for n in windows}
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        for part in ([os.path.join(path, p) for p in os.listdir(path)] if os.path.isdir(path) else [path]):
            with open(part, errors="replace") as f:
                for line in f:
                    if '"SparkListenerTaskEnd"' not in line:
                        continue
                    e = json.loads(line)
                    at, m = e["Task Info"]["Launch Time"], e.get("Task Metrics") or {}
                    n = next((n for n, (a, b) in windows.items() if a <= at <= b), None)
                    if n:
                        out[n]["rows_in"] += m.get("Input Metrics", {}).get("Records Read", 0)
                        out[n]["shuffle_bytes"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                        out[n]["spill_bytes"] += m.get("Disk Bytes Spilled", 0)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [a for a in sys.argv[1:]]
    log_dir = tempfile.mkdtemp(prefix="kilonova-bench-")   # one machine: bench.py runs in local mode
    os.environ["PYSPARK_SUBMIT_ARGS"] = ("--conf spark.eventLog.enabled=true --conf spark.eventLog.compress=false "
                                         f"--conf spark.eventLog.dir=file://{log_dir} pyspark-shell")
    from kilonova.plans import catalog
    from kilonova.session import get_session

    spark = get_session()
    # the feature queries as a pipeline runs them (no output snapping for the oracle compare)
    qs = catalog.raw_queries()
    names = [n for n in (only or HEADLINE + MORE) if n in qs]
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    windows: dict[str, tuple[float, float]] = {}
    for n in names:
        df = qs[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # warm-up (codegen, file listing)
        runs = []
        for _ in range(repeat):
            t0, began = time.perf_counter(), time.time() * 1000
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            windows[n] = (began, time.time() * 1000)   # the last run's
        times[n] = round(statistics.median(runs), 3)
        rows[n] = qs[n](spark, sf_dir).count()
    spark.stop()
    io = task_totals(log_dir, windows)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(t for n, t in times.items() if only or n in HEADLINE), 3),
        "unit": "sec",
        "queries": times,
        "rows_out": rows,
        "rows_in": {n: io[n]["rows_in"] for n in names},
        "shuffle_bytes": {n: io[n]["shuffle_bytes"] for n in names},
        "spill_bytes": {n: io[n]["spill_bytes"] for n in names},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "repeat": repeat,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
