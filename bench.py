"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up, then up to twice; the median is reported.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagegrid.plans import registry  # noqa: E402
from pagegrid.plans.lineage import release  # noqa: E402
from pagegrid.session import build_session  # noqa: E402

HEADLINE = [
    "a04_column_profile", "a06_row_dedupe", "a07_window_summary", "a08_family_summary", "a16_event_summary", "a17_duplicate_groups", "a19_run_artifacts",
    "a30_tag_counts", "f04_strip_html", "f09_page_summary", "f10_text_rows", "f11_emails", "f12_phones", "f14_metadata_rows", "f21_row_urls", "f37_request_class",
    "j03_license_status", "j08_snapshot_join", "j09_next_cron", "j10_crawl", "p01_any_column_search", "p18_policy_audit", "q03_expired_locks", "s08_insert_if_absent",
    "s10_csv_lines", "st1_sliding_requests", "st3_monitor_runs", "t07_link_cap", "w04_device_admission", "w07_rate_limit", "w08_monitor_history", "w12_lifecycle_check",
    "x01_node_table", "x02_list_rows",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", cpus, os.environ.get("BENCH_SHARED_DIR"))
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        runs: list[float] = []
        for attempt in range(3):
            start = time.perf_counter()
            run(queries[name](spark, sf_dir))
            took = time.perf_counter() - start
            release()
            if attempt or took > 20:
                runs.append(took)
            if sum(runs) > 6:
                break
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
