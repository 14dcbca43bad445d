"""Headline queries, timed; prints one JSON line.

Each query is planned and run to its last row without collecting anything on the
driver.  ``throughput`` relates line and archive jobs to the bytes they read.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logquarry.queries import QUERIES  # noqa: E402
from logquarry.session import local_session  # noqa: E402

HEADLINE = [
    "prj_14_log_level",
    "fn_06_name_tokens",
    "flt_03_magic_format",
    "flt_14_substring_match",
    "flt_15_token_match",
    "ag_01_total_matches",
    "ag_03_lines_per_file",
    "ag_13_distinct_path_keys",
    "jn_01_most_specific_root",
    "jn_03_resolve_files",
    "jn_05_affected_files",
    "jn_09_revision_check",
    "wn_01_line_numbers",
    "wn_02_line_offsets",
    "wn_04_last_change_wins",
    "wn_05_stable_size",
    "sr_01_token_rank",
    "sr_02_path_order",
    "sr_04_deep_page",
    "st_02_minimal_roots",
    "src_04_text_lines",
    "src_05_zip_entries",
    "src_09_entry_lines",
    "src_10_nested_entries",
    "snk_01_upsert",
    "sm_02_directory_changes",
    "sm_05_stable_arrivals",
    "sm_08_apply_journal_batch",
    "sm_12_unread",
    "fn_02_decode",
]
# Queries reading every byte of the documents.
READS_TEXT = ["src_04_text_lines", "src_09_entry_lines", "ag_03_lines_per_file", "fn_02_decode"]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds from building the query to its last row."""
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first().n
    run(spark, "ag_02_catalog_count", sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in wanted}
    mib = docs / 1024**2
    out = {
        "metric": "total wall-clock of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "throughput_mib_per_sec": {name: round(mib / times[name], 1) for name in READS_TEXT if name in times},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
