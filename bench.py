"""Wall time of the headline queries; prints one JSON line.

Every query runs twice in one session (BENCH_RUNS) and the last run counts. The result is consumed in
full by a sink that discards it, so nothing is pulled to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from annolink.catalog import QUERIES  # noqa: E402
from annolink.session import local_session  # noqa: E402

HEADLINE = [
    "prj_01_final_projection", "prj_04_classify_events", "prj_20_note_match", "jn_02_zip_join", "jn_03_consume_join", "jn_05_interval_join",
    "jn_08_nearest_join", "jn_10_asof_backward", "jn_11_asof_forward", "jn_12_prefer_join", "jn_13_lookup_one", "jn_15_dim_join",
    "mt_06_segment_score", "mt_07_rank_candidates", "mt_12_overlay", "mt_13_candidate_lists", "pr_01_pair_lifo", "pr_05_match_blocks", "pr_07_fill_gaps",
    "pr_08_repeat_rows", "ag_01_count_by", "ag_05_coverage", "ag_06_accuracy", "ag_09_manual_groups", "ag_12_collect_members", "win_01_onset_cursor",
    "win_03_layout_counters", "win_04_assign_ids", "win_10_islands", "srt_02_priority_sort", "srt_04_top_k", "set_03_combine_lossless", "set_05_set_checks",
    "rev_03_auto_accept", "rev_07_apply_decisions", "inc_02_pending", "src_06_shred_pages",
]


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=8, memory="16g")
    times = {}
    for name in HEADLINE:
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(data.rstrip("/"))}))


if __name__ == "__main__":
    main()
