"""Time the headline queries and print one JSON line.

One untimed pass of the flagship query over the smallest tables starts the JVM and its compiler;
what follows is timed on the bench tables only.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressgauge.session import local_session  # noqa: E402
from pressgauge.workload import registry, screen_queries  # noqa: E402

HEADLINE = (
    "a2_a3_w5_w6_subject_trend",
    "a7_w7_source_contribution",
    "a4_axis_sentiment",
    "a5_axis_window",
    "a6_subject_window",
    "w1_p7_article_pick",
    "j3_w4_record_latest",
    "a8_body_share",
    "w13_j8_x20_record_versions",
    "q12_l6_record_list",
    "q10_j10_u3_l8_compare_versions",
    "q10_a12_j6_cycle_progress",
    "b1_bronze_items",
    "s11_s12_x24_article_text",
    "x18_keyword_labels",
    "x12_x15_reply_judgement",
    "k2_t1_replaced_cycles",
    "q1_l2_w9_j15_dashboard_top",
    "q2_l5_trend",
    "q5_a22_l3_fairness",
    "q6_a21_spikes",
    "q7_j4_j7_l7_contributing_articles",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"))
    known = registry.queries()
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        run(known[registry.FLAGSHIP](spark, smallest))
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name.startswith("q1_"):
            started = time.perf_counter()
            screen_queries.published(spark, sf_dir)
            times["b3_gold_build"] = round(time.perf_counter() - started, 3)
        started = time.perf_counter()
        run(known[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
