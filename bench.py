"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each query to completion with the ``noop`` sink (every row is computed,
nothing is collected to the driver) on ``local[$BENCH_CPUS]`` and prints ONE
JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # monitoring
    "mon_degradation", "mon_metrics", "st_windowed_metrics", "mon_cooldown", "mon_report",
    # dashboards
    "agg_grouping_sets", "agg_crosstab", "agg_daily_volume", "agg_metrics_cards", "agg_conf_box",
    # audit / GDPR
    "aud_rule_eval", "aud_report", "join_gdpr_or", "join_gdpr_erase",
    # ensemble / learning
    "ens_weighted_vote", "al_uncertainty", "al_error_patterns", "win_learning_trend",
    # text
    "txt_clean", "txt_tfidf", "txt_token_sequence", "ft_statistical", "ft_domain",
    # drift
    "drift_ks", "drift_psi", "drift_js", "drift_wasserstein", "drift_report",
    # versions / responses / explain / eval
    "ab_route", "ab_results", "ver_compare", "rsp_generate", "mm_classify", "ex_bias_parity",
    "ev_class_report", "join_pareto_dominance", "win_ema",
    # streaming
    "st_classify", "st_alert_cooldown",
    # splits, bias, online learning
    "txt_stratified_split", "ex_bias_pivot", "ol_incremental_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    os.environ["BENCH_CPUS"] = str(cpus)
    from ticketscope.plans.registry import all_queries
    from ticketscope.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    qs = all_queries()
    # warm-up: JVM, Python workers and file listing, excluded from timings
    qs["agg_class_distribution"].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
