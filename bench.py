"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

# One or two of each kind: scans, version comparison, rollups, ranks, graph
# search, geometry, reconciliation, reviews, text and streams.
HEADLINE = (
    "scan_feather", "scan_csv_typed", "pair_region_agg", "edge_delta_region", "edge_delta_pair", "version_comparison",
    "reconcile_edges", "explain_residual", "filter_rule_search", "class_crosswalk", "enrich_endpoints", "flow_matrix",
    "membership_confusion", "weighted_channels", "evidence_rollup", "percentile_summary", "rank_in_group", "review_rank",
    "trailing_rate", "inter_event_interval", "ewma", "degrees", "hop_distance", "paths_2hop", "reach_summary", "adjacency",
    "skeleton_topology", "point_to_node", "point_to_segment", "nearest_in_key", "exact_site_matches", "resolve_ids",
    "claims_rollup", "node_catalog", "dual_detector_review", "table_audit", "text_scrub", "link_check", "stable_hash",
    "stream_edge_counts", "stream_tumbling", "stream_ewma", "version_audit", "matched_control", "shortest_paths", "paths_3hop", "ablation",
    "partner_patterns", "node_coverage", "udtf_path_edges",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tractum.catalog import load
    from tractum.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    for key in ("pair_region_agg", "udf_scalar"):  # warm the JVM and the Python workers
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
