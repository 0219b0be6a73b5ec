"""Wall time of headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from concourse.plans import load_all
from concourse.session import local_session

HEADLINES = [
    "src_text_spans",
    "src_manifest_sha256",
    "prj_fill_class",
    "join_availability_overlay",
    "join_translation",
    "join_point_in_polygon",
    "join_segment_intersect",
    "join_cover_union",
    "agg_polyline_length",
    "agg_duplicate_keys",
    "win_turn_angle",
    "win_instructions",
    "lrs_point_at",
    "txt_normalize",
    "search_directory",
    "top_search_rank",
    "gr_shortest_costs",
    "gr_all_pairs",
    "gr_route_status",
    "gr_contract_chains",
    "gr_grid_links",
    "set_union_used_edges",
    "dq_contract",
    "rep_source_truth",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"), app="concourse-bench")
    registry = load_all()
    spark.range(1).count()
    times = {}
    for key in wanted:
        start = time.perf_counter()
        registry[key].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr)
    extra = {}
    if "gr_all_pairs" in times:
        pairs = registry["gr_all_pairs"].build(spark, folder).count()
        extra["all_pairs_per_sec"] = round(pairs / times["gr_all_pairs"], 1)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cores),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
