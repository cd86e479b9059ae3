"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is written to a sink that keeps nothing, so a query is timed whole.
"""

from __future__ import annotations

import json
import os
import sys
import time

from reefline.plans import catalog
from reefline.plans.fixtures import Fixtures
from reefline.session import local_session

HEADLINE = [
    "A02_news_feed_items", "A03_page_harvest", "A04_register_import", "A07_evidence_shape",
    "A08_relevance_gate", "A09_idempotent_capture", "A10_news_upsert", "B01_incident_filter_set",
    "B05_text_search", "B07_public_view", "C01_attach_sources", "C02_match_by_url",
    "C03_match_by_headline", "C04_match_by_place", "C05_match_cascade", "D01_overview",
    "D02_by_year", "D03_by_country", "D04_by_species", "E01_feed_collapse",
    "E02_near_duplicate_blocks", "E03_latest_observation", "E06_case_numbers", "F02_offset_page",
    "F06_feed_page", "G02_map_features", "G03_grid_clusters", "G06_on_land", "G07_nearest_coast",
    "G08_coast_snap", "G10_gazetteer_ranking", "H01_answer_parse", "H05_claim_rows", "H06_constraint_check",
    "H07_correction_overlay", "H08_routing", "H11_candidate_grouping", "I01_exact_clusters",
    "I05_enrichment", "I06_merged_sources", "I06_merged_incidents", "I08_attached_sources",
    "I09_submission_outcome", "I14_news_from_incidents", "J01_job_state", "J02_retry_schedule",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, shuffle_partitions=cores)
    # one untimed query so that no query pays for starting the engine
    catalog.run("D02_by_year", Fixtures(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.run(name, Fixtures(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
