"""Wall time of the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default the headline list). The stage tables (facts, corpus, resolved keys,
pools, ...) are written first and timed apart, under "staging".
"""

from __future__ import annotations

import json
import os
import time

from factsieve.plans import fixtures, registry
from factsieve.session import local_session

HEADLINE = (
    "facts value_uniqueness value_clusters reverse_skips split_groups paraphrases bios relational_examples build_report "
    "split_examples retain_only_many neighbor_counts retain_neighbor_counts distinct_neighbor_counts value_neighbors "
    "retain_neighbors resolved_keys classify_records validate_requests split_forget_probe request_summary redact_relational "
    "redact_bio batch_plan score_answers accuracy pool_accuracy impact_assessment relational_summary decoy_checks "
    "percentile_rank membership_inference reference_accuracy key_takeaways tokenize_records tokenize_and_mask length_stats "
    "sequence_logprob npo_loss early_stop_step check_fact_coverage check_reverse_unique validate_build upsert_rows "
    "sibling_revisions latest_jobs stream_job_status"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    runs, times = registry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query
    staging = {}
    for build in (fixtures.requests, fixtures.facts, fixtures.corpus, fixtures.keys, fixtures.classified, fixtures.probes):
        start = time.time()
        build(spark, folder)
        staging[build.__name__] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "staging": staging, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
