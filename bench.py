"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from litevidence.plans.catalog import QUERIES
from litevidence.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "article_mentions", "improve_ids", "triplet_extract", "triplet_extract_outer", "triplet_prevalence",
    "accepted_pairs", "attach_evidence", "dated_evidence_lists", "attach_dated", "temporal_precedence",
    "therapeutic_areas", "max_phase_drug", "attach_max_phase", "article_type", "annotated_triplets",
    "probe_dictionary", "unique_triples", "disease_histogram", "corpus_profile", "compare_triplets",
    "sentence_overlap",
)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    # Starts the session's code paths; not counted.
    QUERIES["corpus_article_count"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
