"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tripmill.plans import queries as q
from tripmill.session import local_session

# Whole jobs from the raw table: clean, sample, fit, score.
HEADLINE = (
    "trip_features",
    "reject_reasons",
    "feature_statistics",
    "scaled_features",
    "assign_clusters",
    "cluster_profiles",
    "anomaly_summary",
    "score_rows",
    "lloyd_steps",
    "silhouette_trips",
    "adjusted_rand_trips",
    "kmeans_fit",
    "minibatch_fit",
    "minibatch_one_pass",
    "line_reasons",
    "line_statistics",
)
# Tables with one timed fit per row.  worker_seconds includes fit and metrics.
STUDIES = ("line_sweep", "batch_study", "k_study")


def scale(folder: str) -> float | str:
    name = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the workers and compile the common code once, as a long-lived session would have.
    q.QUERIES["cluster_profiles"](spark, sf).collect()
    q.QUERIES["minibatch_one_pass"](spark, sf).collect()
    spark.catalog.clearCache()
    seconds: dict[str, float] = {}
    fits: dict[str, dict] = {}
    for name in (*HEADLINE, *STUDIES):
        begin = time.perf_counter()
        rows = q.QUERIES[name](spark, sf).collect()
        seconds[name] = round(time.perf_counter() - begin, 3)
        spark.catalog.clearCache()
        if name in ("line_sweep", "batch_study"):
            for row in rows:
                label = f"{row['algorithm']}_{row['rows']}_{row['batch_size']}"
                label += "_one_pass" if row["streaming"] else ""
                fits[label] = {
                    key: row[key]
                    for key in (
                        "status",
                        "fit_seconds",
                        "worker_seconds",
                        "normalized_inertia",
                        "silhouette",
                        "ari_vs_kmeans",
                        "iterations",
                    )
                }
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale(sf),
                "fits": fits,
            }
        )
    )


if __name__ == "__main__":
    main()
