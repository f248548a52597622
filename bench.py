"""Headline queries at one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pathloom.plans import registry
from pathloom.session import local_session

HEADLINE = [
    "path_stats", "rms_delay_spread", "angular_spread", "big_link_features", "path_percentiles", "imputed_links",
    "tdoa_imputed", "fingerprint_scalars", "ofdm_mag_db", "cov_eig", "path_match", "knn_topk", "wknn_cv_grid",
    "wknn_metrics", "c2f_cv_grid", "error_cdf", "ablation_table", "trustworthiness", "kruskal_stress",
    "paths_to_position", "fingerprints", "nn_regression_plain", "autoencoder_chart",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "pathloom-bench", "8g")

    def run(name: str) -> float:
        t = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run(HEADLINE[0])  # start the workers and compile the common code once
    times = {name: round(statistics.median([run(name) for _ in range(3)]), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
