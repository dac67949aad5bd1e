"""Time and recall of approximate search against exact search.

Uses the vectors of BENCH_SF_DIR (default /root/testdata/sf0.1) and 100 of them
as queries; prints one JSON line per setting.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from lodestone.operators import ivf
from lodestone.operators.neighbours import nearest
from lodestone.session import build_session, checkpointed

K = 30


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "recall", "local[*]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").withColumnsRenamed(
        {"vec_id": "row_key", "embedding": "vector"}
    )
    queries = checkpointed(
        table.orderBy(F.xxhash64("row_key")).limit(100).select(
            F.col("row_key").alias("query_id"), "vector"
        )
    )
    centroids = ivf.train_centroids(table)
    quantizer = ivf.Quantizer.fit(table, unit=True)
    indexed = checkpointed(
        ivf.encode_vectors(ivf.assign_partitions(table, centroids), quantizer)
    )
    wanted = None
    settings = [("exact", {})]
    settings += [("probed", {"nprobes": n}) for n in (1, 5, 10, 20, 40, 100)]
    settings += [("refined", {"factor": n}) for n in (1, 2, 10)]
    settings += [("probed and refined", {"nprobes": 40, "factor": 10})]
    for name, options in settings:
        def run():
            if name == "exact":
                return nearest(indexed, queries, K)
            if name == "probed":
                return ivf.probed_nearest(indexed, centroids, queries, K, **options)
            used = centroids if "nprobes" in options else None
            return ivf.refined_nearest(indexed, quantizer, queries, K, centroids=used, **options)

        seconds = []
        for _ in range(3):
            start = time.perf_counter()
            found = {(r.query_id, r.row_key) for r in run().collect()}
            seconds.append(time.perf_counter() - start)
        wanted = wanted or found
        recall = len(found & wanted) / len(wanted)
        print(json.dumps({"search": name, **options, "seconds": round(min(seconds), 3), "recall": round(recall, 4)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
