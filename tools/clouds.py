"""Time searches and growth on ridge clouds and grid meshes of any size.

    python tools/clouds.py 200000 [2000000 ...]

A cloud of n points comes from a table of n parts, as the catalogue derives it.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ("knn_ridge", "grow_regions", "adjacency_interior", "get_clusters_ridge", "nearest_on_mesh", "locate_on_mesh", "laplace_z")


def main() -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "32").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="clouds-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ridgeline.catalog import QUERIES
    from ridgeline.catalog.base import Inputs

    for n in map(int, sys.argv[1:]):
        folder = tempfile.mkdtemp(prefix=f"cloud-{n}-")
        spark.range(n).selectExpr("id AS p_partkey", "cast(1 + (id * 7919) % 50 AS int) AS p_size").write.parquet(f"{folder}/part.parquet")
        Inputs.forget()
        for name in NAMES:
            if name not in QUERIES:
                continue
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            print(f"{n:>9} {name:20s} {time.time() - start:8.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
