"""Headline queries of the graph engine; prints one JSON line.

The graphs (lists of 10, and of 50 for the workload) are built and written once,
as an index would be, with their time as ``build`` and ``build_k50``; each query
is then timed from planning to the last row. ``value`` sums up the headline
queries, ``workload`` the eight shapes with lists of 50.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from lodegraph import fixtures
from lodegraph.engine import Engine
from lodegraph.registry import TEXTS, WORKLOAD

HEADLINE = (
    "scan_vcc", "bgp_chain", "bgp_star", "bgp_cycle", "bgp_varpred", "knn_scan", "knn_triangle", "sim_join_uni", "sim_join_uni_bgp",
    "sim_join_bi", "sim_join_bi_asym", "sim_chain", "sim_chain_bi", "sim_triangle", "sim_lonely",
)
#: The same texts by the evaluate-then-filter strategy, for comparison.
COMPARED = ("sim_join_uni", "sim_join_bi", "sim_chain_bi", "sim_triangle", "sim_lonely")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        took[name] = round(time.perf_counter() - start, 3)

    timed("build", lambda: fixtures.graph(spark, sf_dir).statistics)
    timed("build_k50", lambda: fixtures.graph(spark, sf_dir, fixtures.K_WORKLOAD).statistics)
    engine, long_lists = (Engine(fixtures.graph(spark, sf_dir, k)) for k in (fixtures.K, fixtures.K_WORKLOAD))
    run = lambda text, on=engine, **o: on.query(text, **o).write.format("noop").mode("overwrite").save()
    run(TEXTS["sim_join_uni"])  # compiles
    for name in HEADLINE:
        timed(name, lambda name=name: run(TEXTS[name]))
    compared = {name: took[name] for name in COMPARED}
    for name in COMPARED:
        timed(f"{name}_postfilter", lambda name=name: run(TEXTS[name], strategy="postfilter"))
    for name, text in WORKLOAD.items():
        timed(name, lambda text=text: run(text, long_lists))
    for name, text in WORKLOAD.items():
        timed(f"{name}_postfilter", lambda text=text: run(text, long_lists, strategy="postfilter"))
    print(
        json.dumps(
            {
                "metric": "graph_queries_total",
                "value": round(sum(took[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": took,
                "workload": round(sum(took[n] for n in WORKLOAD), 3),
                "workload_against_postfilter": round(sum(took[n] for n in WORKLOAD) / sum(took[f"{n}_postfilter"] for n in WORKLOAD), 3),
                "flat_against_postfilter": round(sum(compared.values()) / sum(took[f"{n}_postfilter"] for n in COMPARED), 3),
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
