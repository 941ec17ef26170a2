"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from flowspark.catalog.base import ORDER, WINDOW
from flowspark.catalog.detection import SETTINGS, mean_bytes_score
from flowspark.catalog.evaluation import predicted_flows
from flowspark.flows import flows, packets
from flowspark.operators import assemble, encode, evaluate, split, stats, windows
from flowspark.operators.order import index_rows
from flowspark.plans.detection import detect_table
from flowspark.session import get_session
from flowspark.specs import NFV1

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = get_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = flows(spark, SF_DIR)
    params = stats.collect_params(table, NFV1)

    def halo_windows():
        indexed = index_rows(table.select(*ORDER, *NFV1.features, "Attack"), ORDER)
        coded = encode.encode_codes(indexed, params, keep=["idx", "Attack"])
        return windows.sliding_windows(coded, NFV1.features, WINDOW, keep=["Attack"])

    queries = {
        "fit_scaling_and_levels": lambda: stats.fit_params(table, NFV1.numerical, NFV1.categorical),
        "encode_flows": lambda: encode.encode_vectors(table, params, keep=["flow_id"]),
        "row_index": lambda: index_rows(table, ORDER),
        "sliding_windows": halo_windows,
        "balance_down": lambda: split.balance_down(table, "flow_id", "Dos_TCP_Flood"),
        "class_report": lambda: evaluate.class_report(predicted_flows(spark, SF_DIR), "Attack", "predicted"),
        "assemble_flows": lambda: assemble.assemble_flows(packets(spark, SF_DIR), 6 * 3600),
        "detect": lambda: detect_table(
            table, params, mean_bytes_score, SETTINGS, ORDER, ["flow_id"], WINDOW, "user_id"
        ),
    }
    seconds = {}
    for name, make in queries.items():
        best = None
        for _ in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    total = sum(seconds.values())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": seconds,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
