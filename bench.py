"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores. Each
query's whole result is computed (noop sink). The stored stages (routing and
response runs over all tickets) are timed on their own, as the write they are;
later queries read their tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "route_summary",
    "route_decisions",
    "route_rule_outcomes",
    "route_breakdown",
    "rules_eval",
    "context_for_response",
    "order_product_names",
    "safety_scan",
    "safety_by_code",
    "response_decisions",
    "response_eval",
    "classification_validation",
    "classifier_eval",
    "confusion_matrix",
    "ticket_fact",
    "classification_metrics",
    "rule_decision_metrics",
    "response_metrics",
    "operational_metrics",
    "all_metrics_summary",
    "measures_by_channel",
    "measures_path_override",
    "measures_grouping_sets",
    "medians_by_channel",
    "daily_volume",
    "dq_pk",
    "dq_fk_orphans",
    "dq_order_totals",
    "dq_constraints",
    "dq_suite",
    "dq_metric_selfcheck",
    "orders_per_customer",
    "top_products",
    "overlay_predictions",
    "overlay_decisions",
    "write_gate",
    "kpi_order_value_percentiles",
    "kpi_monthly_medians",
    "stream_route",
]

#: Timed too, but not part of the total, which stays comparable from round to round.
MORE = [
    "dq_suite_rows",
    "dq_checks_fire",
    "dq_analytics",
    "write_back_tickets",
    "maintained_metrics",
    "medians_from_sketches",
    "dq_fact_grain",
    "load_counts",
    "stream_intake",
    "classify_run",
]


def training_queries() -> dict:
    """The training-data queries, if that part of the package is there."""
    try:
        from ticketloom.llm import queries
    except ImportError:
        return {}
    return queries.QUERIES


def main() -> None:
    from ticketloom.plans.queries import QUERIES
    from ticketloom.plans.testmodel import Model
    from ticketloom.session import local_session

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{directory}/events.parquet").count()  # starts the executor threads
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    model = Model(spark, directory)
    timed("store_decisions", model.decided_tickets)
    timed("store_responses", model.stored_tickets)
    every = QUERIES | training_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [*HEADLINE, *MORE, *sorted(training_queries(), key=lambda n: int(n[2:].split("_")[0]))]
    for name in names:
        timed(name, lambda: every[name](spark, directory).write.format("noop").mode("overwrite").save())
    headline = [t for n, t in times.items() if chosen or n in {*HEADLINE, "store_decisions", "store_responses"}]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(headline), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(directory).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
