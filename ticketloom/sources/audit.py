"""Audit events: one row per decision, allow-listed columns, no text and no personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: event fields ---
AUDIT_FIELDS = [
    "ticket_id",
    "event",
    "success",
    "predicted_category",
    "predicted_priority",
    "latency_ms",
    "error_type",
    "error_message",
    "input_tokens",
    "output_tokens",
    "dry_run",
    "final_priority",
    "decision_path",
    "triggered_rules",
    "reasons",
    "conflicting_signals",
    "is_fallback",
    "response_status",
    "response_type",
    "customer_facing",
    "requires_human_review",
    "has_draft",
]


def allowed(events: DataFrame) -> DataFrame:
    """The allow-listed fields present in the frame, in their fixed order."""
    return events.select(*[c for c in AUDIT_FIELDS if c in events.columns])


def redact(text: Column, secrets: list[str]) -> Column:
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return text


def routing_events(decided: DataFrame, dry_run: bool) -> DataFrame:
    return allowed(
        decided.withColumns(
            {
                "event": F.when(F.col("is_fallback"), F.lit("rules_fallback")).otherwise(F.lit("rules_decision")),
                "success": ~F.col("is_fallback"),
                "ticket_id": F.coalesce(F.col("ticket_id"), F.lit(-1)),
                "dry_run": F.lit(dry_run),
            }
        ).select(
            "ticket_id", "event", "success", "final_priority", "decision_path", "triggered_rules", "reasons",
            "conflicting_signals", "is_fallback", "dry_run",
        )
    )


def response_events(decided: DataFrame, dry_run: bool) -> DataFrame:
    return allowed(
        decided.withColumns(
            {
                "event": F.when(F.col("is_fallback"), F.lit("response_fallback")).otherwise(F.lit("response_decision")),
                "success": ~F.col("is_fallback"),
                "ticket_id": F.coalesce(F.col("ticket_id"), F.lit(-1)),
                "has_draft": F.col("response_draft").isNotNull(),
                "dry_run": F.lit(dry_run),
            }
        ).select(
            "ticket_id", "event", "success", "response_status", "response_type", "customer_facing",
            "requires_human_review", "has_draft", "is_fallback", "dry_run",
        )
    )


def classification_events(validated: DataFrame, dry_run: bool, secrets: list[str] | None = None) -> DataFrame:
    ok = F.col("success")
    latency = F.round("latency_ms", 1) if "latency_ms" in validated.columns else F.lit(None).cast("double")
    message = F.col("error_message") if "error_message" in validated.columns else F.lit(None).cast("string")
    return allowed(
        validated.select(
            "ticket_id",
            F.when(ok, F.lit("classification_success")).otherwise(F.lit("classification_failure")).alias("event"),
            "success",
            F.when(ok, F.col("category")).alias("predicted_category"),
            F.when(ok, F.col("priority")).alias("predicted_priority"),
            latency.alias("latency_ms"),
            "error_type",
            redact(message, secrets or []).alias("error_message"),
            F.when(ok, F.col("input_tokens")).alias("input_tokens"),
            F.when(ok, F.col("output_tokens")).alias("output_tokens"),
            F.lit(dry_run).alias("dry_run"),
        )
    )


def write_events(events: DataFrame, path: str, run_date: str, fmt: str = "json", run_id: str | None = None) -> None:
    """Write one run's events, laid out by event and run date.

    With ``run_id`` they go to a folder of that run, which a repeated run
    replaces, so that no decision is logged twice. Without it they are appended.
    """
    folder, mode = (path, "append") if run_id is None else (f"{path}/run_id={run_id}", "overwrite")
    dated = allowed(events).withColumn("run_date", F.lit(run_date))
    dated.write.mode(mode).partitionBy("event", "run_date").format(fmt).save(folder)
