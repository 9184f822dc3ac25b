"""Reviewer action streams and the pluggable action sink."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.operators.review import decisions, directives


def run_reviews(actions: DataFrame, decision_path: str, directive_path: str, checkpoint: str,
                trigger: dict | None = None):
    """Append decisions and directives of each micro-batch to two JSON tables.

    Files are written under the batch id and replaced on a retry, so a batch that is run
    again leaves no doubles.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        d = decisions(batch)
        d.write.mode("overwrite").json(f"{decision_path}/batch={batch_id}")
        directives(d).write.mode("overwrite").json(f"{directive_path}/batch={batch_id}")
    return (actions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


class ActionSink(Protocol):
    """Receives the audit rows of a micro-batch by kind; must not throw."""

    def arm(self, rows: DataFrame) -> None: ...
    def revert(self, rows: DataFrame) -> None: ...
    def start_watch(self, rows: DataFrame) -> None: ...
    def stop_watch(self, rows: DataFrame) -> None: ...
    def notify(self, rows: DataFrame) -> None: ...
    def audit(self, rows: DataFrame) -> None: ...


def dispatch(sink: ActionSink, on_error: Callable[[Exception], None] = lambda e: None):
    """foreachBatch function that routes audit rows to an action sink and survives its errors."""
    routes = {
        "arm": F.col("detail") == "arm continuous capture",
        "revert": F.col("detail") == "revert to baseline sampling",
        "start_watch": F.col("detail").startswith("start holdover watch"),
        "stop_watch": F.col("detail") == "stop holdover watch",
        "notify": F.col("kind") == "notify",
        "audit": F.col("kind").isin("transition", "action", "guardrail"),
    }

    def handle(batch: DataFrame, batch_id: int) -> None:
        for name, cond in routes.items():
            try:
                getattr(sink, name)(batch.where(cond))
            except Exception as e:  # a failing sink must not stop the stream
                on_error(e)
    return handle
