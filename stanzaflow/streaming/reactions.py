"""The reaction state over a stream of log rows (an extension: the reference reads the log as a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stanzaflow.operators.recommend import reaction_state


def stream_state(log: DataFrame) -> DataFrame:
    """``reaction_state`` of a streaming log; write it in update mode. State is one row for each reader and poem, latest wins, so late rows need no watermark."""
    return reaction_state(log)


def start(log: DataFrame, name: str, checkpoint: str):
    """Starts a query that keeps the state in a memory table of that name (for tests and small uses)."""
    return stream_state(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
