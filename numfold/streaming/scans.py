"""Streaming twins of the ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from numfold.operators.scan import Step
from numfold.operators.scan import streaming as stateful


def scan_stream(signal: DataFrame, step: Step, start: list[float]) -> DataFrame:
    """Applies a scan step to a streaming (series, k, x); state lives in the state store.

    Samples must arrive in order between micro-batches; within one they are sorted by k."""
    return signal.select("series", "k", "x").groupBy("series").applyInPandasWithState(stateful(step, start), "series long, k long, y double", "values array<double>", "append", "NoTimeout")
