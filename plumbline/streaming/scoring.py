"""Scoring of arriving rows: fitted constants are plain expressions, so they apply to streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_layers(rows: DataFrame, layers: Sequence[dict[str, Column]]) -> DataFrame:
    """Apply fitted column expressions, layer by layer, to a batch or streaming frame."""
    for layer in layers:
        rows = rows.withColumns(layer)
    return rows


def score_stream(
    rows: DataFrame,
    layers: Sequence[dict[str, Column]],
    keep: Sequence[str],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append the scored rows of a stream to parquet files and stop when the input is read."""
    return (
        apply_layers(rows, layers)
        .select(*keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
