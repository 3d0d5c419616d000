"""Scoring of streams. Only stateless steps are offered: prediction, scaling with fitted statistics, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lattica.plans.predict import predict


def score_stream(stream: DataFrame, beta: dict[str, float], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Score every row of a stream into Parquet, once each; options as for `predict`."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use lattica.plans.predict.predict")
    scored = predict(stream, beta, **options)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
