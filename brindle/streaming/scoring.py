"""Fitted models over streams: scoring is a stateless expression, so it runs on a streaming DataFrame as on any other."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, stream: DataFrame) -> DataFrame:
    """The stream with the model's prediction, or its transformed features if it has no ``predict``."""
    return model.predict(stream) if hasattr(model, "predict") else model.transform(stream)


def score_to_parquet(model, stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that scores what has arrived and appends it to ``path``, exactly once, then ends.

    What has been read is kept in ``checkpoint``, by default a folder named by
    ``path`` under ``spark.checkpoint.dir``, so a later process goes on where
    this one ends. A session without that setting must name one.
    """
    shared = stream.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not checkpoint and not shared:
        raise ValueError("name a checkpoint, or set spark.checkpoint.dir: a temporary folder would forget what has been read")
    at = checkpoint or f"{shared.rstrip('/')}/stream-{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    return score_stream(model, stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", at).trigger(availableNow=True).start()
