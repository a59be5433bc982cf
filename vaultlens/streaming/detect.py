"""Detection over streams.  Detectors keep no state, so a stream of chunks maps to a stream of hits as a batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.operators.detect import hits_in
from vaultlens.operators.spans import Settings


def stream_hits(chunks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Hits of a streaming chunks(file_id, raw_idx, text); a file's chunk limit needs the whole file and isn't applied."""
    own = chunks.select("file_id", F.col("raw_idx").cast("int").alias("norm_idx"), F.coalesce("text", F.lit("")).alias("text"))
    return hits_in(own, settings or Settings())


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of key by tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
