"""Scenes that arrive over time: a stream of pixel files kept as running quality counts by scene and window.

Batch plans work unchanged on a stream's micro-batches; this is the one aggregate that is worth
keeping while files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import is_valid


def running_quality(stream: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """window, scene_id, n, n_valid, mean of pixels (scene_id, v, ts); windows close when the watermark passes them."""
    ok = is_valid(F.col("v"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), F.avg(F.when(ok, F.col("v"))).alias("mean"))
