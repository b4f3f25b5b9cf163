"""The pair-labelled volume from a stream of points (an addition: the batch operator is lattica.operators.volumes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.voxels import AXES


def mesh_stream(points: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Maintains z, y, x, pair_id of a stream of points(pair_id, z, y, x) as the in-memory table `name`: of each place the
    greatest id. The maximum does not depend on the order of arrival, so late points need no watermark."""
    merged = points.groupBy(*AXES).agg(F.max("pair_id").alias("pair_id"))
    return merged.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
