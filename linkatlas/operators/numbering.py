"""Dense numbers for the rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number rows 1..N by ``key``: a range shuffle, then each partition's offset from the partition counts."""
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    ranged = cut(ranged.withColumn("_m", F.monotonically_increasing_id()), "ids").withColumn("_p", F.shiftright("_m", 33))
    counts = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())
    offset, at = [], 0
    for p, n in counts:
        offset.append((p, at))
        at += n
    offsets = ranged.sparkSession.createDataFrame(offset, "_p long, _o long")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_m", "_o")
