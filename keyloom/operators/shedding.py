"""Load shedding, simulated; Spark itself never drops, and limits what it reads instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PENDING = 100_000


def shed(df: DataFrame, batch: str, seq: str, most: int = MAX_PENDING) -> DataFrame:
    """df with `discarded`, as a queue without workers would decide for each batch that arrives at once.

    More than twice `most` are refused as they come, so the last ones go first; of those that were queued, the oldest are dropped
    until `most` are left. 0 or less: no limit.
    """
    if most <= 0:
        return df.withColumn("discarded", F.lit(False))
    w = Window.partitionBy(batch)
    place, n = F.row_number().over(w.orderBy(seq)), F.count(F.lit(1)).over(w)
    queued = F.least(n, F.lit(2 * most))
    return df.withColumn("discarded", (place > 2 * most) | (place <= queued - most))


def limited(df: DataFrame, batch: str, seq: str, most: int) -> DataFrame:
    """df with `discarded` for a limit on what one container may have pending: what comes after `most` is not accepted."""
    if most < 0:
        return df.withColumn("discarded", F.lit(False))
    return df.withColumn("discarded", F.row_number().over(Window.partitionBy(batch).orderBy(seq)) > most)


def read_limit(most: int) -> dict[str, str]:
    """Options of a file stream that hold a batch to a number of files; back-pressure without loss."""
    return {"maxFilesPerTrigger": str(max(1, most))}
