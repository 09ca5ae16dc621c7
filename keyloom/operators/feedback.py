"""Loops over tables: what a stage sends back to itself, until it sends nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.storage import cut


def fixpoint(first: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """All rows of first, step(first), step(step(first)) and so on until a step gives none, with their `round` from 0.

    Each round is written, and only the last one is read for the next; no number of rows or rounds ends the loop early. With
    `rounds`, rows left after so many are an error.
    """
    found, last, n = None, cut(first), 0
    while not last.isEmpty():
        if rounds is not None and n >= rounds:
            raise RuntimeError("rounds ended with rows left")
        own = last.withColumn("round", F.lit(n))
        found = own if found is None else found.union(own)
        if n % 32 == 31:
            found = cut(found)
        last, n = cut(step(last)), n + 1
    return found if found is not None else first.withColumn("round", F.lit(0)).limit(0)
