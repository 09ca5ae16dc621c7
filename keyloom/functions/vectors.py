"""Functions in Python that run over Arrow batches: a scalar one, an aggregate and a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


@F.arrow_udf(DoubleType())
def clipped(values: pa.Array) -> pa.Array:
    """Values held to 10 to 100."""
    return pc.min_element_wise(pc.max_element_wise(values, 10.0, skip_nulls=False), 100.0, skip_nulls=False)


@F.pandas_udf(DoubleType())
def spread(values: pd.Series) -> float:
    """The largest less the smallest value of a group."""
    return float(values.max() - values.min())


@F.udtf(returnType=StructType([StructField("place", IntegerType()), StructField("word", StringType())]))
class Words:
    """The words of a text with their places."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for k, w in enumerate(re.findall("[A-Za-z]+", text or "")):
            yield k, w
