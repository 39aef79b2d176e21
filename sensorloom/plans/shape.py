"""Last step of every registered query: engine-neutral types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def neutral(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds doubles and drops the zone from timestamps, so that engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        out.append(c)
    return df.select(*out)
