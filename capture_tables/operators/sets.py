"""Set operations over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_frames(a: DataFrame, b: DataFrame, on=("seq", "frame")) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def covered_frames(observations: DataFrame, least_views: int = 2, on=("seq", "frame")) -> DataFrame:
    """Frames that at least so many different cameras see, with their number."""
    return observations.groupBy(*on).agg(F.countDistinct("cam").alias("views")).where(F.col("views") >= least_views)


def minus_frames(a: DataFrame, b: DataFrame, on=("seq", "frame")) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def append_hypotheses(**sources: DataFrame) -> DataFrame:
    """All rows of the named tables, with the name in `source`."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def split_examples(df: DataFrame, train) -> DataFrame:
    """One table for both sets, `split` says which."""
    return df.withColumn("split", F.when(train, "train").otherwise("test"))
