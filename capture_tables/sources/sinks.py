"""Writers of metrics and tracks, and renaming of a sequence across tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capture_tables.functions.shared import stored


def write_metrics(frames: DataFrame, summary: DataFrame, path: str, parts: int = 64) -> None:
    """Frame metrics as Parquet by run and part, of which each sequence is in one, and the summary as JSON
    beside it. A run's sequences replace what stood of them there, all others stay; only partitions that
    hold one are written. A folder for each sequence would cost as many files as there are sequences."""
    spark, at = frames.sparkSession, f"{path}/frames"
    rows = frames.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.parquet(at).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
        old = old.join(rows.select("run", "part").distinct(), ["run", "part"], "left_semi").join(rows.select("run", "seq").distinct(), ["run", "seq"], "left_anti")
        rows = stored(rows.unionByName(old))
    rows.repartition("run", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(at)
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_track(track: DataFrame, path: str, most_residual: float) -> None:
    """Rows within the residual gate."""
    track.where(F.col("residual") <= most_residual).write.mode("overwrite").parquet(path)


def rename_sequence(tables: dict[str, DataFrame], old: str, new: str, dry_run: bool = False) -> dict[str, DataFrame]:
    """Each table with the sequence renamed, or for a dry run the number of its rows that name it."""
    if dry_run:
        return {n: df.where(F.col("seq") == old).agg(F.count("*").alias("hits")) for n, df in tables.items()}
    return {n: df.withColumn("seq", F.when(F.col("seq") == old, new).otherwise(F.col("seq"))) for n, df in tables.items()}
