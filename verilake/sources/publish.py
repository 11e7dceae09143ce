"""Writers: results by run, reports, lists of failures, and publishing what passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.sources import versioned
from verilake.sources.scratch import cut


def write_runs(results: DataFrame, path: str) -> None:
    """Results by run_id; a run that is written again replaces itself and no other."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_reports(texts: DataFrame, path: str) -> None:
    """Report texts (run_id, part, text), one file for each part, in order by name."""
    rows = texts.repartition("run_id", "part").select("run_id", "part", F.col("text").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("run_id", "part").text(path)


def write_failures(failed: DataFrame, path: str) -> bool:
    """The failures as JSON lines; nothing is written, and False given, if there are none."""
    if failed.isEmpty():
        return False
    failed.write.mode("overwrite").json(path)
    return True


def publish_verified(spark: SparkSession, staged: str, target: str, verdicts: DataFrame, key: str, partition: str) -> DataFrame:
    """Put the partitions of a staged table whose rows all passed in force in the target; the verdict of each.

    ``verdicts`` has key and passed. A partition with a row that failed or has no
    verdict stays as it was in the target. The target is a table of versions
    (``versioned``): its readers see all of these partitions at once or none, and
    a run that stops anywhere, or is run again, leaves the same rows in force.
    """
    rows = spark.read.parquet(staged)
    judged = rows.select(key, partition).join(verdicts.groupBy(key).agg(F.min(F.coalesce("passed", F.lit(False))).alias("passed")), key, "left")
    by_partition = cut(judged.groupBy(partition).agg(F.count("*").alias("n"), F.count_if(F.coalesce("passed", F.lit(False))).alias("n_passed")))
    good = by_partition.filter(F.col("n") == F.col("n_passed")).select(F.col(partition).alias("_good"))
    if not good.isEmpty():
        versioned.replace(spark, target, rows.join(good, F.col(partition).eqNullSafe(F.col("_good")), "left_semi"), partition)
    return by_partition.withColumn("published", F.col("n") == F.col("n_passed"))


def published(spark: SparkSession, target: str, version: int | None = None) -> DataFrame | None:
    """What is in force in the target, or was in a version; None if nothing has been published."""
    return versioned.read(spark, target, version)
