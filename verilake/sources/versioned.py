"""Tables of partitions that change together: versions, each a manifest, and one switch between them.

    path/data/publication=<id>/<partition>=<value>/...   rows, written once and never changed
    path/manifests/v<number>/                            which publication holds each partition

Rows are written first, then the manifest of the next version beside the others,
and one rename puts it in force. Until that a reader sees all partitions of the
version before, and from then on all of the new one; a writer that stops anywhere
leaves nothing behind but files that no manifest names. A writer that comes second
to the same version is told so and may try again on what is there then.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Overtaken(RuntimeError):
    """Another writer has put the same version in force."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what is in a folder; none if it is not there."""
    at, fs = _fs(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def _stored(kind: StructType) -> StructType:
    """The schema of the files, which lie by publication too."""
    return StructType([*kind.fields, StructField("publication", StringType())])


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[1:]) for name, _ in _children(spark, f"{path}/manifests") if name[0] == "v" and name[1:].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """partition, publication, schema of a version, or of the newest; None before the first."""
    if version is None:
        found = versions(spark, path)
        if not found:
            return None
        version = found[-1]
    return spark.read.parquet(f"{path}/manifests/v{version:012d}")


def read(spark: SparkSession, path: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
    """The rows of a version, or of the newest; None before the first. ``only`` has values of the partition to read."""
    named = manifest(spark, path, version)
    return None if named is None else _rows(spark, path, named, only)


def _rows(spark: SparkSession, path: str, named: DataFrame, only: DataFrame | None = None) -> DataFrame:
    partition, whole = named.columns[0], named
    if only is not None:
        named = named.join(only.select(F.col(partition).alias("_only")).distinct(), F.col(partition).eqNullSafe(F.col("_only")), "left_semi")
    # as many publications as the table has partitions, at most
    publications = [r["publication"] for r in named.select("publication").distinct().collect()]
    shown = whole.select("schema").first()
    if shown is None:
        return None  # a version of no partitions
    kind = StructType.fromJson(json.loads(shown["schema"]))
    if not publications:
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(_stored(kind)).option("basePath", f"{path}/data").parquet(*[f"{path}/data/publication={p}" for p in publications])
    held = named.select(F.col(partition).alias("_held"), F.col("publication").alias("_by"))
    return rows.join(held, F.col(partition).eqNullSafe(F.col("_held")) & (F.col("publication") == F.col("_by")), "left_semi").select(*kind.names)


def write_rows(rows: DataFrame, path: str, partition: str) -> str:
    """Step 1: the rows of some partitions, that no version holds yet; the id of the publication."""
    publication = uuid.uuid4().hex
    rows.write.partitionBy(partition).parquet(f"{path}/data/publication={publication}")
    return publication


def prepare(spark: SparkSession, path: str, partition: str, rows: DataFrame, publication: str, dropped: DataFrame | None = None) -> tuple[str, int]:
    """Step 2: the manifest of the next version, beside the others; (where it is, its number)."""
    kind = rows.schema
    found = versions(spark, path)
    stored = spark.read.schema(_stored(kind)).option("basePath", f"{path}/data").parquet(f"{path}/data/publication={publication}")
    named = stored.select(partition).distinct().select(partition, F.lit(publication).alias("publication"), F.lit(rows.schema.json()).alias("schema"))
    if found:
        gone = named.select(F.col(partition).alias("_gone"))
        if dropped is not None:
            gone = gone.union(dropped.select(partition))
        before = manifest(spark, path, found[-1])
        named = before.join(gone, F.col(partition).eqNullSafe(F.col("_gone")), "left_anti").withColumn("schema", F.lit(rows.schema.json())).unionByName(named)
    at = f"{path}/manifests/.writing-{uuid.uuid4().hex}"
    named.coalesce(1).write.parquet(at)
    return at, (found[-1] if found else -1) + 1


def switch(spark: SparkSession, path: str, at: str, version: int) -> None:
    """Step 3: one rename, which fails if the version is there already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    to = hadoop.Path(f"{path}/manifests/v{version:012d}")
    files = hadoop.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else hadoop.Path(f"file://{path}").toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        files.rename(hadoop.Path(at), to, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to):
            raise Overtaken(f"{path} has a version {version}") from e
        raise


def replace(spark: SparkSession, path: str, rows: DataFrame, partition: str) -> int:
    """Put rows in force as all rows of the partitions that they are of, all at once; the number of the version.

    Columns are those of the rows, the partition last. Rows of no partition at all
    give a version that holds what the one before does.
    """
    rows = rows.select(*[c for c in rows.columns if c != partition], partition)
    publication = write_rows(rows, path, partition)
    at, version = prepare(spark, path, partition, rows, publication)
    switch(spark, path, at, version)
    return version


def vacuum(spark: SparkSession, path: str, keep_seconds: float) -> list[str]:
    """Delete versions that have been out of force for so long, and what no manifest left names and is as old; what went.

    A reader that takes no longer than that never misses a file.
    """
    spared = (time.time() - keep_seconds) * 1000
    gone, numbers = [], versions(spark, path)
    put = dict(_children(spark, f"{path}/manifests"))
    name = lambda v: f"v{v:012d}"
    # a version went out of force when the next one came
    old = [v for v, following in zip(numbers, numbers[1:], strict=False) if put[name(following)] < spared]
    left = [v for v in numbers if v not in old]
    named = {r["publication"] for v in left for r in manifest(spark, path, v).select("publication").distinct().collect()}
    gone += [f"manifests/{name(v)}" for v in old] + [f"manifests/{x}" for x, t in put.items() if x.startswith(".writing-") and t < spared]
    gone += [f"data/{x}" for x, t in _children(spark, f"{path}/data") if x.removeprefix("publication=") not in named and t < spared]
    for x in gone:
        at, fs = _fs(spark, f"{path}/{x}")
        fs.delete(at, True)
    return gone
