"""Listing of files as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.functions.text import leaf_name
from verilake.sources.files import Entry, Stores, entries, entry_of, local_path
from verilake.sources.scratch import cut


def any_case(extension: str) -> str:
    """A glob for an extension in any case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


_FOUND = {"root": pa.int32(), "level": pa.int32(), "kind": pa.string(), "path": pa.string(), "canonical": pa.string(), "name": pa.string(), "size": pa.int64(), "modified": pa.timestamp("us", "UTC"), "error": pa.string()}
_FOUND_DDL = "root int, level int, kind string, path string, canonical string, name string, size long, modified timestamp, error string"
#: Entries that a task gives out at once.
_ROWS = 10_000


def _listed(extension: str):
    """Of rows (root, level, path, canonical) of folders what stands in them; level -1 are roots, which stand for themselves."""
    ending = "." + extension.lower()

    def wanted(e: Entry) -> bool:
        return e.kind in ("folder", "error") or (e.kind == "file" and e.name.lower().endswith(ending))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, rows = Stores(), []
        for batch in batches:
            for root, level, path, canonical in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for e in [entry_of(stores, path)] if level < 0 else entries(stores, path, canonical):
                    if wanted(e):
                        rows.append((root, level + 1, e.kind, e.path, e.canonical, e.name, e.size, e.modified, e.error))
                    if len(rows) >= _ROWS:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.values(), strict=True)], list(_FOUND))


def walk(spark: SparkSession, roots: list[str], extension: str = "flac") -> DataFrame:
    """root (its ordinal), level, kind (file or error), path, canonical, name, size, modified, error: what the roots hold.

    Folders are dealt to tasks, level by level; what a level holds is a table in
    the shared folder, and the driver sees nothing of it. Links are followed. A
    folder is listed once for each root, however many links lead to it, by the
    way that has the fewest levels, then by path; a link back to a folder above
    is an error. An entry that cannot be looked at, a folder that cannot be listed
    and a root that is not there give one error each, and everything else is listed.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([(i, -1, r, r) for i, r in enumerate(roots)], "root int, level int, path string, canonical string")
    found, visited = None, None
    while found is None or not frontier.isEmpty():
        level = cut(frontier.repartition(parts).mapInArrow(_listed(extension), _FOUND_DDL))
        found = level if found is None else found.unionByName(level)
        ways = level.filter("kind = 'folder'").groupBy("root", "canonical").agg(F.min("path").alias("path"), F.min("level").alias("level"))
        frontier = ways if visited is None else ways.join(visited, ["root", "canonical"], "left_anti")
        frontier = cut(frontier.select("root", "level", "path", "canonical"))
        seen = frontier.select("root", "canonical")
        visited = seen if visited is None else visited.unionByName(seen)
    uri = F.when(F.col("path").startswith("/"), F.concat(F.lit("file:"), "path")).otherwise(F.col("path"))
    return found.filter("kind <> 'folder'").withColumn("path", uri)


def identified(found: DataFrame) -> DataFrame:
    """path, name, size, modified, root_ordinal of each file once: of the first root that holds it, and there by its own path rather than a link, then the fewest levels, then by path."""
    linked = (F.col("path") != F.col("canonical")) & (F.col("path") != F.concat(F.lit("file:"), "canonical"))
    first = F.min(F.struct("root", linked.alias("linked"), "level", "path", "name", "size", "modified")).alias("first")
    files = found.filter("kind = 'file'").groupBy("canonical").agg(first)
    return files.select("first.path", "first.name", "first.size", "first.modified", F.col("first.root").alias("root_ordinal"))


def scan_with_errors(spark: SparkSession, roots: list[str], extension: str = "flac") -> tuple[DataFrame, DataFrame]:
    """(path, name, size, modified, root_ordinal of the files under the roots, path and error of what cannot be listed), of one walk.

    A file, the links to it and the ways to its folder are one file. No bad entry
    and no bad root ends the scan.
    """
    found = walk(spark, roots, extension)
    errors = found.filter("kind = 'error'").groupBy("path").agg(F.min(F.when((F.col("level") == 0) & (F.col("error") == "ENOENT"), "PATH_NOT_FOUND").otherwise(F.col("error"))).alias("error"))
    plain = [r for r in roots if local_path(r) is not None]
    return identified(found), errors.withColumn("path", F.when(F.regexp_replace("path", "^file:", "").isin(plain), F.regexp_replace("path", "^file:", "")).otherwise(F.col("path")))


def read_errors(listed: DataFrame, read: DataFrame) -> DataFrame:
    """path, error of listed files that a read which skips bad files (``ignoreCorruptFiles``, ``ignoreMissingFiles``) did not give."""
    return listed.select("path").join(read.select("path").distinct(), "path", "left_anti").withColumn("error", F.lit("UNREADABLE"))


def scan(spark: SparkSession, roots: list[str], extension: str = "flac") -> DataFrame:
    """path, name, size, modified of the files under the roots (folders or files).

    Nothing but the listing is read: the content is pruned. A file under two
    roots is listed twice; ``catalog.dedup`` settles that. ``walk`` lists by tasks,
    tells links from files, and goes on where an entry cannot be listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(extension)).load(roots)
    return files.select("path", leaf_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
