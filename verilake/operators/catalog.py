"""File catalogs: union, dedup, set differences, orders and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from verilake.functions.text import canonical_path
from verilake.sources.scratch import cut


def with_extension(files: DataFrame, extension: str = ".flac") -> DataFrame:
    return files.filter(F.endswith(F.lower("path"), F.lit(extension)))


def union_roots(*catalogs: DataFrame) -> DataFrame:
    """Several catalogs in one; root_ordinal tells which root a row was listed under."""
    out = catalogs[0].withColumn("root_ordinal", F.lit(0))
    for i, c in enumerate(catalogs[1:], 1):
        out = out.unionByName(c.withColumn("root_ordinal", F.lit(i)))
    return out


def dedup(files: DataFrame) -> DataFrame:
    """One row per file, of the first root that lists it; one shuffle with partial aggregation.

    Paths are told apart in their canonical form, which is what comes out: two
    ways to write a path are one file, two links to it are two. Of files on disk
    ``listing.identified`` tells links from files, while it walks.
    """
    rows = files.withColumn("path", canonical_path(F.col("path")))
    return rows.groupBy("path").agg(F.min(F.struct("root_ordinal", "size")).alias("first")).select("path", F.col("first.size").alias("size"), F.col("first.root_ordinal").alias("root_ordinal"))


def error_digest(errors: DataFrame, shown: int = 3) -> DataFrame:
    """ordinal, line: the first distinct paths in order, and how many more there are."""
    paths = errors.select("path").distinct()
    first = paths.orderBy("path").limit(shown)
    lines = first.select(F.row_number().over(_all_of_few("path")).alias("ordinal"), F.col("path").alias("line"))
    more = paths.agg(F.count("*").alias("n")).filter(F.col("n") > shown).select(F.lit(shown + 1).alias("ordinal"), F.format_string("... plus %d more", F.col("n") - shown).alias("line"))
    return lines.unionByName(more)


def _all_of_few(*order):
    """A window over a whole table of a few rows."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def work_order(files: DataFrame) -> list[Column]:
    """Large files first, then by name and path: a total order."""
    return [F.desc("size"), F.asc("name"), F.asc("path")]


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank from 1 over the whole table, without one task that sees it all.

    Rows are dealt by ranges and sorted there; a row's rank is its place in its
    range plus the rows of the ranges before it, one number per range. All columns
    are written on the way: select what is needed before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before, rows = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "_part long, _before long")
    rank = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, rank).drop("_part", "_at", "_before")


def dealt(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """``df`` as a written table, dealt by ranges of key and order: _part, and _at, the place in the order there. Select what is needed before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*_keys(key), *order]
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return cut(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def _with_earlier(placed: DataFrame, keys: list[str], earlier: DataFrame) -> DataFrame:
    """Rows with what their key has in the ranges before theirs.

    At most one key reaches into a range from before it, so that ``earlier`` has
    one row for each range.
    """
    other = earlier.withColumnsRenamed({"_part": "_p", **{c: f"_k{i}" for i, c in enumerate(keys)}})
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(F.broadcast(other), same, "left").drop("_p", *[f"_k{i}" for i in range(len(keys))])


def with_running(placed: DataFrame, key: str | list[str], **sums: Column) -> DataFrame:
    """Rows that ``dealt`` has placed by the key, with running ``sums``: those of the range, and of the key's ranges before."""
    keys = _keys(key)
    values = {f"_{c}": F.coalesce(value, F.lit(0)).cast("long") for c, value in sums.items()}
    placed = placed.withColumns(values)
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(c).alias(c) for c in values])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = next(iter(values))
    before = totals.select("_part", *keys, *[F.sum(c).over(earlier).alias(f"_b{c}") for c in values]).filter(F.col(f"_b{first}").isNotNull())
    here = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {c[1:]: F.sum(c).over(here) + F.coalesce(f"_b{c}", F.lit(0)) for c in values}
    return _with_earlier(placed, keys, before).withColumns(so_far).drop(*values, *[f"_b{c}" for c in values])


def with_previous(placed: DataFrame, key: str | list[str], value: Column, name: str) -> DataFrame:
    """Rows that ``dealt`` has placed by the key, with the value of the key's row before; null for the first.

    The last value of a key in a range is handed over to the next range that has the key.
    """
    keys = _keys(key)
    placed = placed.withColumn("_v", F.struct(value.alias("v")))
    last = placed.groupBy("_part", *keys).agg(F.max_by("_v", "_at").alias("_last"))
    before = last.select("_part", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_handed")).filter("_handed IS NOT NULL")
    here = Window.partitionBy("_part", *keys).orderBy("_at")
    joined = _with_earlier(placed, keys, before)
    return joined.withColumn(name, F.coalesce(F.lag("_v").over(here), F.col("_handed"))["v"]).drop("_v", "_handed")


def with_total(placed: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Rows that ``dealt`` has placed by the key, with how many rows their key has. They meet that by key and range, so that no key is hot."""
    keys = _keys(key)
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_c"))
    sizes = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.sum("_c").over(Window.partitionBy(*keys)).alias(name))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(sizes, same).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, key: str | list[str], order: list[str], carry: list[str] | tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """The key, the columns of the order, those to carry, nth (from 1) and running ``sums`` of the rows of each key, without one task that sees a whole key.

    Nothing but the columns named here is written.
    """
    own = [c for c in dict.fromkeys([*_keys(key), *order, *carry]) if c not in sums]
    placed = dealt(df.select(*own, *[F.coalesce(v, F.lit(0)).cast("long").alias(f"_s_{c}") for c, v in sums.items()]), key, order)
    return with_running(placed, key, nth=F.lit(1), **{c: F.col(f"_s_{c}") for c in sums}).select(*own, "nth", *sums)


def shard_plan(files: DataFrame, shards: int) -> DataFrame:
    """Each file's shard, dealt back and forth over the ranks so that sizes even out."""
    at = F.col("rank") - 1
    turn, place = F.call_function("div", at, F.lit(shards)), at % shards
    return ranked(files, *work_order(files)).withColumn("shard", F.when(turn % 2 == 0, place).otherwise(shards - 1 - place).cast("int"))


def shard_loads(planned: DataFrame) -> DataFrame:
    return planned.groupBy("shard").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def deal_to_shards(planned: DataFrame, shards: int) -> DataFrame:
    """The rows in one partition for each shard, for work that runs by shard."""
    return planned.repartitionById(shards, F.col("shard"))


def _temps(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    temps = files.filter(F.lower("ext") == "tmp").select("dir", "stem")
    return temps, files.filter(F.lower("ext") == "flac").select("dir", "stem")


def stale_temps(files: DataFrame) -> DataFrame:
    """Temporary files whose finished file is there: a list to delete, nothing is deleted."""
    temps, done = _temps(files)
    return temps.join(done, ["dir", "stem"], "left_semi")


def orphan_temps(files: DataFrame) -> DataFrame:
    temps, done = _temps(files)
    return temps.join(done, ["dir", "stem"], "left_anti")


def skip_done(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SKIPPED for files that carry a marker of earlier work, else QUEUED."""
    marked = done.select(key).distinct().withColumn("_done", F.lit(True))
    return files.join(marked, key, "left").withColumn("status", F.when(F.col("_done"), "SKIPPED").otherwise("QUEUED")).drop("_done")


def new_only(scan: DataFrame, queued: DataFrame) -> DataFrame:
    """Files of a scan that are not queued yet, once each."""
    return scan.join(queued.select("path").distinct(), "path", "left_anti").dropDuplicates(["path"])


def pending(discovered: DataFrame, finished: DataFrame, key: str = "path") -> DataFrame:
    return discovered.join(finished.select(key), key, "left_anti")


def with_origin(files: DataFrame, origins: DataFrame, key: str) -> DataFrame:
    """The origin of each cached file; one without a mapping is a failure.

    The mapping is looked up by an ordinary join: Spark broadcasts it if it is
    small and shuffles it if it is not.
    """
    joined = files.join(origins, key, "left")
    return joined.withColumn("status", F.when(F.col("origin").isNull(), "FAIL").otherwise("OK"))


def first_seen(events: DataFrame, value: str, seq: str) -> DataFrame:
    return events.groupBy(value).agg(F.min(seq).alias("first_seq"))
