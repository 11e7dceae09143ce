"""Bottom-k sketches of word shingles, by DataFrame functions alone.

A sketch is the ascending array of the k smallest 64-bit hashes of a text's
distinct shingles. The k smallest of a union are among the k smallest of its
parts, so sketches of parts merge into that of the whole. Two sketches give the
resemblance and the containment of their texts, one gives the number of distinct
shingles; all are exact while a text has at most k shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 128
SHINGLE = 5
#: Windows that share the documents, about, where these are many.
CELLS = 65536
#: Documents of a window where they are few.
ROWS_PER_BUCKET = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of the runs of n words; fewer words count as one shingle, none as no shingle.

    Words are what white space (blank, tab to carriage return) parts, in lower case.
    A null text has no words.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
    none = F.array().cast("array<long>")
    return F.array_distinct(_let(hashes, lambda h: F.when(F.size(h) >= n, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(shingles(text, n)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One merged sketch for each key, keys with any number of rows included.

    Hashes are made distinct and ranked; the window keeps k of a key before the
    shuffle, so a hot key sends k hashes from each task.
    """
    hashes = sketches.select(*keys, F.explode(column).alias("hash")).distinct()
    best = hashes.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).filter(F.col("nth") <= k)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(column))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch."""
    below = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.nullif(below, F.lit(0.0)))


def _common(a: Column, b: Column, u: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(a, b), u))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(_common(a, b, u) / F.nullif(F.size(u), F.lit(0))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    union = _let(merge(a, b, k), lambda u: distinct_shingles(u, k) * _common(a, b, u) / F.nullif(F.size(u), F.lit(0)))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), union / distinct_shingles(a, k)))


def fingerprint(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _leaves(ids: DataFrame, limit: int) -> list[tuple[int, int | None, int, int | None]]:
    """(shift, cell, rows, largest id) of cells of doc_id >> shift, from the largest id down, nulls last.

    The range of ids is cut into 2**16 cells, and a cell of more than ``limit``
    rows into 2**8 finer ones, over and over, down to a single id. At most
    rows / limit cells are cut at a time, so that few counts reach the driver.
    """
    low, high, nulls = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    found: list[tuple[int, int | None, int, int | None]] = []
    if low is not None:
        shift = 48 if (low < 0) != (high < 0) else max(0, (low ^ high).bit_length() - 16)
        rows = ids.filter("doc_id IS NOT NULL")
        while True:
            cell = F.shiftright("doc_id", shift).alias("cell")
            cells = rows.groupBy(cell).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).collect()
            full = [(r["cell"],) for r in cells if r["n"] > limit and shift]
            found += [(shift, r["cell"], r["n"], r["top"]) for r in cells if r["n"] <= limit or not shift]
            if not full:
                break
            parents = ids.sparkSession.createDataFrame(full, "parent long")
            rows = rows.join(F.broadcast(parents), F.shiftright("doc_id", shift) == F.col("parent"), "left_semi")
            shift = max(0, shift - 8)
    found.sort(key=lambda x: -x[3])
    return [*found, (0, None, nulls, None)] if nulls else found


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, and bucket: every bucket is a run of descending doc_ids.

    A bucket also gets one row with ``after`` set, which has the text of the first
    row behind it (behind the last bucket: of the first one). Neighbouring cells
    of ids make up a bucket; one id with the rows of many buckets has as many,
    over which its rows are dealt by text and input partition, so that equal rows
    spread too. Cells, buckets and their largest ids are numbers by the 65,536ths
    of the rows, whatever their sum.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    limit = max(ROWS_PER_BUCKET, -(-docs.count() // CELLS))
    where: dict[int, list[tuple[int | None, int, int]]] = {}
    tops, filled = [], limit
    for shift, cell, n, top in _leaves(docs.select("doc_id"), limit):
        pieces = -(-n // limit)
        if pieces > 1 or filled + n > limit or cell is None:
            first = len(tops)
            tops += [top] * pieces
            filled = 0
        else:
            first = len(tops) - 1
        filled = limit if pieces > 1 else filled + n
        where.setdefault(shift, []).append((cell, first, pieces))
    rows = docs.withColumn("bucket", F.lit(None).cast("int")).withColumn("pieces", F.lit(None).cast("int"))
    for shift, cells in where.items():
        own = F.broadcast(spark.createDataFrame(cells, "cell long, own_bucket int, own_pieces int"))
        rows = rows.join(own, F.shiftright("doc_id", shift).eqNullSafe(F.col("cell")), "left")
        rows = rows.select("doc_id", "text", F.coalesce("bucket", "own_bucket").alias("bucket"), F.coalesce("pieces", "own_pieces").alias("pieces"))
    dealt = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("text", F.spark_partition_id()), F.col("pieces")).cast("int")).otherwise(0)
    rows = rows.select((F.col("bucket") + dealt).alias("bucket"), "doc_id", "text")
    heads = F.broadcast(spark.createDataFrame(list(enumerate(tops)), "top_bucket int, top long"))
    firsts = rows.join(heads, (F.col("bucket") == F.col("top_bucket")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("text"))
    # a bucket that got no row hands on what it is handed: the next bucket that has one comes after
    following = F.coalesce(F.lag("bucket").over(Window.partitionBy(F.lit(0)).orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    after = firsts.select("bucket", "text")
    before = firsts.select("bucket").withColumn("goes_to", following)  # one number a bucket
    after = after.join(F.broadcast(before), "bucket").select(F.col("goes_to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("after"))
    return rows.withColumn("after", F.lit(False)).unionByName(after)


def edited_likeness(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edited form, and how alike they are.

    The edited form has the last third of the characters replaced by the first as
    many of the next document, in descending order of doc_id (equal ids: by text,
    or, if they are so many that tasks share them, by a deal of the texts; null
    ids last; after the last: the first). A null text is an empty one; two
    empty sketches are alike (1). One document alone is its own next. Other
    columns are dropped.
    """
    order = Window.partitionBy("bucket").orderBy("after", F.desc_nulls_last("doc_id"), "text")
    own = _in_order(docs).withColumn("sketch", sketch(F.col("text"), k, n))
    own = own.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("after"))
    n_chars = F.length("text")
    moved = F.floor(n_chars / 3).cast("int")
    own = own.withColumn("n_chars", n_chars.cast("long")).withColumn("edited", F.concat(F.left("text", n_chars - moved), F.left("next_text", moved)))
    own = own.withColumn("edited_sketch", sketch(F.col("edited"), k, n))
    return own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_within"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
    )


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents and of their edited texts."""
    found = edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "shingles", "edited_within")
