"""What is inside audio containers: metadata blocks, checksums, pictures, padding, comments.

A container is a marker ``fLaC`` (perhaps behind other bytes), then blocks of a
one-byte header (top bit: last block; rest: type), a three-byte length, and the
content. Files are read by ranges: a task opens each of its paths, reads the four
bytes of a header, takes the content of the blocks that are asked for, and seeks
past all others and past the audio. Nothing depends on the size of a file, and what
is read is as much as its headers, comments and pictures hold. The same walk takes
contents that are in a column already.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from verilake.functions.classes import has_marker, image_type
from verilake.functions.text import NULL_MD5
from verilake.sources import listing
from verilake.sources.files import Memory, Ranges, Stores

STREAMINFO, PADDING, COMMENT, PICTURE = 0, 1, 4, 6
#: The blocks whose content the operators below ask for.
CONTENTS = (STREAMINFO, COMMENT, PICTURE)
MARKER = b"fLaC"
#: Bytes that are searched for a marker at once, and bytes of contents that a task gives out at once.
SEARCH = 1 << 20
_GIVE = 1 << 25


def read(spark: SparkSession, roots: list[str], extension: str = "flac") -> DataFrame:
    """path, size of the files under the roots, of any size; ``inventory`` opens them. Links and repeats count once."""
    files, _ = listing.scan_with_errors(spark, roots, extension)
    return files.select("path", "size")


def big_endian(content: Column, at: Column, n: int) -> Column:
    """The unsigned number of n bytes at a position (from 1); null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(content, at, F.lit(n))), F.lit("")), 16, 10).cast("long")


# -- the walk ---------------------------------------------------------------------


def find_marker(source: Ranges | Memory) -> int:
    """Where the marker is, from 0; -1 without one.

    It is sought at the start, then behind a tag that states its size (``ID3``),
    and then from the start on, piece by piece.
    """
    head = source.read(0, 10)
    if head[:4] == MARKER:
        return 0
    if head[:3] == b"ID3" and len(head) == 10 and not any(b & 0x80 for b in head[6:]):
        size = 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + 10 * bool(head[5] & 0x10)
        if source.read(size, 4) == MARKER:
            return size
    at = 0
    while at < source.size:
        found = source.read(at, SEARCH + len(MARKER) - 1).find(MARKER)
        if found >= 0:
            return at + found
        at += SEARCH
    return -1


def walk_blocks(source: Ranges | Memory, marker: int) -> Iterator[tuple[int, int, int, bool]]:
    """(type, offset of the content from 0, length, is_last) of the blocks behind the marker, up to the last one or the end of the file.

    What cannot be a header ends the walk too: type 127, or stream facts that are
    not the first block, as in a file that is full of zeros.
    """
    at, last, first = marker + len(MARKER), marker < 0, True
    while not last:
        head = source.read(at, 4)
        if len(head) < 4 or head[0] % 128 == 127 or (head[0] % 128 == STREAMINFO and not first):
            return
        last, first, length = head[0] >= 128, False, int.from_bytes(head[1:], "big")
        yield head[0] % 128, at + 4, length, last
        at += 4 + length


_WALKED = {"path": pa.string(), "size": pa.int64(), "prefix": pa.int64(), "block_number": pa.int32(), "type": pa.int32(), "offset": pa.int64(), "length": pa.int64(), "is_last": pa.bool_(), "truncated": pa.bool_(), "data": pa.binary(), "error": pa.string()}
_WALKED_DDL = "path string, size long, prefix long, block_number int, type int, offset long, length long, is_last boolean, truncated boolean, data binary, error string"


def _rows(path: str, source: Ranges | Memory, contents: tuple[int, ...]) -> Iterator[tuple]:
    marker = find_marker(source)
    found = list(walk_blocks(source, marker))
    if not found:  # nothing but where the marker is, if there is one
        yield (path, source.size, marker, *[None] * 8)
        return
    truncated = not found[-1][3]
    for n, (kind, at, length, last) in enumerate(found):
        yield path, source.size, marker, n, kind, at + 1, length, last, truncated, source.read(at, length) if kind in contents else None, None


def _walked(contents: tuple[int, ...], in_memory: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, rows, held = Stores(), [], 0
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    if in_memory:
                        content = batch.column(1)[k]
                        source = Memory(content.as_buffer() if content.is_valid else b"")
                    else:
                        source = Ranges(lambda p=path: stores.open(p))
                    try:
                        for row in _rows(path, source, contents):
                            rows.append(row)
                            held += 200 + len(row[9] or b"")
                            if held >= _GIVE:
                                yield _batch(rows)
                                rows, held = [], 0
                    finally:
                        source.close()
                except OSError as e:  # the file went, or cannot be read: a row that says so
                    rows.append((path, *[None] * 9, type(e).__name__))
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_WALKED)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _WALKED.values(), strict=True)], list(_WALKED))


def walked(files: DataFrame, contents: tuple[int, ...] = CONTENTS) -> DataFrame:
    """A row for each block of each file, and one of nulls for a file without blocks or that cannot be read (error).

    ``files`` has path, and content if the bytes are there already; otherwise the
    paths are dealt to tasks, which open them.
    """
    if "content" in files.columns:
        return files.select("path", "content").mapInArrow(_walked(contents, True), _WALKED_DDL)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # paths are small, what they lead to is not
    return files.select("path").repartition(parts).mapInArrow(_walked(contents, False), _WALKED_DDL)


def inventory(files: DataFrame, contents: tuple[int, ...] = CONTENTS) -> DataFrame:
    """path, size, block_number, type, offset (of the content, from 1), length, is_last, truncated (no last block), and data, the content of the types asked for."""
    return walked(files, contents).filter("block_number IS NOT NULL").drop("prefix", "error")


def unreadable(files: DataFrame) -> DataFrame:
    """path, error of files that cannot be opened or read."""
    return walked(files, ()).filter("error IS NOT NULL").select("path", "error")


def foreign_prefix(files: DataFrame) -> DataFrame:
    """Bytes before the marker, of files that have some."""
    return walked(files, ()).filter("prefix > 0 AND coalesce(block_number, 0) = 0").select("path", F.col("prefix").alias("prefix_bytes"))


def stream_facts(blocks: DataFrame) -> DataFrame:
    """path, sample_rate, channels, bits, samples, raw_bytes, embedded_md5 (null if unset) of each file."""
    at = lambda i, n: big_endian(F.col("data"), F.lit(i), n)
    packed = at(11, 8)  # 20 bits rate, 3 channels - 1, 5 bits - 1, 36 samples
    hi, lo = at(11, 4), at(15, 4)
    channels, bits = F.expr("0") + (F.shiftright(hi, 9) % 8) + 1, (F.shiftright(hi, 4) % 32) + 1
    samples = (hi % 16) * F.lit(1 << 32) + lo
    md5 = F.lower(F.hex(F.substring("data", 19, 16)))
    rows = blocks.filter((F.col("type") == STREAMINFO) & (F.col("length") >= 34) & packed.isNotNull())
    return rows.select("path", F.shiftright(hi, 12).alias("sample_rate"), channels.alias("channels"), bits.alias("bits"), samples.alias("samples"), F.expr("1").cast("int").alias("_one"), md5.alias("_md5")).select(
        "path", "sample_rate", "channels", "bits", "samples", (F.col("samples") * F.col("channels") * F.col("bits") / 8).cast("long").alias("raw_bytes"), F.nullif(F.col("_md5"), F.lit(NULL_MD5)).alias("embedded_md5")
    )


def missing_md5(facts: DataFrame) -> DataFrame:
    """Files without an embedded checksum, by folder."""
    folder = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    return facts.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.count_if(F.col("embedded_md5").isNull()).alias("n_missing"))


def pictures(blocks: DataFrame) -> DataFrame:
    """Picture blocks: type, MIME type, description, dimensions, bytes, image type, digest, and what to beware of."""
    d = F.col("data")
    be = lambda at: big_endian(d, at.cast("int"), 4)
    rows = blocks.filter(F.col("type") == PICTURE).select("path", "block_number", "data", be(F.lit(1)).alias("picture_type"), be(F.lit(5)).alias("m"))
    rows = rows.withColumn("n", be(F.col("m") + 9)).withColumn("at", F.col("m") + F.col("n") + 13)
    text = lambda start, n: F.decode(F.expr(f"substring(data, int({start}), int({n}))"), "UTF-8")
    mime, description = text("9", "m"), text("m + 13", "n")
    image = F.expr("substring(data, int(at + 20), int(m) * 0 + 2147483647)")
    return rows.select(
        "path", "block_number", F.col("picture_type").cast("int").alias("picture_type"), mime.alias("mime"), description.alias("description"), be(F.col("at")).cast("int").alias("width"), be(F.col("at") + 4).cast("int").alias("height"),
        be(F.col("at") + 8).cast("int").alias("depth"), be(F.col("at") + 12).cast("int").alias("colors"), be(F.col("at") + 16).alias("data_length"), image_type(image, mime).alias("image"), F.sha2(image, 256).alias("digest"),
        (mime == "-->").alias("is_url"), description.rlike(r"[\r\n]").alias("unsafe_to_rewrite"),
    )


def repeated_pictures(found: DataFrame) -> DataFrame:
    return found.groupBy("digest").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.max("data_length").alias("bytes")).filter("n > 1")


def _segments(image: memoryview) -> int | None:
    """The bytes of the segments to strip, of a JPEG whose image data begins somewhere."""
    if bytes(image[:2]) != b"\xff\xd8":
        return None
    at, total, end = 2, 0, len(image)
    while at + 1 < end and image[at] == 0xFF:
        kind = image[at + 1]
        if kind in (0xDA, 0xD9):
            return total
        if kind == 0xFF:
            at += 1
            while at + 1 < end and image[at + 1] == 0xFF:  # fill bytes, of any number
                run = bytes(image[at + 1 : at + 1 + SEARCH])
                at += len(run) - len(run.lstrip(b"\xff"))
        elif 0xD0 <= kind <= 0xD7 or kind == 0x01:
            at += 2
        else:
            length = int.from_bytes(image[at + 2 : at + 4], "big")
            if at + 4 > end or length < 2:
                return None
            total += (length + 2) * (0xE1 <= kind <= 0xEF or kind == 0xFE)
            at += 2 + length
    return None


@F.arrow_udf(LongType())
def _strippable(images: pa.Array) -> pa.Array:
    return pa.array([_segments(memoryview(x.as_buffer()).cast("B")) if x.is_valid else None for x in images], pa.int64())


def strippable_jpeg_bytes(content: Column) -> Column:
    """Bytes of the APP1 to APP15 and comment segments of a JPEG before its image data; null if it is none, or broken."""
    return _strippable(content)


def padding(blocks: DataFrame) -> DataFrame:
    """Reclaimable bytes of each file: its padding blocks with their headers."""
    return blocks.filter(F.col("type") == PADDING).groupBy("path").agg((F.sum("length") + 4 * F.count("*")).alias("padding_bytes"), F.count("*").alias("padding_blocks"))


def _texts(data: memoryview) -> list[str]:
    number = lambda at: int.from_bytes(data[at : at + 4], "little")
    at = 4 + number(0)
    left, found = number(at), []
    at += 4
    while left > 0 and at + 4 <= len(data):
        n = number(at)
        found.append(bytes(data[at + 4 : at + 4 + n]).decode("utf-8", "replace"))
        at, left = at + 4 + n, left - 1
    return found


@F.arrow_udf(ArrayType(StringType()))
def _comments(data: pa.Array) -> pa.Array:
    return pa.array([_texts(memoryview(x.as_buffer())) if x.is_valid else [] for x in data], pa.list_(pa.string()))


def comments(blocks: DataFrame) -> DataFrame:
    """path, comments: the NAME=value texts of each file."""
    return blocks.filter(F.col("type") == COMMENT).select("path", _comments("data").alias("comments"))


def tag_counts(found: DataFrame) -> DataFrame:
    tags = found.select("path", F.explode("comments").alias("c"))
    return tags.groupBy(F.upper(F.substring_index("c", "=", 1)).alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def marker_coverage(found: DataFrame, tag: str) -> DataFrame:
    return found.agg(F.count("*").alias("n_files"), F.count_if(has_marker(F.col("comments"), tag)).alias("n_marked"))
