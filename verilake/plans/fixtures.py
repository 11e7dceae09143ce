"""Projections of the driver's tables onto the schemas of this library, in Spark and in SQL.

Each adapter covers every branch of the operators that read it, over all rows
of its table.
"""

from __future__ import annotations

import contextlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.functions.text import NULL_MD5
from verilake.sources.files import local_path
from verilake.sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.expr("CASE WHEN doc_id % 6 = 1 THEN doc_id - 1 ELSE doc_id END")
    ext = F.expr("CASE WHEN doc_id % 6 = 1 THEN 'tmp' WHEN doc_id % 10 = 0 THEN 'FLAC' WHEN doc_id % 10 = 4 THEN 'mp3' ELSE 'flac' END")
    rows = table(spark, sf_dir, "documents").select("doc_id", stem.cast("string").alias("stem"), F.concat(F.lit("/lib/r"), stem % 5).alias("dir"), ext.alias("ext"), F.col("n_chars").alias("size"))
    return rows.withColumn("name", F.concat_ws(".", "stem", "ext")).withColumn("path", F.concat_ws("/", "dir", "name"))


FILES = """files_v AS (
  SELECT doc_id, stem, dir, ext, size, stem || '.' || ext AS name, dir || '/' || stem || '.' || ext AS path FROM (
    SELECT doc_id, CAST(s AS VARCHAR) AS stem, '/lib/r' || (s % 5) AS dir, n_chars AS size,
           CASE WHEN doc_id % 6 = 1 THEN 'tmp' WHEN doc_id % 10 = 0 THEN 'FLAC' WHEN doc_id % 10 = 4 THEN 'mp3' ELSE 'flac' END AS ext
    FROM (SELECT *, CASE WHEN doc_id % 6 = 1 THEN doc_id - 1 ELSE doc_id END AS s FROM documents)))"""


def nested_root(catalog: DataFrame) -> DataFrame:
    """A second root inside the first: the folders r3 and r4, listed again."""
    return catalog.filter(F.col("dir").isin("/lib/r3", "/lib/r4"))


ROOTS = FILES + """, roots_v AS (SELECT *, 0 AS root_ordinal FROM files_v UNION ALL SELECT *, 1 FROM files_v WHERE dir IN ('/lib/r3', '/lib/r4'))"""


def hashes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embedded, before, after) as three tables on doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.md5(F.concat("text", F.lit(" ")).cast("binary")).alias("other"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    emb = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("h")).otherwise(NULL_MD5).alias("emb"))
    pre = docs.select("doc_id", F.expr("CASE WHEN doc_id % 7 <> 0 THEN h END").alias("pre"))
    out = docs.select("doc_id", F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN other ELSE h END").alias("out"))
    return emb, pre, out


HASHES = f"""hashes_v AS (
  SELECT d.doc_id, CASE WHEN l.quality = 1 THEN md5(d.text) WHEN l.doc_id IS NOT NULL THEN '{NULL_MD5}' END AS emb,
         CASE WHEN d.doc_id % 7 <> 0 THEN md5(d.text) END AS pre,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN md5(d.text || ' ') ELSE md5(d.text) END AS out
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), verdicts_v AS (
  SELECT *, CASE WHEN pre IS NOT NULL AND out IS NOT NULL AND pre = out AND (emb IS NULL OR emb = '{NULL_MD5}') THEN 'MATCH|NEW'
                 WHEN pre IS NOT NULL AND out IS NOT NULL AND pre = out THEN 'MATCH'
                 WHEN pre IS NULL AND out IS NOT NULL AND emb IS NOT NULL AND emb <> '{NULL_MD5}' AND emb = out THEN 'MATCH|EMB'
                 WHEN pre IS NULL AND out IS NOT NULL THEN 'FAIL|NO_SRC'
                 WHEN pre IS NOT NULL AND out IS NOT NULL THEN 'FAIL|MISMATCH src=' || left(pre, 8) || ' out=' || left(out, 8)
                 ELSE 'FAIL|NO_HASH' END AS verdict FROM hashes_v)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k).withColumn("before", F.round(F.col("value") * 100).cast("long"))
    status = F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'OK' WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'signup' THEN 'SKIPPED' ELSE 'FAIL' END")
    rows = e.select(
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("run_id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 4).cast("string")).alias("file"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), "before", F.expr("before * k div 400").alias("saved"), (F.col("k") % 3).alias("blocks"), "k",
    )
    rows = rows.withColumn("after", F.col("before") - F.col("saved")).withColumn("art", F.expr("CASE WHEN blocks > 0 OR k % 5 = 0 THEN saved div 4 ELSE CAST(0 AS BIGINT) END"))
    return rows.withColumn("pct", F.when(F.col("before") > 0, F.col("saved") * 100.0 / F.nullif(F.col("before"), F.lit(0))).otherwise(0.0))


ATTEMPTS = """attempts_v AS (
  SELECT *, before - saved AS after, CASE WHEN blocks > 0 OR k % 5 = 0 THEN saved // 4 ELSE 0 END AS art, CASE WHEN before > 0 THEN saved * 100.0::DOUBLE / before ELSE 0.0::DOUBLE END AS pct FROM (
    SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS run_id, user_id || '-' || (k % 4) AS file, event_id AS seq, ts,
           CASE WHEN event_type IN ('click', 'view') THEN 'OK' WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'signup' THEN 'SKIPPED' ELSE 'FAIL' END AS status,
           before, before * k // 400 AS saved, k % 3 AS blocks, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS before FROM events)))"""

SETTLED = ATTEMPTS + """, settled_v AS (
  SELECT run_id, file, max(seq) AS seq, count(*) AS attempts, arg_max(status, seq) AS status, arg_max(before, seq) AS before, arg_max(after, seq) AS after,
         arg_max(saved, seq) AS saved, arg_max(art, seq) AS art, arg_max(blocks, seq) AS blocks FROM attempts_v GROUP BY run_id, file)"""

COUNTERS = """, counters_v AS (
  SELECT run_id, count(*) FILTER (WHERE status <> 'RETRY') AS processed, count(*) FILTER (WHERE status IN ('OK', 'WARN')) AS successful, count(*) FILTER (WHERE status = 'OK') AS ok,
         count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped, count(*) FILTER (WHERE status = 'RETRY') AS retried,
         CAST(coalesce(sum(before) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS original_bytes, CAST(coalesce(sum(after) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS new_bytes,
         CAST(coalesce(sum(saved) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS saved_bytes, CAST(coalesce(sum(art) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS artwork_saved,
         count(*) FILTER (WHERE status IN ('OK', 'WARN') AND blocks > 0) AS artwork_files, CAST(coalesce(sum(blocks) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS artwork_blocks
  FROM {source} GROUP BY run_id)"""


def counters_sql(source: str) -> str:
    return COUNTERS.replace("{source}", source)


def runs(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """The runs behind the attempts, which may be made already; the newest was canceled with a tenth of its files to come."""
    found = (attempts(spark, sf_dir) if made is None else made).groupBy("run_id").agg(F.countDistinct("file").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("finished"))
    newest = found.agg(F.max("run_id").alias("newest"))
    canceled = F.col("run_id") == F.col("newest")
    return found.join(F.broadcast(newest)).select(  # one row
        "run_id", (F.col("n") + F.when(canceled, F.expr("n div 10 + 1")).otherwise(F.lit(0))).alias("total_files"), canceled.alias("run_canceled"),
        F.unix_millis("started").alias("start_ms"), F.unix_millis("finished").alias("finish_ms"),
    )


RUNS = """, runs_v AS (
  SELECT run_id, n + CASE WHEN run_id = newest THEN n // 10 + 1 ELSE 0 END AS total_files, run_id = newest AS run_canceled, epoch_us(started) // 1000 AS start_ms, epoch_us(finished) // 1000 AS finish_ms
  FROM (SELECT run_id, count(DISTINCT file) AS n, min(ts) AS started, max(ts) AS finished FROM attempts_v GROUP BY run_id), (SELECT max(run_id) AS newest FROM attempts_v))"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker events: the file is on starts alone, hashes come with stage changes."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    kind = F.expr("CASE event_type WHEN 'click' THEN 'workerStarted' WHEN 'view' THEN 'workerProgress' WHEN 'signup' THEN 'workerStageChanged' WHEN 'purchase' THEN 'fileCompleted' ELSE 'workerIdle' END")
    stage = F.expr("CASE WHEN event_type = 'signup' THEN CASE k % 5 WHEN 0 THEN 'converting' WHEN 1 THEN 'hashing-source' WHEN 2 THEN 'hashing-output' WHEN 3 THEN 'artwork' ELSE 'finalizing' END END")
    return e.select(
        (F.col("user_id") % 8).alias("worker"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
        F.expr("CASE WHEN event_type = 'click' THEN concat('f', cast(event_id AS string)) END").alias("file"), F.expr("CASE WHEN event_type = 'view' THEN k END").alias("percent"), stage.alias("stage"),
        F.expr("CASE WHEN event_type = 'signup' AND k % 5 = 1 THEN 'source' WHEN event_type = 'signup' AND k % 5 = 2 THEN 'output' END").alias("phase"),
        F.expr("CASE WHEN event_type = 'signup' AND k % 5 IN (1, 2) THEN md5(cast(event_id AS string)) END").alias("hash"),
    )


PIPELINE = """pipeline_v AS (
  SELECT user_id % 8 AS worker, event_id AS seq, ts, k,
         CASE event_type WHEN 'click' THEN 'workerStarted' WHEN 'view' THEN 'workerProgress' WHEN 'signup' THEN 'workerStageChanged' WHEN 'purchase' THEN 'fileCompleted' ELSE 'workerIdle' END AS type,
         CASE WHEN event_type = 'click' THEN 'f' || event_id END AS file, CASE WHEN event_type = 'view' THEN k END AS percent,
         CASE WHEN event_type = 'signup' THEN CASE k % 5 WHEN 0 THEN 'converting' WHEN 1 THEN 'hashing-source' WHEN 2 THEN 'hashing-output' WHEN 3 THEN 'artwork' ELSE 'finalizing' END END AS stage,
         CASE WHEN event_type = 'signup' AND k % 5 = 1 THEN 'source' WHEN event_type = 'signup' AND k % 5 = 2 THEN 'output' END AS phase,
         CASE WHEN event_type = 'signup' AND k % 5 IN (1, 2) THEN md5(CAST(event_id AS VARCHAR)) END AS hash
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)), states_v AS (
  SELECT worker, arg_max(CASE WHEN type IN ('workerIdle', 'fileCompleted') THEN 'idle' WHEN type = 'workerStageChanged' THEN coalesce(stage, 'converting') ELSE 'converting' END, seq) AS state,
         arg_max(coalesce(percent, 0), seq) AS percent FROM pipeline_v GROUP BY worker)"""


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.year("l_shipdate").alias("run"), F.col("l_suppkey").alias("supplier"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("before"),
        F.round(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount"))).cast("long").alias("after"),
    )


SAVINGS = """savings_v AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS run, l_suppkey AS supplier, CAST(round(l_extendedprice * 100) AS BIGINT) AS before, CAST(round(l_extendedprice * 100 * (1 - l_discount)) AS BIGINT) AS after FROM lineitem)"""


def _hex(n, digits: int):
    """A number as hexadecimal digits, most significant first."""
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def _small(n):
    """A number below 256 as four bytes, least significant first, in hexadecimal digits."""
    return F.concat(_hex(n, 2), F.lit("000000"))


def _block(kind: int, last: bool, data):
    return F.concat(F.lit(f"{kind + 128 * last:02X}"), _hex(F.length(data) / 2, 6), data)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, content: a small container made of each document's columns.

    Some have bytes before the marker or no marker; checksums, pictures of several
    kinds, comments and padding vary with the id.
    """
    d = F.col("doc_id")
    md5 = F.when(d % 7 == 0, "0" * 32).otherwise(F.upper(F.md5(F.col("text").cast("binary"))))
    packed = (F.lit(44100) + d % 3) * F.lit(1 << 44) + (d % 8) * F.lit(1 << 41) + (d % 2 * 8 + 15) * F.lit(1 << 36) + F.coalesce(F.col("n_chars"), F.lit(0))
    info = F.concat(F.lit("00" * 10), _hex(packed, 16), md5)
    text = lambda c: F.hex(F.encode(c, "UTF-8"))
    counted = lambda c, size: F.concat(size(F.octet_length(F.encode(c, "UTF-8"))), text(c))
    mime = F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "-->", "image/gif"))), (d % 4 + 1).cast("int"))
    description = F.concat(F.lit("cover"), F.when(d % 6 == 1, "\n").otherwise(" "), (d % 10).cast("string"))
    jpeg = F.concat(F.lit("FFD8FFE00004AAAA"), F.lit("FFE1"), _hex(d % 50 + 2, 4), F.repeat(F.lit("00"), (d % 50).cast("int")), F.lit("FFFE0005414243FFDA0002"))
    image = F.when(d % 4 == 0, F.concat(F.lit("89504E470D0A1A0A"), text((d % 10).cast("string")))).when(d % 4 == 1, jpeg).otherwise(text(F.lit("http://x")))
    wide = lambda n: _hex(n, 8)
    picture = F.concat(F.lit("00000003"), counted(mime, wide), counted(description, wide), _hex(d % 500, 8), _hex(d % 300, 8), F.lit("0000001800000000"), _hex(F.length(image) / 2, 8), image)
    items = F.concat(
        F.array(F.concat(F.lit("SOURCE="), F.coalesce("source", F.lit("")))), F.when(d % 2 == 0, F.array(F.lit("Job_Done=1"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.sequence(F.lit(0), (d % 3).cast("int")), lambda i: F.concat(F.lit("note="), i.cast("string"))),
    )
    written = F.transform(items, lambda x: F.concat(_small(F.octet_length(x)), F.hex(F.encode(x, "UTF-8"))))
    comment = F.concat(_small(F.lit(3)), F.lit("6C6962"), _small(F.size(items)), F.array_join(written, ""))
    padding = F.repeat(F.lit("00"), (d % 64).cast("int"))
    content = F.concat(
        F.when(d % 5 == 0, F.lit("49443300000000000000")).otherwise(""), F.when(d % 13 == 0, "").otherwise("664C6143"),
        _block(0, False, info), F.when(d % 3 != 0, _block(6, False, picture)).otherwise(""), _block(4, False, comment), _block(1, True, padding),
    )
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("/lib/r"), d % 5, F.lit("/"), d, F.lit(".flac")).alias("path"), F.unhex(content).alias("content"))
    return rows.select("path", F.octet_length("content").cast("long").alias("size"), "content")


CONTAINERS = """containers_v AS (
  SELECT *, ['image/png', 'image/jpeg', '-->', 'image/gif'][doc_id % 4 + 1] AS mime, 'cover' || CASE WHEN doc_id % 6 = 1 THEN chr(10) ELSE ' ' END || (doc_id % 10) AS description,
         CASE doc_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 23 + doc_id % 50 ELSE 8 END AS image_length,
         list_concat(['SOURCE=' || coalesce(source, '')], CASE WHEN doc_id % 2 = 0 THEN ['Job_Done=1'] ELSE [] END, list_transform(range(0, doc_id % 3 + 1), lambda i: 'note=' || i)) AS items
  FROM (SELECT doc_id, '/lib/r' || (doc_id % 5) || '/' || doc_id || '.flac' AS path, '/lib/r' || (doc_id % 5) AS folder, n_chars, text, source FROM documents) WHERE doc_id % 13 <> 0)"""


def write_files(rows: DataFrame, root: str) -> None:
    """Files of path and content below a folder that is mounted, which tasks write."""
    at = local_path(root)
    if at is None:
        raise ValueError("files are made in a shared folder that is mounted, not in a store")

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = at + path
                os.makedirs(os.path.dirname(own), exist_ok=True)
                with open(f"{own}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{own}.{os.getpid()}", own)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def written_containers(spark: SparkSession, sf_dir: str) -> str:
    """The containers as files of a folder, which tasks write; its path.

    Some files have a link in a folder ``links``, and some a broken link beside
    them; each folder has a link back to the whole.
    """
    root = local_path(scratch_path(spark, "library"))
    if root is None:
        raise ValueError("links are made in a shared folder that is mounted, not in a store")

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, k = root + path, int(path.rsplit("/", 1)[1].split(".")[0])
                os.makedirs(os.path.dirname(own), exist_ok=True)
                os.makedirs(f"{root}/links", exist_ok=True)
                with open(f"{own}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{own}.{os.getpid()}", own)
                links = [(root, f"{os.path.dirname(own)}/back"), *[(own, f"{root}/links/{k}.flac")] * (k % 9 == 0), *[("gone", f"{os.path.dirname(own)}/gone-{k}.flac")] * (k % 50 == 7)]
                for to, link in links:
                    with contextlib.suppress(FileExistsError):  # another task's, or this one's before it was run again
                        os.symlink(to, link)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    containers(spark, sf_dir).select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


def log_lines(spark: SparkSession, sf_dir: str, written) -> DataFrame:
    """file, line_no, line: a log of each user's events; ``written`` gives a line of an attempt."""
    rows = attempts(spark, sf_dir)
    return rows.select(F.concat(F.lit("log-"), F.substring_index("file", "-", 1)).alias("file"), F.col("seq").cast("int").alias("line_no"), written.alias("line"))
