"""Hashes before and after a rewrite, digests of ordered pieces, duplicate contents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.functions import classes
from verilake.operators.catalog import dealt, with_running, with_total
from verilake.sources.scratch import cut


def align(emb: DataFrame, pre: DataFrame, out: DataFrame, key: str) -> DataFrame:
    """The three hashes of each file in one row; any of them may be missing."""
    return emb.join(pre, key, "full").join(out, key, "full")


def with_verdict(hashes: DataFrame) -> DataFrame:
    v = hashes.withColumn("verdict", classes.verdict(F.col("pre"), F.col("out"), F.col("emb")))
    return v.withColumn("passed", classes.passed(F.col("verdict")))


def with_agreement(hashes: DataFrame) -> DataFrame:
    emb, pre, out = classes.hash_agreement(F.col("pre"), F.col("out"), F.col("emb"))
    return hashes.select("*", emb.alias("emb_class"), pre.alias("pre_class"), out.alias("out_class"), classes.embedded_stale(F.col("pre"), F.col("out"), F.col("emb")).alias("embedded_stale"))


def stream_digest(pieces: DataFrame, key: str, pos: str, payload: str) -> DataFrame:
    """key, digest, n_pieces: MD5 over the pieces of each key in order of pos, then of payload; nulls add nothing.

    The pieces of a key lie sorted in one partition, and the state of the digest is
    all that is held of them, so that a key may have any number. An MD5 cannot be
    put together from parts: ``tree_digest`` is for keys that are to be many tasks' work.
    """
    own = pieces.select(key, F.col(pos).alias("_pos"), F.col(payload).cast("binary").alias("_payload"))

    def run(batches):
        held, digest, n = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], [key, "digest", "n_pieces"])

        for batch in batches:
            keys, kind = batch.column(0), batch.column(0).type
            for k, piece in zip(keys.to_pylist(), batch.column(1), strict=True):
                if held != (k,):
                    if held is not None:
                        yield done()
                    held, digest, n = (k,), hashlib.md5(usedforsecurity=False), 0
                if piece.is_valid:
                    digest.update(piece.as_buffer())
                n += 1
        if held is not None:
            yield done()

    sorted_pieces = own.repartition(key).sortWithinPartitions(key, "_pos", "_payload").select(key, "_payload")
    return sorted_pieces.mapInArrow(run, f"{key} {pieces.schema[key].dataType.simpleString()}, digest string, n_pieces long")


def tree_digest(pieces: DataFrame, key: str, pos: str, payload: str, fan_out: int = 1024) -> DataFrame:
    """key, digest, n_pieces: the root of a tree of SHA-256 over the pieces of each key in order of pos, then of their digests.

    The digest of a piece is of its payload (of nothing for a null). While a key has
    several nodes, each ``fan_out`` of them in order make one: the digest of their
    hex texts. So the parts of a key are hashed by many tasks and put together level
    by level, and no task holds more than one run of digests. A null key is a key.
    """
    own = pieces.select(key, F.col(pos).alias("_pos"), F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256).alias("_digest"))
    placed = with_total(with_running(dealt(own, key, ["_pos", "_digest"]), key, _nth=F.lit(1)), key, "n_pieces")
    nodes = placed.select(key, (F.col("_nth") - 1).alias("_idx"), F.col("n_pieces").alias("_n"), "n_pieces", "_digest")
    found = nodes.filter("_n = 1")
    nodes = nodes.filter("_n > 1")
    while not nodes.isEmpty():
        run = F.call_function("div", F.col("_idx"), F.lit(fan_out)).alias("_run")
        together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_idx", "_digest"))), lambda x: x["_digest"]), "")
        level = nodes.groupBy(key, run).agg(F.ceil(F.first("_n") / fan_out).alias("_n"), F.first("n_pieces").alias("n_pieces"), F.sha2(together.cast("binary"), 256).alias("_digest"))
        level = cut(level.withColumnRenamed("_run", "_idx"))
        found = found.unionByName(level.filter("_n = 1"))
        nodes = level.filter("_n > 1")
    return found.select(key, F.col("_digest").alias("digest"), "n_pieces")


def content_duplicates(files: DataFrame, content: str, key: str, size: str) -> DataFrame:
    """Contents that occur more than once: how often, which one to keep, what the others take.

    The content is hashed before the shuffle, so that only digests travel.
    """
    hashed = files.select(F.md5(F.col(content)).alias("digest"), key, size)
    return (
        hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("keep"), (F.sum(size) - F.min(size)).alias("reclaimable"))
        .filter(F.col("n") > 1)
    )
