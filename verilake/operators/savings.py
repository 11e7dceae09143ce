"""Where the saved bytes come from, and the best files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.operators.outcomes import SUCCESS


def breakdown(settled: DataFrame) -> DataFrame:
    """Of each run: bytes saved in all, on audio, on metadata, and of that on pictures and on padding.

    What a file saved on metadata counts as picture saving if a picture block of
    it was rewritten, else as padding. Audio is what is left, 0 if nothing was
    saved in all.
    """
    done = settled.filter(F.col("status").isin(*SUCCESS))
    sums = done.groupBy("run_id").agg(
        F.sum("before").alias("before"), F.sum("saved").alias("total_saved"),
        F.coalesce(F.sum(F.when(F.col("blocks") > 0, F.col("art"))), F.lit(0)).alias("artwork_saved"),
        F.coalesce(F.sum(F.when(F.col("blocks") == 0, F.col("art"))), F.lit(0)).alias("padding_saved"),
    )
    metadata = F.col("artwork_saved") + F.col("padding_saved")
    return sums.withColumn("metadata_saved", metadata).withColumn("audio_saved", F.when(F.col("total_saved") > 0, F.col("total_saved") - metadata).otherwise(F.lit(0)))


def _pct(part, whole):
    return F.when(whole > 0, F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 4)).otherwise(0.0)


def kpis(settled: DataFrame) -> DataFrame:
    """Of each run: reduction of the files that succeeded and of all files scanned, success rate, mean saving."""
    ok = F.col("status").isin(*SUCCESS)
    sums = settled.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.coalesce(F.sum("before"), F.lit(0)).alias("scanned"),
        F.coalesce(F.sum(F.when(ok, F.col("before"))), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(ok, F.col("saved"))), F.lit(0)).alias("saved"),
        F.coalesce(F.sum(F.when(ok, F.col("saved") - F.col("art"))), F.lit(0)).alias("audio"),
    )
    c = F.col
    return sums.select(
        "run_id", _pct(c("saved"), c("before")).alias("reduction_pct_of_success"), _pct(c("saved"), c("scanned")).alias("reduction_pct_of_scan"),
        _pct(c("n_ok"), c("n")).alias("success_rate_pct"), F.when(c("n_ok") > 0, F.call_function("div", c("saved"), F.nullif(c("n_ok"), F.lit(0)))).otherwise(F.lit(0)).alias("avg_saved"),
        _pct(c("audio"), c("before")).alias("audio_reduction_pct"),
    )


def _saved(events: DataFrame) -> DataFrame:
    return events.filter(F.col("status").isin(*SUCCESS) & (F.col("saved") > 0))


def top(events: DataFrame, k: int) -> DataFrame:
    """The k events that saved most, earlier ones first among equals."""
    best = _saved(events).orderBy(F.desc("saved"), "seq").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("saved"), "seq")))


def top_by_run(events: DataFrame, k: int) -> DataFrame:
    return _saved(events).withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("saved"), "seq"))).filter(F.col("rank") <= k)


def artwork_rollup(blocks: DataFrame) -> DataFrame:
    """Picture blocks to files: blocks that shrank, their raw saving, the file's net saving, whether it counts."""
    shrank = (F.col("raw_saved") > 0) & ~F.col("is_url")
    out = blocks.groupBy("file").agg(F.count_if(shrank).alias("blocks_optimized"), F.coalesce(F.sum(F.when(shrank, F.col("raw_saved"))), F.lit(0)).alias("raw_saved"), F.sum("net_saved").alias("net_saved"))
    return out.withColumn("changed", (F.col("blocks_optimized") > 0) & (F.col("net_saved") > 0))
