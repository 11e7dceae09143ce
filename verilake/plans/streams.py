"""Registered queries of the streams and the writers: what each leaves behind, and its SQL.

The tables come in lots (``replay``), each taken by a stream that is started anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verilake.operators import outcomes, savings, verify
from verilake.plans import fixtures as fx
from verilake.plans import registry
from verilake.plans.registry import query
from verilake.sources import logs, publish
from verilake.sources.scratch import cut, scratch_path
from verilake.streaming import live
from verilake.streaming.replay import append_lines, replay, replay_into

# -- streams --------------------------------------------------------------------


@query("SELECT worker, seq, type, file, percent, stage FROM pipeline_v", fx.PIPELINE)
def stream_decoded(spark, sf_dir):
    """Lines of JSON as they come."""
    rows = fx.pipeline(spark, sf_dir)
    lines = rows.select("seq", F.to_json(F.struct(*rows.columns)).alias("value"))
    return replay(lines, "seq", lambda stream: stream.select("worker", "seq", "type", "file", "percent", "stage"), put=append_lines, opened=live.read_events)


@query("SELECT * FROM counters_v", fx.ATTEMPTS + fx.counters_sql("attempts_v"))
def stream_counters(spark, sf_dir):
    return replay(fx.attempts(spark, sf_dir), "seq", live.counters, mode="complete")


@query("SELECT worker, state, percent FROM states_v", fx.PIPELINE)
def stream_workers(spark, sf_dir):
    return replay(fx.pipeline(spark, sf_dir), "seq", live.worker_state, mode="complete")


@query(registry.ORACLES["closed_runs"])
def stream_idle_runs(spark, sf_dir):
    """Spans of a week's run, given out when all its workers are idle and a minute has passed."""
    rows = fx.pipeline(spark, sf_dir).withColumn("run_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return replay(rows, "ts", lambda stream: live.idle_runs(stream, 60_000))


@query(
    """, b AS (SELECT worker, ts, lag(ts) OVER (PARTITION BY worker ORDER BY ts, seq) AS before FROM pipeline_v),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM b),
    g AS (SELECT worker, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS "end", count(*) AS n FROM s GROUP BY worker, span)
    SELECT worker, start, "end", n FROM g WHERE "end" <= (SELECT max(ts) FROM pipeline_v) - INTERVAL 10 MINUTE""",
    fx.PIPELINE,
)
def stream_pauses(spark, sf_dir):
    """Spans of a worker's activity between pauses of 20 minutes, as far as the watermark has passed them."""
    return replay(fx.pipeline(spark, sf_dir), "ts", lambda stream: live.closed_runs(stream, "worker", "20 minutes"))


@query(
    registry._BLOCKS + """ SELECT path, regexp_extract(path, '[^/]*$') AS name,
      CAST(any_value(CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 4 END) + sum(4 + length) AS BIGINT) AS size FROM b JOIN containers_v USING (path) GROUP BY path""",
    fx.CONTAINERS.replace(" WHERE doc_id % 13 <> 0", ""),
)
def stream_catalog(spark, sf_dir):
    """Files that appear in a folder while it is watched."""
    rows = cut(fx.containers(spark, sf_dir))
    own = F.regexp_extract("path", "(/lib/r[^/]*/[^/]*)$", 1)
    opened = lambda spark, path: live.catalog(spark, path, looks=f"{path}/_looks")  # noqa: E731  names that begin so are no files
    return replay(rows, "size", lambda stream: stream.withColumn("path", own), put=fx.write_files, opened=opened)


@query(registry.ORACLES["progress_changes"])
def stream_progress(spark, sf_dir):
    return replay(fx.pipeline(spark, sf_dir), "seq", live.changed_progress)


@query(
    """, p AS (SELECT *, make_timestamp(epoch_us(ts) // 100000 * 100000) AS start FROM pipeline_v WHERE type = 'workerProgress'), g AS (SELECT worker, start, arg_max(percent, seq) AS percent FROM p GROUP BY worker, start)
    SELECT worker, start, percent FROM g WHERE start + INTERVAL 100 MILLISECOND <= (SELECT max(ts) FROM p) - INTERVAL 10 MINUTE""",
    fx.PIPELINE,
)
def stream_coalesced(spark, sf_dir):
    return replay(fx.pipeline(spark, sf_dir), "ts", live.coalesced_progress)


@query(
    """, g AS (SELECT run_id, make_timestamp(epoch_us(ts) // 10000000 * 10000000) AS start, count(*) AS n, count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(coalesce(sum(saved) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS saved FROM attempts_v GROUP BY 1, 2)
    SELECT run_id, start, n, failed, saved, CAST(sum(n) OVER w AS BIGINT) AS total_n, CAST(sum(failed) OVER w AS BIGINT) AS total_failed, CAST(sum(saved) OVER w AS BIGINT) AS total_saved FROM g
    WHERE start + INTERVAL 10 SECOND <= (SELECT max(ts) FROM attempts_v) - INTERVAL 10 MINUTE WINDOW w AS (PARTITION BY run_id ORDER BY start ROWS UNBOUNDED PRECEDING)""",
    fx.ATTEMPTS,
)
def stream_heartbeat(spark, sf_dir):
    """Each beat of a run and what the run has done so far."""
    return replay(fx.attempts(spark, sf_dir), "ts", lambda stream: live.running_totals(live.heartbeat(stream)))


@query(f"{registry._NUMBERED} SELECT run_id, file, seq, CAST(attempt AS INTEGER) AS attempt, CASE WHEN status = 'FAIL' AND attempt < 3 AND k % 5 <> 0 THEN 'RETRY' ELSE status END AS decision FROM n", fx.ATTEMPTS)
def stream_retries(spark, sf_dir):
    """The decision on each try as it comes; one failure in five is fatal."""
    rows = fx.attempts(spark, sf_dir).withColumn("retryable", F.col("k") % 5 != 0)
    return replay(rows, "seq", lambda stream: live.retries(stream, 3))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saved DESC, seq) AS n FROM attempts_v WHERE status IN ('OK', 'WARN') AND saved > 0) SELECT run_id, file, seq, saved FROM r WHERE n <= 3", fx.ATTEMPTS)
def stream_top(spark, sf_dir):
    path = scratch_path(spark, "top")
    replay_into(fx.attempts(spark, sf_dir), "seq", live.keep_top(path))
    return _kept(spark, path, fx.attempts(spark, sf_dir)).select("run_id", "file", "seq", "saved")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS n FROM attempts_v) SELECT run_id, seq, file, status FROM r WHERE n <= 25", fx.ATTEMPTS)
def stream_recent(spark, sf_dir):
    path = scratch_path(spark, "recent")
    replay_into(fx.attempts(spark, sf_dir), "seq", live.keep_recent(path))
    return _kept(spark, path, fx.attempts(spark, sf_dir)).select("run_id", "seq", "file", "status")


def _kept(spark, path, rows):
    found = live.kept(spark, path)
    return spark.createDataFrame([], rows.schema) if found is None else found


# -- writers --------------------------------------------------------------------


@query("SELECT run_id, file, seq, attempts, status, CASE WHEN run_id = (SELECT min(run_id) FROM settled_v) THEN -1 ELSE saved END AS saved FROM settled_v", fx.SETTLED)
def runs_written(spark, sf_dir):
    """Results by run, all written and all but the first run's written again: those replace themselves."""
    rows = outcomes.settle(fx.attempts(spark, sf_dir)).select("run_id", "file", "seq", "attempts", "status", "saved")
    path = scratch_path(spark, "runs")
    publish.write_runs(rows.withColumn("saved", F.lit(-1).cast("long")), path)
    first = rows.agg(F.min("run_id").alias("first"))
    publish.write_runs(rows.join(F.broadcast(first), F.col("run_id") > F.col("first")).drop("first"), path)  # one row
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query(registry._REPORT.replace("SELECT run_id, part, n_files, sha256(body)", "SELECT run_id, part, true AS valid, sha256(body)"), fx.SETTLED + fx.counters_sql("settled_v") + fx.RUNS)
def reports_written(spark, sf_dir):
    """Reports read back from their files, a part each, with their checksums verified."""
    path = scratch_path(spark, "reports")
    publish.write_reports(registry._report_texts(spark, sf_dir).select("run_id", "part", "text"), path)
    files = spark.read.schema("value string, run_id string, part int").text(path, wholetext=True)
    checked = logs.report_check(files.select(F.concat_ws("/", "run_id", F.col("part").cast("string")).alias("file"), F.regexp_replace("value", "\n$", "").alias("text")))
    run_id, part = F.substring_index("file", "/", 1), F.substring_index("file", "/", -1).cast("int")
    return checked.select(run_id.alias("run_id"), part.alias("part"), "valid", F.sha2("body", 256).alias("body_sha256"), F.size(F.split("body", "\r\n", -1)).alias("n_lines"))


@query("SELECT run_id, file, seq, attempts FROM settled_v WHERE status = 'FAIL'", fx.SETTLED)
def failures_written(spark, sf_dir):
    rows = outcomes.settle(fx.attempts(spark, sf_dir)).filter("status = 'FAIL'").select("run_id", "file", "seq", "attempts")
    path = scratch_path(spark, "failures")
    return spark.read.schema(rows.schema).json(path) if publish.write_failures(rows, path) else rows


_PART = "CASE WHEN passed AND doc_id % 3 <> 0 THEN doc_id % 16 ELSE 16 + doc_id % 4 END"


@query(
    f""", j AS (SELECT doc_id, verdict LIKE 'MATCH%' AS passed FROM verdicts_v), p AS (SELECT *, {_PART} AS part FROM j)
    SELECT doc_id, CAST(part AS INTEGER) AS part, CASE WHEN bool_and(passed) OVER (PARTITION BY part) THEN 2 ELSE 1 END AS writing FROM p""",
    fx.HASHES,
)
def verified_published(spark, sf_dir):
    """A table in force, and a second writing of it of which the partitions whose rows all passed are put in force."""
    verdicts = verify.with_verdict(verify.align(*fx.hashes(spark, sf_dir), "doc_id")).select("doc_id", "passed")
    rows = verdicts.select("doc_id", F.expr(_PART).cast("int").alias("part"))
    target = scratch_path(spark, "target")
    for writing, judged in ((1, verdicts.withColumn("passed", F.lit(True))), (2, verdicts)):
        staged = scratch_path(spark, "staged")
        rows.withColumn("writing", F.lit(writing)).write.parquet(staged)
        publish.publish_verified(spark, staged, target, judged, "doc_id", "part")
    found = publish.published(spark, target)
    return rows.withColumn("writing", F.lit(1)) if found is None else found.select("doc_id", "part", "writing")
