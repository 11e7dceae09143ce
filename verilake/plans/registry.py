"""Every registered query by name, and its SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.functions import classes, text
from verilake.operators import catalog, events, outcomes, report, savings, verify
from verilake.plans import fixtures as fx
from verilake.sources import blocks, listing, logs
from verilake.sources.scratch import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *ctes: str):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {', '.join(ctes)}{sql if sql.startswith(',') else ' ' + sql}" if ctes else sql
        return f

    return add


# -- catalogs ---------------------------------------------------------------


@query("SELECT path, name, size FROM files_v WHERE lower(path) LIKE '%.flac'", fx.FILES)
def catalog_scan(spark, sf_dir):
    return catalog.with_extension(fx.files(spark, sf_dir)).select("path", "name", "size")


@query(None)
def catalog_scan_files(spark, sf_dir):
    return listing.scan(spark, [sf_dir], "parquet").select("name", "size")


@query("SELECT path, size, root_ordinal FROM roots_v", fx.ROOTS)
def multi_root_union(spark, sf_dir):
    all_files = fx.files(spark, sf_dir)
    return catalog.union_roots(all_files, fx.nested_root(all_files)).select("path", "size", "root_ordinal")


@query("SELECT path, arg_min(size, (root_ordinal, size)) AS size, min(root_ordinal) AS root_ordinal FROM roots_v GROUP BY path", fx.ROOTS)
def catalog_dedup(spark, sf_dir):
    all_files = fx.files(spark, sf_dir)
    nested = fx.nested_root(all_files).withColumn("path", F.concat(F.lit("file:/lib/../lib/./"), F.element_at(F.split("dir", "/"), -1), F.lit("//"), "name"))  # the same files, written another way
    return catalog.dedup(catalog.union_roots(nested, all_files).withColumn("root_ordinal", 1 - F.col("root_ordinal")))


@query(
    """, bad AS (SELECT DISTINCT path FROM files_v WHERE lower(ext) <> 'flac'), n AS (SELECT count(*) AS n FROM bad)
    SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS ordinal, path AS line FROM (SELECT path FROM bad ORDER BY path LIMIT 3)
    UNION ALL SELECT 4, '... plus ' || (n - 3) || ' more' FROM n WHERE n > 3""",
    fx.FILES,
)
def scan_error_digest(spark, sf_dir):
    return catalog.error_digest(fx.files(spark, sf_dir).filter(F.lower("ext") != "flac"))


@query("SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM files_v", fx.FILES)
def catalog_totals(spark, sf_dir):
    return catalog.totals(fx.files(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY size DESC, name, path) AS rank, path, size FROM files_v", fx.FILES)
def work_order(spark, sf_dir):
    rows = fx.files(spark, sf_dir).select("name", "path", "size")
    return catalog.ranked(rows, *catalog.work_order(rows)).select("rank", "path", "size")


@query(
    """, r AS (SELECT size, row_number() OVER (ORDER BY size DESC, name, path) - 1 AS pos FROM files_v)
    SELECT CAST(CASE WHEN (pos // 4) % 2 = 0 THEN pos % 4 ELSE 3 - pos % 4 END AS INTEGER) AS shard, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY 1""",
    fx.FILES,
)
def shard_plan(spark, sf_dir):
    return catalog.shard_loads(catalog.shard_plan(fx.files(spark, sf_dir).select("name", "path", "size"), 4))


_TEMPS = "SELECT dir, stem FROM files_v t WHERE lower(ext) = 'tmp' AND {} EXISTS (SELECT 1 FROM files_v f WHERE lower(f.ext) = 'flac' AND f.dir = t.dir AND f.stem = t.stem)"


@query(_TEMPS.format(""), fx.FILES)
def stale_temp_semi(spark, sf_dir):
    return catalog.stale_temps(fx.files(spark, sf_dir))


@query(_TEMPS.format("NOT"), fx.FILES)
def orphan_temp_anti(spark, sf_dir):
    return catalog.orphan_temps(fx.files(spark, sf_dir))


@query("SELECT path, CASE WHEN l.doc_id IS NOT NULL THEN 'SKIPPED' ELSE 'QUEUED' END AS status FROM files_v f LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON f.doc_id = l.doc_id", fx.FILES)
def skip_done(spark, sf_dir):
    done = fx.table(spark, sf_dir, "labels").filter("quality = 1")
    return catalog.skip_done(fx.files(spark, sf_dir), done, "doc_id").select("path", "status")


@query("SELECT DISTINCT path FROM files_v WHERE path NOT IN (SELECT path FROM files_v WHERE dir IN ('/lib/r3', '/lib/r4'))", fx.FILES)
def enqueue_new(spark, sf_dir):
    scan = fx.files(spark, sf_dir)
    return catalog.new_only(scan, fx.nested_root(scan)).select("path")


@query("SELECT path FROM files_v WHERE doc_id NOT IN (SELECT doc_id FROM verdicts_v WHERE verdict LIKE 'MATCH%')", fx.FILES, fx.HASHES)
def pending_files(spark, sf_dir):
    done = verify.with_verdict(verify.align(*fx.hashes(spark, sf_dir), "doc_id")).filter("passed")
    return catalog.pending(fx.files(spark, sf_dir), done, "doc_id").select("path")


@query("SELECT c_custkey, n.uri AS origin, CASE WHEN n.uri IS NULL THEN 'FAIL' ELSE 'OK' END AS status FROM customer c LEFT JOIN (SELECT n_nationkey, 'store://' || n_name AS uri FROM nation WHERE n_regionkey <> 4) n ON c.c_nationkey = n.n_nationkey")
def origin_lookup(spark, sf_dir):
    origins = fx.table(spark, sf_dir, "nation").filter("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("store://"), "n_name").alias("origin"))
    return catalog.with_origin(fx.table(spark, sf_dir, "customer"), origins, "c_nationkey").select("c_custkey", "origin", "status")


@query("SELECT event_type, min(event_id) AS first_seq FROM events GROUP BY event_type")
def distinct_first_seen(spark, sf_dir):
    return catalog.first_seen(fx.table(spark, sf_dir, "events"), "event_type", "event_id")


# -- names and texts ----------------------------------------------------------


def _pages(spark, sf_dir, value):
    return fx.table(spark, sf_dir, "pages").select("page_id", value.alias("value"))


@query(r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS value FROM pages")
def leaf_name(spark, sf_dir):
    return _pages(spark, sf_dir, text.leaf_name(F.col("url")))


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '[multifolder] (2 folders)' ELSE coalesce(list_filter(regexp_split_to_array(url, '[/\\]'), lambda p: p <> '')[-1], url) END AS value FROM pages")
def collection_label(spark, sf_dir):
    roots = F.when(F.col("page_id") % 3 == 0, F.array("url", F.lit("/lib"))).otherwise(F.array("url"))
    return _pages(spark, sf_dir, text.collection_label(roots))


@query(r"SELECT page_id, left(coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._ \-]', '_', 'g'), ' +', ' ', 'g'), ' .'), ''), 'job'), 100) AS value FROM pages")
def safe_name(spark, sf_dir):
    return _pages(spark, sf_dir, text.safe_name(F.col("url")))


@query(
    r""", d AS (SELECT page_id, regexp_extract(url_decode(url), '([^/]*)$', 1) AS last FROM pages), s AS (SELECT *, regexp_extract(last, '^([^:]*):', 1) AS kind, regexp_extract(last, '^[^:]*:(.*)$', 1) AS val, regexp_replace(last, '[^\p{L}\p{N}._\-]', '-', 'g') AS plain FROM d)
    SELECT page_id, CASE WHEN lower(last) LIKE '%.flac' THEN last WHEN contains(last, ':') AND lower(val) LIKE '%.flac' THEN val
      WHEN contains(last, ':') THEN kind || '-' || regexp_replace(val, '[^\p{L}\p{N}_\-]', '-', 'g') || '.flac' WHEN lower(plain) LIKE '%.flac' THEN plain ELSE plain || '.flac' END AS value FROM s""",
    "one AS (SELECT 1)",
)
def uri_leaf(spark, sf_dir):
    return _pages(spark, sf_dir, text.uri_leaf(F.col("url")))


@query(
    r""", t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM documents)
    SELECT doc_id, CASE WHEN coalesce(line, '') = '' THEN '(none)' WHEN length(line) <= 400 THEN line ELSE left(line, 400) || '...' END AS snippet FROM t""",
    "one AS (SELECT 1)",
)
def error_snippet(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.error_snippet(F.col("text")).alias("snippet"))


# What errors say.
_SAID = ("Access is denied.", "open: permission denied", "UnauthorizedAccess at file", "volume is Read-Only", "flac__stream_decoder_error_status_LOST_SYNC", "disk full", "", "while decoding FLAC input, state = FLAC__STREAM_DECODER_ABORTED")


@query(
    f""", t AS (SELECT k % 8 AS c FROM attempts_v)
    SELECT CASE WHEN c IN (0, 1, 2, 3) THEN 'permission' WHEN c IN (4, 7) THEN 'corrupt' WHEN c = 6 THEN 'none' ELSE 'other' END AS class, c NOT IN (4, 7) AS retryable, count(*) AS n FROM t GROUP BY 1, 2""",
    fx.ATTEMPTS,
)
def error_class(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("k") % 8).cast("int"))
    rows = fx.attempts(spark, sf_dir).select(classes.error_class(said).alias("class"), (~classes.is_fatal_error(said)).alias("retryable"))
    return rows.groupBy("class", "retryable").agg(F.count("*").alias("n"))


# -- hashes -------------------------------------------------------------------


@query("SELECT doc_id, verdict, verdict LIKE 'MATCH%' AS passed FROM verdicts_v", fx.HASHES)
def verify_verdict(spark, sf_dir):
    return verify.with_verdict(verify.align(*fx.hashes(spark, sf_dir), "doc_id")).select("doc_id", "verdict", "passed")


@query(
    f""", r AS (SELECT *, nullif(emb, '{text.NULL_MD5}') AS e FROM hashes_v)
    SELECT doc_id,
      CASE WHEN e IS NULL THEN 'missing' WHEN pre IS NOT NULL THEN CASE WHEN e = pre THEN 'match' ELSE 'warn' END WHEN out IS NOT NULL THEN CASE WHEN e = out THEN 'match' ELSE 'warn' END ELSE 'neutral' END AS emb_class,
      CASE WHEN out IS NOT NULL AND pre IS NOT NULL THEN CASE WHEN pre = out THEN 'match' ELSE 'mismatch' END WHEN out IS NOT NULL THEN 'missing' WHEN pre IS NOT NULL AND e IS NOT NULL THEN CASE WHEN e = pre THEN 'match' ELSE 'warn' END ELSE 'neutral' END AS pre_class,
      CASE WHEN out IS NULL THEN 'neutral' WHEN pre IS NOT NULL THEN CASE WHEN pre = out THEN 'match' ELSE 'mismatch' END WHEN e IS NOT NULL THEN CASE WHEN e = out THEN 'match' ELSE 'mismatch' END ELSE 'warn' END AS out_class,
      coalesce(pre = out AND e <> pre, false) AS embedded_stale FROM r""",
    fx.HASHES,
)
def hash_agreement(spark, sf_dir):
    return verify.with_agreement(verify.align(*fx.hashes(spark, sf_dir), "doc_id")).select("doc_id", "emb_class", "pre_class", "out_class", "embedded_stale")


@query(f"SELECT doc_id, CASE WHEN emb IS NULL THEN 'N/A' WHEN emb = '{text.NULL_MD5}' THEN 'NULL-EMBEDDED' ELSE left(emb, 10) || '...' || right(emb, 6) END AS shown, CASE WHEN emb IS NULL THEN '(none)' WHEN emb = '{text.NULL_MD5}' THEN '(null)' ELSE emb END AS full_text FROM hashes_v", fx.HASHES)
def hash_display(spark, sf_dir):
    rows = verify.align(*fx.hashes(spark, sf_dir), "doc_id")
    return rows.select("doc_id", text.hash_short(F.col("emb")).alias("shown"), text.hash_full(F.col("emb")).alias("full_text"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn, text)) AS digest, count(*) AS n_pieces FROM conversations GROUP BY conv_id")
def stream_digest(spark, sf_dir):
    return verify.stream_digest(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    """WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(text)) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n_pieces, sha256(text) AS digest FROM conversations),
    l AS (SELECT conv_id, idx, n_pieces, n_pieces AS n, digest FROM p
      UNION ALL SELECT conv_id, idx // 3, any_value(n_pieces), (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM l WHERE n > 1 GROUP BY conv_id, idx // 3)
    SELECT conv_id, digest, n_pieces FROM l WHERE n = 1"""
)
def tree_digest(spark, sf_dir):
    """As stream_digest, by a tree of three pieces each, whose levels are many tasks' work whatever a key holds."""
    return verify.tree_digest(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", fan_out=3)



@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS keep_doc_id, CAST(sum(n_chars) - min(n_chars) AS BIGINT) AS reclaimable_chars FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, sf_dir):
    return verify.content_duplicates(fx.table(spark, sf_dir, "documents"), "text", "doc_id", "n_chars").select("digest", "n", F.col("keep").alias("keep_doc_id"), F.col("reclaimable").alias("reclaimable_chars"))


@query(
    """, c AS (SELECT CASE WHEN verdict LIKE 'FAIL%' THEN 'bad' WHEN verdict LIKE 'MATCH%' THEN 'good' ELSE 'other' END AS class, CASE verdict WHEN 'MATCH|NEW' THEN 'new' WHEN 'MATCH' THEN 'good' ELSE 'other' END AS exact_class FROM verdicts_v)
    SELECT class, exact_class, count(*) AS n FROM c GROUP BY ALL""",
    fx.HASHES,
)
def event_class(spark, sf_dir):
    rows = verify.with_verdict(verify.align(*fx.hashes(spark, sf_dir), "doc_id"))
    return rows.groupBy(classes.event_class(F.col("verdict")).alias("class"), classes.event_class_exact(F.col("verdict")).alias("exact_class")).agg(F.count("*").alias("n"))


# -- savings ------------------------------------------------------------------


@query("SELECT supplier, count(*) AS n, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, CAST(sum(before - after) AS BIGINT) AS saved, CASE WHEN sum(before) > 0 THEN round(CAST(sum(before - after) AS DOUBLE) * 100.0 / CAST(sum(before) AS DOUBLE), 4) ELSE 0.0 END AS pct FROM savings_v GROUP BY supplier", fx.SAVINGS)
def file_savings(spark, sf_dir):
    sums = fx.savings(spark, sf_dir).groupBy("supplier").agg(F.count("*").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    saved, pct = outcomes.savings(F.col("before"), F.col("after"))
    return sums.select("supplier", "n", "before", "after", saved.alias("saved"), F.round(pct.cast("double"), 4).alias("pct"))


@query("SELECT CASE WHEN pct >= 20 THEN 'excellent' WHEN pct >= 10 THEN 'good' WHEN pct >= 5 THEN 'fair' WHEN pct > 0 THEN 'poor' ELSE 'none' END AS tier, count(*) AS n, CAST(sum(saved) AS BIGINT) AS saved FROM attempts_v GROUP BY 1", fx.ATTEMPTS)
def savings_tiers(spark, sf_dir):
    return fx.attempts(spark, sf_dir).groupBy(classes.savings_tier(F.col("pct")).alias("tier")).agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))


@query(
    """, t AS (SELECT saved, CASE WHEN status = 'FAIL' THEN NULL ELSE k // 4 END AS p FROM attempts_v)
    SELECT CASE WHEN p IS NULL THEN 'unknown' WHEN p >= 20 THEN 'exceptional' WHEN p >= 15 THEN 'very high' WHEN p >= 10 THEN 'high' WHEN p >= 6 THEN 'strong' WHEN p >= 3 THEN 'moderate' WHEN p > 1 THEN 'light' WHEN p > 0 THEN 'minimal' WHEN p = 0 THEN 'unchanged' ELSE 'larger' END AS tier,
      count(*) AS n, CAST(sum(saved) AS BIGINT) AS saved FROM t GROUP BY 1""",
    fx.ATTEMPTS,
)
def savings_tiers_fine(spark, sf_dir):
    shown = F.when(F.col("status") == "FAIL", "N/A").otherwise(F.concat(F.expr("k div 4").cast("string"), F.lit("%")))
    return fx.attempts(spark, sf_dir).groupBy(classes.savings_tier_fine(shown).alias("tier")).agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))


@query("SELECT run, round(CAST(sum(after) AS DOUBLE) / CAST(sum(before) AS DOUBLE), 6) AS ratio FROM savings_v GROUP BY run", fx.SAVINGS)
def compression_ratio(spark, sf_dir):
    sums = fx.savings(spark, sf_dir).groupBy("run").agg(F.sum("after").alias("a"), F.sum("before").alias("b"))
    return sums.select("run", F.round(classes.compression_ratio(F.col("a"), F.col("b")).cast("double"), 6).alias("ratio"))


# -- attempts and outcomes -----------------------------------------------------


@query("SELECT * FROM counters_v", fx.ATTEMPTS + fx.counters_sql("attempts_v"))
def run_counters(spark, sf_dir):
    return outcomes.count(fx.attempts(spark, sf_dir))


_NUMBERED = """, w AS (SELECT *, count(*) FILTER (WHERE status IN ('OK', 'WARN')) OVER (PARTITION BY run_id, file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS won FROM attempts_v),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id, file, won ORDER BY seq) AS attempt FROM w)"""


@query(
    f"""{_NUMBERED}
    SELECT run_id, file, CAST(attempt AS INTEGER) AS attempt, CASE WHEN status = 'FAIL' AND attempt < 3 THEN 'RETRY' ELSE status END AS decision FROM n""",
    fx.ATTEMPTS,
)
def retry_decision(spark, sf_dir):
    return outcomes.decide(fx.attempts(spark, sf_dir), 3).select("run_id", "file", "attempt", "decision")


@query("SELECT run_id, file, attempts, status, before, after, saved FROM settled_v", fx.SETTLED)
def file_outcomes(spark, sf_dir):
    return outcomes.settle(fx.attempts(spark, sf_dir)).select("run_id", "file", "attempts", "status", "before", "after", "saved")


@query(_NUMBERED + " SELECT CAST(attempt AS INTEGER) AS attempt, count(*) AS n_files FROM n GROUP BY 1", fx.ATTEMPTS)
def attempt_stats(spark, sf_dir):
    return outcomes.attempt_stats(fx.attempts(spark, sf_dir))


@query(
    """, b AS (SELECT run_id, CAST(sum(before) AS BIGINT) AS before, CAST(sum(saved) AS BIGINT) AS total_saved, CAST(coalesce(sum(art) FILTER (WHERE blocks > 0), 0) AS BIGINT) AS artwork_saved, CAST(coalesce(sum(art) FILTER (WHERE blocks = 0), 0) AS BIGINT) AS padding_saved FROM settled_v WHERE status IN ('OK', 'WARN') GROUP BY run_id)
    SELECT *, artwork_saved + padding_saved AS metadata_saved, CASE WHEN total_saved > 0 THEN total_saved - artwork_saved - padding_saved ELSE 0 END AS audio_saved FROM b""",
    fx.SETTLED,
)
def savings_breakdown(spark, sf_dir):
    return savings.breakdown(outcomes.settle(fx.attempts(spark, sf_dir)))


@query(
    """, s AS (SELECT run_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE status IN ('OK', 'WARN')) AS n_ok, CAST(sum(before) AS DOUBLE) AS scanned, CAST(coalesce(sum(before) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS DOUBLE) AS before,
      CAST(coalesce(sum(saved) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS saved, CAST(coalesce(sum(saved - art) FILTER (WHERE status IN ('OK', 'WARN')), 0) AS BIGINT) AS audio FROM settled_v GROUP BY run_id)
    SELECT run_id, CASE WHEN before > 0 THEN round(CAST(saved AS DOUBLE) * 100.0 / before, 4) ELSE 0.0 END AS reduction_pct_of_success, CASE WHEN scanned > 0 THEN round(CAST(saved AS DOUBLE) * 100.0 / scanned, 4) ELSE 0.0 END AS reduction_pct_of_scan,
      round(n_ok * 100.0::DOUBLE / n, 4) AS success_rate_pct, CASE WHEN n_ok > 0 THEN saved // n_ok ELSE 0 END AS avg_saved, CASE WHEN before > 0 THEN round(CAST(audio AS DOUBLE) * 100.0 / before, 4) ELSE 0.0 END AS audio_reduction_pct FROM s""",
    fx.SETTLED,
)
def run_kpis(spark, sf_dir):
    out = savings.kpis(outcomes.settle(fx.attempts(spark, sf_dir)))
    return out.select(*[F.col(c).cast("double").alias(c) if c.endswith("_pct") or "_pct_" in c else c for c in out.columns])


@query("SELECT run_id, CASE WHEN failed > 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN failed = 0 THEN 'Complete' WHEN successful = 0 THEN 'Failed' ELSE 'Complete (with errors)' END AS label FROM counters_v", fx.SETTLED + fx.counters_sql("settled_v"))
def run_outcome(spark, sf_dir):
    return report.outcome(outcomes.count(outcomes.settle(fx.attempts(spark, sf_dir))))


@query("SELECT run_id, start_ms, finish_ms, total_files, successful, failed, skipped, saved_bytes FROM counters_v JOIN runs_v USING (run_id)", fx.SETTLED + fx.counters_sql("settled_v") + fx.RUNS)
def run_history(spark, sf_dir):
    counters = outcomes.count(outcomes.settle(fx.attempts(spark, sf_dir)))
    return report.history(counters, fx.runs(spark, sf_dir)).select("run_id", "start_ms", "finish_ms", "total_files", "successful", "failed", "skipped", "saved_bytes")


@query("SELECT file, count(*) FILTER (WHERE saved > 0 AND k % 7 <> 0) AS blocks_optimized, CAST(coalesce(sum(saved) FILTER (WHERE saved > 0 AND k % 7 <> 0), 0) AS BIGINT) AS raw_saved, CAST(sum(art) AS BIGINT) AS net_saved, count(*) FILTER (WHERE saved > 0 AND k % 7 <> 0) > 0 AND sum(art) > 0 AS changed FROM attempts_v GROUP BY file", fx.ATTEMPTS)
def artwork_rollup(spark, sf_dir):
    blocks = fx.attempts(spark, sf_dir).select("file", F.col("saved").alias("raw_saved"), F.col("art").alias("net_saved"), (F.col("k") % 7 == 0).alias("is_url"))
    return savings.artwork_rollup(blocks)


@query("SELECT CAST(row_number() OVER (ORDER BY saved DESC, seq) AS INTEGER) AS rank, file, seq, saved FROM (SELECT * FROM attempts_v WHERE status IN ('OK', 'WARN') AND saved > 0 ORDER BY saved DESC, seq LIMIT 3)", fx.ATTEMPTS)
def top_savings(spark, sf_dir):
    return savings.top(fx.attempts(spark, sf_dir), 3).select("rank", "file", "seq", "saved")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saved DESC, seq) AS n FROM attempts_v WHERE status IN ('OK', 'WARN') AND saved > 0) SELECT run_id, CAST(n AS INTEGER) AS rank, file, seq, saved FROM r WHERE n <= 3", fx.ATTEMPTS)
def top_savings_by_run(spark, sf_dir):
    return savings.top_by_run(fx.attempts(spark, sf_dir), 3).select("run_id", "rank", "file", "seq", "saved")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS n FROM attempts_v) SELECT run_id, CAST(n AS INTEGER) AS nth, seq, file, status FROM r WHERE n <= 25", fx.ATTEMPTS)
def recent_events(spark, sf_dir):
    return outcomes.recent(fx.attempts(spark, sf_dir), 25).select("run_id", "nth", "seq", "file", "status")


@query("SELECT seq, run_id, file, saved FROM attempts_v ORDER BY saved DESC, seq DESC LIMIT 100", fx.ATTEMPTS)
def event_sort(spark, sf_dir):
    return outcomes.event_sort(fx.attempts(spark, sf_dir), "audio", True, 100).select("seq", "run_id", "file", "saved")


@query(
    """, r AS (SELECT run_id, seq, count(*) OVER w AS done, CAST(sum(saved) OVER w AS BIGINT) AS saved_so_far, count(*) OVER (PARTITION BY run_id) AS n FROM attempts_v WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT run_id, seq, done, saved_so_far FROM r WHERE done % 10 = 0 OR done = n""",
    fx.ATTEMPTS,
)
def running_progress(spark, sf_dir):
    return outcomes.running_progress(fx.attempts(spark, sf_dir), 10).select("run_id", "seq", "done", "saved_so_far")


# -- reports ------------------------------------------------------------------

# The labels and sentences of reports.
_STATUS = """, c AS (SELECT *, greatest(total_files - processed, 0) AS pending FROM counters_v JOIN runs_v USING (run_id)), l AS (
  SELECT run_id, list_filter([
    CASE WHEN successful > 0 THEN ' ' || successful || ' file(s) processed successfully' END, CASE WHEN failed > 0 THEN ' ' || failed || ' file(s) failed' END,
    CASE WHEN skipped > 0 THEN ' ' || skipped || ' file(s) skipped (already processed)' END, CASE WHEN pending > 0 THEN ' ' || pending || ' file(s) pending' END,
    CASE WHEN successful = 0 AND failed = 0 AND skipped = 0 AND pending = 0 THEN ' 0 file(s) processed' END, '',
    CASE WHEN run_canceled AND pending > 0 THEN 'Processing canceled by user' WHEN failed > 0 THEN 'Some files could not be verified'
         WHEN warned > 0 AND pending = 0 THEN 'All files compressed; ' || warned || ' file(s) could not be written back' WHEN successful > 0 AND pending = 0 THEN 'All files processed successfully' ELSE 'Processing complete' END, '',
    CASE WHEN failed > 0 OR (run_canceled AND pending > 0) THEN 'There were errors' WHEN warned > 0 THEN 'Some compressed files could not be written back to their original location' ELSE 'No errors occurred' END, '', 'End of status report'],
    lambda x: x IS NOT NULL) AS lines FROM c)"""


def _run_counters(spark, sf_dir):
    return outcomes.count(outcomes.settle(fx.attempts(spark, sf_dir))).join(fx.runs(spark, sf_dir), "run_id")


@query(_STATUS + " SELECT run_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line FROM l", fx.SETTLED + fx.counters_sql("settled_v") + fx.RUNS)
def status_report(spark, sf_dir):
    return report.status_report(_run_counters(spark, sf_dir))


@query("SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY file) AS INTEGER) AS entry, file, attempts, before FROM settled_v WHERE status = 'FAIL'", fx.SETTLED)
def failed_list(spark, sf_dir):
    return report.failed_list(outcomes.settle(fx.attempts(spark, sf_dir))).select("run_id", "entry", "file", "attempts", "before")


def _num(b: str) -> str:
    """SQL of the padded byte text."""
    h = f"(CASE WHEN {b} >= 1073741824 THEN ({b} * 100 + 536870912) // 1073741824 WHEN {b} >= 1048576 THEN ({b} * 100 + 524288) // 1048576 WHEN {b} >= 1024 THEN ({b} * 100 + 512) // 1024 ELSE {b} * 100 END)"
    whole = f"CAST({h} // 100 AS VARCHAR)"
    number = f"(CASE WHEN length({whole}) >= 2 THEN {whole} ELSE lpad({whole}, 2, '0') END || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0'))"
    return f"(CASE WHEN length({number}) >= 8 THEN {number} ELSE lpad({number}, 8, ' ') END || ' ' || CASE WHEN {b} >= 1073741824 THEN 'GB' WHEN {b} >= 1048576 THEN 'MB' WHEN {b} >= 1024 THEN 'KB' ELSE 'B' END)"


def _pct_text(p: str) -> str:
    h = f"CAST(CASE WHEN abs({p}) < 0.005 THEN 0 ELSE floor(abs({p}) * 100 + 0.5) END AS BIGINT)"
    return f"(CASE WHEN {p} < 0 AND {h} > 0 THEN '-' ELSE '' END || ({h} // 100) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '%')"


def _line(label: str, value: str) -> str:
    return f"'     {label.ljust(20)} ' || {value}"


# The labels of a file's lines.
_REPORT = (
    _STATUS
    + f""", e AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS nth, array_to_string(list_concat(
    ['File', '', '     Filename ' || file, '', {_line("Logged at", "strftime(ts, '%H:%M:%S')")}, {_line("Attempt", "CAST(blocks + 1 AS VARCHAR)")}, {_line("Verification", "status")}],
    CASE WHEN status IN ('OK', 'WARN') THEN list_concat([{_line("Original size", _num("before"))}, {_line("Compressed size", _num("greatest(after, 0)"))}, {_line("Net saved", _num("abs(saved)") + " || ' (' || " + _pct_text("pct") + " || ')'")}, {_line("Audio delta", "'N/A'")},
        {_line("Embedded MD5", "'N/A'")}, {_line("Calculated pre MD5", "md5(file)")}, {_line("Calculated post MD5", "md5(file)")}],
        CASE WHEN status = 'WARN' THEN [{_line("Write-back", "'kept'")}, '     Copy warning (original file unchanged)'] WHEN blocks > 0 THEN [{_line("Metadata cleanup", "'kept'")}, '     Copy OK'] ELSE ['     Copy OK'] END)
      WHEN status = 'FAIL' THEN ['     Copy failed', {_line("Reason", "CASE WHEN status = 'WARN' OR blocks > 0 THEN 'kept' ELSE '' END")}]
      ELSE list_concat([{_line("Original size", _num("before"))}, '     Skipped - already processed'], CASE WHEN blocks > 0 THEN [{_line("Reason", "'kept'")}] ELSE [] END) END, ['']), chr(13) || chr(10)) AS txt FROM attempts_v),
  p AS (SELECT run_id, CAST(nth // 1000 AS INTEGER) AS part, string_agg(txt, chr(13) || chr(10) ORDER BY seq) AS t, count(*) AS n_files FROM e GROUP BY 1, 2), z AS (SELECT run_id, max(part) AS last FROM p GROUP BY run_id),
  t AS (SELECT run_id, list('  ' || n || '. Saved ' || {_num("abs(saved)")} || ' (' || {_pct_text("pct")} || ') | ' || file ORDER BY n) AS best
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saved DESC, seq) AS n FROM attempts_v WHERE status IN ('OK', 'WARN') AND saved > 0) WHERE n <= 3 GROUP BY run_id),
  b0 AS (SELECT p.run_id, part, last, n_files, CASE WHEN last > 0 THEN 'Part ' || (part + 1) || ' of ' || (last + 1) || chr(13) || chr(10) ELSE '' END || CASE WHEN part = 0 THEN array_to_string(['Processing report', '', 'Logfile from ' || strftime(to_timestamp(finish_ms / 1000) AT TIME ZONE 'UTC', '%-d. %B %Y, %-H:%M'), '', p.run_id, '', {_line("Source folder", "'/lib/' || p.run_id")},
    {_line("Run started", "strftime(to_timestamp(start_ms / 1000) AT TIME ZONE 'UTC', '%-d. %B %Y, %-H:%M')")}, {_line("Run finished", "strftime(to_timestamp(finish_ms / 1000) AT TIME ZONE 'UTC', '%-d. %B %Y, %-H:%M')")},
    {_line("Worker threads", "'8'")}, {_line("Retry limit", "'3'")}, {_line("Files discovered", "CAST(total_files AS VARCHAR)")}, '', ''], chr(13) || chr(10)) ELSE '' END || t || CASE WHEN part = last THEN chr(13) || chr(10) || array_to_string(lines, chr(13) || chr(10)) || coalesce(chr(13) || chr(10) || array_to_string(list_concat(['', '---- Compression notes', ''], best), chr(13) || chr(10)), '') ELSE '' END AS body
    FROM p JOIN z USING (run_id) JOIN l USING (run_id) JOIN runs_v USING (run_id) LEFT JOIN t USING (run_id)),
  s AS (SELECT run_id, sha256(string_agg(sha256(body), '' ORDER BY part)) AS root FROM b0 WHERE part < last GROUP BY run_id),
  b AS (SELECT b0.run_id, part, n_files, CASE WHEN last > 0 AND part = last THEN body || chr(13) || chr(10) || '==== Parts checksum ' || root ELSE body END AS body FROM b0 LEFT JOIN s USING (run_id))
  SELECT run_id, part, n_files, sha256(body) AS body_sha256, CAST(len(string_split(body, chr(13) || chr(10))) AS INTEGER) AS n_lines FROM b"""
)


@query(_REPORT, fx.SETTLED + fx.counters_sql("settled_v") + fx.RUNS)
def run_report(spark, sf_dir):
    return _report_texts(spark, sf_dir).select("run_id", "part", "n_files", F.sha2("body", 256).alias("body_sha256"), F.size(F.split("body", report.NEWLINE, -1)).alias("n_lines"))


@query(
    """, n AS (SELECT run_id, count(*) AS n FROM attempts_v GROUP BY run_id), k AS (SELECT run_id, (n + 49) // 50 AS parts, CAST(row_number() OVER (ORDER BY run_id) % 6 AS INTEGER) AS kind FROM n)
    SELECT run_id AS report, CAST(1 AS INTEGER) AS part, 'missing' AS problem FROM k WHERE kind IN (1, 4) AND parts > 1 UNION ALL SELECT run_id, 0, 'altered' FROM k WHERE kind = 2
    UNION ALL SELECT run_id, 0, unnest(['doubled', 'altered']) FROM k WHERE kind = 4 AND parts > 1 UNION ALL SELECT run_id, 1, 'misplaced' FROM k WHERE kind = 4 AND parts > 1
    UNION ALL SELECT run_id, unnest([0, 1]), 'misplaced' FROM k WHERE kind = 3 AND parts > 1 UNION ALL SELECT run_id, NULL, 'foreign' FROM k WHERE kind = 5 AND parts > 1""",
    fx.ATTEMPTS,
)
def report_gaps(spark, sf_dir):
    """Parts of reports that are gone (1), altered (2), exchanged (3), replaced by an altered copy of another (4), or of another writing of the same report (5)."""
    texts = _report_texts(spark, sf_dir, part_size=50).select("run_id", "part", "text")
    attempts = fx.attempts(spark, sf_dir).groupBy("run_id").agg(F.expr("(count(*) - 1) div 50").alias("last"))
    kinds = catalog.ranked(attempts, F.col("run_id"), name="kind").select("run_id", "last", (F.col("kind") % 6).alias("kind"))
    # a row a run, written: Spark sees its size. Each text is read once, and gives none, one or two
    rows = texts.join(cut(kinds), "run_id")
    kind, part, several = F.col("kind"), F.col("part"), F.col("last") > 0
    changed = F.regexp_replace("text", "Logfile from ", "Log file from ")
    given = lambda place, words: F.array(F.struct(place.alias("part"), words.alias("text")))
    own = given(
        F.when((kind == 3) & several & (part < 2), 1 - part).otherwise(part),
        F.when((kind == 2) & (part == 0), changed).when((kind == 5) & several & (part == 0), _resealed(changed)).otherwise(F.col("text")),
    )
    both = F.concat(given(F.lit(0), changed), given(F.lit(1), F.col("text")))
    gone = several & (part == 1) & kind.isin(1, 4)
    files = rows.select(F.col("run_id").alias("report"), F.explode(F.when((kind == 4) & several & (part == 0), both).when(~gone, own)).alias("x")).select("report", "x.part", "x.text")
    checked = logs.report_check(files.select(F.concat_ws("/", "report", F.col("part").cast("string")).alias("file"), "text"))
    return logs.report_gaps(checked.select(F.substring_index("file", "/", 1).alias("report"), F.substring_index("file", "/", -1).cast("int").alias("part"), "body", "valid", "actual"))


def _resealed(text):
    """A report text with the checksum that its body has now."""
    return report.with_checksum(F.regexp_extract(text, logs._FOOTER, 1))


def _report_texts(spark, sf_dir, part_size=1000):
    made = cut(fx.attempts(spark, sf_dir))
    rows = made.select(
        "*", F.date_format("ts", "HH:mm:ss").alias("time"), (F.col("blocks") + 1).cast("string").alias("attempt"), F.col("status").alias("verification"), F.lit(None).cast("string").alias("emb"),
        F.md5(F.col("file").cast("binary")).alias("pre"), F.md5(F.col("file").cast("binary")).alias("out"), F.when((F.col("blocks") > 0) | (F.col("status") == "WARN"), "kept").alias("detail"),
    )
    runs = fx.runs(spark, sf_dir, made).select(
        "run_id", "total_files", "run_canceled", F.concat(F.lit("/lib/"), "run_id").alias("source_folder"), text.report_datetime(F.col("start_ms")).alias("started"),
        text.report_datetime(F.col("finish_ms")).alias("finished"), F.lit(8).alias("threads"), F.lit(3).alias("max_attempts"),
    )
    return report.texts(runs, rows, outcomes.count(outcomes.settle(made)), savings.top_by_run(made, 3), part_size=part_size)


def _plain(b: str) -> str:
    h = lambda u: f"(abs({b}) * 100 + {u // 2}) // {u}"
    t = lambda u, n: f"({h(u)} // 100) || '.' || lpad(CAST({h(u)} % 100 AS VARCHAR), 2, '0') || ' {n}'"
    return f"CASE WHEN {b} < 0 THEN '-' ELSE '' END || CASE WHEN abs({b}) >= 1073741824 THEN {t(1 << 30, 'GB')} WHEN abs({b}) >= 1048576 THEN {t(1 << 20, 'MB')} WHEN abs({b}) >= 1024 THEN {t(1 << 10, 'KB')} ELSE abs({b}) || ' B' END"


@query(f"SELECT seq, {_plain('saved * (k - 50)')} AS text, {_num('before')} AS padded FROM attempts_v", fx.ATTEMPTS)
def format_bytes(spark, sf_dir):
    return fx.attempts(spark, sf_dir).select("seq", text.format_bytes(F.col("saved") * (F.col("k") - 50)).alias("text"), text.format_bytes_padded(F.col("before")).alias("padded"))


@query(
    """, s AS (SELECT seq, greatest(before - 5000, 0) AS s FROM attempts_v)
    SELECT seq, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text FROM s""",
    fx.ATTEMPTS,
)
def format_elapsed(spark, sf_dir):
    return fx.attempts(spark, sf_dir).select("seq", text.format_elapsed(F.col("before") - 5000).alias("text"))


@query(f"SELECT seq, {_pct_text('pct - 10')} AS text FROM attempts_v", fx.ATTEMPTS)
def format_percent(spark, sf_dir):
    return fx.attempts(spark, sf_dir).select("seq", text.format_percent(F.col("pct") - 10).alias("text"))


@query("SELECT event_id AS seq, strftime(ts, '%-d. %B %Y, %-H:%M') AS text FROM events")
def report_datetime(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.report_datetime(F.unix_millis(F.col("ts").cast("timestamp"))).alias("text"))


# -- worker events --------------------------------------------------------------


@query("SELECT worker, seq, type, file, percent, stage FROM pipeline_v", fx.PIPELINE)
def event_decode(spark, sf_dir):
    rows = fx.pipeline(spark, sf_dir)
    hashing = F.when(F.col("stage").startswith("hashing-"), F.struct(F.substring("stage", 9, 99).alias("hashing")))
    plain, nested = rows.filter(hashing.isNull()), rows.filter(hashing.isNotNull()).withColumn("stage", hashing)
    lines = plain.select(F.to_json(F.struct(*plain.columns)).alias("value")).unionByName(nested.select(F.to_json(F.struct(*nested.columns)).alias("value")))
    decoded, _ = events.decode(lines)
    return decoded.select("worker", "seq", "type", "file", "percent", "stage")


@query("SELECT worker, seq, (last_value(CASE WHEN type = 'workerStarted' THEN {'f': file} WHEN type = 'workerIdle' THEN {'f': NULL} END IGNORE NULLS) OVER (PARTITION BY worker ORDER BY seq ROWS UNBOUNDED PRECEDING)).f AS current_file FROM pipeline_v", fx.PIPELINE)
def worker_fill(spark, sf_dir):
    return events.with_file(fx.pipeline(spark, sf_dir)).select("worker", "seq", "current_file")


@query(", p AS (SELECT worker, seq, percent, coalesce(lag(percent) OVER (PARTITION BY worker ORDER BY seq), 0) AS b FROM pipeline_v WHERE type = 'workerProgress') SELECT worker, seq, percent FROM p WHERE percent <> b", fx.PIPELINE)
def progress_changes(spark, sf_dir):
    return events.progress_changes(fx.pipeline(spark, sf_dir)).select("worker", "seq", "percent")


@query(
    """, j AS (SELECT *, CAST(sum(CASE WHEN type = 'workerStarted' THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS job FROM pipeline_v)
    SELECT worker, job, max(hash) FILTER (WHERE phase = 'source') AS source_hash, max(hash) FILTER (WHERE phase = 'output') AS output_hash FROM j WHERE job > 0 AND hash IS NOT NULL GROUP BY worker, job""",
    fx.PIPELINE,
)
def hash_pairing(spark, sf_dir):
    return events.hash_pairs(fx.pipeline(spark, sf_dir))


@query("SELECT state, count(*) AS n FROM states_v GROUP BY state", fx.PIPELINE)
def worker_histogram(spark, sf_dir):
    return events.histogram(events.worker_state(fx.pipeline(spark, sf_dir)))


@query("SELECT least(100.0, round((100 + coalesce(sum(CASE state WHEN 'hashing-output' THEN 1.0 WHEN 'artwork' THEN 1.0 WHEN 'finalizing' THEN 1.0 WHEN 'hashing-source' THEN 0.05 WHEN 'idle' THEN 0.0 ELSE percent / 100.0 END), 0)) * 100.0 / 200, 4))::DOUBLE AS pct FROM states_v", fx.PIPELINE)
def live_progress(spark, sf_dir):
    out = events.live_progress(events.worker_state(fx.pipeline(spark, sf_dir)), 100, 200)
    return out.select(F.col("pct").cast("double").alias("pct"))


@query(
    """SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (
      SELECT user_id, ts, CAST(sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, session"""
)
def activity_sessions(spark, sf_dir):
    return events.sessions(fx.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq"), "user_id", "1 DAY")


@query(
    """, e AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS run_id, worker, seq, ts, CASE WHEN type IN ('workerIdle', 'fileCompleted') THEN 0 ELSE 1 END AS busy FROM pipeline_v),
    d AS (SELECT *, busy - coalesce(lag(busy) OVER (PARTITION BY run_id, worker ORDER BY ts, seq), 0) AS change FROM e),
    b AS (SELECT *, sum(change) OVER (PARTITION BY run_id ORDER BY ts, seq) AS n_busy FROM d),
    p AS (SELECT *, lag(n_busy) OVER w AS was_busy, lag(ts) OVER w AS was_ts FROM b WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
    s AS (SELECT *, sum(CASE WHEN was_ts IS NULL OR (was_busy = 0 AND ts >= was_ts + INTERVAL 1 MINUTE) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, seq) AS session FROM p),
    g AS (SELECT run_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n, arg_max(n_busy, seq) AS n_busy FROM s GROUP BY run_id, session),
    l AS (SELECT *, session = max(session) OVER (PARTITION BY run_id) AS latest, max("end") OVER () AS now FROM g)
    SELECT run_id, start, "end", n FROM l WHERE NOT latest OR (n_busy = 0 AND now >= "end" + INTERVAL 1 MINUTE)""",
    fx.PIPELINE,
)
def closed_runs(spark, sf_dir):
    """Spans of a week's run that ended with all its workers idle."""
    rows = fx.pipeline(spark, sf_dir).withColumn("run_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return events.closed_runs(rows, "1 MINUTE")


_ORDERS = {"time": "seq", "file": "lower(file)", "audio": "saved", "art": "art", "pct": "pct", "verify": "lower(CASE WHEN k % 3 <> 0 THEN 'V' || (k % 5) ELSE coalesce(status, '') END)", "status": "status"}


@query(
    " " + " UNION ALL ".join(
        f"SELECT '{key}' AS sort_key, {down} AS descending, seq FROM (SELECT seq FROM attempts_v ORDER BY {by} {'DESC' if down else 'ASC'}, seq DESC LIMIT 50)" for key, by in _ORDERS.items() for down in (True, False)
    ),
    fx.ATTEMPTS,
)
def event_orders(spark, sf_dir):
    """The first rows of every order that events can be shown in."""
    rows = fx.attempts(spark, sf_dir).withColumn("verification", F.when(F.col("k") % 3 != 0, F.concat(F.lit("V"), (F.col("k") % 5).cast("string")))).withColumn("detail", F.col("status"))
    found = [outcomes.event_sort(rows, key, down, 50).select(F.lit(key).alias("sort_key"), F.lit(down).alias("descending"), "seq") for key in _ORDERS for down in (True, False)]
    return functools.reduce(DataFrame.unionByName, found)


@query(
    f""", s AS (SELECT seq, before * (k - 50) AS n, before % 200000 - 1000 AS e FROM attempts_v), t AS (SELECT *, abs(n) AS a, greatest(e, 0) AS g FROM s)
    SELECT seq, CASE WHEN a >= 1048576 THEN ((a * 10 + 524288) // 1048576 // 10) || '.' || ((a * 10 + 524288) // 1048576 % 10) || ' MB' WHEN a >= 1024 THEN ((a * 10 + 512) // 1024 // 10) || '.' || ((a * 10 + 512) // 1024 % 10) || ' KB' ELSE a || ' B' END AS short,
      CASE WHEN n <= 0 THEN '0 B' ELSE {_plain('n')} END AS ui, CASE WHEN g >= 3600 THEN lpad(CAST(g // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(g % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(g % 60 AS VARCHAR), 2, '0') AS elapsed FROM t""",
    fx.ATTEMPTS,
)
def format_short(spark, sf_dir):
    n = F.col("before") * (F.col("k") - 50)
    return fx.attempts(spark, sf_dir).select("seq", text.format_bytes_short(n).alias("short"), text.format_bytes_ui(n).alias("ui"), text.format_elapsed_short(F.col("before") % 200000 - 1000).alias("elapsed"))


# -- containers -----------------------------------------------------------------


def _inventory(spark, sf_dir):
    return blocks.inventory(fx.containers(spark, sf_dir))


_BLOCKS = """, b AS (
  SELECT path, 0 AS n, 0 AS type, 34 AS length FROM containers_v
  UNION ALL SELECT path, 1, 6, 32 + length(mime) + length(description) + image_length FROM containers_v WHERE doc_id % 3 <> 0
  UNION ALL SELECT path, 2, 4, 11 + list_sum(list_transform(items, lambda x: 4 + strlen(x))) FROM containers_v
  UNION ALL SELECT path, 3, 1, doc_id % 64 FROM containers_v)"""


@query(_BLOCKS + " SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INTEGER) AS block_number, CAST(type AS INTEGER) AS type, CAST(length AS BIGINT) AS length, n = 3 AS is_last, false AS truncated FROM b", fx.CONTAINERS)
def block_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).select("path", "block_number", "type", "length", "is_last", "truncated")


@query(
    """, f AS (SELECT path, 44100 + doc_id % 3 AS sample_rate, doc_id % 8 + 1 AS channels, doc_id % 2 * 8 + 16 AS bits, coalesce(n_chars, 0) AS samples, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS embedded_md5 FROM containers_v)
    SELECT path, CAST(sample_rate AS BIGINT) AS sample_rate, CAST(channels AS BIGINT) AS channels, CAST(bits AS BIGINT) AS bits, CAST(samples AS BIGINT) AS samples, CAST(samples * channels * bits // 8 AS BIGINT) AS raw_bytes, embedded_md5 FROM f""",
    fx.CONTAINERS,
)
def stream_facts(spark, sf_dir):
    out = blocks.stream_facts(_inventory(spark, sf_dir))
    return out.select("path", *[F.col(c).cast("long").alias(c) for c in ("sample_rate", "channels", "bits", "samples", "raw_bytes")], "embedded_md5")


@query("SELECT folder, count(*) AS n_files, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_missing FROM containers_v GROUP BY folder", fx.CONTAINERS)
def missing_md5(spark, sf_dir):
    return blocks.missing_md5(blocks.stream_facts(_inventory(spark, sf_dir)))


@query("SELECT path, CAST(10 AS BIGINT) AS prefix_bytes FROM containers_v WHERE doc_id % 5 = 0", fx.CONTAINERS)
def foreign_prefix(spark, sf_dir):
    return blocks.foreign_prefix(fx.containers(spark, sf_dir)).select("path", F.col("prefix_bytes").cast("long").alias("prefix_bytes"))


_PICTURES = """, p AS (SELECT path, doc_id, mime, description, CAST(doc_id % 500 AS INTEGER) AS width, CAST(doc_id % 300 AS INTEGER) AS height, CAST(image_length AS BIGINT) AS data_length,
  CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS image, CASE doc_id % 4 WHEN 0 THEN 'png' || (doc_id % 10) WHEN 1 THEN 'jpeg' || (doc_id % 50) ELSE 'address' END AS same FROM containers_v WHERE doc_id % 3 <> 0)"""


@query(_PICTURES + " SELECT path, mime, description, width, height, data_length, image, mime = '-->' AS is_url, doc_id % 6 = 1 AS unsafe_to_rewrite FROM p", fx.CONTAINERS)
def picture_inventory(spark, sf_dir):
    return blocks.pictures(_inventory(spark, sf_dir)).select("path", "mime", "description", "width", "height", "data_length", "image", "is_url", "unsafe_to_rewrite")


@query(_PICTURES + " SELECT n, n_files, bytes, count(*) AS n_pictures FROM (SELECT count(*) AS n, count(DISTINCT path) AS n_files, max(data_length) AS bytes FROM p GROUP BY same HAVING count(*) > 1) GROUP BY ALL", fx.CONTAINERS)
def repeated_pictures(spark, sf_dir):
    return blocks.repeated_pictures(blocks.pictures(_inventory(spark, sf_dir))).groupBy("n", "n_files", "bytes").agg(F.count("*").alias("n_pictures"))


@query("SELECT doc_id % 4 AS kind, count(*) AS n, CAST(sum(CASE WHEN doc_id % 4 = 1 THEN doc_id % 50 + 11 END) AS BIGINT) AS strippable FROM containers_v WHERE doc_id % 3 <> 0 GROUP BY 1", fx.CONTAINERS)
def strippable_artwork(spark, sf_dir):
    d = F.regexp_extract("path", r"(\d+)\.flac$", 1).cast("long")
    found = blocks.pictures(_inventory(spark, sf_dir)).select("path", "block_number", "data_length").join(_inventory(spark, sf_dir).select("path", "block_number", "data"), ["path", "block_number"])
    shown = found.select((d % 4).alias("kind"), F.substring("data", F.octet_length("data") - F.col("data_length").cast("int") + 1, F.col("data_length").cast("int")).alias("image"))
    return shown.groupBy("kind").agg(F.count("*").alias("n"), F.sum(blocks.strippable_jpeg_bytes(F.col("image"))).alias("strippable"))


@query("SELECT path, CAST(doc_id % 64 + 4 AS BIGINT) AS padding_bytes, CAST(1 AS BIGINT) AS padding_blocks FROM containers_v", fx.CONTAINERS)
def padding_totals(spark, sf_dir):
    return blocks.padding(_inventory(spark, sf_dir))


@query(", t AS (SELECT path, upper(split_part(x, '=', 1)) AS tag FROM (SELECT path, unnest(items) AS x FROM containers_v)) SELECT tag, count(*) AS n, count(DISTINCT path) AS n_files FROM t GROUP BY tag", fx.CONTAINERS)
def tag_counts(spark, sf_dir):
    return blocks.tag_counts(blocks.comments(_inventory(spark, sf_dir)))


@query("SELECT count(*) AS n_files, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_marked FROM containers_v", fx.CONTAINERS)
def marker_coverage(spark, sf_dir):
    return blocks.marker_coverage(blocks.comments(_inventory(spark, sf_dir)), "JOB_DONE")


@query("""SELECT seq, '{"processed":true,"version":"1.' || (k % 7) || '","library":"lib","time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS marker FROM attempts_v""", fx.ATTEMPTS)
def marker_value(spark, sf_dir):
    return fx.attempts(spark, sf_dir).select("seq", classes.marker_value(F.concat(F.lit("1."), (F.col("k") % 7).cast("string")), F.lit("lib"), F.col("ts")).alias("marker"))


# -- files on disk: walked, told from links, and read by ranges ---------------------


def _relative(root: str):
    return F.regexp_replace("path", "^(file:)?" + re.escape(root), "")


@query(
    "SELECT '/lib/r' || (doc_id % 5) || '/' || doc_id || '.flac' AS path, CAST(doc_id % 5 <> 3 AS INTEGER) AS root_ordinal FROM documents",
)
def walked_files(spark, sf_dir):
    """Every file once, of the first root that holds it: the second root holds the first, and links lead to files and back to the root."""
    root = fx.written_containers(spark, sf_dir)
    files, _ = listing.scan_with_errors(spark, [f"{root}/lib/r3", f"{root}/lib", f"{root}/links"])
    return files.select(_relative(root).alias("path"), F.col("root_ordinal").cast("int").alias("root_ordinal"))


@query(
    """SELECT '/lib/r' || (doc_id % 5) || '/gone-' || doc_id || '.flac' AS path, 'ENOENT' AS error FROM documents WHERE doc_id % 50 = 7
    UNION ALL SELECT DISTINCT '/lib/r' || (doc_id % 5) || '/back', 'ELOOP' FROM documents UNION ALL SELECT '/missing', 'PATH_NOT_FOUND'"""
)
def walked_errors(spark, sf_dir):
    """What cannot be listed, inside the roots and of the roots, while everything else is."""
    root = fx.written_containers(spark, sf_dir)
    _, errors = listing.scan_with_errors(spark, [root, f"{root}/missing"])
    return errors.select(_relative(root).alias("path"), "error")


@query(_BLOCKS + " SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INTEGER) AS block_number, CAST(type AS INTEGER) AS type, CAST(length AS BIGINT) AS length, n = 3 AS is_last, false AS truncated FROM b", fx.CONTAINERS)
def file_inventory(spark, sf_dir):
    """As block_inventory, of files that tasks open and read by ranges."""
    root = fx.written_containers(spark, sf_dir)
    return blocks.inventory(blocks.read(spark, [root])).select(_relative(root).alias("path"), "block_number", "type", "length", "is_last", "truncated")


# -- logs -----------------------------------------------------------------------


@query(
    """SELECT 'log-' || split_part(file, '-', 1) AS file, CAST(seq AS INTEGER) AS line_no, CASE WHEN k % 5 <> 0 THEN date_trunc('second', ts) END AS ts,
      CASE WHEN k % 5 = 0 THEN NULL WHEN status = 'OK' THEN 'SUCCESS' WHEN status = 'WARN' THEN 'WARN' WHEN status = 'FAIL' THEN 'ERROR' ELSE 'INFO' END AS level,
      CASE WHEN k % 5 <> 0 THEN file || ' [' || saved || '] done' END AS message, CASE WHEN k % 5 = 0 THEN 'no log line: ' || file END AS corrupt FROM attempts_v""",
    fx.ATTEMPTS,
)
def run_log(spark, sf_dir):
    c = F.col
    level = F.when(c("status").isin("OK", "WARN"), c("status")).when(c("status") == "FAIL", "ERROR").otherwise("INFO")
    line = F.when(c("k") % 5 == 0, F.concat(F.lit("no log line: "), "file")).otherwise(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] "), "file", F.lit(" ["), c("saved").cast("string"), F.lit("] done")))
    return logs.run_log(fx.log_lines(spark, sf_dir, line)).withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(
    """SELECT CAST(seq AS INTEGER) AS line_no, CASE WHEN k % 5 <> 0 THEN status END AS level, CASE WHEN k % 5 <> 0 THEN 'File done' END AS event, CASE WHEN k % 5 <> 0 THEN '/lib/' || file || ': x' END AS path,
      CASE WHEN k % 5 <> 0 THEN CAST(saved AS VARCHAR) END AS saved, CASE WHEN k % 5 = 0 THEN 'half | ' || file END AS corrupt FROM attempts_v""",
    fx.ATTEMPTS,
)
def pipe_log(spark, sf_dir):
    c = F.col
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), "status", F.lit(" | File done | Path: /lib/"), "file", F.lit(": x | Saved: 0 | Saved: "), c("saved").cast("string"))
    rows = logs.pipe_log(fx.log_lines(spark, sf_dir, F.when(c("k") % 5 == 0, F.concat(F.lit("half | "), "file")).otherwise(line)))
    return rows.select("line_no", "level", "event", F.col("fields")["Path"].alias("path"), F.col("fields")["Saved"].alias("saved"), "corrupt")


@query(
    "SELECT seq, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE least(100, k * 2) END AS INTEGER) AS percent, CASE WHEN k % 4 <> 0 THEN '0.' || (k % 10) END AS ratio FROM attempts_v",
    fx.ATTEMPTS,
)
def encoder_progress(spark, sf_dir):
    k = F.col("k")
    said = F.concat(F.lit("file: 1% complete, ratio=0.99\rfile: "), (k * 2).cast("string"), F.lit("% complete, ratio=0."), (k % 10).cast("string"))
    return fx.attempts(spark, sf_dir).select("seq", logs.progress(F.when(k % 4 == 0, "wrote nothing").otherwise(said)).alias("p")).select("seq", "p.*")


@query(
    """SELECT 'listing-' || doc_id AS file, CAST(2 AS INTEGER) AS block_number, mime, trim(replace(description, chr(10), ' ')) AS description, CAST(doc_id % 500 AS INTEGER) AS width, CAST(doc_id % 300 AS INTEGER) AS height,
      CAST(24 AS INTEGER) AS depth, CAST(0 AS INTEGER) AS colors, CAST(image_length AS BIGINT) AS data_length FROM containers_v WHERE doc_id % 3 <> 0""",
    fx.CONTAINERS,
)
def picture_listing(spark, sf_dir):
    d = F.regexp_extract("path", r"(\d+)\.flac$", 1)
    shown = blocks.pictures(_inventory(spark, sf_dir)).select(d.alias("d"), "mime", F.translate("description", "\n", " ").alias("description"), "width", "height", "data_length")
    head = ["METADATA block #1", "  type: 4 (COMMENT)", "METADATA block #2", "  type: 6 (PICTURE)"]
    said = [F.lit(x) for x in head] + [F.concat(F.lit(f"  {k}: "), F.col(c).cast("string")) for k, c in (("MIME type", "mime"), ("description", "description"), ("width", "width"), ("height", "height"))]
    said += [F.lit("  depth: 24"), F.lit("  colors: 0 (unindexed)"), F.concat(F.lit("  data length: "), F.col("data_length").cast("string"))]
    return logs.picture_listing(shown.select(F.concat(F.lit("listing-"), "d").alias("file"), F.posexplode(F.array(*said)).alias("line_no", "line")))


@query(
    "SELECT run_id, file AS filename, CASE WHEN status = 'FAIL' AND blocks > 0 THEN 'kept' END AS reason, status AS verification, count(*) AS n, CAST(2 AS INTEGER) AS checks FROM attempts_v GROUP BY ALL",
    fx.ATTEMPTS,
)
def report_reading(spark, sf_dir):
    """Reports, read again: those with a changed letter are found out, the others give back their files."""
    whole = _report_texts(spark, sf_dir).select(F.concat_ws("/", "run_id", F.col("part").cast("string")).alias("file"), "text")
    # one reading of the texts: the changed copy of a first part comes with it
    broken = F.array(F.struct(F.concat("file", F.lit("/broken")).alias("file"), F.regexp_replace("text", "Retry limit", "Retry Limit").alias("text")))
    own = F.array(F.struct("file", "text"))
    checked = logs.report_check(whole.select(F.explode(F.when(F.col("file").endswith("/0"), F.concat(own, broken)).otherwise(own)).alias("x")).select("x.*"))
    wrong = (F.col("valid") == F.endswith("file", F.lit("broken"))).cast("int")
    # those that are found out give a row without a file, which says whether that was right
    files = logs.report_files(checked.withColumn("wrong", wrong).withColumn("body", F.when(F.col("valid"), F.col("body"))), "valid", "wrong", outer=True)
    verification = F.col("fields")["Verification"]
    found = files.select("valid", "wrong", F.substring_index("file", "/", 1).alias("run_id"), "filename", F.nullif(F.when(verification == "FAIL", F.col("fields")["Reason"]), F.lit("")).alias("reason"), verification.alias("verification"))
    kinds = cut(found.groupBy("run_id", "filename", "reason", "verification").agg(F.count_if(F.col("valid") & F.col("filename").isNotNull()).alias("n"), F.max("wrong").alias("wrong")))
    proper = kinds.agg((2 - F.max("wrong")).alias("checks"))
    return kinds.filter("n > 0").drop("wrong").crossJoin(F.broadcast(proper))  # one row


# -- what went wrong, and what was cleaned up -------------------------------------


@query(
    """, t AS (SELECT seq, file, k, ['Access is denied.', 'open: permission denied', 'UnauthorizedAccess at file', 'volume is Read-Only', 'flac__stream_decoder_error_status_LOST_SYNC', 'disk full', '', 'while decoding FLAC input, state = FLAC__STREAM_DECODER_ABORTED'][k % 8 + 1] AS said FROM attempts_v)
    SELECT seq, CASE WHEN k % 8 < 4 THEN 'Permission denied while converting file | Path: ' || file || ' | Detail: ' || said WHEN k % 3 = 0 THEN 'gave up' WHEN k % 5 <> 0 THEN 'encoder exit ' || (k % 5) ELSE 'encoder gave no output' END
      || CASE WHEN k % 8 IN (4, 7) THEN ' (not retryable: corrupt input)' ELSE '' END AS reason FROM t""",
    fx.ATTEMPTS,
)
def failure_reason(spark, sf_dir):
    k = F.col("k")
    said = F.get(F.array(*map(F.lit, _SAID)), (k % 8).cast("int"))
    return fx.attempts(spark, sf_dir).select("seq", classes.failure_reason(F.when(k % 3 == 0, "gave up").when(k % 3 == 1, " "), (k % 5).cast("int"), said, F.col("file")).alias("reason"))


@query(
    f""", t AS (SELECT seq, saved, before, blocks, k % 2 = 0 AS changed, k % 4 = 0 AS nothing FROM attempts_v)
    SELECT seq, CASE WHEN NOT nothing AND saved > 0 AND blocks > 0 THEN ltrim({_num('saved')}) || ' net (' || ltrim({_num('before')}) || ' raw image, ' || blocks || ' block' || CASE WHEN blocks = 1 THEN '' ELSE 's' END || ')'
      WHEN NOT nothing AND saved > 0 THEN ltrim({_num('saved')}) || ' net (padding only)' WHEN changed AND blocks > 0 THEN 'no change of size (' || ltrim({_num('before')}) || ' raw image)' WHEN changed THEN 'no change of size (padding only)' ELSE 'none' END AS summary FROM t""",
    fx.ATTEMPTS,
)
def cleanup_summary(spark, sf_dir):
    net = F.when(F.col("k") % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("saved"))
    return fx.attempts(spark, sf_dir).select("seq", classes.cleanup_summary(net, F.col("before"), F.col("blocks"), F.col("k") % 2 == 0).alias("summary"))


@query(
    "SELECT seq, lpad(CAST(blocks AS VARCHAR), 8, ' ') || ' / ' || lpad(CAST(k AS VARCHAR), 8, ' ') AS pair, (blocks + 1) || '/3' AS attempt, 'Net saved           : ' || saved AS labelled FROM attempts_v",
    fx.ATTEMPTS,
)
def count_texts(spark, sf_dir):
    return fx.attempts(spark, sf_dir).select("seq", text.count_pair(F.col("blocks"), F.col("k")).alias("pair"), text.attempt_of(F.col("blocks") + 1, F.lit(3)).alias("attempt"), text.label_value("Net saved", F.col("saved").cast("string")).alias("labelled"))
