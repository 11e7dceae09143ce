"""Reports of runs: verdict lines, texts with a checksum, lists of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilake.functions.text import collection_label, format_bytes_padded, format_percent, report_line
from verilake.operators.catalog import running
from verilake.sources.scratch import cut

NEWLINE = "\r\n"


def outcome(counters: DataFrame) -> DataFrame:
    """exit_code and label of each run."""
    label = F.when(F.col("failed") == 0, "Complete").when(F.col("successful") == 0, "Failed").otherwise("Complete (with errors)")
    return counters.select("run_id", F.when(F.col("failed") > 0, 1).otherwise(0).alias("exit_code"), label.alias("label"))


# The labels and sentences of reports below are fixed values.


def _status_lines() -> Column:
    """The lines of a status report from the counters; the order of the rules decides."""
    c = F.col
    pending = F.greatest(c("total_files") - c("processed"), F.lit(0))
    stopped = c("run_canceled") & (pending > 0)
    n = lambda x, tail: F.when(x > 0, F.concat(F.lit(" "), x.cast("string"), F.lit(f" file(s) {tail}")))
    return F.array(
        n(c("successful"), "processed successfully"), n(c("failed"), "failed"), n(c("skipped"), "skipped (already processed)"), n(pending, "pending"),
        F.when((c("successful") == 0) & (c("failed") == 0) & (c("skipped") == 0) & (pending == 0), " 0 file(s) processed"),
        F.lit(""),
        F.when(stopped, "Processing canceled by user").when(c("failed") > 0, "Some files could not be verified")
        .when((c("warned") > 0) & (pending == 0), F.concat(F.lit("All files compressed; "), c("warned").cast("string"), F.lit(" file(s) could not be written back")))
        .when((c("successful") > 0) & (pending == 0), "All files processed successfully").otherwise("Processing complete"),
        F.lit(""),
        F.when((c("failed") > 0) | stopped, "There were errors").when(c("warned") > 0, "Some compressed files could not be written back to their original location").otherwise("No errors occurred"),
        F.lit(""), F.lit("End of status report"),
    )


def status_report(counters: DataFrame) -> DataFrame:
    """run_id, line_no, line: the verdict on each run; counters has total_files and run_canceled too."""
    lines = F.filter(_status_lines(), lambda x: x.isNotNull())
    return counters.select("run_id", F.posexplode(lines).alias("line_no", "line"))


def _file_block() -> Column:
    """The lines of one file, by its status."""
    c = F.col
    line = lambda label, value: F.array(report_line(label, value))
    plain = lambda text: F.array(F.lit("     " + text))
    none = F.array().cast("array<string>")
    head = F.concat(F.array(F.lit("File"), F.lit(""), F.concat(F.lit("     Filename "), c("file")), F.lit("")), line("Logged at", c("time")), line("Attempt", c("attempt")), line("Verification", c("verification")))
    done = F.concat(
        line("Original size", format_bytes_padded(c("before"))), line("Compressed size", format_bytes_padded(c("after"))),
        line("Net saved", F.concat(format_bytes_padded(F.abs("saved")), F.lit(" ("), format_percent(c("pct")), F.lit(")"))), line("Audio delta", F.lit("N/A")),
        line("Embedded MD5", F.coalesce("emb", F.lit("N/A"))), line("Calculated pre MD5", F.coalesce("pre", F.lit("N/A"))), line("Calculated post MD5", F.coalesce("out", F.lit("N/A"))),
    )
    detail = F.coalesce("detail", F.lit(""))
    body = (
        F.when(c("status") == "WARN", F.concat(done, line("Write-back", detail), plain("Copy warning (original file unchanged)")))
        .when(c("status") == "OK", F.concat(done, F.when((detail != "") & (detail != "none"), line("Metadata cleanup", detail)).otherwise(none), plain("Copy OK")))
        .when(c("status") == "RETRY", F.concat(plain("Copy aborted"), plain("Retry scheduled"), line("Reason", detail)))
        .when(c("status") == "FAIL", F.concat(plain("Copy failed"), line("Reason", detail)))
        .when(c("status") == "SKIPPED", F.concat(line("Original size", format_bytes_padded(c("before"))), plain("Skipped - already processed"), F.when(detail != "", line("Reason", detail)).otherwise(none)))
        .otherwise(none)
    )
    return F.array_join(F.concat(head, body, F.array(F.lit(""))), NEWLINE)


def with_checksum(body: Column, known: Column | None = None) -> Column:
    """The body, a blank line, and its SHA-256, which may be known."""
    return F.concat(body, F.lit(NEWLINE * 2 + "==== Log checksum "), F.sha2(body, 256) if known is None else known, F.lit(" ====" + NEWLINE))


def numbered(events: DataFrame, part_size: int) -> DataFrame:
    """run_id, seq, part of each event: the parts of a run are counted off in the order of seq, by ranges of it."""
    return running(events, "run_id", ["seq"]).select("run_id", "seq", F.call_function("div", F.col("nth") - 1, F.lit(part_size)).cast("int").alias("part"))


def report_parts(events: DataFrame, places: DataFrame) -> DataFrame:
    """run_id, part, text, n_files: the file blocks of each run in order, in the parts that ``numbered`` gives.

    A run of any length is written by as many tasks as it has parts.
    """
    blocks = events.join(places, ["run_id", "seq"]).select("run_id", "part", "seq", _file_block().alias("txt"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "txt"))), lambda x: x.txt)
    return blocks.groupBy("run_id", "part").agg(F.array_join(ordered, NEWLINE).alias("text"), F.count("*").alias("n_files"))


# What binds the parts of a report together.
PART_LINE, ROOT_LINE = "Part {} of {}", "==== Parts checksum {}"


def _filled(line: str, *values: Column) -> Column:
    texts = line.split("{}")
    return F.concat(F.lit(texts[0]), *[x for v, t in zip(values, texts[1:], strict=True) for x in (v.cast("string"), F.lit(t))])


def _best_lines(best: DataFrame) -> DataFrame:
    """run_id, best: the lines on the files that saved most, from (run_id, rank, file, saved, pct) with a few ranks a run."""
    c = F.col
    line = F.concat(F.lit("  "), c("rank").cast("string"), F.lit(". Saved "), format_bytes_padded(F.abs("saved")), F.lit(" ("), format_percent(c("pct")), F.lit(") | "), c("file"))
    rows = best.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    head = F.array(F.lit(""), F.lit("---- Compression notes"), F.lit(""))
    return rows.select("run_id", F.array_join(F.concat(head, F.transform("lines", lambda x: x.line)), NEWLINE).alias("best"))


def texts(runs: DataFrame, events: DataFrame, counters: DataFrame, best: DataFrame, title: str = "Processing report", part_size: int = 10_000) -> DataFrame:
    """run_id, part, n_files, body, text: the report of each run, each part closed by its own checksum.

    The first part has the header, the last the status report and the files that
    saved most (``best``: run_id, rank, file, saved, pct; none for a run, no list).
    Where there are several, each begins with its number and how many there are,
    and the last ends with the checksum of all the others' checksums
    (``logs.report_gaps`` reads them). seq is unique in a run. runs has
    source_folder, started and finished as text, threads, max_attempts, total_files
    and run_canceled.
    """
    c = F.col
    header = F.array_join(
        F.array(
            F.lit(title), F.lit(""), F.concat(F.lit("Logfile from "), c("finished")), F.lit(""), collection_label(F.array("source_folder")), F.lit(""), report_line("Source folder", c("source_folder")), report_line("Run started", c("started")),
            report_line("Run finished", c("finished")), report_line("Worker threads", c("threads").cast("string")), report_line("Retry limit", c("max_attempts").cast("string")),
            report_line("Files discovered", c("total_files").cast("string")), F.lit(""),
        ),
        NEWLINE,
    )
    status = F.array_join(F.filter(_status_lines(), lambda x: x.isNotNull()), NEWLINE)
    heads = runs.join(counters, "run_id").select("run_id", header.alias("header"), status.alias("status"))
    places = cut(numbered(events, part_size))
    # a row for each part: what follows does not ask the places of all files again
    sizes = cut(places.select("run_id", "part").distinct())
    counts = sizes.groupBy("run_id").agg((F.max("part") + 1).alias("parts"))
    # what the first and the last part have besides files, at most two rows a run: joined by run and part, so that no run's parts meet
    edges = counts.join(heads, "run_id").join(_best_lines(best), "run_id", "left").withColumn("part", F.explode(F.array_distinct(F.array(F.lit(0), F.col("parts") - 1))))
    last = F.col("part") == F.col("parts") - 1
    edges = edges.select("run_id", "part", F.when(c("part") == 0, c("header")).alias("header"), F.when(last, c("status")).alias("status"), F.when(last, c("best")).alias("best"))
    # and how many there are, which every part says
    joined = report_parts(events, places).join(sizes.join(counts, "run_id"), ["run_id", "part"]).join(edges, ["run_id", "part"], "left")
    number = F.when(c("parts") > 1, _filled(PART_LINE, c("part") + 1, c("parts")))
    bodies = joined.select("run_id", "part", "parts", "n_files", F.concat_ws(NEWLINE, number, c("header"), c("text"), c("status"), c("best")).alias("body"))
    bodies = cut(bodies.withColumn("sum", F.sha2("body", 256)))
    # the checksums of all parts but the last, in order: of many parts 64 letters each
    sums = bodies.filter((c("parts") > 1) & ~last).groupBy("run_id", "parts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sum"))), lambda x: x["sum"]), "").alias("sums"))
    # a row a run, written: Spark sees its size, and few are brought to the texts rather than the texts to them
    roots = cut(sums.select("run_id", (c("parts") - 1).alias("part"), _filled(ROOT_LINE, F.sha2("sums", 256)).alias("root")))
    bound = bodies.join(roots, ["run_id", "part"], "left")
    whole = bound.select("run_id", "part", "n_files", F.concat_ws(NEWLINE, "body", "root").alias("body"), F.when(c("root").isNull(), c("sum")).alias("sum"))
    return whole.select("run_id", "part", "n_files", "body", with_checksum(c("body"), F.coalesce("sum", F.sha2("body", 256))).alias("text"))


def failed_list(settled: DataFrame) -> DataFrame:
    """The files that failed for good, numbered in each run."""
    return running(settled.filter(F.col("status") == "FAIL"), "run_id", ["file"], carry=settled.columns).withColumn("entry", F.col("nth").cast("int")).drop("nth")


def history(counters: DataFrame, runs: DataFrame) -> DataFrame:
    return counters.join(runs, "run_id")
