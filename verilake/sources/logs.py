"""Readers of log files and of texts that tools print.

Logs are read line by line, a large one by many tasks; lines are numbered by the
place of their block in the file. Reports are read whole: their checksum is of
the whole text, and they are written in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.operators.catalog import running
from verilake.sources.scratch import cut


def read_lines(spark: SparkSession, path) -> DataFrame:
    """file, line_no (from 0), line of text files."""
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    return running(placed, "file", ["block", "at"], carry=["line"]).select("file", (F.col("nth") - 1).cast("int").alias("line_no"), "line")


_BRACKETS = r"^\[([^\]]+)\] \[(INFO|WARN|ERROR|OK|SUCCESS)\] (.*)$"


def run_log(lines: DataFrame) -> DataFrame:
    """ts, level, message of ``[time] [LEVEL] message`` lines; others are in corrupt. OK is read as SUCCESS."""
    fits = F.col("line").rlike(_BRACKETS)
    part = lambda i: F.when(fits, F.regexp_extract("line", _BRACKETS, i))
    level = F.when(part(2) == "OK", "SUCCESS").otherwise(part(2))
    return lines.filter(F.col("line") != "").select("file", "line_no", F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), level.alias("level"), part(3).alias("message"), F.when(~fits, F.col("line")).alias("corrupt"))


def pipe_log(lines: DataFrame) -> DataFrame:
    """ts, level, event, fields of ``time | LEVEL | event | key: value | key: value`` lines; others are in corrupt."""
    parts = F.split("line", r" \| ", 3)
    fits = F.size(parts) == 3
    body = F.get(parts, F.lit(2))
    pairs = F.filter(F.split(body, r" \| "), lambda x: F.contains(x, F.lit(": ")))
    keyed = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.regexp_extract(x, r"^.*?: (.*)$", 1).alias("value")))
    return lines.filter(F.col("line") != "").select(
        "file", "line_no", F.when(fits, F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"), F.when(fits, F.get(parts, F.lit(1))).alias("level"),
        F.when(fits, F.get(F.filter(F.split(body, r" \| "), lambda x: ~F.contains(x, F.lit(": "))), F.lit(0))).alias("event"),
        F.when(fits, F.map_from_entries(_last_of_each(keyed))).alias("fields"), F.when(~fits, F.col("line")).alias("corrupt"),
    )


def _last_of_each(pairs: Column) -> Column:
    """Of entries with the same key only the last. The entries are made once, not anew for each of them."""
    later = lambda all, x, i: F.exists(F.slice(all, i + 2, F.size(all)), lambda y: y["key"] == x["key"])
    return F.get(F.transform(F.array(pairs), lambda all: F.filter(all, lambda x, i: ~later(all, x, i))), F.lit(0))


def progress(text: Column) -> Column:
    """(percent, ratio) of the last ``NN% complete, ratio=R`` in a text; 0 and null without one."""
    pattern = r"(\d{1,3})% complete, ratio=([0-9.]+)"
    last = lambda group: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(last(1).cast("int"), F.lit(0))))
    return F.struct(percent.alias("percent"), last(2).alias("ratio"))


def picture_listing(lines: DataFrame) -> DataFrame:
    """Picture rows of block listings: ``METADATA block #n`` opens a block, ``key: value`` lines fill it.

    One file is in one task; listings are small.
    """
    opens = F.col("line").rlike(r"^METADATA block #\d+")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(order)).filter("block > 0")
    key, value = F.lower(F.btrim(F.substring_index("line", ":", 1))), F.btrim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    rows = rows.select("file", "block", F.when(opens, F.regexp_extract("line", r"#(\d+)", 1)).alias("number"), key.alias("key"), value.alias("value"))
    of = lambda *names: F.max(F.when(F.col("key").isin(*names), F.col("value")))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("long")
    out = rows.groupBy("file", "block").agg(
        F.max("number").try_cast("int").alias("block_number"), of("type").alias("kind"), of("mime type").alias("mime"), of("description").alias("description"), number(of("width")).cast("int").alias("width"),
        number(of("height")).cast("int").alias("height"), number(of("depth")).cast("int").alias("depth"), number(of("colors")).cast("int").alias("colors"), number(of("data length")).alias("data_length"),
    )
    return out.filter(F.col("kind").rlike(r"(?i)picture|^6\b")).drop("block", "kind")


_FOOTER = r"(?s)^(.*?)\r?\n\r?\n==== Log checksum ([0-9A-Fa-f]{64}) ====\s*$"
# the same, found from the end, in this many last letters and at most so many of them
_ENDING, _TAIL, _LONGEST = r"(?s)^.*?(\r?\n\r?\n==== Log checksum [0-9A-Fa-f]{64} ====\s*[\x{85}\x{2028}\x{2029}]?)\z", 200, 190


def read_reports(spark: SparkSession, path) -> DataFrame:
    """file, text of report files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def report_check(whole: DataFrame) -> DataFrame:
    """file, body, stated and true checksum of reports (file, text), and whether they agree, in either case of letters."""
    return split_footer(whole).withColumn("actual", F.sha2("body", 256)).withColumn("valid", F.col("stated") == F.col("actual")).select("file", "body", "stated", "actual", "valid")


def split_footer(whole: DataFrame) -> DataFrame:
    """Rows with a text, and its body and stated checksum; empty ones without a footer.

    A footer stands at the end, where it is looked for first: a pattern that goes
    through a whole part costs more than its checksum. Only a text whose footer is
    not in its last letters is searched whole.
    """
    ending = F.regexp_extract(F.right("text", F.lit(_TAIL)), _ENDING, 1)
    rows = whole.withColumn("_ending", ending).withColumn("_near", F.length("_ending").between(1, _LONGEST))
    body = F.when(F.col("_near"), F.substring(F.col("text"), F.lit(1), F.length("text") - F.length("_ending"))).otherwise(F.regexp_extract("text", _FOOTER, 1))
    stated = F.when(F.col("_near"), F.regexp_extract("_ending", "([0-9A-Fa-f]{64})", 1)).otherwise(F.regexp_extract("text", _FOOTER, 2))
    return rows.withColumn("body", body).withColumn("stated", F.lower(stated)).drop("_ending", "_near")


# What binds the parts of a report together.
_PART, _ROOT = r"^Part (\d+) of (\d+)\r?\n", r"\r?\n==== Parts checksum ([0-9a-f]{64})$"


def report_gaps(checked: DataFrame) -> DataFrame:
    """report, part (from 0), problem: what is wrong with the parts of reports.

    ``checked`` has report, part (the place in which a part was found: its file's
    name says it), body and valid, as ``report_check`` gives them, and may have actual. A part is
    ``altered`` (its own checksum), ``misplaced`` (it says another number than its
    place's), ``doubled`` (a number that several parts say) or ``missing`` (a number
    that none says; of how many there are, any part tells). If nothing of that is
    found but the parts are not those that the last one was written with, part is
    null and the problem ``foreign``. A report in one part says no number.
    """
    # the number stands in the first letters and the checksum of the parts in the last ones: patterns do not go through the texts
    first, last = F.left("body", F.lit(100)), F.right("body", F.lit(100))
    number = F.coalesce(F.nullif(F.regexp_extract(first, _PART, 1), F.lit("")).cast("int") - 1, F.lit(0))
    of = F.coalesce(F.nullif(F.regexp_extract(first, _PART, 2), F.lit("")).cast("int"), F.lit(1))
    own = F.col("actual") if "actual" in checked.columns else F.sha2("body", 256)
    # written once, without the texts: what follows asks it several times
    said = cut(checked.select("report", "part", "valid", number.alias("number"), of.alias("of"), F.nullif(F.regexp_extract(last, _ROOT, 1), F.lit("")).alias("root"), own.alias("sum")))
    bad = said.filter(~F.coalesce("valid", F.lit(False))).select("report", "part", F.lit("altered").alias("problem"))
    moved = said.filter("part <> number").select("report", "part", F.lit("misplaced").alias("problem"))
    counts = said.groupBy("report", "number").agg(F.count("*").alias("n"))
    twice = counts.filter("n > 1").select("report", F.col("number").alias("part"), F.lit("doubled").alias("problem"))
    wanted = said.groupBy("report").agg(F.max("of").alias("of")).select("report", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("number"))
    absent = wanted.join(counts, ["report", "number"], "left_anti").select("report", F.col("number").alias("part"), F.lit("missing").alias("problem"))
    found = bad.unionByName(moved).unionByName(twice).unionByName(absent)
    whole = said.join(found.select("report").distinct(), "report", "left_anti")
    sums = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("root").isNull(), F.struct("number", "sum")))), lambda x: x["sum"]), "")
    roots = whole.filter("of > 1").groupBy("report").agg(F.max("root").alias("root"), F.sha2(sums, 256).alias("true"))
    foreign = roots.filter(~F.col("root").eqNullSafe(F.col("true"))).select("report", F.lit(None).cast("int").alias("part"), F.lit("foreign").alias("problem"))
    return found.unionByName(foreign)


def report_files(checked: DataFrame, *carry: str, outer: bool = False) -> DataFrame:
    """file, the columns to carry, nth, filename, fields: the file sections of reports; the label is what stands in the first columns.

    With ``outer`` a report without any gives a row without a filename.
    """
    sections = F.slice(F.split("body", r"(?:^|\r?\n)File\r?\n", -1), 2, 2_147_483_647)
    rows = checked.select("file", *carry, (F.posexplode_outer if outer else F.posexplode)(sections).alias("nth", "section"))
    labelled = F.filter(F.split("section", r"\r?\n"), lambda x: x.rlike(r"^ {5}[A-Z][^ ].{18,}") & ~x.startswith("     Filename "))
    pairs = F.transform(labelled, lambda x: F.struct(F.btrim(F.substring(x, 6, 20)).alias("key"), F.btrim(F.substring(x, 27, 2_147_483_647)).alias("value")))
    return rows.select("file", *carry, "nth", F.regexp_extract("section", r"(?m)^ {5}Filename (.*?)\r?$", 1).alias("filename"), F.map_from_entries(_last_of_each(pairs)).alias("fields"))
