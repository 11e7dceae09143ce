"""Names, paths, URIs, numbers and times as text. All are column expressions.

Numbers are rounded in whole hundredths, half up, and only then made into text,
so that two engines print the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MD5 = "0" * 32  # stands for "no checksum embedded"


def leaf_name(path: Column) -> Column:
    """What follows the last / or \\ of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def collection_label(roots: Column) -> Column:
    """The last part of the only root, the root itself if it has no parts, or the number of roots."""
    first = F.get(roots, F.lit(0))
    leaf = F.try_element_at(F.filter(F.split(first, r"[/\\]"), lambda p: p != ""), F.lit(-1))
    return F.when(F.size(roots) > 1, F.format_string("[multifolder] (%d folders)", F.size(roots))).otherwise(F.coalesce(leaf, first))


def safe_name(value: Column, default: str = "job", longest: int = 100) -> Column:
    """A name of letters, digits, dot, underscore, blank and hyphen."""
    clean = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._ \-]", "_"), r" +", " ")
    clean = F.btrim(clean, F.lit(" ."))
    return F.left(F.when(clean == "", default).otherwise(F.coalesce(clean, F.lit(default))), F.lit(longest))


def percent_decoded(uri: Column) -> Column:
    """%XX as UTF-8 bytes; a stray % and a + stay as they are."""
    return F.try_url_decode(F.replace(F.regexp_replace(uri, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def uri_leaf(uri: Column, extension: str = ".flac") -> Column:
    """A file name for a URI: its leaf if that has the extension, else ``type-value`` or a cleaned leaf with it."""
    last = F.regexp_extract(percent_decoded(uri), r"([^/]*)$", 1)
    kind, value = F.regexp_extract(last, r"^([^:]*):", 1), F.regexp_extract(last, r"^[^:]*:(.*)$", 1)
    clean = lambda c, kept: F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{kept}_\-]", "-")
    plain = clean(last, ".")
    return (
        F.when(F.endswith(F.lower(last), F.lit(extension)), last)
        .when(F.contains(last, F.lit(":")) & F.endswith(F.lower(value), F.lit(extension)), value)
        .when(F.contains(last, F.lit(":")), F.concat(kind, F.lit("-"), clean(value, ""), F.lit(extension)))
        .when(F.endswith(F.lower(plain), F.lit(extension)), plain)
        .otherwise(F.concat(plain, F.lit(extension)))
    )


def error_snippet(text: Column, longest: int = 400) -> Column:
    """One line of an error text, cut with dots; ``(none)`` if it is null or blank."""
    line = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(line, F.lit("")) == "", "(none)").when(F.length(line) <= longest, line).otherwise(F.concat(F.left(line, F.lit(longest)), F.lit("...")))


def hundredths(numerator: Column, unit: Column) -> Column:
    """numerator / unit in whole hundredths, half up; both are whole and not negative."""
    return F.call_function("div", numerator * 100 + F.call_function("div", unit, F.lit(2)), unit)


def _fixed(h: Column, width: int = 1) -> Column:
    whole = F.call_function("div", h, F.lit(100)).cast("string")
    whole = F.when(F.length(whole) >= width, whole).otherwise(F.lpad(whole, width, "0"))
    return F.concat(whole, F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(n: Column, units: int = 4, signed: bool = False) -> Column:
    """``-1.50 KB``: whole bytes, else two digits behind the point; + before positive ones if signed."""
    size = F.abs(n)
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i in range(1, units):
        unit = F.lit(1024**i).cast("long")
        out = F.when(size >= unit, F.concat(_fixed(hundredths(size, unit)), F.lit(f" {_UNITS[i]}"))).otherwise(out)
    sign = F.when(n < 0, "-").otherwise("+" if signed else "")
    return F.concat(sign, out)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def format_bytes_padded(n: Column, units: int = 4, signed: bool = False) -> Column:
    """The report's form: a number of at least 00.00 in eight places, clamped at 0 or behind its sign."""
    size = F.abs(n) if signed else F.greatest(n, F.lit(0).cast("long"))
    width = 7 if signed else 8

    def parts(x: Column) -> Column:
        unit, name = F.lit(1).cast("long"), F.lit("B")
        for i in range(1, units):
            least = F.lit(1024**i).cast("long")
            unit, name = F.when(x >= least, least).otherwise(unit), F.when(x >= least, _UNITS[i]).otherwise(name)
        return F.struct(x.alias("x"), unit.alias("unit"), name.alias("name"))

    def shown(p: Column) -> Column:
        number = _let(hundredths(p["x"], p["unit"]), lambda h: _fixed(h, 2))
        return F.concat(_let(number, lambda t: F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, " "))), F.lit(" "), p["name"])

    sign = F.when(n < 0, "-").otherwise(" ") if signed else F.lit("")
    return F.concat(sign, _let(size, lambda x: _let(parts(x), shown)))


def format_bytes_short(n: Column) -> Column:
    """One digit behind the point, up to MB, without a sign."""
    size = F.abs(n)
    tenths = lambda unit: F.call_function("div", size * 10 + F.lit(unit // 2), F.lit(unit).cast("long"))
    text = lambda unit, name: F.concat(F.call_function("div", tenths(unit), F.lit(10)).cast("string"), F.lit("."), (tenths(unit) % 10).cast("string"), F.lit(name))
    return F.when(size >= 1 << 20, text(1 << 20, " MB")).when(size >= 1024, text(1024, " KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def format_bytes_ui(n: Column) -> Column:
    """``0 B`` for nothing or less."""
    return F.when(n <= 0, "0 B").otherwise(format_bytes(n))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def format_elapsed(seconds: Column) -> Column:
    """HH:MM:SS, with days before it from 24 hours on; negative times are 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    clock = F.concat(_two(div(s % 86400, 3600)), F.lit(":"), _two(div(s % 3600, 60)), F.lit(":"), _two(s % 60))
    return F.when(s >= 86400, F.concat(div(s, 86400).cast("string"), F.lit("d "), clock)).otherwise(clock)


def format_elapsed_short(seconds: Column) -> Column:
    """MM:SS below an hour, HH:MM:SS from there on."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    tail = F.concat(_two(div(s % 3600, 60)), F.lit(":"), _two(s % 60))
    return F.when(s >= 3600, F.concat(F.lpad(div(s, 3600).cast("string"), 2, "0"), F.lit(":"), tail)).otherwise(tail)


def format_percent(pct: Column) -> Column:
    """Two digits and %; what rounds to nothing is 0.00, never -0.00."""
    h = F.when(F.abs(pct) < 0.005, F.lit(0)).otherwise(F.floor(F.abs(pct) * 100 + 0.5)).cast("long")
    return F.concat(F.when((pct < 0) & (h > 0), "-").otherwise(""), _fixed(h), F.lit("%"))


def report_datetime(ms: Column) -> Column:
    """``5. March 2026, 4:05`` of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "d. MMMM yyyy, H:mm")


def header_count(n: Column) -> Column:
    """A count in eight places."""
    text = n.cast("string")
    return F.when(F.length(text) >= 8, text).otherwise(F.lpad(text, 8, " "))


def count_pair(left: Column, right: Column) -> Column:
    """``       3 /       10``."""
    return F.concat(header_count(left), F.lit(" / "), header_count(right))


def attempt_of(n: Column, limit: Column) -> Column:
    """``1/3``."""
    return F.concat(n.cast("string"), F.lit("/"), limit.cast("string"))


def label_value(label: str, value: Column, width: int = 20) -> Column:
    """The label filled up to ``width``, a colon, the value."""
    return F.concat(F.lit(label.ljust(width) + ": "), value)


def canonical_path(path: Column) -> Column:
    """A path in one form: forward slashes, none doubled or at the end, ``.`` and ``..`` resolved, ``file:`` dropped, other schemes in lower case.

    Nothing is looked up: links stay as they are.
    """
    slashed = F.translate(path, "\\", "/")
    scheme = F.lower(F.regexp_extract(slashed, r"^([A-Za-z][A-Za-z0-9+.-]+):", 1))
    rest = F.regexp_replace(slashed, r"^[A-Za-z][A-Za-z0-9+.-]+:", "")
    host = F.when(~scheme.isin("", "file"), F.regexp_extract(rest, r"^//([^/]*)", 1)).otherwise("")
    tail = F.when(~scheme.isin("", "file"), F.regexp_replace(rest, r"^//[^/]*", "")).otherwise(rest)
    rooted = tail.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, F.when(F.size(done) > 0, -1).otherwise(F.lit(None))), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when((part == "..") & rooted, done).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(tail, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.when(~scheme.isin("", "file"), F.concat(scheme, F.lit("://"), host)).otherwise(""), F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


def report_line(label: str, value: Column, width: int = 20) -> Column:
    """Five blanks, the label filled up to ``width`` (longer ones stay whole), a blank, the value."""
    return F.concat(F.lit(" " * 5 + label.ljust(width) + " "), value)


def hash_short(h: Column) -> Column:
    """For narrow places: first 10 and last 6 characters of long hashes."""
    low = F.lower(h)
    return F.when(F.coalesce(F.btrim(h), F.lit("")) == "", "N/A").when(h == NULL_MD5, "NULL-EMBEDDED").when(F.length(low) <= 20, low).otherwise(F.concat(F.left(low, F.lit(10)), F.lit("..."), F.right(low, F.lit(6))))


def hash_full(h: Column) -> Column:
    return F.when(h.isNull(), "(none)").when(h == NULL_MD5, "(null)").otherwise(F.lower(h))
