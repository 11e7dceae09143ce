"""Classifications of verdicts, errors, savings and hashes. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verilake.functions.text import NULL_MD5

# What the messages of a failed file access say.
PERMISSION_PHRASES = (
    "access is denied",
    "permission denied",
    "unauthorizedaccess",
    "unauthorized access",
    "not authorized",
    "read-only",
    "readonly",
)
# A decoder that says this will fail again.
FATAL_PHRASES = (
    "FLAC__STREAM_DECODER_ERROR_STATUS_LOST_SYNC",
    "while decoding FLAC input, state = FLAC__STREAM_DECODER_ABORTED",
)

STATUSES = ("OK", "WARN", "RETRY", "FAIL", "SKIPPED", "CANCELED")


def is_permission_error(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(PERMISSION_PHRASES)), F.lit(False))


def is_fatal_error(text: Column) -> Column:
    """Whether the input itself is broken, so that no further try helps; in either case of letters."""
    said = [F.contains(F.lower(text), F.lit(phrase.lower())) for phrase in FATAL_PHRASES]
    return F.coalesce(said[0] | said[1], F.lit(False))


def permission_message(operation: str, path: Column, detail: Column) -> Column:
    """What went wrong, where, and the system's own words; null if it isn't about permissions."""
    given = lambda c: F.when(F.coalesce(F.btrim(c), F.lit("")) != "", c)
    parts = F.concat_ws(" | ", F.lit(f"Permission denied while {operation}"), F.concat(F.lit("Path: "), given(path)), F.concat(F.lit("Detail: "), given(detail)))
    return F.when(is_permission_error(detail), parts)


def failure_reason(reason: Column, exit_code: Column, detail: Column, path: Column, operation: str = "converting file") -> Column:
    """A permission message, else the given reason, else the exit code, else that there was no output."""
    given = F.when(F.coalesce(F.btrim(reason), F.lit("")) != "", reason)
    plain = F.coalesce(given, F.when(exit_code != 0, F.format_string("encoder exit %d", exit_code)), F.lit("encoder gave no output"))
    out = F.coalesce(permission_message(operation, path, detail), plain)
    return F.when(is_fatal_error(detail), F.concat(out, F.lit(" (not retryable: corrupt input)"))).otherwise(out)


def error_class(text: Column) -> Column:
    return F.when(F.coalesce(F.btrim(text), F.lit("")) == "", "none").when(is_permission_error(text), "permission").when(is_fatal_error(text), "corrupt").otherwise("other")


def savings_tier(pct: Column) -> Column:
    return F.when(pct >= 20, "excellent").when(pct >= 10, "good").when(pct >= 5, "fair").when(pct > 0, "poor").otherwise("none")


def savings_tier_fine(pct_text: Column) -> Column:
    """Of a percentage as text; what is no number is ``unknown``."""
    pct = F.rtrim(F.btrim(pct_text), F.lit("%")).try_cast("double")
    return (
        F.when(pct.isNull(), "unknown").when(pct >= 20, "exceptional").when(pct >= 15, "very high").when(pct >= 10, "high").when(pct >= 6, "strong")
        .when(pct >= 3, "moderate").when(pct > 1, "light").when(pct > 0, "minimal").when(pct == 0, "unchanged").otherwise("larger")
    )


def event_class(verification: Column, detail: Column | None = None) -> Column:
    """bad, good, warning or other, by how the verification (else the detail) text begins or what it holds."""
    text = F.when(F.coalesce(verification, F.lit("")) != "", verification)
    v = F.lower(F.coalesce(text, detail if detail is not None else F.lit(""), F.lit("")))
    return F.when(v.startswith("mismatch") | v.startswith("fail"), "bad").when(v.startswith("match") | (v == "ok"), "good").when(v.contains("warn") | v.contains("error"), "warning").otherwise("other")


def event_class_exact(verification: Column) -> Column:
    """The older form, by the exact text."""
    return F.when(F.coalesce(F.btrim(verification), F.lit("")) == "", "none").when(verification == "MATCH|NEW", "new").when(verification == "MATCH", "good").when(verification == "MISMATCH", "bad").otherwise("other")


def verdict(pre: Column, out: Column, emb: Column) -> Column:
    """How the hash before, the hash after and the embedded one agree."""
    both, only_out = pre.isNotNull() & out.isNotNull(), pre.isNull() & out.isNotNull()
    unset = emb.isNull() | (emb == NULL_MD5)
    return (
        F.when(both & (pre == out) & unset, "MATCH|NEW").when(both & (pre == out), "MATCH")
        .when(only_out & ~unset & (out == emb), "MATCH|EMB").when(only_out, "FAIL|NO_SRC")
        .when(both, F.concat(F.lit("FAIL|MISMATCH src="), F.left(pre, F.lit(8)), F.lit(" out="), F.left(out, F.lit(8))))
        .otherwise("FAIL|NO_HASH")
    )


def passed(verdict_text: Column) -> Column:
    return verdict_text.startswith("MATCH")


def hash_agreement(pre: Column, out: Column, emb: Column) -> tuple[Column, Column, Column]:
    """(emb, pre, out): match, mismatch, warn, missing or neutral for each hash."""
    real = lambda h: h.isNotNull() & (h != NULL_MD5) & (h != "")
    p, o, e = real(pre), real(out), real(emb)
    pre_class = F.when(o & p, F.when(pre == out, "match").otherwise("mismatch")).when(o, "missing").when(p & e, F.when(emb == pre, "match").otherwise("warn")).otherwise("neutral")
    out_class = F.when(~o, "neutral").when(p, F.when(pre == out, "match").otherwise("mismatch")).when(e, F.when(emb == out, "match").otherwise("mismatch")).otherwise("warn")
    emb_class = F.when(~e, "missing").when(p, F.when(emb == pre, "match").otherwise("warn")).when(o, F.when(emb == out, "match").otherwise("warn")).otherwise("neutral")
    return emb_class, pre_class, out_class


def embedded_stale(pre: Column, out: Column, emb: Column) -> Column:
    """The file agrees with itself but not with the hash inside it."""
    return F.coalesce((pre == out) & (emb != NULL_MD5) & (emb != pre), F.lit(False))


def image_type(content: Column, mime: Column | None = None) -> Column:
    """png or jpeg by the first bytes, else by the MIME type, else null."""
    by_mime = F.when(F.lower(mime).rlike("png"), "png").when(F.lower(mime).rlike("jpe?g"), "jpeg") if mime is not None else F.lit(None).cast("string")
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(F.when(F.octet_length(content) < 4, F.lit(None)).when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg"), by_mime)


def compression_ratio(out_bytes: Column, raw_bytes: Column) -> Column:
    return F.when(raw_bytes > 0, out_bytes / F.nullif(raw_bytes, F.lit(0))).otherwise(1.0)


def has_marker(comments: Column, tag: str) -> Column:
    """Whether a list of NAME=value texts has the tag, in any case."""
    return F.exists(comments, lambda c: F.startswith(F.upper(c), F.lit(tag.upper() + "=")))


def marker_value(version: Column, library: Column, at: Column) -> Column:
    """The JSON text that marks a processed file."""
    return F.to_json(F.struct(F.lit(True).alias("processed"), version.alias("version"), library.alias("library"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("time")))


def cleanup_summary(net: Column, raw: Column, blocks: Column, changed: Column) -> Column:
    """What was won on pictures and padding, in words."""
    from verilake.functions.text import format_bytes_padded

    size = lambda c: F.btrim(format_bytes_padded(c))
    plural = F.when(blocks == 1, "").otherwise("s")
    return (
        F.when((net > 0) & (blocks > 0), F.concat(size(net), F.lit(" net ("), size(raw), F.lit(" raw image, "), blocks.cast("string"), F.lit(" block"), plural, F.lit(")")))
        .when(net > 0, F.concat(size(net), F.lit(" net (padding only)")))
        .when(changed & (blocks > 0), F.concat(F.lit("no change of size ("), size(raw), F.lit(" raw image)")))
        .when(changed, "no change of size (padding only)")
        .otherwise("none")
    )
