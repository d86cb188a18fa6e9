"""Scalar text rules: blanks, "NA", numbers, lists, keys. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# PRJ-02 -----------------------------------------------------------------
def is_na(c) -> Column:
    """True where the text says "not applicable" (a value of its own, not NULL)."""
    return F.coalesce(F.upper(F.trim(_c(c).cast("string"))) == "NA", F.lit(False))


def norm_text(c) -> Column:
    """Trimmed text; blank and NA become NULL."""
    t = F.trim(_c(c).cast("string"))
    return F.when((t != "") & (F.upper(t) != "NA"), t)


def blank_na(c) -> Column:
    """Text for a sink: NULL and NA become the empty string."""
    return F.coalesce(norm_text(c), F.lit(""))


def first_nonblank(*cols) -> Column:
    return F.coalesce(*[norm_text(c) for c in cols])


def try_int(c) -> Column:
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def try_float(c) -> Column:
    return F.trim(_c(c).cast("string")).try_cast("double")


def json_list(c) -> Column:
    """JSON array to array<string>; another JSON value becomes a one-element list; bad JSON is empty."""
    t = norm_text(c)
    empty = F.array().cast("array<string>")
    scalar = F.try_variant_get(F.try_parse_json(t), "$", "string")
    return F.when(t.isNull() | F.try_parse_json(t).isNull(), empty).when(
        F.substring(t, 1, 1) == "[", F.coalesce(F.from_json(t, "array<string>"), empty)
    ).otherwise(F.coalesce(F.array(scalar), empty))


def id_list(c) -> Column:
    """Id list given as a JSON array or as text joined by "+" or ","; blanks and NA are dropped."""
    t = norm_text(c)
    items = F.when(
        t.rlike(r"^\[") & F.try_parse_json(t).isNotNull(), F.from_json(t, "array<string>")
    ).otherwise(F.split(t, r"[+,]"))
    kept = F.filter(F.transform(items, norm_text), lambda x: x.isNotNull())
    return F.coalesce(kept, F.array().cast("array<string>"))


# PRJ-03 -----------------------------------------------------------------
def distinct_ints(c) -> Column:
    """Distinct integers of a text list, first-seen order."""
    return F.array_distinct(F.filter(F.transform(_c(c), try_int), lambda x: x.isNotNull()))


def resolve_ids(note_ids, connected, start, end) -> Column:
    """First nonempty of: id list, connected list, the two endpoints."""
    a, b = distinct_ints(json_list(note_ids)), distinct_ints(json_list(connected))
    ends = F.array_distinct(F.array_compact(F.array(try_int(start), try_int(end))))
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(ends)


# PRJ-14 -----------------------------------------------------------------
def page_number(c) -> Column:
    """Number at the end of a page name."""
    return F.regexp_extract(_c(c), r"([0-9]+)$", 1).try_cast("int")


def safe_id(c, fallback: str) -> Column:
    cleaned = F.regexp_replace(F.trim(_c(c)), r"[^A-Za-z0-9_.-]+", "-")
    cleaned = F.regexp_replace(cleaned, r"^[-._]+|[-._]+$", "")
    return F.when(cleaned != "", cleaned).otherwise(F.lit(fallback))


def bbox_key(page, line) -> Column:
    return F.concat(_c(page).cast("string"), F.lit(":Y"), _c(line).cast("string"))


def natural_key(c) -> Column:
    """Sort key under which "p2" comes before "p10"."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    padded = F.transform(
        parts,
        lambda x: F.when(
            x.rlike("^[0-9]+$"),
            F.concat(F.repeat(F.lit("0"), F.greatest(20 - F.length(x), F.lit(0))), x),
        ).otherwise(F.lower(x)),
    )
    return F.array_join(padded, "")


# PRJ-18 -----------------------------------------------------------------
def anchor_list(c) -> Column:
    """Numbers of a list written with mixed separators (spaces, commas, semicolons, bars)."""
    parts = F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"[\s,;，、；|/]+"), lambda x: x != "")
    return F.transform(parts, try_int)


def parse_anchors(c) -> Column:
    """struct(anchors, error): anchors must be positive and strictly increasing."""
    a = anchor_list(c)
    bad = F.exists(a, lambda x: x.isNull())
    low = F.exists(a, lambda x: x < 1)
    pairs = F.arrays_zip(
        F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))).alias("p"),
        F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))).alias("q"),
    )
    unordered = F.exists(pairs, lambda z: z["p"] >= z["q"])
    error = (
        F.when(bad, "not_a_number").when(low, "not_positive").when(unordered, "not_increasing")
    )
    return F.struct(F.when(error.isNull(), a).alias("anchors"), error.alias("error"))


# SNK-03 -----------------------------------------------------------------
def basename(c) -> Column:
    return F.coalesce(F.substring_index(_c(c), "/", -1), F.lit(""))


def camel_words(c) -> Column:
    """Words joined with their first letters raised."""
    words = F.regexp_extract_all(_c(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), ""
    )


def micros(c) -> Column:
    """Microseconds since the epoch of a timestamp without time zone; no session zone involved."""
    t = _c(c)
    seconds = (
        F.unix_date(t.cast("date")).cast("bigint") * 86400
        + F.hour(t) * 3600 + F.minute(t) * 60
    )
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
