"""Words, lines and bindings shared by the text operators; everything stays a native expression."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters, digits and everything outside ASCII. Stated as what belongs to a word: Java matches the
#: complement of the ASCII rest, which is the same set, several times slower.
ITEM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same words in a text whose capitals still stand, for counts.
ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Words are runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def lower_word(c) -> Column:
    """lower_ascii for one word: ASCII words, which are most, by the faster general function."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(lower_ascii(c))


def words(c, pattern: str) -> Column:
    """All words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate a value once per row and use it many times inside body(value)."""
    return F.transform(F.array(value), body)[0]


def grams(w: Column, n: int) -> Column:
    """Texts of all windows of n words; fewer words (but not none) are one window."""
    def windows(v):
        size = F.size(v)
        shifted = F.arrays_zip(*[F.slice(v, F.lit(i + 1), F.greatest(size - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)])
        return F.when(size >= n, F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)]))) \
            .when(size > 0, F.array(F.array_join(v, " "))).otherwise(F.array().cast("array<string>"))
    return let(w, windows)


def row_key(*cols: str) -> Column:
    """64-bit hash of the columns a verdict rests on: equal rows share it, a null differs from every value, and
    rows of one id with different texts are told apart."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """Deal rows evenly over all tasks where the input has fewer splits than the session has slots; else leave it alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(4 * slots)
