"""Quality rules: text statistics and line frequencies across the documents of one host.

Lines are normalised (lower case, digits as one 0, outer white space off) and hashed with their
host. A line in more than `max_docs` distinct documents of its host is removed from all of them
but its holder. A row that keeps under `min_left` of its words is depleted and rejected.

The holder is the first row (smallest id) that stays. Depletion is decided with the first row that passes the
base rules as the holder. Where that one is depleted, the first row that is not takes its place and only gains
words. Where all are depleted, the first of them stays as it is, with all its lines, so that one full copy of a
shared text stays. Rows that fail the base rules hold a line only if no other row has it.

Null texts have no words and fail the base rule; a null host is a host of its own. Each row is judged by its own
text, also if its id is repeated or null (see `row_key`). Rows of one id count as one document for the
limit; rows with a null id are documents of their own, after all others in order. Equal rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .near import kept_table
from .text import SPACE_WORD, grams, let, row_key, words

SALTS = 16


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(F.coalesce(host.cast("string"), F.lit("")), F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "0"))


def lines_of(text) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(SPACE_WORD))


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of three that occurs at least twice in the text."""
    def covered(g):
        marked = F.array_sort(F.transform(g, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i"))))

        def starts(s):
            n = F.size(s)
            hit = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
        return let(marked, starts)
    return F.when(F.size(w) >= 3, let(grams(w, 3), covered)).otherwise(0).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and row, with the base statistics and the base verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", row_key("doc_id", "source", "text").alias("row"), let(words(text, SPACE_WORD), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"))).alias("s"))
    return one.select("doc_id", "row", "s.*").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def folded(lines: Column) -> Column:
    """(key, n) of the distinct keys among (key, n) lines, n being the words of all copies."""
    def runs(s):
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i - 1)["key"] != F.get(s, i)["key"]))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(s, i)["key"].alias("key"), (F.get(s, i)["n"] * (F.coalesce(F.get(at, j + 1), F.size(s)) - i)).alias("n"))))
    return let(F.array_sort(lines), runs)


def common_lines(docs: DataFrame, base: DataFrame, max_docs: int) -> DataFrame:
    """(row, key, n, id, base_failed, n_words) of the lines over the limit, once for equal rows."""
    # copies of a line inside a document are folded where the document is read
    line = docs.select(row_key("doc_id", "source", "text").alias("row"), "doc_id", F.explode(folded(F.transform(lines_of(F.col("text")), lambda x: F.struct(
        line_key(F.col("source"), x).alias("key"), F.regexp_count(x, F.lit(SPACE_WORD)).cast("bigint").alias("n"))))).alias("l")).select("row", "doc_id", "l.key", "l.n")
    # rows are at least as many as documents; documents are counted on what is left
    many = line.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > max_docs).drop("rows")
    found = by_key(line, many).dropDuplicates(["row", "key"])
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("own"))
    found = kept_table(found.select("row", "key", "n", order.alias("id")).join(base.select("row", "base_failed", "n_words").dropDuplicates(["row"]), "row"))
    common = found.groupBy("key").agg(F.count_distinct("id").alias("docs")).where(F.col("docs") > max_docs).drop("docs")
    return by_key(found, common)


def by_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Join by key; a hot key is salted."""
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(keys, ["key", "salt"]).drop("salt")


def with_holders(found: DataFrame, state) -> DataFrame:
    """held: the row holds the line; orphan: the holder's state is not 0. The least state comes first, then the least id."""
    rank = F.struct(state.alias("state"), "id", "row")
    holder = found.groupBy("key").agg(F.min(rank).alias("holder"))
    out = by_key(found, holder).withColumn("orphan", F.col("holder.state") != 0)
    return out.withColumn("held", F.col("holder.row") == F.col("row")).drop("holder")


def removed_lines(docs: DataFrame, base: DataFrame, max_docs: int, min_left: float) -> DataFrame:
    """row, removed_words (of every copy), gone (keys of the lines to remove); rows with such lines only."""
    found = with_holders(common_lines(docs, base, max_docs), F.col("base_failed").cast("int"))
    w = W.partitionBy("row")
    left = F.col("n_words") - F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).over(w)
    depleted = left < min_left * F.col("n_words")
    found = found.withColumn("state", F.when(F.col("base_failed"), 2).when(depleted, 1).otherwise(0)).drop("orphan", "held")
    found = with_holders(kept_table(found), F.col("state"))
    # the first of a line that only depleted rows have stays whole
    whole = F.max(F.col("orphan") & F.col("held") & ~F.col("base_failed")).over(w)
    gone = found.withColumn("whole", whole).where("not held and not whole")
    return gone.groupBy("row").agg(F.sum("n").alias("removed_words"), F.collect_list("key").alias("gone"))


def judged(docs: DataFrame, max_docs: int, min_left: float) -> DataFrame:
    """One row per input row: row, statistics, removed_words, gone, base_failed, kept."""
    base = kept_table(statistics(docs))
    out = base.join(removed_lines(docs, base, max_docs, min_left), "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))


def verdicts(docs: DataFrame, max_docs: int = 50, min_left: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, statistics, words in removed lines, base_failed, kept.

    Only hashes and counts are shuffled; texts stay where they are read.
    """
    out = judged(docs, max_docs, min_left)
    stats = [c for c in out.columns if c not in ("row", "doc_id", "gone", "removed_words", "kept")]
    return out.select("doc_id", *stats, "removed_words", "kept")


def clean(docs: DataFrame, max_docs: int = 50, min_left: float = 0.5) -> DataFrame:
    """Rows that pass, without their removed lines; the columns stay as they are."""
    cols = docs.columns
    good = judged(docs, max_docs, min_left).where("kept").select(F.col("row").alias("__row"), F.col("gone").alias("__gone")).dropDuplicates(["__row"])
    kept = docs.withColumn("__row", row_key("doc_id", "source", "text")).join(good, "__row")
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(SPACE_WORD) | ~F.array_contains(F.col("__gone"), line_key(F.col("source"), x)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return kept.withColumn("text", text).select(*cols)
