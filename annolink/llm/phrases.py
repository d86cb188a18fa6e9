"""Benchmark decontamination with a distributed positional inverted index.

The index holds (term, doc_id, pos). A test window asks for its rarest terms first: the lists of the
two rarest are shifted by the terms' places in the window and intersected, and what is left is
compared word by word. Only lists of asked terms are written out. Null and empty texts have no
words; an item without words asks nothing; equal windows of several items are searched once;
each input row is searched by itself and gives one result row, also if its id is repeated or null: rows
are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .text import ANY_CASE, ITEM_WORD, grams, let, lower_ascii, lower_word, row_key, words

#: Terms asked for are broadcast up to this number (some 30 MB); beyond it they are joined by a shuffle.
SMALL = 200_000


def windows_of(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(wid, terms) of distinct windows, and (wid, item_id)."""
    one = items.select("item_id", F.explode(grams(words(lower_ascii(F.col("text")), ITEM_WORD), n)).alias("phrase"))
    one = settle(one.select(F.xxhash64("phrase").alias("wid"), "phrase", "item_id").distinct())
    return one.select("wid", F.split("phrase", " ").alias("terms")).dropDuplicates(["wid"]), one.select("wid", "item_id")


def limited(asked: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(asked) if rows <= SMALL else asked


def postings(docs: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """Positional lists of the terms asked for, with what asks for them."""
    every = docs.select("doc_id", F.posexplode(words(F.col("text"), ANY_CASE)).alias("pos", "term"))
    return every.withColumn("term", lower_word(F.col("term"))).join(limited(asked, rows), "term")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, wid, start, len) of all exact occurrences of the windows."""
    docs = docs.select(row_key("doc_id", "text").alias("row"), "text")
    slots = windows.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    vocabulary = settle(slots.select("term").distinct())
    n_terms = vocabulary.count()
    every = docs.select(F.explode(words(F.col("text"), ANY_CASE)).alias("term")).select(lower_word(F.col("term")).alias("term"))
    df = every.join(limited(vocabulary, n_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # the rarest two places of each window; a window with a term that no document has is dropped
    ranked = slots.join(df, "term", "left").groupBy("wid", "len").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term"))).alias("r"))
    ranked = settle(ranked.where(F.col("r")[0]["df"] > 0).select("wid", "len", F.slice("r", 1, 2).alias("r")))
    probes = ranked.select("wid", "len", F.size("r").alias("need"), F.explode("r").alias("x")).select("wid", "len", "need", "x.off", "x.term")
    n_probes = probes.count()
    lists = postings(docs.withColumnRenamed("row", "doc_id"), probes, n_probes)
    shifted = lists.where("pos >= off").withColumnRenamed("doc_id", "row")
    met = shifted.groupBy("row", "wid", (F.col("pos") - F.col("off")).alias("start")).agg(
        F.count_distinct("off").alias("got"), F.first("need").alias("need"), F.first("len").alias("len"))
    met = met.where("got = need").select("row", "wid", "start", "len")
    met = settle(met)
    holders = met.select("row").distinct()
    n_holders = holders.count()
    text = docs
    if n_holders <= SMALL:
        # texts without a candidate stay where they are; beyond that number the join below moves texts, not words
        text = docs.join(F.broadcast(holders), "row", "left_semi")
    asked = met.join(windows.select("wid", "terms"), "wid").groupBy("row").agg(F.collect_list(F.struct("wid", "start", "len", "terms")).alias("m"))
    # the words of a text are taken once, not once for each of its windows
    exact = asked.join(text, "row").select("row", let(words(lower_ascii(F.col("text")), ITEM_WORD), lambda w: F.filter(
        "m", lambda x: F.slice(w, x["start"] + 1, x["len"]) == x["terms"])).alias("m"))
    return exact.select("row", F.explode("m").alias("m")).select("row", "m.wid", "m.start", "m.len")


def near(docs: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """Proximity: (doc_id, pos, other) where two terms stand at most `within` words apart, at different places."""
    asked = docs.sparkSession.createDataFrame([(term,) for term in sorted({first, second})], "term string")
    lists = postings(docs, asked, 2).withColumn("cell", F.floor(F.col("pos") / (within + 1)))
    a = lists.where(F.col("term") == first).select("doc_id", "pos", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    b = lists.where(F.col("term") == second).select("doc_id", F.col("pos").alias("other"), "cell")
    return a.join(b, ["doc_id", "cell"]).where((F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other"))).select("doc_id", "pos", "other")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, item ids, contaminated."""
    windows, owners = windows_of(items, n)
    windows = settle(windows)
    found = settle(occurrences(docs, windows).distinct())
    hit = found.groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list(
        F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))))).cast("bigint").alias("n_hit"))
    which = found.select("row", "wid").distinct().join(owners, "wid").groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    total = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE)).cast("bigint").alias("n_words"))
    out = total.join(hit, "row", "left").join(which, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Rows without any test window; all columns stay."""
    windows, _ = windows_of(items, n)
    bad = occurrences(docs, settle(windows)).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row_key("doc_id", "text")).join(bad, "__row", "left_anti").select(*docs.columns)
