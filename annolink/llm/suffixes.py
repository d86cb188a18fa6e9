"""Repeated passages from a sparse suffix array.

A word is repeated if it lies in a window of MIN_WORDS words that occurs at two places or more. Each window
belongs to its minimiser, the place of the least hash of GRAM words among its first WINDOW places; equal
windows have the same one, and at least SEED words of the window follow it. A suffix is kept at each
minimiser, with exactly the words of the windows that belong to it.

1. Suffixes are sorted over the cluster (range partitions by suffix, prior words, document and place, so that a
   passage of a third of all rows is spread). The longer of the common prefixes with both neighbours is the
   longest with any suffix, so it tells which windows can be repeated at all. A row that equals its neighbour in
   all words is repeated as a whole; one row of such a run stands for its words in step 2.
2. Texts that have such windows are read again. 64-bit hashes of the exact words of these windows are sorted in
   the same way; equal neighbours are repeated windows, whatever stands to the left or right of them.

Step 1 compares words by 8-bit hashes, which can only name windows too many; rows
count as equal in all words if a 64-bit hash of all their words agrees as well. Null and empty texts have no words.
Each row is judged by its own text, whatever its id: rows of one id are rows like any others, ids may be null, and
equal rows of one id repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .near import LOWER, pieces
from .text import ITEM_WORD, lower_ascii, row_key

GRAM, WINDOW, SEED, MIN_WORDS = 8, 24, 28, 51
#: Bytes that ITEM_WORD does not hold become blanks; all bytes of a character outside ASCII belong to words.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def terms_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, as ITEM_WORD finds them after lower-casing A-Z."""
    return (text or b"").translate(FOLD).split()


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers of all windows of MIN_WORDS words, and the first and last start of the windows of each."""
    n = len(h) - GRAM + 1
    mix = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    view = np.lib.stride_tricks.sliding_window_view(mix, WINDOW)[:len(h) - MIN_WORDS + 1]
    # places never fall, so the windows of one minimiser are neighbours
    place, first, many = np.unique(view.argmin(axis=1) + np.arange(len(view)), return_index=True, return_counts=True)
    return place, first, first + many - 1


def word_hashes(terms) -> np.ndarray:
    return pd.util.hash_array(np.asarray(terms, dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words from first to end - 1, from running sums of a polynomial (modulo 2 ** 64)."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(len(h) + 1, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(h) * up[:-1], dtype=np.uint64)])
    return mixed((total[end] - total[first]) * down[first]).view(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """key, pos, suffix (seed and what follows), prior (words before, nearest first), whole (hash of all their words).

    A few texts at a time: their words, as Python objects, are many times a text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [[], [], [], [], []]
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                terms = terms_of(text)
                if len(terms) < MIN_WORDS:
                    continue
                h = word_hashes(terms)
                short = (h & np.uint64(0xFF)).astype(np.uint8)
                ahead, behind = short.tobytes(), short[::-1].tobytes()
                place, firsts, lasts = minimisers(h)
                for x, values in zip(out, (
                        [key] * len(place), place.tolist(), [ahead[p:last + MIN_WORDS] for p, last in zip(place.tolist(), lasts.tolist())],
                        [behind[len(h) - p:len(h) - first] for p, first in zip(place.tolist(), firsts.tolist())],
                        span_hashes(h, firsts, lasts + MIN_WORDS).tolist())):
                    x += values
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["key", "pos", "suffix", "prior", "whole"])

    return docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key bigint, pos bigint, suffix binary, prior binary, whole bigint")


def reach(a: bytes, b: bytes) -> int:
    """Leading equal words of two suffixes; 0 if their seeds differ."""
    n = min(len(a), len(b))
    if a[:SEED] != b[:SEED]:
        return 0
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(SEED, n) if a[i] != b[i])


def windows_within(row, right: int) -> tuple[int, int] | None:
    """First and last start of the windows of a suffix with at most `right` of its words."""
    least, many = MIN_WORDS - min(right, len(row[2])), len(row[3])
    return (row[1] - many, row[1] - max(least, 0)) if least <= many else None


FOUND = "key bigint, first bigint, last bigint, twin boolean, pos bigint, suffix binary, prior binary, whole bigint, right bigint"


def matches(sorted_suffixes: DataFrame, ends: bool) -> DataFrame:
    """Rows equal to a neighbour as twin (first, last) words, starts of windows that can be repeated as (first, last), and
    the first and last suffix of each task as edges (pos, suffix, prior, whole, right so far). ends: the rows are all
    edges, in one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [x.split()[0] for x in FOUND.split(", ")]
        kinds = {x: "Int64" for x in ("key", "first", "last", "pos", "whole", "right")}

        def settled(row, right, twin, edge):
            if edge and not ends:
                out.append((row[0], None, None, False, *row[1:5], right))
            elif right and (ends or not twin):
                starts = windows_within(row, right)
                if starts:
                    out.append((row[0], *starts, False, None, None, None, None, None))

        held, right, twin, edge = None, 0, False, True
        for b in batches:
            out = []
            for row in zip(b["key"], b["pos"], b["suffix"], b["prior"], b["whole"], b["right"]):
                if held is None:
                    held, right = row, row[5]
                    continue
                r = reach(held[2], row[2])
                same = held[4] == row[4] and held[2] == row[2] and held[3] == row[3]
                if same:
                    out += [(x[0], x[1] - len(x[3]), x[1] + r - 1, True, None, None, None, None, None) for x in (held, row)]
                settled(held, max(right, r), twin, edge)
                held, right, twin, edge = row, max(r, row[5]), same, False
            yield pd.DataFrame(out, columns=cols, dtype=object).astype(kinds)
        if held is not None:
            out = []
            settled(held, right, twin, True)
            yield pd.DataFrame(out, columns=cols, dtype=object).astype(kinds)

    return sorted_suffixes.mapInPandas(run, FOUND)


def windows_of(texts: DataFrame) -> DataFrame:
    """key, first and hash of the exact words of each window that starts in one of the ranges of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 32):
            for key, text, ranges in zip(*(b.column(c).to_pylist() for c in ("key", "text", "ranges"))):
                h = word_hashes(terms_of(text))
                first = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges]))
                columns = [pa.array(np.full(len(first), key, dtype=np.int64)), pa.array(first), pa.array(span_hashes(h, first, first + MIN_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "first", "content"])

    return texts.select("key", F.col("text").cast("binary").alias("text"), "ranges").mapInArrow(run, "key bigint, first bigint, content bigint")


def equal_windows(sorted_windows: DataFrame) -> DataFrame:
    """key, first, content of rows whose content is a neighbour's, and the first and last row of each task as edges."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = None, 0
        for b in batches:
            if not len(b):
                continue
            rows += len(b)
            b = b.assign(edge=False)
            if held is None:
                yield b.iloc[:1].assign(edge=True)
            else:
                b = pd.concat([held, b], ignore_index=True)
            content = b["content"].to_numpy()
            equal = np.zeros(len(b), dtype=bool)
            equal[1:] = content[1:] == content[:-1]
            equal[:-1] |= equal[1:]
            yield b[equal]
            held = b.iloc[-1:]
        if rows > 1:
            yield held.assign(edge=True)

    return sorted_windows.mapInPandas(run, "key bigint, first bigint, content bigint, edge boolean")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeat_words, spans [first, last] of repeated passages; a row per document."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism * 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    order = ["suffix", "prior", "whole", "key", "pos"]
    ranked = suffixes(rows).withColumn("right", F.lit(0).cast("bigint")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = settle(matches(ranked, ends=False))
    # at most two rows per task: neighbours that lie in different tasks
    edges = settle(matches(found.where("suffix is not null").select("key", "pos", "suffix", "prior", "whole", "right").repartition(1).sortWithinPartitions(*order), ends=True))
    found = found.where("suffix is null").unionByName(edges)
    # one text per key: equal rows share it
    ranges = found.where("not twin").groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    texts = rows.select("key", "text").join(ranges.select("key"), "key", "left_semi").dropDuplicates(["key"]).join(ranges, "key")
    order = ["content", "key", "first"]
    windows = settle(equal_windows(windows_of(texts).repartitionByRange(parts, *order).sortWithinPartitions(*order)))
    ends = equal_windows(windows.where("edge").select("key", "first", "content").repartition(1).sortWithinPartitions(*order))
    windows = windows.where("not edge").unionByName(ends.where("not edge")).select("key", "first", (F.col("first") + MIN_WORDS - 1).alias("last"))
    spans = found.where("twin").select("key", "first", "last").unionByName(windows).distinct()
    # spans that touch become one
    w = W.partitionBy("key").orderBy("first", "last")
    reached = spans.withColumn("reach", F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1)))
    island = reached.withColumn("nth", F.sum(F.when(F.col("reach") >= F.col("first") - 1, 0).otherwise(1)).over(w))
    merged = island.groupBy("key", "nth").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    per = merged.groupBy("key").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    total = rows.select("doc_id", "key", F.regexp_count(lower_ascii(F.col("text")), F.lit(ITEM_WORD)).cast("bigint").alias("n_words"))
    return total.join(per, "key", "left").select("doc_id", "n_words", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_repeat_words"),
                                                 F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("spans"))
