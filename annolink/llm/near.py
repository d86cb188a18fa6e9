"""Near-duplicates from bottom-k sketches of one hash function.

A document's set is its distinct shingle hashes in ascending order; the sketch is the bottom k with
k = n - ceil(t n) + 1. Two sets with a similarity of t or more always share a value of their sketches,
because both are prefixes under one order. Equal sets are folded into classes first, and one member
stands for its class.

1. Inverted lists of the sketch values. A member is held against the first of the lists that it meets
   most often; this joins most groups of near copies without pairs.
2. Lists of up to WHOLE members: all members still apart are candidates. The overlap of the sketches
   estimates the similarity; a candidate goes only where so small an overlap has a chance below 1e-12, or where
   step 3 rules it out.
3. Members of longer lists that are still apart get a second sketch of the same size, in which rare
   shingles (by counts in 2**BITS hash buckets) come first. Under any one order similar sets share a value of
   their prefixes, so this loses no link; common passages no longer fill the lists. For TURNS turns each member is
   held against one member of a list, another one in each turn, which joins most groups without pairs. Then members of
   one list that are still apart are candidates if what follows the value in both could hold the overlap and the parities
   of both sets allow it (an exact bound), filtered by the same estimate. No list is cut and no partner is dropped.

Every candidate is confirmed on full sets. Null texts and texts without words have empty sets, linked
with nothing, and stay. Rows of one repeated id are linked with each other; a null id never links.
"""

from __future__ import annotations

import hashlib
import math
import string
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.matching import components
from ..session import ensure_checkpoint_dir, settle

WHOLE, SALTS, SMALL, CROWD, BITS, PARITIES, FOLDS, TURNS = 32, 16, 500_000, 64, 18, 1024, 2, 1
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all windows of `size` words; fewer words are one window."""
    # words are runs without ASCII white space, which bytes.split() knows as such
    terms = (text or "").encode().translate(LOWER).split()
    if not terms:
        return np.zeros(0, dtype=np.int64)
    h = pd.util.hash_array(np.asarray(terms, dtype=object), categorize=False)
    n = max(1, len(h) - size + 1)
    mixed = np.full(n, min(size, len(h)), dtype=np.uint64)
    for i in range(min(size, len(h))):
        mixed = mixed * MIX + h[i:i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that the sets of long texts do not pile up."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_sets(df: DataFrame, size: int) -> DataFrame:
    """The column text is replaced by s, the shingle set."""
    rest = [c for c in df.columns if c != "text"]

    def run(batches):
        for b in pieces(batches, 32):
            got = lists([shingle_set(t, size) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], got], names=[*rest, "s"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(run, f"{schema}, s array<bigint>")


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, digest (g1, g2) of the set, sketch; one row per input row."""
    def run(batches):
        for b in pieces(batches):
            n, g1, g2, low = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, size)
                a, c = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
                n.append(len(s))
                g1.append(int(a))
                g2.append(int(c))
                low.append(s[:len(s) + (-len(s) * percent // 100) + 1] if len(s) else s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), lists(low)],
                                             names=["doc_id", "n", "g1", "g2", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, g1 bigint, g2 bigint, sketch array<bigint>")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Shingle counts of (text) rows in 2**BITS buckets of the hash: a fixed 2 MB, whatever the input."""
    def run(batches):
        total = np.zeros(1 << BITS, dtype=np.int64)
        for b in pieces(batches):
            for text in b.column("text").to_pylist():
                at, n = np.unique(bucket(shingle_set(text, size)), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    table = np.zeros(1 << BITS, dtype=np.int64)
    got = rows.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return table


def bucket(s: np.ndarray) -> np.ndarray:
    return ((s.view(np.uint64) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def rare_first(s: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """As many values as the sketch has, those of the rarest buckets first."""
    if not len(s):
        return s
    k = len(s) + (-len(s) * percent // 100) + 1
    return s[np.lexsort((s, table[bucket(s)]))[:k]]


def parities(s: np.ndarray) -> np.ndarray:
    """PARITIES bits as 64-bit words: whether a set has an odd number of values with these low bits."""
    return np.packbits(np.bincount(s & (PARITIES - 1), minlength=PARITIES) & 1).view(np.int64)


def rare_values(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """node, n, low, odd: the second sketch of (node, text) in order of frequency, and the parities of the set."""
    shared = rows.sparkSession.sparkContext.broadcast(frequencies(rows, size))

    def run(batches):
        for b in pieces(batches, 64):
            sets = [shingle_set(t, size) for t in b.column("text").to_pylist()]
            n = pa.array([len(x) for x in sets], pa.int64())
            low, odd = lists([rare_first(x, shared.value, percent) for x in sets]), lists([parities(x) for x in sets])
            yield pa.RecordBatch.from_arrays([b.column("node"), n, low, odd], names=["node", "n", "low", "odd"])

    kind = rows.schema["node"].dataType.simpleString()
    return rows.select("node", "text").mapInArrow(run, f"node {kind}, n bigint, low array<bigint>, odd array<bigint>")


def short_parities(odd: str) -> Column:
    """The same of fewer of the low bits, PARITIES // FOLDS in all."""
    step = PARITIES // 64 // FOLDS
    return F.array(*[reduce(Column.bitwiseXOR, [F.col(odd)[i + step * j] for j in range(FOLDS)]) for i in range(step)])


def unlike(a: str, b: str, folds: int = 1) -> Column:
    """In how many parities two sets differ: at most the number of values that only one of them has."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITIES // 64 // folds)), F.lit(0))


def may_reach(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """Whether sets of n and m values of which at least `differ` are in one only can reach the similarity."""
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def allowed(pairs: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their parities allow, and those of which a side is not among the rare."""
    both = pairs.join(rare.select(F.col("node").alias("a"), "n", "odd"), "a", "left")
    both = both.join(rare.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("odd").alias("odd_")), "b", "left")
    return both.where(F.coalesce(may_reach(F.col("n"), F.col("m"), unlike("odd", "odd_"), percent), F.lit(True))).select("a", "b")


def still_mixed(rows: DataFrame) -> DataFrame:
    """The rows (v, component) of lists whose members are not all in one component."""
    mixed = rows.groupBy("v").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").select("v")
    return rows.join(mixed, "v", "left_semi")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b)."""
    joined = links.join(label.toDF("a", "node"), "a").join(label.toDF("b", "other"), "b").select("node", "other").distinct()
    joined = kept_table(joined.where("node <> other"))
    upper = components(joined.select("node").union(joined.select("other")).distinct(), joined, []).toDF("component", "upper")
    return kept_table(label.join(upper, "component", "left").select("node", F.coalesce("upper", "component").alias("component")))


def needed(k: Column, percent: int) -> Column:
    """Least overlap of two sketches, the smaller of k values: less has a chance below 1e-12 for a similar pair."""
    p, out = percent / 100 - 0.05, F.lit(1)
    for q in (0.1, 0.2, 0.3, 0.4, 0.5):
        bits = q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))
        out = F.when(k >= math.ceil(27.6 / bits), F.floor(k * q).cast("int")).otherwise(out)
    return out


def bounded(rows: DataFrame) -> DataFrame:
    """Broadcast up to SMALL rows (some 20 MB); beyond it the join shuffles."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose full sets reach the similarity.

    Sets meet at a; an a with many partners is split into cells of about CROWD partners.
    """
    crowd = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).alias("cells"))
    dealt = kept_table(pairs.join(crowd, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell")))
    text = docs.select("doc_id", "text")
    members = with_sets(text.join(bounded(dealt.withColumnRenamed("b", "doc_id")), "doc_id").select("a", "cell", F.col("doc_id").alias("b"), "text"), size)
    heads = kept_table(dealt.select(F.col("a").alias("doc_id"), "cell").distinct())
    heads = with_sets(text.join(bounded(heads), "doc_id").select(F.col("doc_id").alias("a"), "cell", "text"), size).withColumnRenamed("s", "sa")
    both = members.join(heads, ["a", "cell"])
    common = F.size(F.array_intersect("sa", "s"))
    return kept_table(both.where(100 * common >= percent * (F.size("sa") + F.size("s") - common)).select("a", "b").distinct())


def kept_table(df: DataFrame) -> DataFrame:
    """A written table in the shared folder; smaller than a checkpoint of the same rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/lists-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    base = kept_table(sketches(docs, size, percent))
    # classes of equal sets
    full = base.where("n > 0 and doc_id is not null")
    group = ["n", "g1", "g2"]
    first = kept_table(full.groupBy(*group).agg(F.min("doc_id").alias("cid"), F.count("*").alias("rows")))
    many = first.where("rows > 1").drop("rows").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    member = base.drop("sketch").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(many, [*group, "salt"], "left")
    member = kept_table(member.select("doc_id", "n", F.coalesce("cid", "doc_id").alias("node")))
    classes = full.join(first.select(F.col("cid").alias("doc_id"), *group), ["doc_id", *group], "left_semi").select(F.col("doc_id").alias("node"), "n", "sketch")
    # inverted lists of at least two members, with their first
    post = classes.select("node", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    head = post.groupBy("v").agg(F.count("*").alias("len"), F.min(F.struct("node", "n")).alias("head")).where("len > 1")
    post = kept_table(post.join(head, "v"))
    # step 1: with the first that a member meets most often
    star = post.where((F.col("node") != F.col("head.node")) & close_sizes(F.col("n"), F.col("head.n"), percent))
    star = star.groupBy(F.col("head.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("met"), F.max("k").alias("k")).where("4 * met >= k")
    star = kept_table(star.groupBy("b").agg(F.max(F.struct("met", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"))
    links = verified(star, docs, size, percent)
    # rows of one id with different sets
    twice = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    same_id = member.where("n > 0").join(twice, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    nodes = kept_table(classes.select("node").union(same_id.select("a")).union(same_id.select("b")).distinct())
    edges = links.union(same_id).select(F.col("a").alias("node"), F.col("b").alias("other"))
    label = kept_table(components(nodes, edges, []))
    # members of one list that are still apart
    open_ = post.select("v", "node", "n", "k", "len").join(label, "node")
    open_ = kept_table(still_mixed(open_))
    crowded = kept_table(open_.where(F.col("len") > WHOLE).groupBy("node").agg(F.count("*").alias("crowded"), F.first("n").alias("n"), F.first("component").alias("component")))
    # step 2: short lists; values of long lists may all be shared too
    row = F.struct("node", "n", "k", "component")
    before = F.collect_list(row).over(W.partitionBy("v").orderBy("node").rowsBetween(-WHOLE, -1))
    pair = open_.where(F.col("len") <= WHOLE).select("node", "n", "k", "component", before.alias("before")).withColumn("o", F.explode("before"))
    pair = pair.where((F.col("component") != F.col("o.component")) & close_sizes(F.col("n"), F.col("o.n"), percent))
    pair = pair.groupBy(F.col("o.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.max(F.least("k", "o.k")).alias("k"))
    for side in ("a", "b"):
        pair = pair.join(crowded.select(F.col("node").alias(side), F.col("crowded").alias(f"more_{side}")), side, "left")
    more = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    pair = pair.where(F.col("shared") + more >= needed(F.col("k"), percent)).select("a", "b")
    # step 3: long lists, by rare values
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(bounded(crowded.select("node")), "node", "left_semi")
    rare = kept_table(rare_values(texts, size, percent))
    listed = rare.join(bounded(crowded.select("node", "component")), "node").select("node", "n", "component", F.posexplode("low").alias("at", "v"))
    listed = kept_table(still_mixed(listed).drop("component"))
    odd = rare.select("node", "odd")
    # at the first value that a similar pair shares, what follows in both holds the whole overlap
    room = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) >= percent * (F.col("n") + F.col("m"))
    for turn in range(TURNS):
        now = still_mixed(listed.join(label, "node"))
        chosen = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("component").alias("c"))
        near_ = now.join(now.groupBy("v").agg(F.min(chosen).alias("chosen")), "v").select("node", "n", "at", "component", "chosen.*")
        near_ = near_.where((F.col("component") != F.col("c")) & room).select("node", "other", "n", "m").distinct()
        near_ = near_.join(odd, "node").join(odd.toDF("other", "odd_"), "other").withColumn("differ", unlike("odd", "odd_"))
        near_ = near_.where(may_reach(F.col("n"), F.col("m"), F.col("differ"), percent)).groupBy("node").agg(F.min(F.struct("differ", "other")).alias("best"))
        found = verified(kept_table(near_.select(F.col("best.other").alias("a"), F.col("node").alias("b"))), docs, size, percent)
        if found.isEmpty():
            break
        label = merged(label, found)
    listed = kept_table(still_mixed(listed.join(label, "node")).join(rare.select("node", short_parities("odd").alias("odd")), "node"))
    other = listed.select("v", F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("component").alias("c"), F.col("odd").alias("odd_"))
    met = listed.join(other, "v").where((F.col("node") < F.col("other")) & (F.col("component") != F.col("c")) & room & may_reach(F.col("n"), F.col("m"), unlike("odd", "odd_", FOLDS), percent))
    met = met.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    # those of short lists may have been joined meanwhile; parities are known of members of long lists
    pair = pair.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca <> cb").select("a", "b")
    pair = allowed(pair, rare, percent)
    met = allowed(met, rare, percent)
    low = classes.join(crowded.select("node"), "node", "left_semi").select("node", F.col("sketch"))
    met = met.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b")
    met = met.where(F.size(F.array_intersect("la", "lb")) >= needed(F.least(F.size("la"), F.size("lb")), percent)).select("a", "b")
    label = merged(label, verified(kept_table(pair.union(met).distinct()), docs, size, percent))
    # only labels that differ from the node are asked for; a hot class is salted
    moved = label.where("component <> node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = member.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(moved, ["node", "salt"], "left")
    comp = F.coalesce("component", "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def drop_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document (the smallest id) of each component; all columns stay, and so do rows with a null id."""
    gone = similar_components(docs, size, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
