"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources by code point, null last, weigh WEIGHTS in turn and share `percent` of all words. A target
   stops at `passes` times its source's words; what is over is shared by weight among the others until none is above.
2. Draws. A document is cut into blocks of `block` words. The blocks of a source lie in a permuted order, one
   permutation for each pass over the source. A prefix of that order is drawn, its last block cut, so that the words
   drawn are the target, rounded. The order comes from hashes: blocks fall into buckets of equal chance, buckets are
   summed, and places are counted inside a bucket, so that no source is sorted in one task.
3. Splitting tree. The exact numbers of blocks drawn by source are split among output shards: a node halves its
   shards and draws, source after source, how many blocks go left (hypergeometric given what is left), so that shards
   are as if all blocks had been shuffled and dealt. A node is one row with the numbers of its sources.
4. Shards. A shard takes the next blocks of each source's permuted order, so blocks of shards are disjoint, and
   shuffles them by itself.

All randomness is a hash of `seed` and the rows' values, so reruns agree. Null and empty texts have no words and are
taken 0 times; a null source is a source of its own. Rows with repeated or null ids are drawn by themselves; equal
rows share hashes and are told apart by a number written once, so which of them is which does not matter. A table
without words gives targets of 0. Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .near import kept_table
from .text import SPACE_WORD, let, row_key, words

WEIGHTS = (5, 2, 1)
BUCKET, MAX_BUCKETS = 4096, 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """row (a number of the row), doc_id, source, size in words, key (hash of what the row says)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE_WORD)).cast("bigint")
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), row_key("doc_id", "source", "text").alias("key"))


def targets(rows: DataFrame, block: int, percent: int = 150, passes: int = 2) -> DataFrame:
    """source, source_no, source_size, source_blocks, target of (source, size); one row per source."""
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / block)).alias("source_blocks"))
    # one row of a few bytes for each source
    total = kept_table(total.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))) + 1)
    cap = passes * F.col("source_size")
    share, free, level = 0.0, None, 0.0
    while True:
        # sources at their cap at one level stay there, since the level only rises
        above = cap < F.lit(level) * weight
        r = total.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"),
                      F.coalesce(F.sum(F.when(~above, weight)), F.lit(0)).alias("weights"), F.count_if(~above).alias("free")).first()
        if r.free == free or not r.weights:
            break
        share, free = (percent * (r["all"] or 0) - 100 * r.capped) / 100, r.free
        level = share / r.weights
    return total.withColumn("target", F.when(cap < F.lit(level) * weight, cap.cast("double")).otherwise(F.lit(level) * weight))


def blocks_of(rows: DataFrame, goal: DataFrame, block: int, seed: int) -> DataFrame:
    """source_no, pass, bucket, h, row, key, doc_id, block, words: every block once for each pass over its source that is begun."""
    quota = F.round("target").cast("bigint")
    full = F.floor(quota / F.greatest("source_size", F.lit(1)))
    goal = goal.where("source_size > 0").select(
        F.col("source").alias("its"), "source_no", quota.alias("quota"), F.least(F.ceil(F.col("source_blocks") / BUCKET), F.lit(MAX_BUCKETS)).alias("buckets"),
        (full + (quota > full * F.col("source_size")).cast("int")).cast("int").alias("begun"))
    met = rows.where("size > 0").join(goal.where("begun > 0"), F.col("source").eqNullSafe(F.col("its")))
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block) - 1).cast("int")))).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("begun") - 1)))
    h = F.xxhash64(F.lit(seed), "key", "pass", "block")
    return met.withColumn("h", h).select("source_no", "pass", F.pmod("h", "buckets").alias("bucket"), "h", "row", "key", "doc_id", "block",
                                         F.least(F.lit(block), F.col("size") - block * F.col("block")).alias("words"), "quota")


def draws(rows: DataFrame, goal: DataFrame, block: int, seed: int) -> DataFrame:
    """source_no, place (0, 1, ... in the source's permuted order), h, row, key, doc_id, pass, block, words (of the last block, what is still wanted)."""
    every = blocks_of(rows, goal, block, seed)
    at = ["source_no", "pass", "bucket"]
    before = W.partitionBy("source_no").orderBy("pass", "bucket").rowsBetween(W.unboundedPreceding, -1)
    bucket = every.groupBy(*at).agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.first("quota").alias("quota"))
    bucket = bucket.select(*at, "quota", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "w")])
    wanted = bucket.where("w_before < quota").drop("quota")
    inside = W.partitionBy(*at).orderBy("h", "row", "block")
    met = every.join(wanted, at).withColumns({
        "place": F.col("n_before") + F.row_number().over(inside) - 1,
        "gone": F.col("w_before") + F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("words")})
    return met.where("gone < quota").select("source_no", "place", "h", "row", "key", "doc_id", "pass", "block", F.least("words", F.col("quota") - F.col("gone")).alias("words"))


def uniform(*cols) -> Column:
    """Number between 0 and 1 from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + 0.5) / float(1 << 53)


def hypergeometric(u: Column, total: Column, marked: Column, n: Column) -> Column:
    """Marked ones among n drawn of `total` without return, of which `marked` are marked: the quantile at u.

    Probabilities are relative ones, by their ratios, over the mean and 8 deviations and 8 on either side; the rest
    is below the precision of u. The array grows with the square root of n.
    """
    x, k, m = total.cast("double"), marked.cast("double"), n.cast("double")
    low, high = F.greatest(F.lit(0), n + marked - total), F.least(n, marked)
    mean = m * k / F.greatest(x, F.lit(1.0))
    reach = F.ceil(8 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / F.greatest(x, F.lit(1.0))) * (x - m) / F.greatest(x - 1, F.lit(1.0))))) + 8
    first, last = F.greatest(low, F.floor(mean) - reach), F.least(high, F.ceil(mean) + reach)

    def ratio(i: Column) -> Column:
        return (k - i) * (m - i) / ((i + 1.0) * (x - k - m + i + 1.0))

    def pick(span):
        one = F.lit(1.0)
        mass = F.aggregate(span, F.struct(one.alias("p"), F.lit(0.0).alias("sum")),
                           lambda a, i: F.struct((a["p"] * ratio(i)).alias("p"), (a["sum"] + a["p"]).alias("sum")))["sum"]
        start = F.struct(one.alias("p"), (u * mass).alias("left"), F.lit(None).cast("bigint").alias("at"))
        found = F.aggregate(span, start, lambda a, i: F.struct(
            (a["p"] * ratio(i)).alias("p"), (a["left"] - a["p"]).alias("left"), F.when(a["at"].isNull() & (a["left"] <= a["p"]), i).otherwise(a["at"]).alias("at")))
        return F.coalesce(found["at"], last)
    return F.when(low >= high, low).otherwise(let(F.sequence(first.cast("bigint"), last.cast("bigint")), pick)).cast("bigint")


def split(nodes: DataFrame, seed: int) -> DataFrame:
    """Halves of the nodes (first shard, shards, parts: source_no and n) with more than one shard; the others stay."""
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    half = F.floor(F.col("shards") / 2).cast("int")
    share = (F.col("total").cast("decimal(38, 0)") * F.col("half") / F.col("shards")).cast("bigint")

    def step(a, p):
        taken = hypergeometric(uniform(F.lit(seed), "first", "shards", p["source_no"]), a["total"], p["n"], a["need"])
        return let(taken, lambda t: F.struct((a["total"] - p["n"]).alias("total"), (a["need"] - t).alias("need"), F.concat(a["out"], F.array(t)).alias("out")))
    start = F.struct(F.col("total").alias("total"), F.col("need").alias("need"), F.array().cast("array<bigint>").alias("out"))
    met = nodes.withColumns({"total": total, "half": half}).withColumn("need", share)
    met = met.withColumn("left", F.when(F.col("shards") > 1, F.aggregate("parts", start, step)["out"]))
    part = lambda n: F.transform("parts", lambda p, i: F.struct(p["source_no"].alias("source_no"), n(p, i).alias("n")))
    node = lambda first, shards, parts: F.struct(first.cast("int").alias("first"), shards.cast("int").alias("shards"), parts.alias("parts"))
    both = F.array(node(F.col("first"), F.col("half"), part(lambda p, i: F.get("left", i))),
                   node(F.col("first") + F.col("half"), F.col("shards") - F.col("half"), part(lambda p, i: p["n"] - F.get("left", i))))
    alone = F.array(node(F.col("first"), F.col("shards"), F.col("parts")))
    return met.select(F.explode(F.when(F.col("shards") > 1, both).otherwise(alone)).alias("node")).select("node.*")


def shard_quotas(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, source_no, n, start (place of the shard's first block of the source), width (blocks of the source by shard)."""
    total = drawn.groupBy("source_no").agg(F.count("*").alias("n"))
    nodes = total.agg(F.array_sort(F.collect_list(F.struct("source_no", "n"))).alias("parts"))
    nodes = nodes.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "parts")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level == 5:
            nodes = nodes.repartition("first")
        nodes = split(nodes, seed)
    part = nodes.select(F.col("first").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.source_no", "p.n").where("n > 0")
    every = W.partitionBy("source_no")
    start = F.coalesce(F.sum("n").over(every.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return part.select("shard", "source_no", "n", start.alias("start"), F.ceil(F.sum("n").over(every) / shards).alias("width"))


def dealt(drawn: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """The draws with their shard and their place in it (position)."""
    cells = F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("n") - 1) / F.col("width")))
    ranges = quotas.select("shard", "source_no", "n", "start", F.explode(cells).alias("cell"))
    met = drawn.join(quotas.groupBy("source_no").agg(F.first("width").alias("width")), "source_no").withColumn("cell", F.floor(F.col("place") / F.col("width")))
    met = met.join(ranges, ["source_no", "cell"]).where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n")))
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "row", "block", "pass")
    return met.select("shard", (F.row_number().over(order) - 1).alias("position"), "source_no", "row", "key", "doc_id", "pass", "block", "words")


def mixed(rows: DataFrame, goal: DataFrame, block: int, shard_words: int, seed: int) -> DataFrame:
    """shard, position, source_no, row, key, doc_id, pass, block, words: the mix as spans of words."""
    drawn = kept_table(draws(rows, goal, block, seed))
    wanted = goal.agg(F.sum("target")).first()[0] or 0
    return dealt(drawn, kept_table(shard_quotas(drawn, max(1, math.ceil(wanted / shard_words)), seed)), seed)


def mix(docs: DataFrame, block: int = 256, shard_words: int = 1_000_000, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, mix): the sizes of all rows, the targets of all sources, the drawn spans by shard and position."""
    rows = kept_table(sizes(docs))
    goal = targets(rows, block)
    return rows, goal, kept_table(mixed(rows, goal, block, shard_words, seed))


def texts(docs: DataFrame, spans: DataFrame, block: int = 256) -> DataFrame:
    """shard, position, doc_id, text of the spans; write it partitioned by shard and sorted by position."""
    cut = docs.select(row_key("doc_id", "source", "text").alias("key"), words(F.col("text"), SPACE_WORD).alias("w")).where(F.size("w") > 0)
    cut = cut.select("key", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / block).cast("int"))).alias("block"))
    cut = cut.select("key", "block", F.slice("w", F.col("block") * block + 1, F.lit(block)).alias("w")).dropDuplicates(["key", "block"])
    met = spans.join(cut, ["key", "block"])
    return met.select("shard", "position", "doc_id", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words in the mix)."""
    rows, goal, spans = mix(docs, **options)
    taken = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    goal = goal.select(F.col("source").alias("its"), "source_size", "target")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("its"))).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
