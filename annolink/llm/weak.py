"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation estimates their
accuracies from the counts of vote patterns (at most 3 ** labellers rows, however many documents).
The posterior labels of a bounded sample (the MAX_FIT different rows with the smallest hash of id and text)
train a hashed linear scorer that reads words only; every document is scored. Votes are taken once and kept with
the texts in a table of the shared folder. On an empty table the prior is one half. Null and empty texts get the
votes of an empty text; a null id is an id like any other; repeated rows give repeated results and are fitted once.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import SPACE_WORD, let, lower_ascii, row_key, words

MAX_FIT = 10_000
HASHES = 1 << 15
LABELLERS = ("length", "symbols", "variety", "word_size", "capitals", "lines", "digits", "sentences")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column v_<labeller> of -1, 0 or 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))

    def portion(pattern):
        return F.regexp_count(text, F.lit(pattern)) / size

    one = docs.select("doc_id", "text", let(words(lower_ascii(F.col("text")), SPACE_WORD), lambda w: F.struct(
        F.size(w).alias("n"), (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).alias("variety"))).alias("w"),
        portion(r"[#*$%&|<>{}\[\]@^~=]").alias("sym"), portion(r"[A-Z]").alias("cap"), portion(r"[0-9]").alias("dig"), portion(r"[^\x20\x09-\x0D]").alias("dense"), portion(r"[.!?](?=\s|$)").alias("stops"),
        let(F.split(text, "\n"), lambda x: F.size(F.array_distinct(x)) / F.size(x)).alias("fresh"))
    n = F.greatest(F.col("w.n"), F.lit(1))
    mean = F.col("dense") * size / n
    per_word = F.col("stops") * size / n
    return one.select(
        "doc_id", "text", vote(F.col("w.n") >= 60, F.col("w.n") < 30).alias("v_length"), vote(F.col("sym") < 0.005, F.col("sym") > 0.03).alias("v_symbols"),
        vote((F.col("w.variety") > 0.45) | (F.col("w.n") > 600), F.col("w.variety") < 0.25).alias("v_variety"), vote((mean >= 4) & (mean <= 8), (mean < 3) | (mean > 12)).alias("v_word_size"),
        vote(F.col("cap") < 0.06, F.col("cap") > 0.2).alias("v_capitals"), vote(F.col("fresh") > 0.9, F.col("fresh") < 0.7).alias("v_lines"),
        vote(F.col("dig") < 0.01, F.col("dig") > 0.1).alias("v_digits"), vote((per_word > 0.03) & (per_word < 0.3), (per_word < 0.005) | (per_word > 0.5)).alias("v_sentences"))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """(prior, chance of each vote given bad and good: labellers x 2 x 3) from vote pattern counts."""
    k = patterns.shape[1]
    chance = np.tile(np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]]), (k, 1, 1))
    prior = 0.5
    at = np.arange(k)
    for _ in range(rounds if counts.sum() else 0):
        bad = np.log(1 - prior) + np.log(chance[at, 0, patterns + 1]).sum(axis=1)
        good = np.log(prior) + np.log(chance[at, 1, patterns + 1]).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
        prior = float(np.clip((counts * p).sum() / counts.sum(), 0.02, 0.98))
        for c, weight in enumerate((counts * (1 - p), counts * p)):
            for v in (-1, 0, 1):
                chance[:, c, v + 1] = ((patterns == v) * weight[:, None]).sum(axis=0) + 1.0
        chance /= chance.sum(axis=2, keepdims=True)
    return prior, chance


def smallest_hashes(v: DataFrame, rows: int) -> int:
    """The MAX_FIT-th smallest different hash, or the greatest if there are fewer."""
    share = min(1.0, 2 * MAX_FIT / max(rows, 1))
    while True:
        # hashes are even over 64 bits: a first guess of the range is widened until it holds enough
        cut = (1 << 63) - 1 if share >= 1 else -(1 << 63) + int(share * (1 << 64))
        found = v.where(F.col("h") <= cut).select("h").distinct().orderBy("h").limit(MAX_FIT).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("last")).first()
        if found["n"] == MAX_FIT or share >= 1:
            return found["last"] if found["n"] else -(1 << 63)
        share = min(1.0, share * 8)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, votes as a string, posterior, score of the linear scorer, kept."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext.getCheckpointDir()}/votes-{uuid.uuid4().hex}"
    votes(docs).withColumn("h", row_key("doc_id", "text")).write.parquet(target)
    v = spark.read.parquet(target)
    cols = [f"v_{x}" for x in LABELLERS]
    rows = v.groupBy(*cols).count().collect()  # at most 3 ** 8 patterns
    prior, chance = expectation_maximisation(np.array([[r[c] for c in cols] for r in rows], dtype=int).reshape(-1, len(cols)), np.array([r["count"] for r in rows], dtype=float))
    odds = F.lit(math.log(prior / (1 - prior)))
    for i, c in enumerate(cols):
        w = [math.log(chance[i, 1, x] / chance[i, 0, x]) for x in range(3)]
        odds = odds + F.when(F.col(c) == -1, w[0]).when(F.col(c) == 0, w[1]).otherwise(w[2])
    v = v.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    hashed = HashingTF(numFeatures=HASHES, binary=True, inputCol="w", outputCol="features")

    def features(df):
        return hashed.transform(df.withColumn("w", words(lower_ascii(F.col("text")), SPACE_WORD)))

    # distinct rows up to the MAX_FIT-th smallest hash; copies of a row meet in partial aggregates
    last = smallest_hashes(v, sum(r["count"] for r in rows))
    sample = v.where(F.col("h") <= last).groupBy("h").agg(F.first("text").alias("text"), F.first("posterior").alias("posterior"))
    if rows:
        # bounded by MAX_FIT rows; fitting reads them in every step
        sample = sample.persist(StorageLevel.DISK_ONLY)
        both = sample.withColumn("x", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))))
        model = LogisticRegression(maxIter=15, regParam=0.01, weightCol="weight").fit(features(both.select("text", "x.label", "x.weight")).select("features", "label", "weight"))
        sample.unpersist()
        v = model.transform(features(v)).withColumn("score", vector_to_array("probability")[1])
    else:
        v = v.withColumn("score", F.col("posterior"))
    kept = (F.col("score") + F.col("posterior")) / 2 >= 0.5
    return v.select("doc_id", F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("votes"), "posterior", "score", kept.alias("kept"))
