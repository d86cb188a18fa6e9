"""Secret scans: a random forest removes false positives among high-entropy candidates.

Candidates are runs of 16 or more key characters with the words around them. The forest sees length,
character transitions, dictionary coverage, path signs and neighbouring words. Labelled findings are
the candidates that strict signatures settle: known key shapes or an assignment to a secret's name
(positive), and plain words or paths without digits (negative). At most MAX_LABELLED of each class, those with the
smallest hash, train the forest; every candidate is scored. With one class only (also on empty
tables) the strict signature decides. Null and empty texts have no candidates; equal candidates of
one row count once; each row is judged by itself, also if its id is repeated or null: rows are told
apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .text import row_key

#: Labelled candidates of each class that train the forest.
MAX_LABELLED = 10_000
#: Candidate shape, secret names, common words.
CANDIDATE = r"[A-Za-z0-9_+/=\-]{16,}+"
#: Characters of the same line that are read before and after a candidate.
CONTEXT = 40
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|auth|credential|key)"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{30,}|eyJ[A-Za-z0-9_\-]{20,})"
DICTIONARY = r"(?:the|and|for|with|that|this|from|have|able|ing|tion|ment|ness|http|www|com|org|html|index|page|user|name|data|file|path|test|example|sample|value|version|public|private|license|ation|ence|ance|ight|ound|ther|ouse|est|ere|ent|and|her|ver|ist)"
PROSE = r"\b(?:the|a|an|of|and|or|in|to|is|for|with|on|by|see|at)\b"
FEATURES = ("length", "digits", "uppers", "signs", "flips", "cases", "covered", "slashes", "dots", "named", "assigned", "placeholder", "prose_before", "prose_after", "closed")


def share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, secret, features and the strict label (1, 0 or null)."""
    text = F.coalesce("text", F.lit(""))
    # what lies between the candidates gives the words on both sides
    found = docs.select("doc_id", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("s"), F.split(text, CANDIDATE).alias("gap")).where("size(s) > 0")
    each = F.transform("s", lambda v, i: F.struct(v.alias("secret"), F.regexp_extract(F.right(F.col("gap")[i], F.lit(CONTEXT)), r"[^\n]*$", 0).alias("before"),
                                                  F.regexp_extract(F.left(F.col("gap")[i + 1], F.lit(CONTEXT)), r"^[^\n]*", 0).alias("after")))
    c = found.select("doc_id", F.explode(F.array_distinct(each)).alias("c")).select("doc_id", "c.secret", F.lower("c.before").alias("before"), F.lower("c.after").alias("after"))
    before, after = F.col("before"), F.col("after")
    s = F.col("secret")
    c = c.select(
        "doc_id", "secret", F.length(s).cast("double").alias("length"), share(s, "[0-9]").alias("digits"), share(s, "[A-Z]").alias("uppers"), share(s, r"[_+/=\-]").alias("signs"),
        share(s, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])").alias("flips"), share(s, "(?<=[a-z])(?=[A-Z])").alias("cases"),
        (1 - F.length(F.regexp_replace(F.lower(s), DICTIONARY, "")) / F.length(s)).alias("covered"), share(s, "/").alias("slashes"), F.regexp_count(before, F.lit(r"[./]")).cast("double").alias("dots"),
        before.rlike(NAMES).cast("double").alias("named"), before.rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"), F.lower(s).rlike("example|xxxx|sample|changeme|placeholder").cast("double").alias("placeholder"),
        before.rlike(PROSE).cast("double").alias("prose_before"), after.rlike(PROSE).cast("double").alias("prose_after"), after.rlike(r"^[\"']?\s*(?:$|[,;)}])").cast("double").alias("closed"))
    strict = s.rlike(KNOWN) | ((F.col("named") > 0) & (F.col("assigned") > 0) & (F.col("digits") > 0))
    label = F.when(strict & (F.col("placeholder") == 0), 1.0).when(((F.col("digits") == 0) & (F.col("named") == 0)) | (F.col("placeholder") > 0) | ((F.col("slashes") > 0) & (F.col("dots") > 0)), 0.0)
    return c.withColumn("label", label)


def findings(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, secret, score, is_secret: one row per distinct candidate of a document."""
    # kept once: labels and scores both read it
    c = settle(candidates(docs))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = c.where("label is not null").select("label", *FEATURES).dropDuplicates().withColumn("h", F.xxhash64(*FEATURES))
    # each class apart, so that rare secrets are not crowded out
    labelled = settle(rows.where("label = 1").orderBy("h").limit(MAX_LABELLED).union(rows.where("label = 0").orderBy("h").limit(MAX_LABELLED)))
    if labelled.select("label").distinct().count() == 2:
        # both classes weigh the same
        share_of_one = labelled.agg(F.avg("label")).first()[0]
        weighted = labelled.withColumn("w", F.when(F.col("label") == 1, 0.5 / share_of_one).otherwise(0.5 / (1 - share_of_one)))
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=20, maxDepth=6, seed=7)
        model = forest.fit(vector.transform(weighted))
        c = model.transform(vector.transform(c)).withColumn("score", vector_to_array("probability")[1])
    else:
        c = c.withColumn("score", F.coalesce("label", F.lit(0.0)))
    best = c.groupBy("doc_id", "secret").agg(F.max("score").alias("score"))
    return best.withColumn("is_secret", F.col("score") >= threshold)


def report(docs: DataFrame) -> DataFrame:
    """One row per input row: candidates, secrets, largest score, and the secrets' texts in order."""
    f = findings(docs.select(row_key("doc_id", "text").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row").groupBy("row").agg(F.count("*").alias("n_candidates"), F.sum(F.col("is_secret").cast("bigint")).alias("n_secrets"),
                                             F.max("score").alias("score"), F.array_sort(F.collect_set(F.when(F.col("is_secret"), F.col("secret")))).alias("secrets"))
    out = docs.select("doc_id", row_key("doc_id", "text").alias("row")).join(f, "row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_secrets", zero).alias("n_secrets"),
                      F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.array_join("secrets", " "), F.lit("")).alias("secrets"))


def redact(docs: DataFrame) -> DataFrame:
    """All documents; secrets in their texts are replaced by [SECRET], longest first."""
    cols = docs.columns
    keyed = docs.withColumn("__row", row_key("doc_id", "text"))
    f = findings(keyed.select(F.col("__row").alias("doc_id"), "text")).where("is_secret").groupBy(F.col("doc_id").alias("__row")).agg(F.collect_set("secret").alias("__found"))
    ordered = F.transform(F.sort_array(F.transform("__found", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False), lambda x: x["s"])
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(F.aggregate(ordered, F.col("text"), lambda acc, s: F.replace(acc, s, F.lit("[SECRET]"))))
    return keyed.join(f, "__row", "left").withColumn("text", text).select(*cols)
