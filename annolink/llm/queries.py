"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, counts, idfile, licences, lines, mix, near, phrases, search, secrets, suffixes, weak, whiten
from .text import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_weak_labels(spark, d):
    return weak.score(table(spark, d, "documents").select("doc_id", "text"))


@query
def op2_licence_scan(spark, d):
    return licences.scan(table(spark, d, "documents").select("doc_id", "text")).drop("detections")


@query
def op3_simple8b(spark, d):
    return idfile.stored(table(spark, d, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


@query
def op4_secret_forest(spark, d):
    return secrets.report(table(spark, d, "documents").select("doc_id", "text"))


@query
def op5_token_counts(spark, d):
    return counts.token_counts(spread(table(spark, d, "documents").select("doc_id", "text")), tokenizer("byte_bpe_50k.json"))


@query
def op6_decontamination(spark, d):
    out = phrases.contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op7_line_frequency(spark, d):
    return lines.verdicts(table(spark, d, "documents").select("doc_id", "source", "text"))


@query
def op8_suffix_array(spark, d):
    out = suffixes.repeated(spread(table(spark, d, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_repeat_words", F.size("spans").cast("bigint").alias("n_spans"),
                      F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",").alias("spans"))


@query
def op9_minhash(spark, d):
    return near.similar_components(table(spark, d, "documents").select("doc_id", "text"), size=3, percent=85)


@query
def op10_bpe(spark, d):
    return bpe.digest(spread(table(spark, d, "documents").select("doc_id", "text")), tokenizer("byte_bpe_50k.json"))


@query
def op11_mixing(spark, d):
    return mix.report(table(spark, d, "documents"))


@query
def op12_lexical_search(spark, d):
    return search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op12_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
p AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS impact FROM t JOIN f USING (term), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(c * impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x
QUALIFY rank <= 20"""


@query
def op13_whitening(spark, d):
    return whiten.whiten(table(spark, d, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))
