"""Licence scans with ordered signature rules in native expressions.

A rule has a keyword, a pattern over the text's words, a label, and a priority. Rules whose keyword is
not in the text are skipped before any pattern runs. Detections are spans of characters in the
joined words; a span that lies inside another one of higher priority (or of equal priority, but longer
or earlier in the rule order) is suppressed. Null and empty texts have no words and no detections.
Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ITEM_WORD, let, lower_ascii, words

#: Fixed base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families: label, keyword, name as a pattern over lower-case words.
FAMILIES = (
    ("mit", "mit", "mit"), ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"), ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("gpl-2", "general", "(?:gnu )?general public license(?: version| v)? ?2"), ("gpl-3", "general", "(?:gnu )?general public license(?: version| v)? ?3"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 2 1"), ("lgpl-3", "lesser", "(?:gnu )?lesser general public license(?: version| v)? ?3"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: version| v)? ?3"), ("gpl", "gpl", "gpl(?: ?v?[23])?"), ("lgpl", "lgpl", "lgpl(?: ?v?[23])?(?: 1)?"), ("agpl", "agpl", "agpl(?: ?v?3)?"),
    ("bsd-2", "bsd", "(?:2|two) clause bsd|bsd 2 clause|simplified bsd"), ("bsd-3", "bsd", "(?:3|three) clause bsd|bsd 3 clause|new bsd|modified bsd"), ("bsd-0", "0bsd", "0bsd"), ("bsd", "bsd", "bsd"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?"), ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1"), ("epl-1", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?"), ("epl-2", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("cc-by-nc", "nc", "cc by nc(?: [234] [05])?"), ("cc-by-nc-sa", "nc", "cc by nc sa(?: [234] [05])?"), ("cc-by-nc-nd", "nc", "cc by nc nd(?: [234] [05])?"), ("cc-by-sa", "sa", "cc by sa(?: [234] [05])?"), ("cc-by-nd", "nd", "cc by nd(?: [234] [05])?"), ("cc-by", "cc", "cc by(?: [234] [05])?"),
    ("cc0", "cc0", "cc0(?: 1 0)?"), ("cc-by", "creative", "creative commons attribution(?: [234] [05])?"), ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial(?: [234] [05])?"), ("cc-by-sa", "sharealike", "creative commons attribution sharealike(?: [234] [05])?"),
    ("unlicense", "unlicense", "unlicense"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("artistic-2", "artistic", "artistic license(?: version)? 2(?: 0)?"), ("boost-1", "boost", "boost software license(?: version)?(?: 1 0)?"),
    ("wtfpl", "wtfpl", "wtfpl"), ("ofl-1.1", "sil", "sil open font license(?: version)?(?: 1 1)?"), ("eupl", "european", "european union public licen[cs]e(?: v? ?1 [12])?"), ("cddl-1", "common", "common development and distribution license(?: version)?(?: 1 0)?"), ("postgresql", "postgresql", "postgresql"), ("python-2", "python", "(?:python software foundation|psf)"),
)

#: Ways to name a licence: pattern around the name, priority, confidence.
FORMS = (
    (r" (?:released|distributed|licensed|available|provided|published|made available)(?: to you)? under(?: the(?: terms of the)?)? (?:%s)(?: licen[cs]e)?(?: version \d+)?(?= )", 5, 0.98),
    (r" spdx license identifier (?:%s)(?= )", 5, 0.99),
    (r" under(?: the(?: terms of the)?)? (?:%s)(?: licen[cs]e)?(?= )", 4, 0.9),
    (r" licen[cs]e (?:is )?(?:the )?(?:%s)(?= )", 3, 0.75),
    (r" (?:%s) licen[cs]e[sd]?(?= )", 2, 0.7),
)


def rules() -> list[tuple]:
    """(label, keyword, pattern, priority, confidence, order): every family in every form."""
    return [(label, f" {key}", form % name, priority, confidence, i * len(FORMS) + j)
            for i, (label, key, name) in enumerate(FAMILIES) for j, (form, priority, confidence) in enumerate(FORMS)]


def rule_array() -> Column:
    """The rules as one literal array; only those gated in are matched."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("label", "key", "pattern", "priority", "confidence", "nth"), r)]) for r in rules()])


def spans(text: Column, r: Column) -> Column:
    """Spans of one rule in one text: lengths of what lies between its matches give the places."""
    found = F.regexp_extract_all(text, r["pattern"], F.lit(0))
    between = F.split(text, r["pattern"])

    def place(both):
        walk = F.aggregate(
            both, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out")),
            lambda acc, z: F.struct((acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
                                    F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(z["gap"])).alias("a"), (acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("b")))).alias("out")))
        return F.transform(walk["out"], lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["nth"].alias("nth")))
    return let(F.transform(found, lambda h, i: F.struct(F.get(between, i).alias("gap"), h.alias("hit"))), place)


def inside(x: Column, y: Column) -> Column:
    """x lies in y, and y goes before it."""
    size_x, size_y = x["b"] - x["a"], y["b"] - y["a"]
    before = (y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & ((size_y > size_x) | ((size_y == size_x) & (y["nth"] < x["nth"]))))
    return (y["a"] <= x["a"]) & (x["b"] <= y["b"]) & before


def base_places(w: Column, joined: Column, phrase: str) -> Column:
    terms = phrase.split(" ")

    def places(v):
        return F.filter(F.transform(v, lambda x, i: F.when(x == terms[0], i)), lambda i: i.isNotNull() & (
            F.slice(v, i + 1, len(terms)) == F.array(*[F.lit(x) for x in terms])))
    return F.when(joined.contains(f" {phrase} "), let(w, places)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    one = docs.select("doc_id", let(words(lower_ascii(F.col("text")), ITEM_WORD), lambda w: let(
        F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), lambda j: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            *[base_places(w, j, p).alias(f"p{i}") for i, (p, _) in enumerate(BASE)],
            F.flatten(F.transform(F.filter(rule_array(), lambda r: j.contains(r["key"]) & j.rlike("licen[cs]e|under|spdx")), lambda r: spans(j, r))).alias("raw")))).alias("s"))
    one = one.select("doc_id", "s.*")
    every = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)])))
    raw = F.col("raw")
    kept = F.filter(raw, lambda x: ~F.exists(raw, lambda y: inside(x, y)))
    one = one.select("doc_id", "n_words", every.alias("places"), base.alias("base"), kept.alias("detections"))
    labels = F.array_sort(F.array_union("base", F.transform("detections", lambda x: x["label"])))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)))
    return one.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"),
                      F.array_max("places").cast("bigint").alias("last_word"), F.array_join("base", ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"), "detections")
