"""Mixing against plain sums: targets, exact quotas, disjoint shards, and the hypergeometric draw."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from annolink.llm import mix
from annolink.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(size):
    """Sources to targets by rounds that share what is over."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, free = Fraction(3 * sum(size.values()), 2), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] > 2 * size[s] * total}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = Fraction(2 * size[s])
        left, free = left - sum(out[s] for s in over), free - over
    return out


def check(rows, got):
    """rows: (doc_id, source, text). The answer has the same ids and sizes; sources meet their targets exactly."""
    want = Counter((k, len(SPACE.findall(t or "")), s) for k, s, t in rows)
    size = Counter()
    for (_, n, s), times in want.items():
        size[s] += n * times
    goal = plain_targets(size)
    assert Counter((r.doc_id, r.size) for r in got) == Counter({k: sum(c for w, c in want.items() if w[:2] == k) for k in {w[:2] for w in want}})
    by = defaultdict(set)
    for (k, n, s) in want:
        by[k, n].add(s)
    taken, seen = Counter(), set()
    for r in got:
        near = [s for s in by[r.doc_id, r.size] if size[s] == r.source_size and abs(float(goal[s]) - r.target) < 1e-6]
        assert near and 0 <= r.taken <= 2 * r.size
        full = math.floor(round(r.target) / r.source_size) if r.source_size else 0
        assert full * r.size <= r.taken <= (full + 1) * r.size
        taken[r.source_size, r.target] += r.taken
        seen.add((r.source_size, r.target))
    for s, t in seen:
        alike = sum(1 for x in size if size[x] == s and abs(float(goal[x]) - t) < 1e-6)
        assert taken[s, t] == alike * round(t)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    first = QUERIES["op11_mixing"](spark, d)
    assert dict(first.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    got = first.collect()
    check(rows, got)
    again = mix.report(spark.read.parquet(f"{d}/documents.parquet").repartition(5))
    assert Counter(map(tuple, got)) == Counter(map(tuple, again.collect()))


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a", long), (2, "a", None), (3, None, "x y z"), (4, None, ""), (None, "b", "one two"), (None, "b", "one two"), (7, "b", "three\tfour\x0bfive"),
            (7, "c", "six"), (7, "c", "six"), (8, "", "e " * 700), (9, "d", None), (10, "é", "u " * 300), (11, "z", "v " * 290), (12, "\U0001f600", "q " * 500)]
    df = spark.createDataFrame([(k, s, t, 1, 2) for k, s, t in rows], "doc_id bigint, source string, text string, size int, key int").repartition(3)
    check(rows, mix.report(df, block=16, shard_words=2000).collect())
    assert mix.report(df.where("false")).collect() == []
    empty = mix.report(df.where("text is null")).collect()
    assert len(empty) == 2 and all((r.size, r.target, r.taken) == (0, 0, 0) for r in empty)


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, goal, spans = mix.mix(docs, block=32, shard_words=10_000, seed=3)
    got = spans.collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    total = sum(len(v) for v in shards.values())
    assert sorted(shards) == list(range(len(shards))) and len(shards) > 8
    for v in shards.values():
        assert sorted(r.position for r in v) == list(range(len(v))) and abs(len(v) - total / len(shards)) <= math.log2(len(shards)) + 1
    assert len({(r.row, r.block, r["pass"]) for r in got}) == len(got)
    # every shard has its share of the large sources, within 6 deviations
    by = Counter(r.source_no for r in got)
    for v in shards.values():
        own = Counter(r.source_no for r in v)
        for s, n in by.items():
            p = n / total
            assert abs(own[s] - p * len(v)) <= 6 * math.sqrt(len(v) * p * (1 - p)) + 1
    # the texts of the spans are the words of the documents
    text = {r.doc_id: SPACE.findall(r.text or "") for r in docs.collect()}
    cut = {(r.shard, r.position): r for r in mix.texts(docs, spans, 32).collect()}
    assert len(cut) == len(got)
    for r in got:
        assert cut[r.shard, r.position].text.split(" ") == text[r.doc_id][32 * r.block:32 * r.block + r.words]


@pytest.mark.parametrize("total,marked,n", [(10, 3, 5), (1, 1, 1), (50, 50, 20), (1000, 1, 500), (900, 450, 450), (40, 13, 0), (100_000, 30_000, 50_000)])
def test_hypergeometric(spark, total, marked, n):
    u = [(i + 0.5) / 40 for i in range(40)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    got = [r.k for r in df.select("u", mix.hypergeometric(F.col("u"), F.lit(total).cast("bigint"), F.lit(marked).cast("bigint"), F.lit(n).cast("bigint")).alias("k")).orderBy("u").collect()]
    low, high = max(0, n + marked - total), min(n, marked)
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    at, sums, cum = [], [], 0.0
    for k in range(low, high + 1):
        cum += math.exp(ln(marked, k) + ln(total - marked, n - k) - ln(total, n))
        at.append(k)
        sums.append(cum)
    want = [next((k for k, c in zip(at, sums) if c >= x), high) for x in u]
    assert all(abs(a - b) <= (1 if total > 1000 else 0) for a, b in zip(got, want)) and sum(a != b for a, b in zip(got, want)) <= 1
