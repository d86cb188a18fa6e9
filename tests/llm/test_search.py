"""Lexical search against plain scores, its bounds against all subsets, and its SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from annolink.llm import search
from annolink.llm.queries import QUERIES, SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    rows = [(key, Counter(t), len(t)) for key, t in ((key, terms(text)) for key, text in docs) if t]
    n, total, df = len(rows), sum(r[2] for r in rows), Counter(t for _, c, _ in rows for t in c)
    out = Counter()
    for item, text in items:
        asked, got = Counter(terms(text)), []
        for key, c, size in rows:
            m = 75 + (25 * size * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                got.append((-score, key is None, key or 0))
        for rank, (score, none, key) in enumerate(sorted(got)[:k], 1):
            out[item, rank, None if none else key, -score] += 1
    return out


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["op12_lexical_search"](spark, d)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cols = "item_id, rank, doc_id, score"
    assert sorted(map(tuple, got.select(*cols.split(", ")).collect())) == sorted(con.execute(f"SELECT {cols} FROM ({SQL['op12_lexical_search']})").fetchall())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(search, "SEGMENT", 64)


@pytest.mark.parametrize("blocks", [1, 3])
def test_edge_rows(spark, small, monkeypatch, blocks):
    rng = np.random.default_rng(11)
    vocabulary = [f"t{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(900)]
    docs += [(2000 + i, docs[i % 3][1]) for i in range(120)] + [(5, docs[8][1]), (5, docs[8][1]), (None, docs[9][1]), (None, docs[9][1])]
    docs += [(3000, None), (3001, ""), (3002, "..., !"), (3003, text(30_000)), (3004, "T1,T2;t3\x7ft4 É é"), (2**53 + 1, docs[9][1])]
    items = [(i, docs[7 * i][1]) for i in range(40)] + [(100, None), (101, ""), (102, "zzz"), (103, "t1 T1 t1 t299"), (103, "é"), (None, "t250 t260"), (104, "É")]
    # both of a pair are rare and stand together once
    docs += [(4000, "rare1 x y"), (4001, "rare2 x"), (4002, "rare1 rare2")]
    items += [(105, "rare1 rare2 t1 t2")]
    if blocks > 1:
        monkeypatch.setattr(search, "MAX_TERMS", sum(len(terms(t)) for _, t in items) // blocks)
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id bigint, text string, n int, rank string").repartition(5)
    q = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, query int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(d, q, 7).collect())
    assert got == brute(docs, items, 7)
    assert search.search(d.where("false"), q).collect() == [] and search.search(d, q.where("false")).collect() == []


def test_bounds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        scores = rng.integers(0, 50, (30, n)) * (rng.random((30, n)) < 0.4)
        most = [int(v) for v in scores.max(axis=0)]
        joint = [int(max([0, *scores[(scores[:, i] > 0) & (scores[:, i + 1] > 0)][:, i:i + 2].sum(axis=1)])) if rng.random() < 0.7 else None for i in range(n - 1)]
        bounds = search.prefix_bounds(most, joint)
        singles = np.cumsum([0, *most])
        for i, b in enumerate(bounds):
            assert scores[:, :i].sum(axis=1).max(initial=0) <= b <= singles[i]
        own = [(1, np.flatnonzero(scores[:, i]), scores[scores[:, i] > 0, i]) for i in range(n) if most[i]]
        if own:
            got = np.zeros(30, dtype=np.int64)
            bounds = search.prefix_bounds([int(s.max()) for _, _, s in own], [None] * (len(own) - 1))
            at, floor = search.best_documents(own, bounds, 0, 3, got)
            total = scores.sum(axis=1)
            third = max(1, np.sort(total)[-3])
            assert set(np.flatnonzero(total >= third)) <= set(at) and (got[at] == total[at]).all() and floor <= third
