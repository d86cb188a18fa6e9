"""Near-duplicates in long lists against brute force, and the guarantee of the second sketch."""

import random

import numpy as np
import pytest

from annolink.llm import near


def brute(rows, size, percent):
    sets = {k: set(near.shingle_set(t, size).tolist()) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_rare_value(percent):
    rng = np.random.default_rng(5)
    table = rng.integers(0, 9, 1 << near.BITS)
    for n in (1, 2, 5, 7, 13, 40, 200, 900):
        for _ in range(30):
            a = rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64)
            cut = int(rng.integers(0, n // 5 + 1))
            b = np.concatenate([a[cut:], rng.integers(-2**63, 2**63 - 1, int(rng.integers(0, n // 5 + 1)), dtype=np.int64)])
            both = len(set(a.tolist()) & set(b.tolist()))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                low = [set(near.rare_first(np.unique(x), table, percent).tolist()) for x in (a, b)]
                assert low[0] & low[1], (len(a), len(b), both)


def test_long_lists(spark):
    """Sixty near copies in a chain, eighty clean texts around one passage, one hot exact copy."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10_000)}"
    chain, rows = [word() for _ in range(200)], []
    for i in range(60):
        rows.append((i * 7 + 3, " ".join(chain)))
        for _ in range(3):
            chain[rng.randrange(200)] = word()
    passage = " ".join(word() for _ in range(120))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(20 + i))) for i in range(80)]
    rows += [(2000 + i, "same text again and again") for i in range(50)] + [(3000, None), (3001, " "), (3002, "one two")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, node string")
    for size, percent in ((3, 85), (5, 80)):
        want = brute(rows, size, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.similar_components(docs, size, percent).collect()}
        assert got == want
        kept = near.drop_similar(docs, size, percent)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, (_, c) in want.items() if k == c}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(5, text), (5, "quite another text of some words"), (2, "quite another text of some words"), (None, text), (9, text + " end"), (7, None)]
    got = near.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.doc_id in (2, 5, 9)} == {2}


def test_parities_never_pass_the_difference():
    rng = np.random.default_rng(7)
    for n in (1, 3, 50, 400, 6000):
        a = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
        b = np.unique(np.concatenate([a[n // 9:], rng.integers(-2**63, 2**63 - 1, n // 7, dtype=np.int64)]))
        differ = sum(int(x).bit_count() for x in (near.parities(a) ^ near.parities(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b)) and len(near.parities(a)) * 64 == near.PARITIES
    assert not near.parities(a[:0]).any()


def test_group_below_the_threshold_makes_no_pairs(spark, monkeypatch):
    """Forty texts of one rare passage and two frequent lines each: every two are just below the threshold."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage, lines = " ".join(word() for _ in range(150)), [" ".join(word() for _ in range(9)) for _ in range(80)]
    rows = [(i, f"{lines[2 * i]} {passage} {lines[2 * i + 1]}") for i in range(40)]
    rows += [(100 + i, " ".join(rng.sample(lines, len(lines)))) for i in range(100)]
    asked, whole = [], near.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return whole(pairs, *rest)
    monkeypatch.setattr(near, "verified", counted)
    got = near.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)
    assert sum(asked) < 2 * len(rows)
