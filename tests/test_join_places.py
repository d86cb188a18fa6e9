"""Rows that share a place are asked for once."""

from annolink.operators import joins as J


def counted(monkeypatch, name):
    seen, plain = [], getattr(J, name)
    monkeypatch.setattr(J, name, lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    return seen


def test_containing_band_asks_once_per_place(spark, monkeypatch):
    seen = counted(monkeypatch, "node_rows")
    pts = [(i, "k" if i % 2 else "m", i % 5 * 20) for i in range(400)]
    bands = [("k", 10, 30, 20, 1), ("k", 15, 45, 30, 2), ("k", 90, 95, 92, 3)]
    out = J.containing_band(spark.createDataFrame(pts, "p long, g string, x long"), spark.createDataFrame(bands, "g string, lo long, hi long, mid long, b long"), ["g"], "p", "x", "lo", "hi", "mid", "b", 8)

    def want(x):
        return min((max(lo - x, x - hi, 0), abs(x - mid), b) for _, lo, hi, mid, b in bands)

    assert sorted((r.p, r.b, r.outside) for r in out.collect()) == sorted((p, want(x)[2], want(x)[0]) for p, k, x in pts if k == "k")
    assert seen == [10]


def test_prefer_join_asks_once_per_wish_and_place(spark, monkeypatch):
    seen = counted(monkeypatch, "nearest_1d")
    left = [(i, i % 4, None if i % 3 == 0 else "a", i % 7 * 10) for i in range(400)]
    right = [(j, j % 3, "a" if j % 2 else "b", j % 5 * 15) for j in range(60)]
    out = J.prefer_join(spark.createDataFrame(left, "l long, g int, s string, x long"), spark.createDataFrame(right, "r long, g int, s string, x long"), ["g"], ["s"], "x", ["l"], "r").collect()

    def want(g, s, x):
        best = min(((s not in (None, rs), abs(x - rx), r) for r, rg, rs, rx in right if rg == g), default=None)
        return best and best[1:]

    assert sorted((r.l, tuple(r.near) if r.near else None) for r in out) == sorted((i, want(g, s, x)) for i, g, s, x in left)
    # 3 of the 4 keys have right rows; a null wish has one option, another has two
    assert seen == [3 * 7 * 3]


def test_interval_join_asks_once_per_tick(spark, monkeypatch):
    asked, covered = counted(monkeypatch, "node_rows"), counted(monkeypatch, "cover_rows")
    pts = [(i, i % 2, i % 5 * 9) for i in range(300)]
    spans = [(j, j % 6, j % 4 * 5, j % 4 * 5 + 12) for j in range(240)]
    out = J.interval_join(spark.createDataFrame(pts, "p long, k int, x long"), spark.createDataFrame(spans, "sid long, k int, s long, e long"), ["k"], "p", "x", "s", "e", "sid", 8)
    want = []
    for p, k, x in pts:
        best = min(((x - s, sid) for sid, sk, s, e in spans if sk == k and s <= x <= e), default=None)
        if best:
            want.append((p, best[1], best[0]))
    assert sorted((r.p, r.sid, r.gap) for r in out.collect()) == sorted(want)
    # equal spans and spans under keys without points take no part
    assert asked == [10] and covered == [4]
