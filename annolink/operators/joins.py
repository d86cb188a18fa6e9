"""Join operators: positional, tolerant, containing, nearest, as-of, preferring, exact."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c
from ..session import settle
from .dyadic import cover_rows, node_rows
from .nearest import Axis, nearest_1d, nearest_l1
from .pick import smallest
from .plane import k_nearest, squared
from .scan import Fold, cell_of, number_rows, scan, stack


# JN-01 -----------------------------------------------------------------
def pair_outer(left: DataFrame, right: DataFrame, keys, first: int | None = None, last: int | None = None,
               page: str | None = None) -> DataFrame:
    """Full outer pairing by key with a status; keys seen twice on a side are reported, not paired."""
    keys = list(keys)
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_rows"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_rows"))
    out = l.join(r, keys, "full_outer").fillna(0, ["left_rows", "right_rows"])
    status = (
        F.when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "duplicate_key")
        .when(F.col("right_rows") == 0, "missing_right")
        .when(F.col("left_rows") == 0, "missing_left")
        .otherwise("paired")
    )
    out = out.withColumn("pair_status", status)
    if page is not None and first is not None:
        out = out.where(F.col(page) >= first)
    if page is not None and last is not None:
        out = out.where(F.col(page) <= last)
    return out


# JN-02 / JN-03 ------------------------------------------------------------
def zip_join(left: DataFrame, right: DataFrame, keys, left_order, right_order, left_cols: dict[str, str],
             right_cols: dict[str, str], left_cells=(), right_cells=(), ordinal: str = "k") -> DataFrame:
    """k-th left row with the k-th right row of a group; leftovers of both sides stay.

    left_cols / right_cols map source columns to output names. Adds k (or `ordinal`), n_left, n_right,
    pair_status and confidence (smaller count over larger count).
    """
    keys = list(keys)
    l = number_rows(left, keys, left_order, ordinal, left_cells).select(
        *keys, ordinal, *[F.col(s).alias(o) for s, o in left_cols.items()], F.lit(True).alias("__l"))
    r = number_rows(right, keys, right_order, ordinal, right_cells).select(
        *keys, ordinal, *[F.col(s).alias(o) for s, o in right_cols.items()], F.lit(True).alias("__r"))
    nl = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    nr = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    counts = nl.join(nr, keys, "full_outer").fillna(0, ["n_left", "n_right"])
    out = l.join(r, [*keys, ordinal], "full_outer").join(counts, keys, "left")
    paired = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    conf = F.when(
        F.col("n_left") == F.col("n_right"), 1.0
    ).otherwise(F.least("n_left", "n_right") / F.greatest("n_left", "n_right", F.lit(1)))
    status = (
        F.when(paired & (F.col("n_left") == F.col("n_right")), "matched")
        .when(paired, "review").when(F.col("__l").isNotNull(), "left_only").otherwise("right_only")
    )
    return out.withColumns({"pair_status": status, "confidence": F.round(conf, 6)}).drop("__l", "__r")


def consume_join(left, right, keys, left_order, right_order, left_cols, right_cols, left_cells=(), right_cells=(), ordinal: str = "k") -> DataFrame:
    """First come, first served on an exact key: every right row is used once (zip of the two queues)."""
    out = zip_join(left, right, keys, left_order, right_order, left_cols, right_cols, left_cells, right_cells, ordinal)
    return out.where(F.col("pair_status") != "right_only").drop("n_left", "n_right", "confidence").withColumn(
        "pair_status", F.when(F.col("pair_status") == "left_only", "unmatched").otherwise("exact")
    )


# JN-04 -----------------------------------------------------------------
def nearest_within(left, right, keys, x, right_id, tolerance: int, width=None, payload=()) -> DataFrame:
    """Nearest right row within a tolerance; a right row may serve several left rows."""
    return nearest_1d(left, right, keys, x, right_id, width, payload, max_gap=tolerance)


def tolerance_join(left, right, keys, x: str, left_id: str, right_id: str, tolerance: int, width=None) -> DataFrame:
    """One-to-one pairs within a tolerance, closest first (ties: smaller left id, then right id).

    Rounds of mutual nearest neighbours, each a linear scan; equal to the sequential greedy.
    Returns keys, left_id, right_id, gap.
    """
    keys = list(keys)
    l = settle(left.select(*keys, x, left_id))
    r = settle(right.select(*keys, x, right_id))
    done = None
    while True:
        a = nearest_1d(l, r, keys, x, right_id, width, max_gap=tolerance).where(F.col("near").isNotNull())
        b = nearest_1d(r, l, keys, x, left_id, width, max_gap=tolerance).where(F.col("near").isNotNull())
        a = a.select(*keys, left_id, F.col("near.id").alias(right_id), F.col("near.gap").alias("gap"))
        b = b.select(*keys, F.col("near.id").alias(left_id), right_id)
        pairs = settle(a.join(b, [*keys, left_id, right_id]))
        if pairs.isEmpty():
            return done if done is not None else pairs
        done = pairs if done is None else done.unionByName(pairs)
        near_l = a.select(*keys, left_id)  # rows without any partner in reach can never pair later
        l = settle(l.join(near_l, [*keys, left_id], "left_semi").join(pairs, [*keys, left_id], "left_anti"))
        r = settle(r.join(pairs, [*keys, right_id], "left_anti"))


# JN-05 -----------------------------------------------------------------
def interval_join(points: DataFrame, spans: DataFrame, keys, point_id: str, x: str, start: str, end: str,
                  span_id: str, bits: int, levels: int | None = None) -> DataFrame:
    """The containing span that starts nearest before each point (ties: smaller id); spans are reusable.

    Integer ticks in [0, 2**bits). Spans are cut into dyadic blocks and reduced to one row
    per block before the join, so overlap never multiplies rows. Only spans under a key of some
    point take part, one of equal ones; each tick of a key is asked for once, however many points
    share it. Returns keys, point_id, span_id, gap for points inside some span.
    """
    keys = list(keys)
    p = points.select(*keys, point_id, F.col(x).alias("__px"))
    s = spans.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(span_id).alias("__sid"))
    s = s.join(p.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "__start", "__end").agg(F.min("__sid").alias("__sid"))
    s = s.withColumn("__neg", -F.col("__start"))
    best = smallest(cover_rows(s, F.col("__start"), F.col("__end"), bits, levels=levels), [*keys, "node"], "__neg", "__sid")
    ask = node_rows(p.select(*keys, "__px").distinct(), F.col("__px"), bits, levels=levels)
    hit = ask.join(best, [*keys, "node"]).select(*keys, "__px", (F.col("__px") + F.col("__neg")).alias("gap"), F.col("__sid").alias(span_id))
    found = p.join(smallest(hit, [*keys, "__px"], "gap", span_id), [*keys, "__px"])
    return smallest(found, [*keys, point_id], "gap", span_id).select(*keys, point_id, span_id, "gap")


# JN-06 -----------------------------------------------------------------
def resolve_tiers(left: DataFrame, right: DataFrame, keys, left_id: str, right_id: str, x: str, start: str, end: str,
                  tolerance: int, bits: int, left_order=None, width=None, exact_unit: int = 1, levels: int | None = None) -> DataFrame:
    """Exact key, then tolerance, then containment; keys, left_id, right_id, tier for every left row.

    The first two tiers use a right row once; containment may reuse one. Times that agree
    after rounding to exact_unit ticks count as exact.
    """
    keys = list(keys)
    lo = list(left_order or [left_id])
    near = lambda c: F.round(F.col(c) / exact_unit).cast("bigint")
    l = left.withColumns({"__t": F.col(x), "__e": near(x)})
    r = right.withColumns({"__t": F.col(start), "__e": near(start)})
    exact = consume_join(
        l, r, [*keys, "__e"], lo, [right_id], {left_id: left_id}, {right_id: right_id}, ordinal="__nth"
    ).where(F.col("pair_status") == "exact").select(*keys, left_id, right_id, F.lit("exact").alias("tier"))
    exact = settle(exact)
    l2 = settle(l.join(exact, [*keys, left_id], "left_anti"))
    r2 = r.join(exact, [*keys, right_id], "left_anti")
    tol = tolerance_join(l2, r2, keys, "__t", left_id, right_id, tolerance, width)
    tol = tol.select(*keys, left_id, right_id, F.lit("rounded_tolerance").alias("tier"))
    l3 = l2.join(tol, [*keys, left_id], "left_anti")
    inside = interval_join(l3, right, keys, left_id, x, start, end, right_id, bits, levels)
    inside = inside.select(*keys, left_id, right_id, F.lit("within_tied_span").alias("tier"))
    found = exact.unionByName(tol).unionByName(inside)
    return left.select(*keys, left_id).join(found, [*keys, left_id], "left").fillna("unmatched", ["tier"])


# JN-07 -----------------------------------------------------------------
def nearest_band(points: DataFrame, bands: DataFrame, keys, point_id: str, x: str, center: str, band_id: str, width=None) -> DataFrame:
    """Band with the nearest centre (ties: smaller band id)."""
    b = bands.select(*keys, F.col(center).alias(x), band_id)
    return nearest_1d(points.select(*keys, point_id, x), b, keys, x, band_id, width).select(
        *keys, point_id, F.col("near.id").alias(band_id), F.col("near.gap").alias("gap")
    )


def containing_band(points: DataFrame, bands: DataFrame, keys, point_id: str, x: str, lo: str, hi: str, center: str,
                    band_id: str, bits: int, width=None) -> DataFrame:
    """Band around the point (nearest centre if several), else the band with the nearest edge.

    Inside: bands and points meet on dyadic blocks and the nearest centre is scanned per
    block. Outside: the nearest upper or lower edge; equal edges prefer the nearer centre.
    Each place under a key is asked for once, however many points share it.
    """
    keys = list(keys)
    bx = cover_rows(bands.select(*keys, F.col(center).alias(x), band_id, F.col(lo).alias("__from"), F.col(hi).alias("__to")), F.col("__from"), F.col("__to"), bits).drop("__from", "__to")
    places = points.select(*keys, x, F.col(x).alias("__at")).distinct()
    px = node_rows(places, F.col(x), bits)
    near = nearest_1d(px, bx, [*keys, "node"], x, band_id, width).where(F.col("near").isNotNull())
    inside = near.groupBy(*keys, "__at").agg(F.min("near").alias("near")).select(
        *keys, "__at", F.lit(0).cast("bigint").alias("outside"), F.col("near.gap").alias("c"), F.col("near.id").alias("b"))
    rest = places.join(inside, [*keys, "__at"], "left_anti")
    below = bands.select(*keys, F.col(hi).alias(x), F.struct((F.col(hi) - F.col(center)).alias("c"), F.col(band_id).alias("b")).alias("k"))
    above = bands.select(*keys, F.col(lo).alias(x), F.struct((F.col(center) - F.col(lo)).alias("c"), F.col(band_id).alias("b")).alias("k"))
    a = nearest_side(rest, below, keys, "__at", x, "k", width, forward=False)
    b = nearest_side(rest, above, keys, "__at", x, "k", width, forward=True)
    edge = a.unionByName(b).groupBy(*keys, "__at").agg(F.min(F.struct("gap", F.expr("k.c + gap").alias("c"), F.col("k.b").alias("b"))).alias("e"))
    outside = edge.select(*keys, "__at", F.col("e.gap").alias("outside"), F.col("e.c").alias("c"), F.col("e.b").alias("b"))
    found = points.select(*keys, point_id, F.col(x).alias("__at")).join(inside.unionByName(outside), [*keys, "__at"])
    return found.groupBy(*keys, point_id).agg(F.min(F.struct("outside", "c", "b")).alias("m")).select(
        *keys, point_id, F.col("m.b").alias(band_id), F.col("m.outside").alias("outside"))


def nearest_side(left, right, keys, left_id, x, right_id, width=None, forward=False) -> DataFrame:
    """Nearest right row on one side only: at or before, or (forward) after the left row."""
    from .nearest import neighbours

    out = neighbours(left, right, keys, x, right_id, width)
    side = "after" if forward else "before"
    gap = F.col("after.x") - F.col(x) if forward else F.col(x) - F.col("before.x")
    return out.where(F.col(side).isNotNull()).select(*keys, left_id, F.col(f"{side}.best.id").alias(right_id), gap.alias("gap"))


# JN-08 / JN-09 ------------------------------------------------------------
def nearest_join(left, right, keys, left_id, right_id, x, y, bits: int, page_width: Column | None = None, width=None) -> DataFrame:
    """Nearest anchor under |dx| + 0.18*|dy| on integer ticks; cost is in hundredths of a tick.

    With page_width (left column) adds confidence = 0.49*exp(-4*d/width) held in [0.10, 0.49].
    """
    near = nearest_l1(left, right, keys, left_id, right_id, x, x, 100, [Axis(y, y, 18, bits)], width)
    out = near.select(*keys, left_id, F.col("near.id").alias(right_id), F.col("near.cost").alias("cost"))
    if page_width is None:
        return out
    w = left.select(*keys, left_id, page_width.alias("__w"))
    d = F.col("cost") / 100 / F.greatest(F.col("__w"), F.lit(1))
    conf = F.least(F.lit(0.49), F.greatest(F.lit(0.10), 0.49 * F.exp(-4 * d)))
    return out.join(w, [*keys, left_id]).withColumn("confidence", F.round(conf, 6)).drop("__w")


def nearest_span(left, right, keys, left_id, right_id, x0, x1, y, right_x, right_y, time: str, bits: int, width=None) -> DataFrame:
    """Anchors nearest to both ends of a box, put in time order."""
    keys = list(keys)
    a = Axis(y, right_y, 18, bits)
    s = nearest_l1(left, right, keys, left_id, right_id, x0, right_x, 100, [a], width, out="__s")
    e = nearest_l1(left, right, keys, left_id, right_id, x1, right_x, 100, [a], width, out="__e")
    t = right.select(*keys, F.col(right_id).alias("__id"), F.col(time).alias("__t"))
    out = s.join(e, [*keys, left_id])
    for side in ("s", "e"):
        tt = t.withColumnRenamed("__id", f"__{side}id").withColumnRenamed("__t", f"__{side}t")
        out = out.withColumn(f"__{side}id", F.col(f"__{side}.id")).join(tt, [*keys, f"__{side}id"], "left")
    swap = F.col("__et") < F.col("__st")
    first = F.when(swap, F.col("__eid")).otherwise(F.col("__sid"))
    last = F.when(swap, F.col("__sid")).otherwise(F.col("__eid"))
    return out.select(*keys, left_id, first.alias("start_id"), last.alias("end_id"),
                      F.least("__st", "__et").alias("start_time"), F.greatest("__st", "__et").alias("end_time"))


# JN-10 / JN-11 ------------------------------------------------------------
def asof_backward(left, right, keys, left_time, right_time, right_cols: dict[str, str], right_order=(), width=None) -> DataFrame:
    """State in force at each left row: the latest right row at or before it (by time, not by file order)."""
    keys = list(keys)
    ro = [F.col(right_time), *[F.col(c) for c in right_order]]
    lo = [F.col(left_time), *[F.lit(None).cast(right.schema[c].dataType) for c in right_order]]
    both, order = stack(left, right, keys, lo, ro, right_first=True)
    cells = [cell_of("__o0", width)] if width else []
    seq = [order[0], "__side", *order[1:]]
    out = scan(both, keys, seq, [Fold("__hit", "last", F.col("__r"))], cells)
    out = out.where(F.col("__l").isNotNull())
    return out.select("__l.*", *[F.col(f"__hit.{s}").alias(o) for s, o in right_cols.items()])


def asof_forward(left, right, keys, left_time, right_time, right_cols: dict[str, str], right_order=(), width=None) -> DataFrame:
    """Next right row at or after each left row (ties by right_order)."""
    keys = list(keys)
    ro = [F.col(right_time), *[F.col(c) for c in right_order]]
    lo = [F.col(left_time), *[F.lit(None).cast(right.schema[c].dataType) for c in right_order]]
    both, order = stack(left, right, keys, lo, ro, right_first=False)
    cells = [cell_of("__o0", width)] if width else []
    seq = [order[0], "__side", *order[1:]]
    out = scan(both, keys, seq, [Fold("__hit", "first", F.col("__r"))], cells)
    out = out.where(F.col("__l").isNotNull())
    return out.select("__l.*", *[F.col(f"__hit.{s}").alias(o) for s, o in right_cols.items()])


# JN-12 -----------------------------------------------------------------
def prefer_join(left, right, hard, prefs: Sequence[str], x: str, left_id: Sequence[str], right_id: str, width=None,
                rank: str | None = None, ranks: int = 0, rank_after: int = 0) -> DataFrame:
    """Nearest right row in time among the rows that satisfy the most important preferences.

    hard: columns that must be equal. prefs: columns whose equality is wished for, most
    important first; a NULL wish is neutral. rank: a right column 0..ranks-1 of which less is
    better, weighed after the first `rank_after` wishes. left_id must be unique.

    Left rows that agree in hard, prefs and x are asked for once, and only under a hard key that the
    right side has; the smallest of right rows that agree in them stands for all. Ordering by the negated wishes and then by time equals a nearest search for every set of
    kept wishes. The set is part of the key, so all of them run as one scan, and a large
    hard key never meets itself. Returns left with struct near(gap, id), NULL if none.
    """
    hard, prefs = list(hard), list(prefs)
    axes = [[("p", p, 1), ("p", p, 0)] for p in prefs]
    if rank is not None:
        axes.insert(rank_after, [("r", rank, i) for i in range(ranks)])
    options = []
    for i, choice in enumerate(product(*axes)):
        mask = sum(1 << prefs.index(n) for kind, n, on in choice if kind == "p" and on)
        level = next((v for kind, _, v in choice if kind == "r"), 0)
        options.append(F.struct(F.lit(i).alias("opt"), F.lit(mask).alias("mask"), F.lit(level).alias("level")))
    masks = F.array(*[F.lit(m) for m in range(1 << len(prefs))])

    def keyed(df):
        bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) > 0
        for i, p in enumerate(prefs):
            df = df.where(~bit(i) | F.col(p).isNotNull())
        return df.select(*hard, "mask", "level", *[F.when(bit(i), F.col(p).cast("string")).otherwise("").alias(f"__p{i}") for i, p in enumerate(prefs)],
                         F.col(x), *[c for c in df.columns if c in ("__rid", "opt") or c.startswith("__id")])

    alike = [*hard, *prefs, x]
    r = right.withColumn("level", F.col(rank) if rank else F.lit(0))
    r = r.groupBy(*alike, "level").agg(F.min(right_id).alias("__rid")).withColumn("mask", F.explode(masks))
    ids = {f"__id{i}": F.col(c) for i, c in enumerate(alike)}
    asked = left.select(*alike).distinct().join(right.select(*hard).distinct(), hard, "left_semi")
    l = keyed(asked.withColumns(ids).withColumn("o", F.explode(F.array(*options))).select("*", "o.*"))
    keys = [*hard, "mask", "level", *[f"__p{i}" for i in range(len(prefs))]]
    near = nearest_1d(l, keyed(r), keys, x, "__rid", width).where("near is not null")
    best = near.groupBy(*ids).agg(F.min(F.struct("opt", "near")).alias("__b")).select(*ids, F.col("__b.near").alias("near"))
    same = [F.col(c).eqNullSafe(F.col(n)) for n, c in zip(ids, alike)]
    return left.join(best, same, "left").drop(*ids)


# JN-13 -----------------------------------------------------------------
def lookup_one(left: DataFrame, right: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """Lookup that must find exactly one row; matches counts what was found, cols stay NULL unless it is 1."""
    keys = list(keys)
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), *[F.min(c).alias(c) for c in cols])
    out = left.join(r, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumns({c: F.when(F.col("matches") == 1, F.col(c)) for c in cols})


def lookup_one_near(left, right, keys, x: str, right_id: str, tolerance: int) -> DataFrame:
    """As lookup_one, with an integer time that may differ by `tolerance` ticks."""
    keys = list(keys)
    r = right.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n"), F.min(right_id).alias("__id"))
    steps = F.array(*[F.lit(i) for i in range(-tolerance, tolerance + 1)])
    probe = left.withColumn("__x0", F.col(x)).withColumn("__d", F.explode(steps)).withColumn(x, F.col(x) + F.col("__d"))
    hit = probe.join(r, [*keys, x], "left")
    group = [c for c in left.columns if c != x]
    # equal left rows are counted and come back as rows of their own
    copies = (F.count(F.lit(1)) / (2 * tolerance + 1)).cast("bigint")
    found = hit.groupBy(*[c for c in group if c != "__x0"], F.col("__x0").alias(x)).agg(
        copies.alias("__copies"), (F.coalesce(F.sum("__n"), F.lit(0)) / copies).cast("bigint").alias("matches"), F.min("__id").alias(right_id))
    found = found.withColumn(right_id, F.when(F.col("matches") == 1, F.col(right_id)))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__copy", "__copies")


# JN-14 -----------------------------------------------------------------
def scope_join(systems: DataFrame, overrides: DataFrame) -> DataFrame:
    """Scope of each scanned system: an override, else identity when in range, else out of scope.

    systems: page_id, scan_page, scan_system, xml_system_count. overrides: page_id,
    scan_system, xml_page, xml_systems array<int>, mapping_status, movement_scope_status.
    """
    o = overrides.select(
        "page_id", "scan_system", F.col("xml_page").alias("__p"), F.col("xml_systems").alias("__s"),
        F.col("mapping_status").alias("__m"), F.col("movement_scope_status").alias("__c"), F.lit(True).alias("__o"),
    )
    out = systems.join(o, ["page_id", "scan_system"], "left")
    has = F.col("__o").isNotNull()
    dropped = has & F.col("__c").eqNullSafe(F.lit("outside_bpsd_scope"))
    inside = F.col("scan_system").between(1, F.col("xml_system_count"))
    none = F.array().cast("array<int>")
    direct = F.coalesce("__m", F.lit("direct"))
    return out.withColumns(
        {
            "movement_scope_status": F.when(dropped | (~has & ~inside), "outside_bpsd_scope").otherwise("in_bpsd_scope"),
            "page_mapping_status": F.when(dropped, F.coalesce("__m", F.lit("xml_missing"))).when(has, direct)
            .when(inside, "direct").otherwise("xml_missing"),
            "xml_page": F.when(dropped | (~has & ~inside), F.lit(None)).when(has, F.coalesce("__p", "scan_page")).otherwise(F.col("scan_page")),
            "xml_systems": F.when(dropped | (~has & ~inside), none).when(has, F.coalesce("__s", none))
            .otherwise(F.array(F.col("scan_system").cast("int"))),
            "mapping_source": F.when(has, "scope_override").when(inside, "page_and_system_identity")
            .otherwise("scan_system_beyond_xml_scope"),
            # the status compared here is the override's own text: an override without one needs review
            "review_status": F.when(has & ~dropped & ~F.col("__m").eqNullSafe(F.lit("direct")), "needs_review").otherwise("not_required"),
        }
    ).drop("__p", "__s", "__m", "__c", "__o")


# JN-15 -----------------------------------------------------------------
def dim_join(fact: DataFrame, dim: DataFrame, keys, cols, required: bool = False) -> DataFrame:
    """Lookup of dimension columns. With required, rows without a match get missing_<key> = true."""
    keys = list(keys)
    out = fact.join(dim.select(*keys, *cols, F.lit(True).alias("__hit")), keys, "left")
    if required:
        out = out.withColumn(f"missing_{keys[0]}", F.col("__hit").isNull())
    return out.drop("__hit")


# JN-16 -----------------------------------------------------------------
def exclude(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def require(df: DataFrame, wanted: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Rows of wanted keys, and the wanted keys that do not exist."""
    w = wanted.select(*keys).distinct()
    return df.join(w, list(keys), "left_semi"), w.join(df.select(*keys), list(keys), "left_anti")


# JN-17 -----------------------------------------------------------------
def snap_points(clicks: DataFrame, cands: DataFrame, keys, click_id: str, cand_id: str, x: str, y: str, max_distance: float) -> DataFrame:
    """Nearest candidate by straight-line distance, the smaller id of equals; the distance is given even when it is
    too far. A key without candidates has NULLs. Coordinates are integers.
    """
    keys = list(keys)
    near = k_nearest(clicks, cands, keys, click_id, cand_id, 1, squared, x, y, out="distance2")
    out = clicks.select(*keys, click_id).join(near.select(*keys, click_id, cand_id, "distance2"), [*keys, click_id], "left")
    close = F.sqrt(F.col("distance2").cast("double")) <= max_distance
    return out.select(*keys, click_id, F.when(close, F.col(cand_id)).alias(cand_id), "distance2")
