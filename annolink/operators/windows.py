"""Window operators: cursors, carried values, counters, ids, runs, samples, suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _c
from ..session import settle
from .dyadic import cover_rows, node_rows
from .scan import Fold, number_rows, scan, shift


# WIN-01 -----------------------------------------------------------------
def onset_cursor(nodes: DataFrame, keys, order, kind="kind", duration="duration", cells=()) -> DataFrame:
    """Onset of every element of a measure, and the extent reached so far.

    kind: note, chord (sounds with the note before it), forward, backup, other. Notes and
    forwards move the cursor on, backups move it back; a chord member takes the onset of
    the last plain note.
    """
    k, d = _c(kind), F.coalesce(_c(duration), F.lit(0))
    delta = F.when(k.isin("note", "forward"), d).when(k == "backup", -d).otherwise(0)
    out = scan(nodes, keys, order, [Fold("cursor", "sum", delta, inclusive=False)], cells)
    plain = F.when(k == "note", F.col("cursor"))
    reach = F.when(k.isin("note", "forward"), F.col("cursor") + d)
    out = scan(out, keys, order, [Fold("__last", "last", plain), Fold("extent", "max", reach)], cells)
    onset = F.when(k == "chord", F.coalesce("__last", F.lit(0))).otherwise(F.col("cursor"))
    extent = F.greatest(F.coalesce(F.col("extent"), F.lit(0)), F.lit(0))
    return out.withColumns({"onset": onset, "extent": extent}).drop("__last")


# WIN-02 -----------------------------------------------------------------
def carry_forward(df: DataFrame, keys, order, defaults: dict, cells=()) -> DataFrame:
    """Latest value at or before each row, else the default, for every column of `defaults`."""
    folds = [Fold(f"__cf_{c}", "last", F.col(c)) for c in defaults]
    out = scan(df, keys, order, folds, cells)
    filled = {c: F.coalesce(F.col(f"__cf_{c}"), F.lit(v)) for c, v in defaults.items()}
    return out.withColumns(filled).drop(*[f"__cf_{c}" for c in defaults])


# WIN-03 -----------------------------------------------------------------
def layout_counters(measures: DataFrame, keys, order, new_page="new_page", new_system="new_system", cells=()) -> DataFrame:
    """Page and system number of each measure.

    A page break opens a page and system 1; a system break adds a system; the first
    measure without either opens page 1 when no page is open yet.
    """
    np = F.coalesce(_c(new_page), F.lit(False))
    ns = F.coalesce(_c(new_system), F.lit(False)) & ~np
    opener = (np | ~ns).cast("int")
    out = scan(measures, keys, order, [Fold("__opened", "sum", opener, inclusive=False)], cells)
    turn = np | (~ns & (F.col("__opened") == 0))
    out = out.withColumns({"__turn": turn.cast("int"), "__ns": ns.cast("int")})
    out = scan(out, keys, order, [Fold("page", "sum", F.col("__turn")), Fold("__nsum", "sum", F.col("__ns"))], cells)
    at_turn = F.when(F.col("__turn") == 1, F.col("__nsum"))
    out = scan(out, keys, order, [Fold("__base", "last", at_turn)], cells)
    system = F.col("__nsum") - F.coalesce("__base", F.lit(0)) + F.when(F.col("page") > 0, 1).otherwise(0)
    return out.withColumns({"page": F.col("page").cast("int"), "system": system.cast("int")}).drop(
        "__opened", "__turn", "__ns", "__nsum", "__base"
    )


# WIN-04 -----------------------------------------------------------------
def assign_ids(df: DataFrame, keys, order, fmt: str, out: str, cells=()) -> DataFrame:
    """Padded running id, per group or, with no keys, over the whole table.

    fmt takes the group's key text first when there are keys, for example "%s:E%07d". A
    whole-table id is ranked by ranges of the order (see ranking.py).
    """
    numbered = number_rows(df, keys, order, "__rn", cells)
    args = [F.concat_ws(":", *keys)] if keys else []
    return numbered.withColumn(out, F.format_string(fmt, *args, F.col("__rn"))).drop("__rn")


# WIN-05 -----------------------------------------------------------------
def cumulative_position(df: DataFrame, keys, order, width: str, offset="x_offset", norm="x_norm", cells=()) -> DataFrame:
    """Width of everything before the row, and its share of the whole width (0 when that is 0)."""
    w = F.col(width)
    out = scan(df, keys, order, [Fold(offset, "sum", w, False), Fold("__rest", "rsum", w)], cells)
    total = F.col(offset) + F.col("__rest")
    return out.withColumn(norm, F.when(total > 0, F.col(offset) / total).otherwise(0.0)).drop("__rest")


# WIN-06 -----------------------------------------------------------------
def derive_end(df: DataFrame, keys, page="page", start="start", end="end", cells=()) -> DataFrame:
    """A missing page end is the next page's start minus one, if that page follows directly."""
    out = shift(df, keys, [page], {"__np": F.col(page), "__ns": F.col(start)}, cells, ahead=True)
    follows = F.col("__np") == F.col(page) + 1
    fill = F.when(follows & F.col(start).isNotNull(), F.col("__ns") - 1)
    return out.withColumn(end, F.coalesce(F.col(end), fill)).drop("__np", "__ns")


def printed_numbers(df: DataFrame, keys, order, start: Column, pickup: Column, out="printed_measure", cells=()) -> DataFrame:
    """Printed number of the k-th measure of a system: start + (k - 1) - pickup."""
    return number_rows(df, keys, order, "__rn", cells).withColumn(out, start + F.col("__rn") - 1 - pickup).drop("__rn")


# WIN-07 -----------------------------------------------------------------
def chunk(df: DataFrame, keys, order, n: int, cells=()) -> DataFrame:
    """Part number (from 1) and position inside the part, n rows per part."""
    out = number_rows(df, keys, order, "__rn", cells)
    return out.withColumns(
        {"part": F.ceil(F.col("__rn") / n).cast("int"), "slot": ((F.col("__rn") - 1) % n + 1).cast("int")}
    ).drop("__rn")


# WIN-08 -----------------------------------------------------------------
def sample_extremes(df: DataFrame, strata, value: str, row_id: str) -> DataFrame:
    """Lowest and highest row per stratum, one row only where the stratum has one."""
    key = F.struct(F.col(value).alias("value"), F.col(row_id).alias("row_id"))
    ends = df.groupBy(*strata).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    tagged = F.array(
        F.struct(F.lit("lowest").alias("reason"), F.lit(1).alias("position"), F.col("lo").alias("at")),
        F.struct(F.lit("highest").alias("reason"), F.lit(2).alias("position"), F.col("hi").alias("at")),
    )
    both = F.filter(tagged, lambda t: (t["position"] == 1) | (F.col("lo") != F.col("hi")))
    return ends.select(*strata, F.explode(both).alias("s")).select(
        *strata, "s.reason", "s.position", F.col("s.at.value").alias(value), F.col("s.at.row_id").alias(row_id)
    )


# WIN-09 -----------------------------------------------------------------
def round_robin(df: DataFrame, strata, order: Sequence[Column], n: int) -> DataFrame:
    """Take n rows by turns: first of every stratum in stratum order, then the second ones, ...

    Ranks beyond n cannot be taken, so each map task keeps n rows per stratum at most.
    """
    w = Window.partitionBy(*strata).orderBy(*order)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", *strata).limit(n)


# WIN-10 -----------------------------------------------------------------
def islands(df: DataFrame, keys, pos: str, cells=()) -> DataFrame:
    """Runs of consecutive integers: keys, island (first value), last, length."""
    d = df.select(*keys, pos).distinct()
    d = shift(d, keys, [pos], {"__prev": F.col(pos)}, cells)
    start = F.when(F.col("__prev").isNull() | (F.col(pos) > F.col("__prev") + 1), F.col(pos))
    d = scan(d, keys, [pos], [Fold("island", "last", start)], cells)
    return d.groupBy(*keys, "island").agg(F.max(pos).alias("last"), F.count(F.lit(1)).alias("length"))


def longest_run(df: DataFrame, keys, pos: str, cells=()) -> DataFrame:
    return islands(df, keys, pos, cells).groupBy(*keys).agg(F.max("length").alias("longest_run"))


# WIN-11 -----------------------------------------------------------------
def suppress(df: DataFrame, keys, row_id: str, score: str, lo: str, hi: str, bits: int, levels: int | None = None) -> DataFrame:
    """Greedy choice of non-overlapping intervals, best score first (then smaller id).

    lo and hi are integer ticks in [0, 2**bits). Each round keeps every interval that beats
    all it overlaps and drops what these overlap; equal to the one-by-one choice. The best
    overlapping rival comes from dyadic maxima, so no pair of intervals is ever formed.
    """
    keys = list(keys)
    active = settle(df.select(*keys, row_id, score, lo, hi))
    kept = None
    while True:
        best = _best_overlap(active, active, keys, row_id, score, lo, hi, bits, levels)
        winners = active.join(best.where(F.col("best_id") == F.col(row_id)).select(*keys, row_id), [*keys, row_id])
        winners = settle(winners)
        if winners.isEmpty():
            break
        kept = winners if kept is None else kept.unionByName(winners)
        hit = _best_overlap(active, winners, keys, row_id, score, lo, hi, bits, levels)
        active = settle(active.join(hit.select(*keys, row_id), [*keys, row_id], "left_anti"))
        if active.isEmpty():
            break
    return kept if kept is not None else active


def _best_overlap(queries, items, keys, row_id, score, lo, hi, bits, levels) -> DataFrame:
    """Best item overlapping each query: it covers the query's start, or starts inside it."""
    rank = F.struct(F.col(score).alias("score"), (-F.col(row_id)).alias("neg_id"))
    it = items.select(*keys, rank.alias("rank"), F.col(lo).alias("__a"), F.col(hi).alias("__b"))
    covering = cover_rows(it, F.col("__a"), F.col("__b"), bits, levels=levels).groupBy(*keys, "node").agg(F.max("rank").alias("rank")).withColumn("way", F.lit(0))
    starting = node_rows(it, F.col("__a"), bits, levels=levels).groupBy(*keys, "node").agg(F.max("rank").alias("rank")).withColumn("way", F.lit(1))
    q = queries.select(*keys, row_id, F.col(lo).alias("__a"), F.col(hi).alias("__b"))
    ask = node_rows(q, F.col("__a"), bits, levels=levels).select(*keys, row_id, "node", F.lit(0).alias("way")).unionByName(
        cover_rows(q.where("__b > __a"), F.col("__a") + 1, F.col("__b"), bits, levels=levels).select(*keys, row_id, "node", F.lit(1).alias("way")))
    found = ask.join(covering.unionByName(starting), [*keys, "node", "way"])
    return found.groupBy(*keys, row_id).agg((-F.max("rank")["neg_id"]).alias("best_id"))


# WIN-12 -----------------------------------------------------------------
def argmax_near(profile: DataFrame, predicted: DataFrame, keys, band: Column, edge_min: int = 20,
                edge_share: float = 0.04, cells=()) -> DataFrame:
    """Best column of a profile near each predicted position.

    profile: keys, x, run, ink. predicted: keys, idx, px (rounded in use), width (of the
    system). Inner positions search between the midpoints to their neighbours; the first
    and last search a window around themselves. Score 2*run + ink - 0.4*|x - px|.
    """
    keys = list(keys)
    p = shift(predicted, keys, ["idx"], {"__pp": F.col("px")}, cells)
    p = shift(p, keys, ["idx"], {"__np": F.col("px")}, cells, ahead=True)
    edge = F.col("__pp").isNull() | F.col("__np").isNull()
    win = F.greatest(F.lit(edge_min), F.round(F.col("width") * edge_share)).cast("bigint")
    p = p.withColumns(
        {
            "edge": edge,
            "left": F.when(edge, F.round("px") - win).otherwise(F.round((F.col("__pp") + F.col("px")) / 2)).cast("bigint"),
            "right": F.when(edge, F.round("px") + win).otherwise(F.round((F.col("px") + F.col("__np")) / 2)).cast("bigint"),
        }
    ).drop("__pp", "__np")
    spots = p.select(*keys, "idx", "px", "edge", F.explode(F.sequence("left", "right")).alias("x"))
    cand = spots.join(profile, [*keys, "x"])
    score = F.round(2 * F.col("run") + F.col("ink") - 0.4 * F.abs(F.col("x") - F.col("px")), 6)
    top = cand.groupBy(*keys, "idx").agg(
        F.max(F.struct(score.alias("score"), "x", "run", "ink")).alias("top"),
        F.first("edge").alias("edge"), F.first("px").alias("predicted_x"),
    )
    coverage = F.col("top.run") / band
    status = F.when(F.col("edge"), "system_edge").when(coverage >= 0.85, "detected").otherwise("review_occluded")
    return top.select(*keys, "idx", "predicted_x", "top.x", "top.run", "top.ink", status.alias("status"))


# WIN-13 -----------------------------------------------------------------
def assert_monotone(df: DataFrame, keys, order, value: str, cells=(), strict=True) -> DataFrame:
    """Rows whose value does not grow along the order (violations only)."""
    out = shift(df, keys, order, {"previous": F.col(value)}, cells)
    bad = F.col(value) <= F.col("previous") if strict else F.col(value) < F.col("previous")
    return out.where(bad)
