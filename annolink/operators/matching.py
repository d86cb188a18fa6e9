"""Matching and assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import threshold_for
from ..functions.text import _c
from ..session import settle
from .assignment import least_cost
from .nearest import Axis
from .ordering import top_k
from .pick import WHOLE, smallest
from .plane import k_nearest, nearest_lists, weighted_l1
from .scan import Fold, cell_of, number_rows, scan, stack

EXCLUDED = 1_000_000  # fixed value: a cost from here on means "never"


# MT-01 -----------------------------------------------------------------
def greedy_match(edges: DataFrame, block, left: str, right: str, cost: str, limit=EXCLUDED, in_task: int = 1_000_000) -> DataFrame:
    """One-to-one choice of edges by (cost, left, right), equal to taking them one by one.

    Each round keeps every edge that is the best of both its ends and drops all edges at
    those ends. The best of an end is an aggregation with partial minima, so an end or a
    block that holds a large share of the edges stays spread over the tasks. As soon as a
    block has at most `in_task` edges left, one sorted pass takes them one by one: chains
    of ends that wait for each other cost no rounds there.
    """
    block = list(block)
    whole = [F.col(c).isNotNull() for c in [*block, left, right]]
    active = edges.where(F.col(cost) < limit).groupBy(*block, left, right).agg(F.min(F.col(cost)).alias(cost))
    active = settle(reduce(DataFrame.where, whole, active))
    done = None
    while True:
        sizes = settle(active.groupBy(*block).agg(F.count(F.lit(1)).alias("__n")))
        few, many = sizes.where(F.col("__n") <= in_task).drop("__n"), sizes.where(F.col("__n") > in_task).drop("__n")
        if many.isEmpty():
            rest = settle(_one_by_one(active, block, left, right, cost))
            return rest if done is None else done.unionByName(rest)
        if not few.isEmpty():
            rest = settle(_one_by_one(_of_blocks(active, few, block), block, left, right, cost))
            done = rest if done is None else done.unionByName(rest)
            active = settle(_of_blocks(active, many, block))
        bl = smallest(active, [*block, left], cost, right)
        br = smallest(active, [*block, right], cost, left).drop(cost)
        won = settle(bl.join(br, [*block, left, right]))
        done = won if done is None else done.unionByName(won)
        active = settle(
            active.join(won.select(*block, left), [*block, left], "left_anti")
            .join(won.select(*block, right), [*block, right], "left_anti")
        )


def _of_blocks(edges: DataFrame, blocks: DataFrame, block) -> DataFrame:
    return edges.join(blocks, block, "left_semi") if block else edges


def _one_by_one(edges: DataFrame, block, left: str, right: str, cost: str) -> DataFrame:
    """The same choice in one pass per block over edges in order; only the ends in use are kept."""
    types = dict(edges.dtypes)
    # ends of several fields are told apart by their text
    plain = lambda c: F.col(c) if types[c] in WHOLE else F.to_json(F.struct(c))
    place = F.to_json(F.struct(*block)) if block else F.lit("")
    rows = edges.select(*block, left, right, cost)
    rows = (rows.repartition(*block) if block else rows.coalesce(1)).sortWithinPartitions(*block, cost, left, right)
    rows = rows.withColumns({"__b": place, "__l": plain(left), "__r": plain(right)})

    def take(batches):
        now, lefts, rights = None, set(), set()
        for batch in batches:
            keep = []
            for b, l, r in zip(*(batch.column(c).to_pylist() for c in ("__b", "__l", "__r"))):
                if b != now:
                    now, lefts, rights = b, set(), set()
                free = l not in lefts and r not in rights
                if free:
                    lefts.add(l)
                    rights.add(r)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(take, rows.schema).drop("__b", "__l", "__r")


def greedy_l1(left: DataFrame, right: DataFrame, block, search, left_id: str, right_id: str, lx: str, rx: str, wx,
              axes: Sequence[Axis], back_axes: Sequence[Axis], k: int = 32) -> DataFrame:
    """Greedy one-to-one matching under a weighted L1 cost, without forming the pairs.

    block: keys within which ids are unique. search: further keys that must agree. An id may
    occur on several search keys. back_axes describe the same cost seen from the right side.

    The side with fewer rows asks: each of its rows has a list of its k nearest rows, and greedy_match runs on these
    pairs. Rows in one place share a list; the j-th of them begins at the j-th entry, as those before it take the
    entries ahead or lose them. A row that gets nothing from a cut list waits. Pairs cheaper than all that the waiting
    rows of their block have not seen are final and leave; the waiting rows get longer lists of what is left.
    """
    block, keys = list(block), [*block, *search]
    l, r = settle(left), settle(right)
    if l.count() < r.count():
        asks, live, me, you, x0, x1, rule = l, r, left_id, right_id, lx, rx, axes
    else:
        asks, live, me, you, x0, x1, rule = r, l, right_id, left_id, rx, lx, back_axes
    where = F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate([*search, x0, *[a.left for a in rule]])])
    shapes = settle(asks.groupBy(*block, me).agg(F.to_json(F.sort_array(F.collect_list(where))).alias("__shape")))
    waiting, edges, bounds, final = shapes, None, None, None
    one = Window.partitionBy(*block, me)
    while True:
        mates = settle(number_rows(waiting, [*block, "__shape"], [me], "__j", [cell_of(me, 1 << 16)]))
        first = mates.where("__j = 1").select(*block, "__shape", me)
        lists = nearest_lists(asks.join(first.select(*block, me), [*block, me], "left_semi"), live, keys, me, you, x0, x1, wx, rule, k)
        # an id on several search keys knows all only up to the nearest end of a cut list
        lists = lists.withColumn("__end", F.min(F.when(F.col("rank") == k, F.struct("cost", you))).over(one))
        lists = lists.where(F.col("__end").isNull() | (F.struct("cost", you) <= F.col("__end")))
        lists = lists.groupBy(*block, me, you).agg(F.min("cost").alias("cost"), F.max("__end.cost").alias("__bound"))
        lists = lists.withColumn("__r", F.row_number().over(one.orderBy("cost", you)))
        lists = settle(lists.join(first, [*block, me]).drop(me))
        more = mates.join(lists, [*block, "__shape"]).where("__r >= __j").select(*block, me, you, "cost")
        cut = mates.join(lists.where("__bound is not null").select(*block, "__shape", "__bound").distinct(), [*block, "__shape"]).select(*block, me, "__bound")
        edges = settle(more if edges is None else edges.unionByName(more))
        bounds = settle(cut if bounds is None else bounds.unionByName(cut))
        held = greedy_match(edges, block, left_id, right_id, "cost", 1 << 62).select(*block, left_id, right_id, "cost")
        stuck = settle(bounds.join(held, [*block, me], "left_anti"))
        if stuck.isEmpty():
            break
        held = held.join(stuck.groupBy(*block).agg(F.min("__bound").alias("__least")), block, "left")
        sure = held.where("__least is null or cost < __least").drop("__least")
        final = settle(sure if final is None else final.unionByName(sure))
        held = settle(held.where("cost >= __least").drop("__least"))
        live = settle(live.join(final.select(*block, you), [*block, you], "left_anti"))
        edges = edges.join(held.select(*block, me), [*block, me], "left_semi").join(final.select(*block, you), [*block, you], "left_anti")
        bounds = bounds.join(held.select(*block, me), [*block, me], "left_semi")
        waiting = shapes.join(stuck.select(*block, me), [*block, me], "left_semi")
        k *= 4
    return held if final is None else final.unionByName(held)


def _confidence(cost: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.20), F.exp(-3.0 * cost)))


# MT-02 -----------------------------------------------------------------
def match_points(boxes: DataFrame, targets: DataFrame, bits: int = 13) -> DataFrame:
    """Point marks to chords: cost 3*dx/W + dy/H, +0.35 on the wrong side of the note.

    boxes: page_id, system, kind, mark, yolo_line, class, x, y, page_w, page_h.
    targets: page_id, system, kind, mark, seq (one per chord and rule, in order), x, y,
    page_w, page_h. x and y are integer pixels. Accepted only when the whole page has as
    many boxes as targets of the rule and the confidence reaches the class threshold.
    """
    rule = ["page_id", "kind", "mark"]
    t = targets.groupBy(*rule, "seq").agg(F.min(F.struct("system", "x", "y", "page_w", "page_h")).alias("t")).select(*rule, "seq", "t.*")
    side = F.when(F.col("class").endswith("Above"), "above").when(F.col("class").endswith("Below"), "below").otherwise("none")

    def weigh(df):
        return df.withColumns({"__wx": 300 * F.col("page_h"), "__wy": 100 * F.col("page_w"), "__pen": 35 * F.col("page_w") * F.col("page_h")})

    b = weigh(boxes.withColumn("side", side))
    tt = weigh(t.withColumn("side", F.explode(F.array(F.lit("above"), F.lit("below"), F.lit("none")))))
    above, below = F.col("side") == "above", F.col("side") == "below"
    pen = F.col("__pen")
    fwd = [Axis("y", "y", "__wy", bits, F.when(above, pen).otherwise(0), F.when(below, pen).otherwise(0), ~below)]
    back = [Axis("y", "y", "__wy", bits, F.when(below, pen).otherwise(0), F.when(above, pen).otherwise(0), ~above)]
    pairs = greedy_l1(b, tt, rule, ["system", "side"], "yolo_line", "seq", "x", "x", "__wx", fwd, back)
    nb = boxes.groupBy(*rule).agg(F.count(F.lit(1)).alias("n_boxes"))
    nt = t.groupBy(*rule).agg(F.count(F.lit(1)).alias("n_targets"))
    out = pairs.join(boxes.select(*rule, "yolo_line", "class", "page_w", "page_h"), [*rule, "yolo_line"])
    out = out.join(nb, rule, "left").join(nt, rule, "left")
    cost = F.col("cost") / (100.0 * F.col("page_w") * F.col("page_h"))
    ok = (F.col("n_boxes") == F.col("n_targets")) & (F.col("confidence") >= threshold_for("class", 0.65))
    return out.withColumn("confidence", _confidence(cost)).withColumn("status", F.when(ok, "matched").otherwise("review")).drop("page_w", "page_h", "cost")


# MT-03 -----------------------------------------------------------------
def match_ties(boxes: DataFrame, ties: DataFrame, bits: int = 13) -> DataFrame:
    """Tie boxes to ties: middle and width in one system; across systems the local end, +0.25.

    boxes: page_id, system, yolo_line, x, y, w (pixels), page_w, page_h. ties: page_id,
    tie_id, start_system, end_system, x0, y0, x1, y1, confirmed, page_w, page_h.
    """
    same = F.col("start_system") == F.col("end_system")

    def place(kind, system, x, y, w):
        return F.struct(F.lit(kind).alias("kind"), system.alias("system"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), w.cast("bigint").alias("w"))

    mid = place("same", F.col("start_system"), F.round((F.col("x0") + F.col("x1")) / 2), F.round((F.col("y0") + F.col("y1")) / 2), F.abs(F.col("x1") - F.col("x0")))
    ends = F.array(place("local", F.col("start_system"), F.col("x0"), F.col("y0"), F.lit(0)), place("local", F.col("end_system"), F.col("x1"), F.col("y1"), F.lit(0)))
    t = ties.withColumn("__p", F.explode(F.when(same, F.array(mid)).otherwise(ends))).select("page_id", "tie_id", "page_w", "page_h", "__p.*")
    b = boxes.withColumn("kind", F.explode(F.array(F.lit("same"), F.lit("local"))))
    b = b.withColumn("w", F.when(F.col("kind") == "same", F.col("w")).otherwise(0))  # a local end has no width

    def weigh(df):
        local = F.col("kind") == "local"
        return df.withColumns({
            "__wx": 200 * F.col("page_h"), "__wy": 35 * F.col("page_w"), "__ww": F.when(local, 0).otherwise(100 * F.col("page_h")),
            "__pen": F.when(local, 25 * F.col("page_w") * F.col("page_h")).otherwise(0)})

    axes = [Axis("y", "y", "__wy", bits, F.col("__pen"), F.col("__pen")), Axis("w", "w", "__ww", bits)]
    pairs = greedy_l1(weigh(b), weigh(t), ["page_id"], ["system", "kind"], "yolo_line", "tie_id", "x", "x", "__wx", axes, axes)
    dims = boxes.select("page_id", "yolo_line", "page_w", "page_h")
    out = pairs.join(dims, ["page_id", "yolo_line"]).join(ties.select("page_id", "tie_id", "confirmed"), ["page_id", "tie_id"])
    conf = _confidence(F.col("cost") / (100.0 * F.col("page_w") * F.col("page_h")))
    out = out.withColumn("confidence", conf)
    ok = F.col("confirmed") & (F.col("confidence") >= threshold_for(F.lit("tie"), 0.60))
    return out.withColumn("status", F.when(ok, "matched").otherwise("review")).drop("page_w", "page_h", "cost", "confirmed")


# MT-04 -----------------------------------------------------------------
def match_tuplets(boxes: DataFrame, groups: DataFrame, bits: int = 17) -> DataFrame:
    """Tuplet boxes to note groups: the number in the class must equal the group size.

    boxes: page_id, system, yolo_line, class, x, y, page_w, page_h. groups: page_id, system,
    group_id, actual_notes, mean_x, mean_y, page_w, page_h. Positions are compared in 1/16
    pixels. Accepted only if the page has as many boxes as groups over all tuplet classes.
    """
    def weigh(df):
        return df.withColumns({"__wx": 200 * F.col("page_h"), "__wy": 30 * F.col("page_w")})

    n = F.coalesce(F.regexp_extract("class", r"^tuplet([0-9]+)$", 1).try_cast("int"), F.lit(0))
    b = weigh(boxes.withColumns({"n": n, "__x": F.round(F.col("x") * 16).cast("bigint"), "__y": F.round(F.col("y") * 16).cast("bigint")}))
    g = groups.withColumns({"__x": F.round(F.col("mean_x") * 16).cast("bigint"), "__y": F.round(F.col("mean_y") * 16).cast("bigint")})
    g = weigh(g.withColumn("n", F.explode(F.array(F.col("actual_notes").cast("int"), F.lit(0)))))
    b = b.select("page_id", "system", "n", "yolo_line", F.col("__x").alias("px"), F.col("__y").alias("py"), "__wx", "__wy")
    g = g.select("page_id", "system", "n", "group_id", F.col("__x").alias("px"), F.col("__y").alias("py"), "__wx", "__wy")
    axes = [Axis("py", "py", "__wy", bits)]
    pairs = greedy_l1(b, g, ["page_id"], ["system", "n"], "yolo_line", "group_id", "px", "px", "__wx", axes, axes)
    nb = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    ng = groups.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_groups"))
    out = pairs.join(boxes.select("page_id", "yolo_line", "class", "page_w", "page_h"), ["page_id", "yolo_line"])
    out = out.join(groups.select("page_id", "group_id", "actual_notes"), ["page_id", "group_id"]).join(nb, "page_id", "left").join(ng, "page_id", "left")
    out = out.withColumn("confidence", _confidence(F.col("cost") / (1600.0 * F.col("page_w") * F.col("page_h"))))
    ok = (F.col("n_boxes") == F.col("n_groups")) & (F.col("confidence") >= threshold_for("class", 0.60))
    return out.withColumns({"status": F.when(ok, "matched").otherwise("review"),
                            "xml_symbol": F.concat(F.lit("tuplet"), "actual_notes")}).drop("page_w", "page_h", "cost")


# MT-05 -----------------------------------------------------------------
def expand_segments(spans: DataFrame, systems: DataFrame, keys, ends_only: bool = False) -> DataFrame:
    """One row per system a span touches: full, start, middle, end.

    spans: keys, span_id, start_system, end_system, x0, y0, x1, y1. systems: keys, system,
    x_left, x_right, upper_center. ends_only leaves the middle ones out.
    """
    s, e = F.col("start_system"), F.col("end_system")
    lo, hi = F.least(s, e), F.greatest(s, e)
    steps = F.array_distinct(F.array(lo, hi)) if ends_only else F.sequence(lo, hi)
    out = spans.withColumn("system", F.explode(steps)).join(systems, [*keys, "system"])
    y = F.col("system")
    kind = F.when(s == e, "full").when(y == s, "start").when(y == e, "end").otherwise("middle")
    out = out.withColumn("segment_type", kind)
    k = F.col("segment_type")
    a = F.when(k.isin("full", "start"), F.col("x0")).otherwise(F.col("x_left"))
    b = F.when(k.isin("full", "end"), F.col("x1")).otherwise(F.col("x_right"))
    ya = F.when(k.isin("full", "start"), F.col("y0")).when(k == "end", F.col("y1")).otherwise(F.col("upper_center"))
    yb = F.when(k.isin("full", "end"), F.col("y1")).when(k == "start", F.col("y0")).otherwise(F.col("upper_center"))
    return out.withColumns({"seg_x0": F.least(a, b), "seg_x1": F.greatest(a, b), "seg_y0": ya, "seg_y1": yb}).drop("x_left", "x_right", "upper_center")


# MT-06 -----------------------------------------------------------------
SPAN_WEIGHTS = {"x_center_score": 0.42, "width_score": 0.28, "vertical_score": 0.23, "orientation_score": 0.07}  # fixed values


def predicted_span() -> Column:
    """Width a span's box should have, from seg_x0 and seg_x1."""
    return F.greatest(F.lit(8.0), F.abs(F.col("seg_x1") - F.col("seg_x0")))


def _note_side() -> Column:
    return F.when(F.col("orientation") == "under", F.greatest("seg_y0", "seg_y1")).otherwise(F.least("seg_y0", "seg_y1"))


def expected_height() -> Column:
    """Height at which a span's box should have its middle, from seg_x0 to seg_y1, staff_spacing and orientation."""
    sp, note_y = F.greatest(F.lit(1.0), F.col("staff_spacing")), _note_side()
    lift = F.least(F.greatest(sp * 1.1, predicted_span() * 0.38), sp * 3.5)
    return F.when(F.col("orientation") == "under", note_y + lift).otherwise(note_y - lift)


def segment_shape(df: DataFrame) -> DataFrame:
    """What the score asks of a segment alone; taken once per segment, not once per pair."""
    span = predicted_span()
    return df.withColumns({"__middle": (F.col("seg_x0") + F.col("seg_x1")) / 2, "__span": span, "__tol": F.greatest(F.lit(18.0), span * 0.35),
                           "__sp": F.greatest(F.lit(1.0), F.col("staff_spacing")), "__side": _note_side(), "__height": expected_height(), "__below": F.col("orientation") == "under"})


def segment_score(df: DataFrame, out="score") -> DataFrame:
    """Geometric agreement of a box and a segment in [0, 1].

    Needs center_x, center_y, width_px, seg_x0, seg_x1, seg_y0, seg_y1, staff_spacing, orientation.
    """
    shape = ["__middle", "__span", "__tol", "__sp", "__side", "__height", "__below"]
    if "__height" not in df.columns:
        df = segment_shape(df)
    span, x_tol, sp, note_y = (F.col(c) for c in ("__span", "__tol", "__sp", "__side"))
    x_err = F.abs(F.col("center_x") - F.col("__middle"))
    ratio = F.greatest(F.lit(0.05), F.col("width_px") / span)
    wrong = F.greatest(F.lit(0.0), F.when(F.col("__below"), note_y - F.col("center_y")).otherwise(F.col("center_y") - note_y))
    y_err = F.abs(F.col("center_y") - F.col("__height"))
    parts = {
        "x_center_score": F.exp(-0.5 * (x_err / x_tol) * (x_err / x_tol)),
        "width_score": F.exp(-F.abs(F.log(ratio)) / 0.65),
        "vertical_score": F.exp(-0.5 * (y_err / (sp * 2.0)) * (y_err / (sp * 2.0))),
        "orientation_score": F.exp(-wrong / sp),
    }
    df = df.withColumns({**parts, "x_center_error_px": x_err, "predicted_span_px": span, "vertical_error_px": y_err})
    total = None
    for name, weight in SPAN_WEIGHTS.items():
        total = weight * F.col(name) if total is None else total + weight * F.col(name)
    return df.withColumn(out, total).drop(*shape)


# MT-07 -----------------------------------------------------------------
def rank_candidates(scored: DataFrame, block, box: str, segment: str, score: str, k: int = 3) -> DataFrame:
    """k best segments per box with the next score, the margin and whether the choice is mutual.

    Ties go to the smaller id on both sides.
    """
    block = list(block)
    top = top_k(scored, [*block, box], [F.col(score).desc(), F.col(segment)], k + 1)
    w = Window.partitionBy(*block, box).orderBy("rank")
    top = top.withColumn("second_score", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    best = scored.groupBy(*block, segment).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(box).alias("b"))).alias("__b"))
    out = top.where(F.col("rank") <= k).join(best, [*block, segment])
    return out.withColumns({"margin": F.col(score) - F.col("second_score"), "mutual_best": F.col("__b.b") == F.col(box)}).drop("__b")


def classify_proposal(score, margin, mutual, segment_type) -> tuple[Column, Column]:
    """(status, reason): too weak, strong and unambiguous, or in need of review with the reasons why."""
    s, m, mu, t = map(_c, (score, margin, mutual, segment_type))
    weak = s < 0.42
    strong = (s >= 0.82) & (m >= 0.12) & mu & (t == "full")
    status = F.when(weak, "possible_scan_only").when(strong, "high_confidence_candidate").otherwise("needs_review")
    reasons = F.concat_ws(
        "; ", F.when(s < 0.82, "score below 0.82"), F.when(m < 0.12, "top-two margin below 0.12"),
        F.when(~mu, "candidate segment prefers another box"), F.when(t != "full", "cross-system segment requires review"))
    return status, F.when(weak, "no sufficient geometric agreement").when(strong, "mutual best full-system match").otherwise(reasons)


# MT-08 -----------------------------------------------------------------
def rank_with_locks(scored: DataFrame, reviews: DataFrame, boxes: DataFrame, block, box: str, segment: str, candidate: str, score: str) -> DataFrame:
    """Proposals with earlier decisions locked: reviewed boxes keep their decision and the
    full segment of a matched candidate leaves the race.

    scored also holds segment_type. reviews: block, box, match_status, candidate. boxes: all.
    """
    block = list(block)
    taken = reviews.where(F.col("match_status") == "matched").select(*block, candidate).distinct().withColumn("segment_type", F.lit("full"))
    race = scored.join(taken, [*block, candidate, "segment_type"], "left_anti").join(reviews.select(*block, box), [*block, box], "left_anti")
    best = rank_candidates(race, block, box, segment, score, k=1)
    status, reason = classify_proposal(score, "margin", "mutual_best", "segment_type")
    open_ = best.select(*block, box, segment, candidate, F.col(score).alias("best_score"), "second_score", "margin", status.alias("status"), reason.alias("reason"))
    locked = reviews.select(
        *block, box, F.lit(None).cast(scored.schema[segment].dataType).alias(segment),
        F.when(F.col("match_status") == "matched", F.col(candidate)).alias(candidate), F.lit(None).cast("double").alias("best_score"),
        F.lit(None).cast("double").alias("second_score"), F.lit(None).cast("double").alias("margin"),
        F.when(F.col("match_status") == "matched", "locked_xml_match").otherwise("locked_scan_only").alias("status"), F.lit("decided by a reviewer").alias("reason"))
    # boxes without an open or locked row are found beside these rows, so that the race is not run again for them
    asked = boxes.select(*block, box).withColumn("__rest", F.lit(True))
    rows = open_.unionByName(locked).withColumn("__rest", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    rows = rows.withColumn("__known", F.min("__rest").over(Window.partitionBy(*block, box)))
    rest, unknown = F.col("__rest"), reduce(Column.__or__, [F.col(c).isNull() for c in [*block, box]])
    rows = rows.where(~rest | F.col("__known") | unknown).withColumns({
        "status": F.when(rest, "possible_scan_only").otherwise(F.col("status")), "reason": F.when(rest, "no candidate in this system").otherwise(F.col("reason"))})
    return rows.drop("__rest", "__known")


# MT-09 -----------------------------------------------------------------
def proximity_components(df: DataFrame, block, row_id: str, x: str, y: str, dx: int, dy: int, cell: int | None = None) -> DataFrame:
    """Groups of points linked by |dx| <= dx and |dy| <= dy steps; component = smallest id in it.

    Points of one (dx+1) x (dy+1) cell are always linked, so a cell is one node however many
    points it holds. Cells side by side are linked if their closest points are (min/max per
    cell). Cells on a diagonal are linked if a prefix minimum along x finds a close point.
    The component of each node then comes from the cell graph. No pair of points is formed.
    """
    block = list(block)
    p = df.select(*block, row_id, F.col(x).cast("bigint").alias("__x"), F.col(y).cast("bigint").alias("__y"))
    p = p.withColumns({"__gx": F.floor(F.col("__x") / (dx + 1)), "__gy": F.floor(F.col("__y") / (dy + 1))})
    p = settle(p)
    cells = p.groupBy(*block, "__gx", "__gy").agg(
        F.min(row_id).alias("node"), F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
    cells = settle(cells)
    right = cells.select(*block, (F.col("__gx") - 1).alias("__gx"), "__gy", F.col("node").alias("other"), F.col("x0").alias("__near"))
    up = cells.select(*block, "__gx", (F.col("__gy") - 1).alias("__gy"), F.col("node").alias("other"), F.col("y0").alias("__near"))
    side = cells.join(right, [*block, "__gx", "__gy"]).where(F.col("__near") - F.col("x1") <= dx).select(*block, "node", "other")
    above = cells.join(up, [*block, "__gx", "__gy"]).where(F.col("__near") - F.col("y1") <= dy).select(*block, "node", "other")
    # diagonals: the cell to the right and one up (s=1) or down (s=-1); y is mirrored for s=-1
    sign = F.explode(F.array(F.lit(1), F.lit(-1)))
    me = p.select(*block, sign.alias("s"), F.col("__gx"), "__gy", (F.col("__x") + dx).alias("__t"), "__y").select(
        *block, "s", F.col("__gx"), F.col("__gy"), "__t", (F.col("s") * F.col("__y")).alias("__v"), F.lit(1).alias("__q"))
    it = p.select(*block, sign.alias("s"), (F.col("__gx") - 1).alias("__gx"), "__gy", F.col("__x").alias("__t"), "__y").select(
        *block, "s", "__gx", (F.col("__gy") - F.col("s")).alias("__gy"), "__t", (F.col("s") * F.col("__y")).alias("__v"), F.lit(0).alias("__q"))
    both = me.unionByName(it)
    group = [*block, "s", "__gx", "__gy"]
    met = both.groupBy(*group).agg(F.max("__q").alias("a"), F.min("__q").alias("b")).where("a = 1 and b = 0").select(*group)
    line = scan(both.join(met, group, "left_semi"), group, ["__t", "__q", "__v"],
                [Fold("__best", "min", F.when(F.col("__q") == 0, F.col("__v")))],
                [cell_of("__t", cell or max(1, (dx + 1) // 4))])
    hit = line.where((F.col("__q") == 1) & (F.col("__best") <= F.col("__v") + dy)).select(*group).distinct()
    node = cells.select(*block, "__gx", "__gy", "node")
    other = cells.select(*block, F.col("__gx").alias("__hx"), F.col("__gy").alias("__hy"), F.col("node").alias("other"))
    diag = hit.withColumns({"__hx": F.col("__gx") + 1, "__hy": F.col("__gy") + F.col("s")})
    diag = diag.join(node, [*block, "__gx", "__gy"]).join(other, [*block, "__hx", "__hy"]).select(*block, "node", "other")
    comp = components(cells.select(*block, "node"), side.unionByName(above).unionByName(diag), block)
    labelled = cells.join(comp, [*block, "node"]).select(*block, "__gx", "__gy", "component")
    return p.join(labelled, [*block, "__gx", "__gy"]).select(*block, row_id, "component")


def components(nodes: DataFrame, edges: DataFrame, block) -> DataFrame:
    """Connected components by alternating large-star and small-star steps; label = smallest node.

    Both steps replace the neighbours of a node by links to its smallest neighbour, computed
    with partial minima; the number of rounds grows with the logarithm of the diameter.
    """
    block = list(block)
    e = settle(edges.select(*block, F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(*block, F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy(*block, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(m, [*block, "u"]).select(*block, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        m2 = large.groupBy(*block, "u").agg(F.min("v").alias("m"))
        small = large.join(m2, [*block, "u"]).select(*block, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        new = settle(small.where("u <> v").distinct())
        same = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        e = new
        if same:
            break
    label = e.groupBy(*block, F.col("u").alias("node")).agg(F.min("v").alias("__c"))
    return nodes.join(label, [*block, "node"], "left").select(*block, "node", F.coalesce("__c", "node").alias("component"))


# MT-10 -----------------------------------------------------------------
def allocate_groups(groups: DataFrame, chords: DataFrame, page_w: float, wrong_staff: float = 0.15, dy_weight: float = 0.18,
                    strict_staff: bool = False, threshold: float = 0.95) -> DataFrame:
    """Groups of stacked digits claim distinct notes of one chord, in reading order.

    groups: page_id, system, group_id, x, y (means), preferred_staff, boxes array of
    struct(y, yolo_line). chords: page_id, system, chord_id, staff, time, x (mean), notes
    array of struct(y, note_id). A group takes its best free subset of a chord by
    dx + dy_weight*mean dy + staff penalty, and later groups cannot use those notes.

    Rounds: a group is settled as soon as no earlier open group could touch a note of its
    two best choices, so far-apart groups are settled together and the result is that of
    the one-by-one order.
    """
    reach = page_w * 0.12
    step = max(1, math.ceil(reach))
    g = groups.withColumns({"__bx": F.sort_array("boxes"), "__n": F.size("boxes"), "__ord": F.struct("system", "x", "y", "group_id")})
    g = g.withColumn("__cell", F.explode(F.array(*[(F.floor(F.col("x") / step) + i).cast("bigint") for i in (-1, 0, 1)])))
    c = chords.withColumns({"__nt": F.sort_array("notes"), "__cell": F.floor(F.col("x") / step).cast("bigint")}).select(
        "page_id", "system", "__cell", "chord_id", F.col("staff").alias("__cs"), "time", F.col("x").alias("__cx"), "__nt")
    j = g.join(c, ["page_id", "system", "__cell"])
    dx = F.abs(F.col("x") - F.col("__cx"))
    j = j.withColumn("dx", dx).where((F.col("dx") <= reach) & (F.size("__nt") >= F.col("__n")))
    if strict_staff:
        j = j.where(F.col("__cs") == F.col("preferred_staff"))
    empty = F.array(F.array().cast("array<struct<y:double,note_id:bigint>>"))
    subsets = F.filter(
        F.aggregate("__nt", empty, lambda acc, note: F.concat(
            acc, F.transform(F.filter(acc, lambda s: F.size(s) < F.col("__n")), lambda s: F.concat(s, F.array(note))))),
        lambda s: F.size(s) == F.col("__n"))
    j = j.withColumn("__sub", F.explode(subsets))
    gaps = F.zip_with("__bx", "__sub", lambda b, n: F.abs(b["y"] - n["y"]))
    pen = F.when(F.col("__cs") != F.col("preferred_staff"), page_w * wrong_staff).otherwise(0.0)
    j = j.withColumns({"mean_dy": F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) / F.col("__n"), "penalty": pen, "chord_size": F.size("__nt")})
    j = j.withColumn("score", F.col("dx") + dy_weight * F.col("mean_dy") + F.col("penalty"))
    j = j.select("page_id", "group_id", "__ord", "__n", "__bx", "chord_id", "chord_size", "dx", "penalty", "score",
                 F.transform("__sub", lambda n: n["note_id"]).alias("ids"),
                 F.struct("score", "dx", "mean_dy", "penalty", "time", "chord_id", F.transform("__sub", lambda n: n["note_id"]).alias("ids")).alias("__key"))
    active, done = settle(j), None
    while not active.isEmpty():
        two = top_k(active, ["page_id", "group_id"], [F.col("__key")], 2)
        notes = active.select("page_id", "__ord", F.explode("ids").alias("note"))
        first = notes.groupBy("page_id", "note").agg(F.min("__ord").alias("__first"))
        risk = two.select("page_id", "group_id", "__ord", F.explode("ids").alias("note")).join(first, ["page_id", "note"])
        free = risk.groupBy("page_id", "group_id").agg(F.bool_and(F.col("__first") == F.col("__ord")).alias("ok")).where("ok").select("page_id", "group_id")
        w = Window.partitionBy("page_id", "group_id").orderBy("rank")
        best = two.withColumn("second", F.lead("score").over(w)).where("rank = 1").join(free, ["page_id", "group_id"])
        best = settle(best)
        done = best if done is None else done.unionByName(best)
        used = best.select("page_id", F.explode("ids").alias("note")).distinct()
        blocked = active.select("page_id", "__key", "group_id", F.explode("ids").alias("note")).join(used, ["page_id", "note"], "left_semi")
        active = settle(
            active.join(best.select("page_id", "group_id"), ["page_id", "group_id"], "left_anti")
            .join(blocked.select("page_id", "group_id", "__key").distinct(), ["page_id", "group_id", "__key"], "left_anti"))
    done = done if done is not None else active.withColumns({"second": F.lit(None).cast("double"), "rank": F.lit(1)})
    margin = F.greatest(F.lit(0.0), F.coalesce("second", F.col("score") + 100) - F.col("score"))
    conf = 0.45 + 0.35 * F.exp(-F.col("dx") / max(page_w * 0.025, 1)) + 0.20 * F.least(F.lit(1.0), margin / 25)
    unsure, off = (F.col("__n") == 1) & (F.col("chord_size") > 1), F.col("penalty") > 0
    conf = F.least(F.lit(0.99), F.greatest(F.lit(0.0), conf))
    conf = F.when(unsure | off, F.least(conf, F.lit(0.69))).otherwise(conf)
    source = F.when(unsure, "grouped_nearest_ambiguous_chord").when(off, "grouped_nearest_staff_mismatch").otherwise("grouped_nearest")
    rows = done.select(
        "page_id", "group_id", conf.alias("confidence"), source.alias("match_source"),
        F.explode(F.zip_with("__bx", "ids", lambda b, n: F.struct(b["yolo_line"].alias("yolo_line"), n.alias("note_id")))).alias("p"))
    rows = rows.select("page_id", "group_id", "p.yolo_line", "p.note_id", "confidence", "match_source",
                       F.when(F.col("confidence") >= threshold, "inferred").otherwise("review").alias("status"))
    lone = groups.select("page_id", "group_id", F.explode("boxes.yolo_line").alias("yolo_line")).join(rows, ["page_id", "group_id", "yolo_line"], "left_anti")
    return rows.unionByName(lone.withColumn("status", F.lit("unmatched")), allowMissingColumns=True)


# MT-11 -----------------------------------------------------------------
def optimal_match(edges: DataFrame, block, left: str, right: str, cost: str, small: int = 500_000, ties: int = 1_000_000) -> DataFrame:
    """Perfect matching of least total integer cost per block; a block without one gets no rows.

    left and right are bigint ids. Among equal totals the answer that gives the first left row the smallest right row
    wins, then the second, and so on, whatever the size of the block.

    Blocks of up to `small` edges are solved inside one task, without rounds. Larger ones run as an auction over the edge
    table: every free left row bids for its best right row, prices rise, and with integer costs scaled by the block size the
    result is optimal. The prices then show which edges can be part of any optimal answer; what these edges connect is
    solved for itself, with the tie rule. Such a group of more than `ties` edges raises instead of being gathered.
    """
    block = list(block)
    e = reduce(DataFrame.where, [F.col(c).isNotNull() for c in block], edges)
    e = settle(e.groupBy(*block, left, right).agg(F.min(F.col(cost).cast("bigint")).alias("cost")))
    many = settle(e.groupBy(*block).agg(F.count(F.lit(1)).alias("__edges")).where(F.col("__edges") > small))
    if many.isEmpty():
        return _solved(e, block, block, left, right)
    small_part = _solved(e.join(many, block, "left_anti"), block, block, left, right)
    big = e.join(many, block)
    nl = big.select(*block, left).distinct().groupBy(*block).agg(F.count(F.lit(1)).alias("__nl"))
    nr = big.select(*block, right).distinct().groupBy(*block).agg(F.count(F.lit(1)).alias("__nr"))
    big = settle(big.join(nl.join(nr, block).where(F.col("__nl") == F.col("__nr")), block))
    if big.isEmpty():
        return small_part
    close = settle(_auction(big, block, left, right))
    if not close.groupBy(*block, "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ties).isEmpty():
        raise ValueError(f"more than {ties} edges of one block are tied with each other")
    return small_part.unionByName(_solved(close, block, [*block, "component"], left, right))


def _solved(e: DataFrame, block, group, left, right) -> DataFrame:
    """Least-cost matching of each group, inside one task each."""
    cols = [*block, left, right, "cost"]

    def solve(pdf):
        pairs = least_cost(pdf[left].tolist(), pdf[right].tolist(), pdf["cost"].tolist())
        head = {b: pdf[b].iloc[0] for b in block}
        return pd.DataFrame([{**head, left: l, right: r, "cost": c} for l, r, c in pairs], columns=cols)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.select(*cols).schema)
    return e.select(*dict.fromkeys([*group, *cols])).groupBy(*group).applyInPandas(solve, schema)


def _auction(e: DataFrame, block, left, right) -> DataFrame:
    """Edges that can be part of an optimal matching, with the group that they connect (component).

    Auction with bid step 1 on costs scaled by (n + 1). At its end a chosen edge costs a row at most 1 more than its
    best one, prices included; so the excess of all edges of an optimal matching adds up to n at most, and an edge
    with more excess is in none.
    """
    e = settle(e.select(*block, left, right, "cost", "__nl", (F.col("cost") * (F.col("__nl") + 1)).alias("__c")))
    # a block whose rows cannot all be served would never end: check by the largest matching first
    e = settle(e.join(_perfect_blocks(e, block, left, right), block, "left_semi"))
    price = settle(e.select(*block, right).distinct().withColumn("__p", F.lit(0).cast("bigint")))
    own = settle(e.select(*block, right, left).limit(0))
    everyone = settle(e.select(*block, left).distinct())
    while True:
        free = everyone.join(own, [*block, left], "left_anti")
        if free.isEmpty():
            break
        offers = e.join(free, [*block, left], "left_semi").join(price, [*block, right])
        offers = offers.withColumn("__v", F.col("__c") + F.col("__p"))
        two = top_k(offers, [*block, left], [F.col("__v"), F.col(right)], 2)
        w = Window.partitionBy(*block, left).orderBy("rank")
        bids = two.withColumn("__next", F.lead("__v").over(w)).where("rank = 1")
        # a row with a single choice may raise its price without bound
        spare = F.coalesce(F.col("__next") - F.col("__v"), F.lit(1 << 50))
        bids = bids.select(*block, left, right, (F.col("__p") + spare + 1).alias("__bid"))
        win = bids.groupBy(*block, right).agg(F.max(F.struct("__bid", (-F.col(left)).alias("n"))).alias("w"))
        win = settle(win.select(*block, right, (-F.col("w.n")).alias(left), F.col("w.__bid").alias("__bid")))
        own = settle(own.join(win, [*block, right], "left_anti").unionByName(win.select(*block, right, left)))
        price = settle(price.join(win.select(*block, right, "__bid"), [*block, right], "left").select(*block, right, F.coalesce("__bid", "__p").alias("__p")))
    offers = e.join(price, [*block, right]).withColumn("__v", F.col("__c") + F.col("__p"))
    best = offers.groupBy(*block, left).agg(F.min("__v").alias("__best"))
    close = settle(offers.join(best, [*block, left]).where(F.col("__v") - F.col("__best") <= F.col("__nl")).select(
        *block, left, right, "cost", (F.col(left) * 2).alias("node"), (F.col(right) * 2 + 1).alias("other")))
    nodes = close.select(*block, "node").unionByName(close.select(*block, F.col("other").alias("node"))).distinct()
    group = components(nodes, close.select(*block, "node", "other"), block)
    return close.join(group, [*block, "node"]).select(*block, "component", left, right, "cost")


def _perfect_blocks(e, block, left, right) -> DataFrame:
    """Blocks that have a perfect matching, by layered augmenting in rounds (labels pushed along edges)."""
    sides = e.select(*block, left).distinct().groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    level = settle(e.select(*block, right).distinct().withColumn("__h", F.lit(0).cast("bigint")))
    own = settle(e.select(*block, right, left).limit(0))
    everyone = settle(e.select(*block, left).distinct())
    while True:
        # a free left row takes its lowest right row and lifts it to one above its next lowest
        free = everyone.join(own, [*block, left], "left_anti")
        offers = e.join(free, [*block, left], "left_semi").join(level, [*block, right]).join(sides, block).where(F.col("__h") <= F.col("__n"))
        if offers.isEmpty():
            break
        two = top_k(offers, [*block, left], [F.col("__h"), F.col(right)], 2)
        w = Window.partitionBy(*block, left).orderBy("rank")
        bids = two.withColumn("__next", F.coalesce(F.lead("__h").over(w), F.col("__n"))).where("rank = 1")
        win = bids.groupBy(*block, right).agg(F.max(F.struct(F.col("__next").alias("h"), (-F.col(left)).alias("n"))).alias("w"))
        win = settle(win.select(*block, right, (-F.col("w.n")).alias(left), (F.col("w.h") + 1).alias("__h2")))
        own = settle(own.join(win, [*block, right], "left_anti").unionByName(win.select(*block, right, left)))
        level = settle(level.join(win.select(*block, right, "__h2"), [*block, right], "left").select(*block, right, F.coalesce("__h2", "__h").alias("__h")))
    full = own.groupBy(*block).agg(F.count(F.lit(1)).alias("__m")).join(sides, block).where(F.col("__m") == F.col("__n"))
    return full.select(*block)


# MT-12 -----------------------------------------------------------------
def overlay(sources: Sequence[DataFrame], keys, cols: Sequence[str]) -> DataFrame:
    """Row of the last source (lowest to highest precedence) that has the key, with its position."""
    keys = list(keys)
    parts = [s.select(*keys, F.struct(*cols).alias("__row"), F.lit(i).alias("source_rank")) for i, s in enumerate(sources)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    best = all_.groupBy(*keys).agg(F.max_by("__row", "source_rank").alias("__row"), F.max("source_rank").alias("source_rank"))
    return best.select(*keys, "__row.*", "source_rank")


# MT-13 -----------------------------------------------------------------
def measure_order(notes: DataFrame, keys, cells=()) -> DataFrame:
    """Running number of each note inside its measure and staff, by position."""
    return number_rows(notes, keys, ["x", "y", "note_id"], "measure_note_order", cells)


def candidate_lists(rows: DataFrame, notes: DataFrame, keys, row_id: str, note_id: str, k: int = 64) -> DataFrame:
    """k nearest notes per row by 4*|dx| + 3*|dy| (quarter ticks), ties by x, y, id.

    rows and notes: keys, id, x, y (integers). Rows about a span are not expanded: their list is the page's note
    table itself.
    """
    keys = list(keys)
    near = k_nearest(rows, notes, keys, row_id, note_id, k, weighted_l1(4, 3), ties=("x", "y"), out="distance4")
    return near.select(*keys, row_id, "rank", note_id, "distance4")


# MT-14 -----------------------------------------------------------------
def assemble(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Output columns of a row from its two anchors.

    Anchors are structs (time, note_id, system, measure, staff, x, y, members
    array<struct<seq,note_id,pitch>>). Members are distinct in first-seen order.
    """
    s, e = F.col(start), F.col(end)
    members = F.array_distinct(F.concat(s["members"], e["members"]))
    ids = F.filter(F.transform(members, lambda m: m["note_id"]), lambda i: i.isNotNull())
    pitches = F.filter(F.transform(members, lambda m: m["pitch"]), lambda p: p.isNotNull() & (p != ""))
    return df.withColumns({
        "start_meas": s["time"], "end_meas": e["time"], "start_note": s["note_id"], "end_note": e["note_id"],
        "note_ids": ids, "pitches": pitches, "system": s["system"], "xml_measure": s["measure"], "xml_staff": s["staff"],
        "target_x_px": s["x"], "target_y_px": s["y"], "end_target_x_px": e["x"], "end_target_y_px": e["y"],
    })
