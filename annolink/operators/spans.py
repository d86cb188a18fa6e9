"""Span boxes (slurs) against the printed segments of spans.

A pair counts from `floor` on. Such a pair either lies close in x, or is alike in width and height; the weights of
the score say how close. Both cases are met by equal keys: dyadic cells of the segment's own reach, asked for by the
boxes on every level in use. So a system with very many boxes is not multiplied out; only pairs that are near in one
of the two ways are scored.

Equal boxes and equal segments of a system have equal pairs: the choice looks at shapes, each with the rows behind it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import threshold_for
from ..session import settle
from .inorder import InOrder
from .matching import SPAN_WEIGHTS, expand_segments, expected_height, predicted_span, segment_score, segment_shape
from .ordering import top_k

#: Agreement in x below which width and height must carry the score.
NEAR = 0.05
SLACK = 1 + 1e-9
#: Floors of the looks for a best pair; only rows that do not find enough look further down.
LADDER = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5)


def _level(reach: Column) -> Column:
    """Smallest l with 2**l >= reach."""
    return F.ceil(F.log2(reach)).cast("int")


def _cells(low: Column, high: Column, level: Column) -> Column:
    width = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))


def _levels(df: DataFrame, level: str) -> Column:
    """All levels in use, as a constant; there are as many as powers of two between the sizes."""
    r = df.agg(F.min(level), F.max(level)).first()
    return F.array(*[F.lit(v) for v in range(r[0], r[1] + 1)]) if r[0] is not None else F.array().cast("array<int>")


def span_edges(boxes: DataFrame, segments: DataFrame, keys, floor: float = 0.42) -> DataFrame:
    """All pairs of a box and a segment of its system with a score of `floor` or more.

    boxes: keys, system, yolo_line, center_x, center_y, width_px. segments: as expand_segments gives them, with
    span_id, system, staff_spacing, orientation. Null or NaN coordinates meet nothing.
    """
    keys = list(keys)
    x, w, v, o = (SPAN_WEIGHTS[k] for k in ("x_center_score", "width_score", "vertical_score", "orientation_score"))
    rest = floor - x * NEAR
    if min(rest - v - o, rest - w - o) <= 0:
        raise ValueError("below this floor neither width nor height bounds the pairs")
    # far in x, width and height can still carry the score only where all of it is enough
    carried = rest <= w + v + o
    # else all pairs need this much agreement in x; from 0.05 * w on, very narrow boxes (which count as 1/20) have none in width
    close = max(NEAR, (floor - w - v - o) / x)
    alike = rest - v - o if carried else max(floor - x - v - o, 0.0)
    by_width = alike > 0.05 * w
    ratio = -0.65 * math.log(alike / w) * SLACK if carried or by_width else 1.0
    rise = 2 * math.sqrt(-2 * math.log((rest - w - o) / v)) * SLACK if carried else 1.0

    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    b = boxes.where(real("center_x") & real("center_y") & real("width_px"))
    s = segments.where(real("seg_x0") & real("seg_x1") & real("seg_y0") & real("seg_y1") & real("staff_spacing"))
    s = segment_shape(s)
    own = F.struct(*[c for c in s.columns if c not in (*keys, "system")])
    reach = F.greatest(F.lit(18.0), predicted_span() * 0.35) * math.sqrt(-2 * math.log(close)) * SLACK
    tall = F.greatest(F.lit(1.0), F.col("staff_spacing").cast("double")) * rise
    s = s.select(*keys, "system", own.alias("segment"), ((F.col("seg_x0") + F.col("seg_x1")) / 2).alias("__mid"), reach.alias("__reach"),
                 expected_height().alias("__up"), tall.alias("__tall"), F.floor(F.log(predicted_span()) / ratio).cast("bigint").alias("__w"))
    s = s.withColumns({"__lx": _level(F.col("__reach")), "__ly": _level(F.col("__tall"))})
    box = F.struct(*[c for c in b.columns if c not in (*keys, "system")])
    b = b.select(*keys, "system", box.alias("box"), F.col("center_x").cast("double").alias("__x"), F.col("center_y").cast("double").alias("__y"),
                 F.floor(F.log(F.when(F.col("width_px") > 0, F.col("width_px").cast("double"))) / ratio).cast("bigint").alias("__bw"))
    off = F.abs(F.col("__x") - F.col("__mid"))
    # few bytes go in and many pairs come out: the number of tasks is given, not taken from the bytes
    tasks = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(boxes, segments, on):
        return boxes.repartition(tasks, *on).join(segments.repartition(tasks, *on), on)

    near = s.select(*keys, "system", "segment", "__mid", "__reach", "__w", F.col("__lx").alias("__l"), F.explode(_cells(F.col("__mid") - F.col("__reach"), F.col("__mid") + F.col("__reach"), F.col("__lx"))).alias("__c"))
    sized = b.where("__bw is not null").withColumn("__w", F.explode(F.array(F.col("__bw") - 1, F.col("__bw"), F.col("__bw") + 1)))
    also = ["__w"] if by_width and not carried else []
    asked = (sized if also else b).withColumn("__l", F.explode(_levels(s, "__lx"))).withColumn("__c", F.floor(F.col("__x") / F.pow(F.lit(2.0), F.col("__l"))).cast("bigint"))
    by_x = meet(asked, near if also else near.drop("__w"), [*keys, "system", "__l", "__c", *also]).where(off <= F.col("__reach"))

    met = by_x.select(*keys, "system", "box", "segment")
    if not carried:
        return segment_score(met.select(*keys, "system", "box.*", "segment.*")).where(F.col("score") >= floor)
    alike = s.select(*keys, "system", "segment", "__mid", "__reach", "__w", F.col("__ly").alias("__l"), F.explode(_cells(F.col("__up") - F.col("__tall"), F.col("__up") + F.col("__tall"), F.col("__ly"))).alias("__c"))
    asked = sized.withColumn("__l", F.explode(_levels(s, "__ly"))).withColumn("__c", F.floor(F.col("__y") / F.pow(F.lit(2.0), F.col("__l"))).cast("bigint"))
    by_size = meet(asked, alike, [*keys, "system", "__w", "__l", "__c"]).where(off > F.col("__reach"))

    met = met.unionByName(by_size.select(*keys, "system", "box", "segment"))
    return segment_score(met.select(*keys, "system", "box.*", "segment.*")).where(F.col("score") >= floor)


def _all_pairs(boxes: DataFrame, segments: DataFrame, keys, floor: float) -> DataFrame:
    """The rows of span_edges from all pairs of a system: for shapes so few that cells would cost more."""
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [*keys, "system", "__part"]
    b = boxes.withColumn("__part", F.pmod(F.xxhash64("__gb"), F.lit(tasks)).cast("int")).repartition(tasks, *on)
    s = segment_shape(segments).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, *on)
    return segment_score(b.join(s, on).drop("__part")).where(F.col("score") >= floor)


def _shapes(boxes: DataFrame, segments: DataFrame, keys, box: str, own) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(box shapes, segment shapes, lines, parts): the different boxes and segments of a system, and the rows behind them.

    A box shape has an id __gb and its smallest line; a segment shape an id __gs, its number and its first segment. What
    can be taken once, a line and a part, is also numbered in order: __line_no, __part_no.
    """
    def real(df, cols):
        for c in cols:
            df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
        return df

    at, like = ["center_x", "center_y", "width_px"], ["seg_x0", "seg_x1", "seg_y0", "seg_y1", "staff_spacing", "orientation"]
    place = [*keys, "system"]
    boxes = real(boxes, at).where(F.col(box).isNotNull()).withColumn("__shape", F.struct(*at))
    segments = real(segments, like[:-1]).withColumn("__shape", F.struct(*like))
    bs = boxes.groupBy(*place, "__shape").agg(F.min(box).alias("__line"))
    ss = segments.groupBy(*place, "__shape").agg(F.count(F.lit(1)).alias("__n"), F.min("segment").alias("__first"))
    bs, ss = settle(bs.withColumn("__gb", F.monotonically_increasing_id())), settle(ss.withColumn("__gs", F.monotonically_increasing_id()))
    numbered = lambda df, cols, no: settle(df.select(*keys, *cols).distinct().sort(*cols).withColumn(no, F.monotonically_increasing_id()))
    lines = boxes.join(bs, [*place, "__shape"]).select(*place, "__gb", box)
    lines = settle(lines.join(numbered(lines, [box], "__line_no"), [*keys, box]))
    parts = segments.join(ss, [*place, "__shape"]).select(*place, "__gs", "span_id")
    parts = settle(parts.join(numbered(parts, own, "__part_no"), [*keys, *own]))
    return bs.select(*place, "__shape.*", "__line", "__gb"), ss.select(*place, "__shape.*", "__n", "__first", "__gs"), lines, parts


def _product(bs: DataFrame, ss: DataFrame, keys) -> int:
    place = [*keys, "system"]
    n = bs.groupBy(*place).agg(F.count(F.lit(1)).alias("__b")).join(ss.groupBy(*place).agg(F.count(F.lit(1)).alias("__s")), place)
    return n.agg(F.sum(F.col("__b") * F.col("__s"))).first()[0] or 0


def _down_to(bs: DataFrame, ss: DataFrame, keys, floor: float, product: int, budget: float) -> float:
    """A floor from which on some `budget` pairs lie, by the pairs of a sample of the segments. Only the number of passes hangs on it."""
    every = max(1, product // 2_000_000)
    some = ss.where(F.pmod(F.xxhash64("__gs"), F.lit(every)) == 0)
    bins = _all_pairs(bs, some, keys, floor).groupBy(F.floor(F.col("score") * 512).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    seen, at = 0, 1.0
    for b, n in sorted(((r.bin, r.n) for r in bins), reverse=True):
        seen += n * every
        if seen > budget and at < 1.0:
            return at
        at = max(b / 512, floor)
    return floor


def _in_order(lines: DataFrame, parts: DataFrame, edges: DataFrame, block) -> DataFrame:
    """Greedy one-to-one choice between the rows behind shapes, in one sorted pass per block: __gb, __gs, score, __line_no, __part_no.

    A task keeps the numbers of the lines and parts of its block, not the pairs of shapes, which come from the best one down.
    """
    def rows(df, place, score, gb, gs):
        # blocks are told apart by a hash; two that share it are read as one, which changes nothing
        return df.select((F.shiftleft(F.pmod(F.xxhash64(F.lit(0), *block), F.lit(1 << 31)), 32) + place).alias("__at"), F.col(gb).alias("__gb"), F.col(gs).alias("__gs"), score.alias("score"))

    worst = F.floor((1 - F.col("score")) * (1 << 30)).cast("bigint")
    # no pair has a score over 1: a higher one marks lines and parts
    both = rows(lines, F.lit(0), F.lit(3.0), "__gb", "__line_no").unionByName(rows(parts, F.lit(1), F.lit(2.0), "__part_no", "__gs"))
    both = both.unionByName(rows(edges, worst + 2, F.col("score"), "__gb", "__gs"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, F.shiftright("__at", 32)).sortWithinPartitions("__at", F.col("score").desc()).drop("__at")
    names = ["__gb", "__gs", "score", "__line_no", "__part_no"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def take(batches):
        now, last = InOrder(), 0
        for batch in batches:
            gb, gs, score = (batch.column(c).to_numpy() for c in ("__gb", "__gs", "score"))
            kind, done = np.where(score == 3.0, 0, np.where(score == 2.0, 1, 2)), []
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                a, b = gb[start:end], gs[start:end]
                if kind[start] < last:  # another block
                    now.flush()
                    done += now.chosen()
                    now = InOrder()
                last = kind[start]
                if last == 0:
                    now.left.add(a, b)
                elif last == 1:
                    now.right.add(b, a)
                else:
                    now.pairs(a, b, score[start:end])
            yield table([*done, *now.chosen()])
        if not now.open:
            now.flush()
            yield table(now.chosen())

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows) if rows else [[]] * 5, types)], names)

    return both.mapInArrow(take, "__gb bigint, __gs bigint, score double, __line_no bigint, __part_no bigint")


def _pick(shapes, keys, box: str, claim: str, floor: float, k: float, least: int) -> DataFrame:
    """keys, system, __gb, __gs, score, box, span_id of the greedy one-to-one choice among all pairs, best first.

    The pairs of one pass lie above a floor that some k pairs a row reach. What it chooses is final, and no pair above
    the floor is left, so the next pass goes on further down with the shapes that have free rows.
    """
    bs, ss, lines, parts = shapes
    # a line of several systems is one box all the same
    apart = claim == "segment" and lines.groupBy(*keys, box).agg(F.min("system").alias("a"), F.max("system").alias("b")).where("a <> b").isEmpty()
    block = [*keys, "system"] if apart else keys
    budget = k * max(lines.count() + parts.count(), least)
    picked = None
    while True:
        product = _product(bs, ss, keys)
        at = floor if product <= budget else _down_to(bs, ss, keys, floor, product, budget)
        edges = (span_edges if product > 32 * budget else _all_pairs)(bs, ss, keys, at)
        won = settle(_in_order(lines, parts, edges, block))
        picked = won if picked is None else picked.unionByName(won)
        if at == floor:
            break
        lines = settle(lines.join(won.select("__line_no"), "__line_no", "left_anti"))
        parts = settle(parts.join(won.select("__part_no"), "__part_no", "left_anti"))
        bs, ss = settle(bs.join(lines.select("__gb").distinct(), "__gb", "left_semi")), settle(ss.join(parts.select("__gs").distinct(), "__gs", "left_semi"))
    # a line or part of the shape, should there be several with the number
    of = lambda df, cols, no, c: df.select(*cols, no, c).distinct()
    picked = picked.join(of(shapes[2], [*keys, "system", "__gb"], "__line_no", box), ["__gb", "__line_no"])
    return picked.join(of(shapes[3], ["__gs"], "__part_no", "span_id"), ["__gs", "__part_no"])


def _best_pairs(asking: DataFrame, me: str, pairs, best, floor: float, few: bool) -> DataFrame:
    """What `best` gives for each asking shape from all its pairs, with `sure` where no worse pair can change it."""
    found = None
    for at in [floor] if few else [*(v for v in LADDER if v > floor), floor]:
        now = best(pairs(asking, at))
        now = settle(now if at == floor else now.where("sure"))
        found = now if found is None else found.unionByName(now)
        if at > floor:
            asking = settle(asking.join(now.select(me), me, "left_anti"))
    return found.drop("sure")


# MT-07 -----------------------------------------------------------------
def match_spans(boxes: DataFrame, spans: DataFrame, systems: DataFrame, keys=("page_id",), floor: float = 0.42, claim: str = "segment", k: float = 32,
                least: int = 1 << 20) -> DataFrame:
    """One-to-one choice of span segments by slur boxes, taken from the best pair down over a whole page.

    boxes: keys, system, yolo_line, center_x, center_y, width_px. spans: keys, span_id, start_system, end_system, x0, y0,
    x1, y1, orientation, confirmed. systems: keys, system, x_left, x_right, upper_center, staff_spacing.
    claim: "segment", each printed segment has one box; "span", a box takes the span with all its segments.
    Ties go to the smaller box, then the smaller span, then the smaller system.

    A pair is `matched` where the span is confirmed, the confidence reaches the threshold, the margin to the next best
    segment of the box is 0.12, each is the other's best, and the segment is the whole span; else it is for review.
    A second segment below `floor` counts as 0: it cannot bring the margin of an accepted pair below 0.12.

    A pass looks at some k pairs of shapes a row, k * least at least; results do not hang on k and least.
    """
    keys, box = list(keys), "yolo_line"
    boxes, segments = settle(boxes), expand_segments(spans, systems, keys)
    segments = settle(segments.withColumn("segment", F.struct("span_id", "system")))
    shapes = bs, ss, lines, _ = _shapes(boxes, segments, keys, box, ["span_id", "system"] if claim == "segment" else ["span_id"])
    picked = settle(_pick(shapes, keys, box, claim, floor, k, least))
    few = _product(bs, ss, keys) <= 32 * k * max(lines.count(), least)
    pairs = _all_pairs if few else span_edges
    # only shapes with a chosen pair are compared with all the others

    def two(p):
        order = [F.col("score").desc(), F.col("__first")]
        top = top_k(p.select("__gb", "score", "__first", "__n"), ["__gb"], order, 2).groupBy("__gb").agg(
            F.max(F.when(F.col("rank") == 1, F.struct("score", "__first", "__n"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
        second = F.when(F.col("a.__n") > 1, F.col("a.score")).otherwise(F.col("b"))
        return top.select("__gb", F.col("a.__first").alias("__best"), F.coalesce(second, F.lit(0.0)).alias("second_score"), second.isNotNull().alias("sure"))

    def one(p):
        top = p.groupBy("__gs").agg(F.min(F.struct((1 - F.col("score")).alias("cost"), "__line")).alias("a"))
        return top.select("__gs", F.col("a.__line").alias("__box"), F.lit(True).alias("sure"))

    mine = settle(bs.join(picked.select("__gb").distinct(), "__gb", "left_semi"))
    two = _best_pairs(mine, "__gb", lambda some, at: pairs(some, ss, keys, at), two, floor, few)
    mine = settle(ss.join(picked.select("__gs").distinct(), "__gs", "left_semi"))
    one = _best_pairs(mine, "__gs", lambda some, at: pairs(bs, some, keys, at), one, floor, few)
    out = picked.join(two, "__gb").join(one, "__gs").join(segments.select(*keys, "segment", "span_id", "system", "segment_type", "confirmed"), [*keys, "span_id", "system"])
    # the cost is what pairs are compared by
    out = out.withColumn("confidence", F.least(F.lit(0.99), 1 - (1 - F.col("score"))))
    out = out.withColumns({"margin": F.col("confidence") - F.col("second_score"), "mutual_best": F.col("__box") == F.col(box), "box_best": F.col("__best") == F.col("segment")})
    ok = (F.col("confirmed") & (F.col("confidence") >= threshold_for(F.lit("slur"), 0.82)) & (F.col("margin") >= 0.12)
          & F.col("mutual_best") & F.col("box_best") & (F.col("segment_type") == "full"))
    return out.select(*keys, box, "span_id", "system", "segment_type", "confidence", "second_score", "margin", "mutual_best", "box_best",
                      F.when(F.coalesce(ok, F.lit(False)), "matched").otherwise("review").alias("status"),
                      F.concat(F.lit("musicxml_slur_"), "segment_type", F.lit("_endpoint_candidate")).alias("match_source"))
