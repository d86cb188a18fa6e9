"""MT queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.scan import number_rows
from ..operators.spans import match_spans
from .base import DAY, EV, LI, OD, events, lines, orders, query, t


@query("mt_01_greedy_match")
def mt_01(spark, d):
    e = lines(spark, d).select("l_returnflag", "l_orderkey", "l_partkey", "cents")
    return M.greedy_match(e, ["l_returnflag"], "l_orderkey", "l_partkey", "cents", limit=9_000_000)


def _page(spark, d):
    """Customers as boxes and suppliers as targets; a nation is a page, a balance band a system."""
    c = t(spark, d, "customer").select(
        F.col("c_nationkey").alias("page_id"), (F.col("c_custkey") % 2).alias("system"), F.col("c_custkey").alias("yolo_line"), "c_mktsegment",
        (F.floor("c_acctbal") + 1000).cast("bigint").alias("x"), (F.col("c_custkey") * 37 % 3000).alias("y"), F.lit(12000).alias("page_w"), F.lit(4000).alias("page_h"))
    s = t(spark, d, "supplier").select(
        F.col("s_nationkey").alias("page_id"), (F.col("s_suppkey") % 2).alias("system"), F.col("s_suppkey").alias("seq"),
        (F.floor("s_acctbal") + 1000).cast("bigint").alias("x"), (F.col("s_suppkey") * 53 % 3000).alias("y"), F.lit(12000).alias("page_w"), F.lit(4000).alias("page_h"))
    return c, s


@query("mt_02_match_points")
def mt_02(spark, d):
    c, s = _page(spark, d)
    cls = F.when(F.col("c_mktsegment") == "MACHINERY", "articStaccatoAbove").when(F.col("c_mktsegment") == "HOUSEHOLD", "articStaccatoBelow").otherwise("articStaccato")
    rule = {"kind": F.lit("articulation"), "mark": F.lit("staccato")}
    return M.match_points(c.withColumns({**rule, "class": cls}).drop("c_mktsegment"), s.withColumns(rule), bits=12)


@query("mt_03_match_ties")
def mt_03(spark, d):
    c, s = _page(spark, d)
    ties = s.select("page_id", F.col("seq").alias("tie_id"), F.col("system").alias("start_system"), (F.col("seq") % 3 % 2).alias("end_system"),
                    F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("seq") * 7 % 500).alias("x1"), F.col("y").alias("y1"),
                    (F.col("seq") % 2 == 0).alias("confirmed"), "page_w", "page_h")
    return M.match_ties(c.withColumn("w", F.col("yolo_line") * 11 % 500), ties, bits=12)


@query("mt_04_match_tuplets")
def mt_04(spark, d):
    c, s = _page(spark, d)
    cls = F.when(F.col("c_mktsegment") == "MACHINERY", "tuplet3").when(F.col("c_mktsegment") == "HOUSEHOLD", "tuplet5").otherwise("tupletBracket")
    g = s.select("page_id", "system", F.col("seq").alias("group_id"), F.when(F.col("seq") % 2 == 0, 3).otherwise(5).alias("actual_notes"),
                 F.col("x").alias("mean_x"), F.col("y").alias("mean_y"), "page_w", "page_h")
    return M.match_tuplets(c.withColumn("class", cls).drop("c_mktsegment"), g, bits=16)


@query("mt_05_expand_segments", f"""WITH {OD}, sp AS (SELECT o_orderkey, o_custkey, day // 100 AS s, (day + o_orderkey % 250) // 100 AS e, day AS x0, day + o_orderkey % 250 AS x1 FROM od),
x AS (SELECT *, unnest(generate_series(s, e)) AS system FROM sp), k AS (SELECT *, CASE WHEN s = e THEN 'full' WHEN system = s THEN 'start' WHEN system = e THEN 'end' ELSE 'middle' END AS segment_type FROM x)
SELECT o_orderkey AS span_id, system, segment_type, CASE WHEN segment_type IN ('full','start') THEN x0 ELSE system * 100 END AS seg_x0,
 CASE WHEN segment_type IN ('full','end') THEN x1 ELSE system * 100 + 99 END AS seg_x1,
 CASE segment_type WHEN 'end' THEN 2 WHEN 'middle' THEN 5 ELSE 1 END AS seg_y0, CASE segment_type WHEN 'full' THEN 2 WHEN 'end' THEN 2 WHEN 'start' THEN 1 ELSE 5 END AS seg_y1 FROM k""")
def mt_05(spark, d):
    o = orders(spark, d)
    end = F.col("day") + F.col("o_orderkey") % 250
    sp = o.select(F.col("o_orderkey").alias("span_id"), F.lit(0).alias("page_id"), F.floor(F.col("day") / 100).alias("start_system"), F.floor(end / 100).alias("end_system"),
                  F.col("day").alias("x0"), F.lit(1).alias("y0"), end.alias("x1"), F.lit(2).alias("y1"))
    lo_hi = sp.agg(F.min("start_system").alias("a"), F.max("end_system").alias("b"))
    systems = lo_hi.select(F.lit(0).alias("page_id"), F.explode(F.sequence("a", "b")).alias("system")).withColumns(
        {"x_left": F.col("system") * 100, "x_right": F.col("system") * 100 + 99, "upper_center": F.lit(5)})
    return M.expand_segments(sp, systems, ["page_id"]).select("span_id", "system", "segment_type", "seg_x0", "seg_x1", "seg_y0", "seg_y1")


@query("mt_06_segment_score", f"""WITH {LI}, f AS (SELECT *, CAST(l_partkey % 900 AS DOUBLE) AS cx, CAST(l_suppkey AS DOUBLE) AS cy, qty * 4.0::DOUBLE AS bw, CAST(l_orderkey % 900 AS DOUBLE) AS x0,
 CAST(l_orderkey % 900 + l_linenumber * 20 AS DOUBLE) AS x1, 40.0::DOUBLE AS y0, 44.0::DOUBLE AS y1, 10.0::DOUBLE AS sp, l_returnflag = 'A' AS u FROM li),
g AS (SELECT *, greatest(8.0::DOUBLE, abs(x1 - x0)) AS span FROM f), h AS (SELECT *, abs(cx - (x0 + x1) / 2) / greatest(18.0::DOUBLE, span * 0.35::DOUBLE) AS xr, greatest(0.05::DOUBLE, bw / span) AS ratio,
 least(greatest(sp * 1.1::DOUBLE, span * 0.38::DOUBLE), sp * 3.5::DOUBLE) AS lift, CASE WHEN u THEN y1 ELSE y0 END AS ny FROM g),
k AS (SELECT *, abs(cy - CASE WHEN u THEN ny + lift ELSE ny - lift END) / (sp * 2.0::DOUBLE) AS yr, greatest(0.0::DOUBLE, CASE WHEN u THEN ny - cy ELSE cy - ny END) AS wrong FROM h)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, day, qty, round(0.42::DOUBLE * exp(-0.5::DOUBLE * xr * xr) + 0.28::DOUBLE * exp(-abs(ln(ratio)) / 0.65::DOUBLE)
 + 0.23::DOUBLE * exp(-0.5::DOUBLE * yr * yr) + 0.07::DOUBLE * exp(-wrong / sp), 6) AS score FROM k""")
def mt_06(spark, d):
    f = lines(spark, d).withColumns({
        "center_x": (F.col("l_partkey") % 900).cast("double"), "center_y": F.col("l_suppkey").cast("double"), "width_px": F.col("qty") * 4.0,
        "seg_x0": (F.col("l_orderkey") % 900).cast("double"), "seg_x1": (F.col("l_orderkey") % 900 + F.col("l_linenumber") * 20).cast("double"),
        "seg_y0": F.lit(40.0), "seg_y1": F.lit(44.0), "staff_spacing": F.lit(10.0), "orientation": F.when(F.col("l_returnflag") == "A", "under").otherwise("over")})
    return M.segment_score(f).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "day", "qty", F.round("score", 6).alias("score"))


_EDGE = f"""{LI}, e AS (SELECT l_orderkey, l_partkey, max(cents % 10000) / 10000.0::DOUBLE AS score FROM li GROUP BY 1, 2)"""


def _edges(spark, d):
    return lines(spark, d).groupBy("l_orderkey", "l_partkey").agg((F.max(F.col("cents") % 10000) / 10000.0).alias("score"))


_CLASSIFY = """CASE WHEN score < 0.42 THEN 'possible_scan_only' WHEN score >= 0.82 AND margin >= 0.12 AND mutual_best AND st = 'full' THEN 'high_confidence_candidate' ELSE 'needs_review' END"""


@query("mt_07_rank_candidates", f"""WITH {_EDGE}, r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(lead(score) OVER w, 0.0::DOUBLE) AS second_score,
 first_value(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY score DESC, l_orderkey) = l_orderkey AS mutual_best FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey)),
m AS (SELECT *, score - second_score AS margin, CASE WHEN l_partkey % 3 = 0 THEN 'start' ELSE 'full' END AS st FROM r WHERE rank <= 3)
SELECT l_orderkey, l_partkey, rank, score, second_score, mutual_best, {_CLASSIFY} AS status, CASE WHEN score < 0.42 THEN 'no sufficient geometric agreement'
 WHEN score >= 0.82 AND margin >= 0.12 AND mutual_best AND st = 'full' THEN 'mutual best full-system match'
 ELSE concat_ws('; ', CASE WHEN score < 0.82 THEN 'score below 0.82' END, CASE WHEN margin < 0.12 THEN 'top-two margin below 0.12' END,
  CASE WHEN NOT mutual_best THEN 'candidate segment prefers another box' END, CASE WHEN st <> 'full' THEN 'cross-system segment requires review' END) END AS reason FROM m""")
def mt_07(spark, d):
    r = M.rank_candidates(_edges(spark, d), [], "l_orderkey", "l_partkey", "score")
    st = F.when(F.col("l_partkey") % 3 == 0, "start").otherwise("full")
    status, reason = M.classify_proposal("score", "margin", "mutual_best", st)
    return r.select("l_orderkey", "l_partkey", "rank", "score", "second_score", "mutual_best", status.alias("status"), reason.alias("reason"))


_GEOMETRY = """p AS (SELECT c_nationkey % 3 AS page_id, c_custkey % 3 AS system, c_custkey AS yolo_line, CAST((CAST(floor(c_acctbal) AS BIGINT) + 1000) % 1000 AS DOUBLE) AS cx,
  CAST(c_custkey * 37 % 50 + 100 * (c_custkey % 3) + 20 AS DOUBLE) AS cy, CAST(20 + c_custkey * 11 % 280 AS DOUBLE) AS w FROM customer),
 s AS (SELECT s_nationkey % 3 AS page_id, s_suppkey AS span_id, s_suppkey % 3 AS sa, (s_suppkey * 7 // 5) % 3 AS sb, CAST((CAST(floor(s_acctbal) AS BIGINT) + 1000) % 1000 AS DOUBLE) AS x0,
  CAST((CAST(floor(s_acctbal) AS BIGINT) + 1000) % 1000 + 30 + s_suppkey * 7 % 250 AS DOUBLE) AS x1, s_suppkey % 2 = 0 AS under, s_suppkey % 4 <> 0 AS confirmed,
  CAST(s_suppkey * 53 % 50 + 100 * (s_suppkey % 3) + 40 AS DOUBLE) AS y0, CAST(s_suppkey * 29 % 50 + 100 * ((s_suppkey * 7 // 5) % 3) + 40 AS DOUBLE) AS y1 FROM supplier),
 g AS (SELECT *, unnest(generate_series(least(sa, sb), greatest(sa, sb))) AS system FROM s),
 k AS (SELECT *, CASE WHEN sa = sb THEN 'full' WHEN system = sa THEN 'start' WHEN system = sb THEN 'end' ELSE 'middle' END AS kind FROM g),
 j AS (SELECT *, CASE WHEN kind IN ('full', 'start') THEN x0 ELSE 0.0::DOUBLE END AS a, CASE WHEN kind IN ('full', 'end') THEN x1 ELSE 1200.0::DOUBLE END AS b,
  CASE WHEN kind IN ('full', 'start') THEN y0 WHEN kind = 'end' THEN y1 ELSE 100.0::DOUBLE * system + 50 END AS ya, CASE WHEN kind IN ('full', 'end') THEN y1 WHEN kind = 'start' THEN y0 ELSE 100.0::DOUBLE * system + 50 END AS yb FROM k),
 f AS (SELECT page_id, system, yolo_line, span_id, kind, confirmed, cx, cy, w, under, least(a, b) AS l, greatest(a, b) AS r, greatest(8.0::DOUBLE, abs(b - a)) AS span, CASE WHEN under THEN greatest(ya, yb) ELSE least(ya, yb) END AS ny FROM p JOIN j USING (page_id, system)),
 h AS (SELECT *, abs(cx - (l + r) / 2) / greatest(18.0::DOUBLE, span * 0.35::DOUBLE) AS xr, greatest(0.05::DOUBLE, w / span) AS ratio, least(greatest(11.0::DOUBLE, span * 0.38::DOUBLE), 35.0::DOUBLE) AS lift FROM f),
 e AS (SELECT page_id, system, yolo_line, span_id, kind, confirmed, 0.42::DOUBLE * exp(-0.5::DOUBLE * xr * xr) + 0.28::DOUBLE * exp(-abs(ln(ratio)) / 0.65::DOUBLE)
   + 0.23::DOUBLE * exp(-0.5::DOUBLE * pow(abs(cy - CASE WHEN under THEN ny + lift ELSE ny - lift END) / 20.0::DOUBLE, 2)) + 0.07::DOUBLE * exp(-greatest(0.0::DOUBLE, CASE WHEN under THEN ny - cy ELSE cy - ny END) / 10.0::DOUBLE) AS score FROM h)"""


@query("mt_07_span_matching", f"""WITH RECURSIVE {_GEOMETRY},
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY 1 - score, yolo_line, span_id, system) AS place, span_id * 3 + system AS seg,
 first_value(span_id) OVER (PARTITION BY page_id, yolo_line ORDER BY score DESC, span_id) AS best_span, coalesce(nth_value(score, 2) OVER (PARTITION BY page_id, yolo_line ORDER BY score DESC, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second,
 first_value(yolo_line) OVER (PARTITION BY page_id, span_id, system ORDER BY 1 - score, yolo_line) AS first_box FROM e WHERE score >= 0.42),
take AS (SELECT page_id, []::BIGINT[] AS boxes, []::BIGINT[] AS segs, 0::BIGINT AS place FROM (SELECT DISTINCT page_id FROM q)
 UNION ALL SELECT page_id, list_append(boxes, yolo_line), list_append(segs, seg), place FROM (SELECT t.page_id, t.boxes, t.segs, q.yolo_line, q.seg, q.place, row_number() OVER (PARTITION BY t.page_id ORDER BY q.place) AS rn
  FROM take t JOIN q ON q.page_id = t.page_id AND q.place > t.place AND NOT list_contains(t.boxes, q.yolo_line) AND NOT list_contains(t.segs, q.seg)) WHERE rn = 1)
SELECT page_id, yolo_line, span_id, system, kind AS segment_type, round(least(0.99, 1 - (1 - score)), 6) AS confidence, round(second, 6) AS second_score, first_box = yolo_line AS mutual_best, best_span = span_id AS box_best,
 CASE WHEN confirmed AND score >= 0.82 AND least(0.99, score) - second >= 0.12 AND first_box = yolo_line AND best_span = span_id AND kind = 'full' THEN 'matched' ELSE 'review' END AS status
FROM q JOIN take USING (page_id, place)""")
def mt_07_spans(spark, d):
    wrap = lambda c: (F.floor(c).cast("bigint") + 1000) % 1000
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    boxes = t(spark, d, "customer").select(
        (F.col("c_nationkey") % 3).alias("page_id"), (c % 3).alias("system"), c.alias("yolo_line"), wrap("c_acctbal").cast("double").alias("center_x"),
        (c * 37 % 50 + 100 * (c % 3) + 20).cast("double").alias("center_y"), (20 + c * 11 % 280).cast("double").alias("width_px"))
    start, end, left = s % 3, F.floor(s * 7 / 5) % 3, wrap("s_acctbal")
    spans = t(spark, d, "supplier").select(
        (F.col("s_nationkey") % 3).alias("page_id"), s.alias("span_id"), start.alias("start_system"), end.alias("end_system"), left.cast("double").alias("x0"), (left + 30 + s * 7 % 250).cast("double").alias("x1"),
        (s * 53 % 50 + 100 * start + 40).cast("double").alias("y0"), (s * 29 % 50 + 100 * end + 40).cast("double").alias("y1"),
        F.when(s % 2 == 0, "under").otherwise("over").alias("orientation"), (s % 4 != 0).alias("confirmed"))
    systems = spans.select("page_id").distinct().withColumn("system", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumns(
        {"x_left": F.lit(0.0), "x_right": F.lit(1200.0), "upper_center": 100.0 * F.col("system") + 50, "staff_spacing": F.lit(10.0)})
    out = match_spans(boxes, spans, systems)
    return out.select("page_id", "yolo_line", "span_id", "system", "segment_type", F.round("confidence", 6).alias("confidence"), F.round("second_score", 6).alias("second_score"), "mutual_best", "box_best", "status")


@query("mt_08_rank_with_locks", f"""WITH {_EDGE}, s AS (SELECT *, l_partkey // 2 AS cand, CASE WHEN l_partkey % 2 = 0 THEN 'full' ELSE 'start' END AS st FROM e),
rv AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'matched' ELSE 'scan' END AS ms, o_custkey AS cand FROM orders WHERE o_orderstatus = 'P'),
q AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.l_orderkey = s.l_orderkey) AND NOT (st = 'full' AND EXISTS (SELECT 1 FROM rv WHERE ms = 'matched' AND rv.cand = s.cand))),
r AS (SELECT *, row_number() OVER w AS rk, coalesce(lead(score) OVER w, 0.0::DOUBLE) AS second_score, first_value(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY score DESC, l_orderkey) = l_orderkey AS mutual_best
 FROM q WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey)), b AS (SELECT *, score - second_score AS margin FROM r WHERE rk = 1),
dn AS (SELECT l_orderkey, l_partkey, cand, score AS best_score, {_CLASSIFY} AS status FROM b
 UNION ALL SELECT l_orderkey, NULL, CASE WHEN ms = 'matched' THEN cand END, NULL, CASE WHEN ms = 'matched' THEN 'locked_xml_match' ELSE 'locked_scan_only' END FROM rv)
SELECT * FROM dn UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'possible_scan_only' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM dn)""")
def mt_08(spark, d):
    s = _edges(spark, d).withColumns({"cand": F.floor(F.col("l_partkey") / 2).cast("bigint"), "segment_type": F.when(F.col("l_partkey") % 2 == 0, "full").otherwise("start")})
    o = t(spark, d, "orders")
    rv = o.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "matched").otherwise("scan").alias("match_status"), F.col("o_custkey").alias("cand"))
    out = M.rank_with_locks(s, rv, o.select(F.col("o_orderkey").alias("l_orderkey")), [], "l_orderkey", "l_partkey", "cand", "score")
    return out.select("l_orderkey", "l_partkey", "cand", "best_score", "status")


@query("mt_09_proximity_components")
def mt_09(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.floor(F.col("us") / 60_000_000).alias("x"), "cents")
    return M.proximity_components(e, ["user_id"], "event_id", "x", "cents", 600, 800)


@query("mt_09_time_islands", f"""WITH {EV}, m AS (SELECT user_id, event_id, us // 60000000 AS x FROM ev),
a AS (SELECT *, CASE WHEN x - lag(x) OVER w <= 240 THEN 0 ELSE 1 END AS st FROM m WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id, g) AS component FROM b""")
def mt_09b(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.floor(F.col("us") / 60_000_000).alias("x"), F.lit(0).alias("y"))
    return M.proximity_components(e, ["user_id"], "event_id", "x", "y", 240, 0)


@query("mt_10_allocate_groups")
def mt_10(spark, d):
    e = events(spark, d).withColumns({"page_id": F.col("user_id"), "system": F.floor(F.col("us") / DAY), "x": (F.col("us") % DAY) / 60_000_000, "y": F.col("cents") / 100})
    g = e.where("event_type in ('error', 'signup')").select("page_id", "system", F.col("event_id").alias("group_id"), "x", "y", F.lit(1).alias("preferred_staff"),
                                            F.array(F.struct("y", F.col("event_id").alias("yolo_line"))).alias("boxes"))
    c = e.where("event_type in ('click', 'view')").groupBy("page_id", "system", F.floor(F.col("x") / 2).alias("chord_id")).agg(
        F.lit(1).alias("staff"), F.min("us").cast("double").alias("time"), F.avg("x").alias("x"), F.collect_list(F.struct("y", F.col("event_id").alias("note_id"))).alias("notes"))
    return M.allocate_groups(g, c, 1440.0)


@query("mt_11_optimal_match")
def mt_11(spark, d):
    c = t(spark, d, "customer").select(F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("block"), "c_custkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("bal"))
    l = number_rows(c, ["block"], ["c_custkey"], "k").withColumn("k", F.explode(F.sequence(F.col("k") - 2, F.col("k") + 2)))
    r = number_rows(c.select("block", F.col("c_custkey").alias("other"), F.col("bal").alias("other_bal")), ["block"], ["other_bal", "other"], "k")
    e = l.join(r, ["block", "k"]).withColumn("cost", F.abs(F.col("bal") - F.col("other_bal")))
    return M.optimal_match(e, ["block"], "c_custkey", "other", "cost")


@query("mt_12_overlay", f"""WITH {OD} SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'span' WHEN o_custkey % 2 = 0 THEN 'point' ELSE 'estimate' END AS match_source,
 CASE WHEN o_orderstatus = 'P' THEN cents WHEN o_custkey % 2 = 0 THEN day ELSE 0 END AS v, CASE WHEN o_orderstatus = 'P' THEN 2 WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS source_rank FROM od""")
def mt_12(spark, d):
    o = orders(spark, d)
    a = o.select("o_orderkey", F.lit("estimate").alias("match_source"), F.lit(0).cast("bigint").alias("v"))
    b = o.where("o_custkey % 2 = 0").select("o_orderkey", F.lit("point").alias("match_source"), F.col("day").alias("v"))
    c = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("span").alias("match_source"), F.col("cents").alias("v"))
    return M.overlay([a, b, c], ["o_orderkey"], ["match_source", "v"])


@query("mt_13_candidate_lists", f"""WITH {EV}, q AS (SELECT user_id, event_id, us // 60000000 AS x, cents AS y FROM ev WHERE event_type = 'purchase'), n AS (SELECT user_id, event_id AS note_id, us // 60000000 AS x, cents AS y FROM ev WHERE event_type = 'click'),
p AS (SELECT q.user_id, q.event_id, note_id, 4 * abs(q.x - n.x) + 3 * abs(q.y - n.y) AS distance4, row_number() OVER (PARTITION BY q.event_id ORDER BY 4 * abs(q.x - n.x) + 3 * abs(q.y - n.y), n.x, n.y, note_id) AS rank FROM q JOIN n USING (user_id))
SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank, note_id, distance4 FROM p WHERE rank <= 8""")
def mt_13(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.floor(F.col("us") / 60_000_000).alias("x"), F.col("cents").alias("y"), "event_type")
    notes = e.where("event_type = 'click'").withColumnRenamed("event_id", "note_id").drop("event_type")
    return M.candidate_lists(e.where("event_type = 'purchase'").drop("event_type"), notes, ["user_id"], "event_id", "note_id", 8)


@query("mt_13_measure_order", f"""WITH {EV} SELECT event_id AS note_id, row_number() OVER (PARTITION BY user_id, us // {DAY}, event_type ORDER BY us // 60000000, cents, event_id) AS measure_note_order FROM ev""")
def mt_13b(spark, d):
    e = events(spark, d).select("user_id", F.floor(F.col("us") / DAY).alias("printed_measure"), F.col("event_type").alias("staff"), F.floor(F.col("us") / 60_000_000).alias("x"),
                                F.col("cents").alias("y"), F.col("event_id").alias("note_id"))
    return M.measure_order(e, ["user_id", "printed_measure", "staff"], [F.floor(F.col("x") / 60)]).select("note_id", "measure_note_order")


@query("mt_14_assemble", f"""WITH {LI} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, day, qty AS end_meas, CAST(l_linenumber AS BIGINT) AS start_meas,
 CASE WHEN l_partkey = l_suppkey THEN CAST(l_partkey AS VARCHAR) ELSE concat(l_partkey, ',', l_suppkey) END AS note_ids,
 CASE WHEN l_partkey = l_suppkey THEN l_returnflag ELSE concat(l_returnflag, ',', l_returnflag) END AS pitches FROM li""")
def mt_14(spark, d):
    def anchor(time, note):
        return F.struct(
            F.col(time).cast("bigint").alias("time"), F.col(note).alias("note_id"), F.lit(1).alias("system"), F.lit("1").alias("measure"), F.lit(1).alias("staff"), F.lit(0.0).alias("x"),
            F.lit(0.0).alias("y"), F.array(F.struct(F.col(note).alias("seq"), F.col(note).alias("note_id"), F.col("l_returnflag").alias("pitch"))).alias("members"))

    li = lines(spark, d).withColumns({"start": anchor("l_linenumber", "l_partkey"), "end": anchor("qty", "l_suppkey")})
    out = M.assemble(li)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "day", "start_meas", "end_meas",
                      F.array_join(F.col("note_ids").cast("array<string>"), ",").alias("note_ids"), F.array_join("pitches", ",").alias("pitches"))
