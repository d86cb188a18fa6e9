"""WIN and SRT queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import windows as W
from ..operators.scan import cell_of
from .base import DAY, EV, LI, OD, events, lines, orders, query, t

def day_cells():
    return [cell_of("us", DAY)]



@query("win_01_onset_cursor", f"""WITH {EV}, n AS (SELECT *, CASE event_type WHEN 'click' THEN 'note' WHEN 'view' THEN 'chord'
 WHEN 'purchase' THEN 'forward' WHEN 'error' THEN 'backup' ELSE 'other' END AS kind FROM ev),
a AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('note','forward') THEN cents WHEN kind = 'backup' THEN -cents ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM n),
b AS (SELECT *, last_value(CASE WHEN kind = 'note' THEN cursor END IGNORE NULLS) OVER w AS lastp,
 max(CASE WHEN kind IN ('note','forward') THEN cursor + cents END) OVER w AS ext FROM a
 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CAST(cursor AS BIGINT) AS cursor, CAST(CASE WHEN kind = 'chord' THEN coalesce(lastp, 0) ELSE cursor END AS BIGINT) AS onset,
 CAST(greatest(coalesce(ext, 0), 0) AS BIGINT) AS extent FROM b""")
def win_01(spark, d):
    kind = (F.when(F.col("event_type") == "click", "note").when(F.col("event_type") == "view", "chord")
            .when(F.col("event_type") == "purchase", "forward").when(F.col("event_type") == "error", "backup").otherwise("other"))
    e = events(spark, d).withColumn("kind", kind)
    return W.onset_cursor(e, ["user_id"], ["us", "event_id"], duration="cents", cells=day_cells()).select("event_id", "cursor", "onset", "extent")


@query("win_02_carry_forward", f"""WITH {EV}
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN cents END IGNORE NULLS) OVER w, 1) AS divisions,
 coalesce(last_value(CASE WHEN event_type = 'error' THEN props END IGNORE NULLS) OVER w, 'none') AS beats FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_02(spark, d):
    e = events(spark, d).select(
        "event_id", "user_id", "us", F.when(F.col("event_type") == "signup", F.col("cents")).alias("divisions"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("beats"))
    return W.carry_forward(e, ["user_id"], ["us", "event_id"], {"divisions": 1, "beats": "none"}, day_cells()).select("event_id", "divisions", "beats")


@query("win_03_layout_counters", f"""WITH {EV}, m AS (SELECT event_id, user_id, us, event_type = 'signup' AS np, event_type = 'error' AS ns FROM ev),
a AS (SELECT *, coalesce(sum(CASE WHEN np OR NOT ns THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM m),
b AS (SELECT *, CASE WHEN np OR (NOT ns AND opened = 0) THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS page FROM b)
SELECT event_id, CAST(page AS INTEGER) AS page, CAST(CASE WHEN page > 0 THEN 1 ELSE 0 END + sum(CASE WHEN ns AND turn = 0 THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id, page ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS system FROM c""")
def win_03(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", (F.col("event_type") == "signup").alias("new_page"),
                                (F.col("event_type") == "error").alias("new_system"))
    return W.layout_counters(e, ["user_id"], ["us", "event_id"], cells=day_cells()).select("event_id", "page", "system")


@query("win_04_assign_ids", f"""WITH {EV}
SELECT event_id, printf('%d:E%07d', user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id)) AS local_id,
 printf('Q%08d', row_number() OVER (ORDER BY us, event_id)) AS global_id FROM ev""")
def win_04(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us")
    a = W.assign_ids(e, ["user_id"], ["us", "event_id"], "%s:E%07d", "local_id", day_cells())
    return W.assign_ids(a, [], ["us", "event_id"], "Q%08d", "global_id").select("event_id", "local_id", "global_id")


@query("win_05_cumulative_position", f"""WITH {EV}, a AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY us, event_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(cents) OVER (PARTITION BY user_id) AS total FROM ev)
SELECT event_id, CAST(off AS BIGINT) AS x_offset, CASE WHEN total > 0 THEN CAST(off AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0::DOUBLE END AS x_norm FROM a""")
def win_05(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", "cents")
    return W.cumulative_position(e, ["user_id"], ["us", "event_id"], "cents", cells=day_cells()).select("event_id", "x_offset", "x_norm")


@query("win_06_derive_end", f"""WITH {OD}, p AS (SELECT o_custkey, day, min(o_orderkey) AS s, CASE WHEN count(*) > 1 THEN max(o_orderkey) END AS e FROM od GROUP BY o_custkey, day)
SELECT o_custkey, day, s AS start, coalesce(e, CASE WHEN lead(day) OVER w = day + 1 THEN lead(s) OVER w - 1 END) AS "end" FROM p
WINDOW w AS (PARTITION BY o_custkey ORDER BY day)""")
def win_06(spark, d):
    p = orders(spark, d).groupBy("o_custkey", "day").agg(F.min("o_orderkey").alias("start"), F.when(F.count(F.lit(1)) > 1, F.max("o_orderkey")).alias("end"))
    return W.derive_end(p, ["o_custkey"], "day", "start", "end", [cell_of("day", 365)])


@query("win_06_printed_numbers", f"""WITH {EV}
SELECT event_id, user_id * 10 + row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY us, event_id) - 1 - CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS printed_measure FROM ev""")
def win_06b(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", cell_of("us", DAY).alias("dayno"))
    return W.printed_numbers(e, ["user_id", "dayno"], ["us", "event_id"], F.col("user_id") * 10, F.when(F.col("user_id") % 2 == 0, 1).otherwise(0),
                             cells=[cell_of("us", DAY // 24)]).select("event_id", "printed_measure")


@query("win_07_chunk", """SELECT doc_id, CAST((rn - 1) // 8 + 1 AS INTEGER) AS part, CAST((rn - 1) % 8 + 1 AS INTEGER) AS slot
FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)""")
def win_07(spark, d):
    return W.chunk(t(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 8,
                   [cell_of("doc_id", 100_000)]).select("doc_id", "part", "slot")


@query("win_08_sample_extremes", f"""WITH {LI}, k AS (SELECT *, CAST(l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey AS BIGINT) * 10 + l_linenumber AS rid FROM li),
r AS (SELECT l_returnflag, l_shipmode, cents, rid, row_number() OVER (PARTITION BY l_returnflag, l_shipmode ORDER BY cents, rid) AS a,
 row_number() OVER (PARTITION BY l_returnflag, l_shipmode ORDER BY cents DESC, rid DESC) AS b FROM (SELECT *, l_suppkey AS l_shipmode FROM k))
SELECT l_returnflag, l_shipmode AS l_suppkey, 'lowest' AS reason, 1 AS position, cents, rid FROM r WHERE a = 1
UNION ALL SELECT l_returnflag, l_shipmode, 'highest', 2, cents, rid FROM r WHERE b = 1 AND a <> 1""")
def win_08(spark, d):
    rid = (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return W.sample_extremes(lines(spark, d).withColumn("rid", rid), ["l_returnflag", "l_suppkey"], "cents", "rid")


@query("win_09_round_robin", """SELECT doc_id, lang, source, rn AS turn FROM (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang, source
 ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rn FROM documents) ORDER BY rn, lang, source LIMIT 150""")
def win_09(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return W.round_robin(docs, ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], 150).select("doc_id", "lang", "source", "turn")


@query("win_10_islands", f"""WITH {EV}, h AS (SELECT DISTINCT user_id, us // 3600000000 AS hour FROM ev),
g AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS grp FROM h)
SELECT user_id, min(hour) AS island, max(hour) AS "last", count(*) AS length FROM g GROUP BY user_id, grp""")
def win_10(spark, d):
    e = events(spark, d).select("user_id", cell_of("us", 3_600_000_000).alias("hour"))
    return W.islands(e, ["user_id"], "hour", [cell_of("hour", 24)])


@query("win_10_longest_run", f"""WITH {EV}, h AS (SELECT DISTINCT user_id, us // 3600000000 AS hour FROM ev),
g AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS grp FROM h)
SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, grp, count(*) AS n FROM g GROUP BY user_id, grp) GROUP BY user_id""")
def win_10b(spark, d):
    e = events(spark, d).select("user_id", cell_of("us", 3_600_000_000).alias("hour"))
    return W.longest_run(e, ["user_id"], "hour", [cell_of("hour", 24)])


@query("win_11_suppress")
def win_11(spark, d):
    o = orders(spark, d).select("o_custkey", "o_orderkey", "cents", F.col("day").alias("lo"), (F.col("day") + 45).alias("hi"))
    return W.suppress(o, ["o_custkey"], "o_orderkey", "cents", "lo", "hi", 15, levels=5)


@query("win_12_argmax_near", f"""WITH {EV}, prof AS (SELECT user_id, us // 3600000000 AS x, count(*) AS run, sum(cents % 10) AS ink FROM ev GROUP BY 1, 2),
pred AS (SELECT user_id, us // 604800000000 AS idx, min(us // 3600000000) + 60 AS px FROM ev GROUP BY 1, 2),
n AS (SELECT *, lag(px) OVER w AS pp, lead(px) OVER w AS np FROM pred WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
b AS (SELECT user_id, idx, px, pp IS NULL OR np IS NULL AS edge, CASE WHEN pp IS NULL OR np IS NULL THEN px - 29 ELSE CAST(round((pp + px) / 2.0::DOUBLE) AS BIGINT) END AS l,
 CASE WHEN pp IS NULL OR np IS NULL THEN px + 29 ELSE CAST(round((px + np) / 2.0::DOUBLE) AS BIGINT) END AS r FROM n),
s AS (SELECT b.user_id, idx, px, edge, x, run, ink, row_number() OVER (PARTITION BY b.user_id, idx ORDER BY 20 * run + 10 * ink - 4 * abs(x - px) DESC, x DESC) AS rk
 FROM b JOIN prof ON prof.user_id = b.user_id AND x BETWEEN l AND r)
SELECT user_id, idx, px AS predicted_x, x, run, CAST(ink AS BIGINT) AS ink, CASE WHEN edge THEN 'system_edge' WHEN run >= 3 THEN 'detected' ELSE 'review_occluded' END AS status FROM s WHERE rk = 1""")
def win_12(spark, d):
    e = events(spark, d).select("user_id", cell_of("us", 3_600_000_000).alias("x"), cell_of("us", 7 * DAY).alias("idx"), (F.col("cents") % 10).alias("i"))
    prof = e.groupBy("user_id", "x").agg(F.count(F.lit(1)).alias("run"), F.sum("i").alias("ink"))
    pred = e.groupBy("user_id", "idx").agg((F.min("x") + 60).alias("px"), F.lit(720).alias("width"))
    return W.argmax_near(prof, pred, ["user_id"], F.lit(3.4))


@query("win_13_assert_monotone", f"""WITH {EV}, a AS (SELECT event_id, user_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY us, event_id) AS previous FROM ev)
SELECT event_id, user_id, cents, previous FROM a WHERE cents <= previous""")
def win_13(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", "cents")
    return W.assert_monotone(e, ["user_id"], ["us", "event_id"], "cents", day_cells()).drop("us")


@query("srt_01_time_sort", """WITH e AS (SELECT *, row_number() OVER (ORDER BY value NULLS LAST, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, user_id, event_type, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS pos FROM events)
SELECT event_id, pos FROM e""")
def srt_01(spark, d):
    kind = F.when(F.col("event_type") == "click", "yolo").when(F.col("event_type") == "view", "xml_event").when(F.col("event_type") == "error", "xml_node").otherwise("other")
    e = t(spark, d, "events").select(
        "event_id", F.col("value").cast("string").alias("start_meas"), F.lit("NA").alias("end_meas"), kind.alias("source_record_type"),
        F.col("user_id").cast("string").alias("yolo_line"), F.col("event_type").alias("class"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("record_id"))
    return O.time_rank(e, out="pos").select("event_id", "pos")


@query("srt_02_priority_sort", f"""WITH {LI}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, day, qty, cents, row_number() OVER (ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END,
 CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN -1 ELSE qty / 100.0::DOUBLE END, l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, day) AS queue_rank FROM li""")
def srt_02(spark, d):
    li = lines(spark, d).withColumns({
        "combined_status": F.when(F.col("l_returnflag") == "R", "ambiguous").otherwise("candidate"),
        "confidence": F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "n/a").otherwise((F.col("qty") / 100.0).cast("string"))})
    out = O.priority_rank(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "day"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "day", "qty", "cents", "queue_rank")


@query("srt_03_reader_queue", f"""WITH {OD}, q AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'confirm' WHEN o_orderkey % 3 = 1 THEN 'skipped' ELSE 'pending' END AS saved_action,
 CASE o_orderstatus WHEN 'O' THEN 'review' ELSE 'unresolved' END AS status, (cents % 100) / 100.0::DOUBLE AS c FROM od WHERE o_orderstatus <> 'F')
SELECT o_orderkey AS yolo_line, saved_action, status, row_number() OVER (ORDER BY CASE WHEN saved_action IN ('pending','uncertain','skipped') THEN 0 ELSE 1 END, c, lpad(CAST(o_custkey AS VARCHAR), 9, '0'), o_orderkey) AS pos FROM q""")
def srt_03(spark, d):
    o = orders(spark, d)
    rows = o.select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("page_id"), F.col("o_orderkey").alias("yolo_line"), F.col("o_orderpriority").alias("class"),
                    F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "review").otherwise("NA").alias("status"),
                    ((F.col("cents") % 100) / 100.0).alias("confidence"))
    dec = o.where("o_orderkey % 3 < 2").select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("page_id"), F.col("o_orderkey").alias("yolo_line"),
                                               F.when(F.col("o_orderkey") % 3 == 0, "confirm").otherwise("skipped").alias("action"))
    return O.reader_rank(O.reader_queue(rows, dec), "pos").select("yolo_line", "saved_action", "status", "pos")


@query("srt_04_top_k", f"""WITH {EV} SELECT user_id, event_id, cents, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS INTEGER) AS rank FROM ev) WHERE rank <= 3""")
def srt_04(spark, d):
    e = events(spark, d).select("user_id", "event_id", "cents")
    return O.top_k(e, ["user_id"], [F.col("cents").desc(), F.col("event_id")], 3)
