"""JN queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.scan import cell_of
from .base import DAY, EV, LI, OD, events, lines, orders, query, t

def day_cells():
    return [cell_of("us", DAY)]



@query("jn_01_pair_outer", """WITH l AS (SELECT doc_id, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows,
 CASE WHEN l.n > 1 OR r.n > 1 THEN 'duplicate_key' WHEN r.n IS NULL THEN 'missing_right' WHEN l.n IS NULL THEN 'missing_left' ELSE 'paired' END AS pair_status
FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE coalesce(l.doc_id, r.doc_id) >= 10""")
def jn_01(spark, d):
    return J.pair_outer(t(spark, d, "documents").where("lang <> 'en'").select("doc_id"), t(spark, d, "labels").select("doc_id"), ["doc_id"], first=10, page="doc_id")


@query("jn_02_zip_join", f"""WITH {EV}, l AS (SELECT user_id, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM ev WHERE event_type = 'view'),
r AS (SELECT user_id, event_id AS purchase_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM ev WHERE event_type = 'purchase'),
c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n_left, count(*) FILTER (event_type = 'purchase') AS n_right FROM ev GROUP BY user_id)
SELECT user_id, k, view_id, purchase_id, n_left, n_right, CASE WHEN view_id IS NULL THEN 'right_only' WHEN purchase_id IS NULL THEN 'left_only'
 WHEN n_left = n_right THEN 'matched' ELSE 'review' END AS pair_status,
 round(CASE WHEN n_left = n_right THEN 1.0::DOUBLE ELSE CAST(least(n_left, n_right) AS DOUBLE) / greatest(n_left, n_right, 1) END, 6) AS confidence
FROM l FULL JOIN r USING (user_id, k) JOIN c USING (user_id)""")
def jn_02(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    return J.zip_join(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], ["us", "event_id"], ["us", "event_id"],
                      {"event_id": "view_id"}, {"event_id": "purchase_id"}, day_cells(), day_cells())


@query("jn_03_consume_join", f"""WITH {LI}, {OD}, l AS (SELECT l_suppkey AS grp, day, l_orderkey * 10 + l_linenumber AS lid, row_number() OVER (PARTITION BY l_suppkey, day ORDER BY l_orderkey * 10 + l_linenumber, cents, l_partkey) AS k, cents, l_partkey FROM li),
r AS (SELECT o_custkey % 100 AS grp, day, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 100, day ORDER BY o_orderkey) AS k FROM od)
SELECT l.grp, l.day, k, lid, l_partkey, r.o_orderkey, CASE WHEN r.o_orderkey IS NULL THEN 'unmatched' ELSE 'exact' END AS pair_status FROM l LEFT JOIN r USING (grp, day, k)""")
def jn_03(spark, d):
    l = lines(spark, d).select(F.col("l_suppkey").alias("grp"), "day", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lid"), "cents", "l_partkey")
    r = orders(spark, d).select((F.col("o_custkey") % 100).alias("grp"), "day", "o_orderkey")
    return J.consume_join(l, r, ["grp", "day"], ["lid", "cents", "l_partkey"], ["o_orderkey"], {"lid": "lid", "l_partkey": "l_partkey"}, {"o_orderkey": "o_orderkey"},
                          [cell_of("lid", 1_000_000)], [cell_of("o_orderkey", 100_000)])


def _clicks_views(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.floor(F.col("us") / 1_000_000).alias("sec"), "event_type")
    return (e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "sec"),
            e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "sec"))


@query("jn_04_nearest_within", f"""WITH {EV}, s AS (SELECT user_id, event_id, us // 1000000 AS sec, event_type FROM ev),
c AS (SELECT l.event_id AS click_id, r.event_id AS view_id, abs(l.sec - r.sec) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.sec - r.sec), r.event_id) AS rk
 FROM s l JOIN s r ON l.user_id = r.user_id AND abs(l.sec - r.sec) <= 7200 AND l.event_type = 'click' AND r.event_type = 'view')
SELECT e.event_id AS click_id, c.view_id, c.gap FROM ev e LEFT JOIN c ON c.click_id = e.event_id AND rk = 1 WHERE event_type = 'click'""")
def jn_04(spark, d):
    l, r = _clicks_views(spark, d)
    out = J.nearest_within(l, r, ["user_id"], "sec", "view_id", 7200, 86_400)
    return out.select("click_id", F.col("near.id").alias("view_id"), F.col("near.gap").alias("gap"))


@query("jn_04_tolerance_one_to_one")
def jn_04b(spark, d):
    l, r = _clicks_views(spark, d)
    return J.tolerance_join(l, r, ["user_id"], "sec", "click_id", "view_id", 7200, 86_400)


@query("jn_05_interval_join", f"""WITH {LI}, {OD}, sp AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS span_id, day AS s, day + qty AS e FROM li),
p AS (SELECT o_orderkey, o_custkey % 100 AS l_suppkey, day FROM od),
c AS (SELECT o_orderkey, l_suppkey, span_id, day - s AS gap, row_number() OVER (PARTITION BY o_orderkey ORDER BY day - s, span_id) AS rk FROM p JOIN sp USING (l_suppkey) WHERE day BETWEEN s AND e)
SELECT o_orderkey, l_suppkey, span_id, gap FROM c WHERE rk = 1""")
def jn_05(spark, d):
    s = lines(spark, d).select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), F.col("day").alias("s"), (F.col("day") + F.col("qty")).alias("e"))
    p = orders(spark, d).select("o_orderkey", (F.col("o_custkey") % 100).alias("l_suppkey"), "day")
    return J.interval_join(p, s, ["l_suppkey"], "o_orderkey", "day", "s", "e", "span_id", 15, levels=5)


@query("jn_06_resolve_tiers")
def jn_06(spark, d):
    l = orders(spark, d).select((F.col("o_custkey") % 100).alias("g"), F.col("o_orderkey").alias("lid"), "day")
    r = lines(spark, d).groupBy("l_orderkey").agg(F.min("l_suppkey").alias("g"), F.min("day").alias("s"), (F.max("day")).alias("e")).select("g", F.col("l_orderkey").alias("rid"), "s", "e")
    return J.resolve_tiers(l, r, ["g"], "lid", "rid", "day", "s", "e", 2, 15, width=365, levels=9)


@query("jn_07_nearest_band", """WITH b AS (SELECT CAST(p_brand AS VARCHAR) AS brand, p_size AS band, CAST(round(avg(p_retailprice)) AS BIGINT) AS center FROM part GROUP BY 1, 2),
c AS (SELECT p_partkey, band, abs(center - CAST(round(p_retailprice) AS BIGINT)) AS gap, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(center - CAST(round(p_retailprice) AS BIGINT)), band) AS rk FROM part p JOIN b ON b.brand = p.p_brand)
SELECT p_partkey, band, gap FROM c WHERE rk = 1""")
def jn_07(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.round("p_retailprice").cast("bigint").alias("x"), F.col("p_size").alias("band"), "p_retailprice")
    b = p.groupBy("brand", "band").agg(F.round(F.avg("p_retailprice")).cast("bigint").alias("center"))
    return J.nearest_band(p, b, ["brand"], "p_partkey", "x", "center", "band", 1000).select("p_partkey", "band", "gap")


@query("jn_07_containing_band", """WITH b AS (SELECT p_brand, p_size AS band, CAST(min(floor(p_retailprice)) AS BIGINT) AS lo, CAST(min(floor(p_retailprice)) AS BIGINT) + 20 * p_size AS hi FROM part GROUP BY 1, 2),
x AS (SELECT p_partkey, p_brand, CAST(floor(p_retailprice) AS BIGINT) + p_size % 7 * 100 - 300 AS x FROM part),
c AS (SELECT p_partkey, band, greatest(lo - x, x - hi, 0) AS outside, row_number() OVER (PARTITION BY p_partkey ORDER BY greatest(lo - x, x - hi, 0), abs(x - (lo + hi) // 2), band) AS rk FROM x JOIN b USING (p_brand))
SELECT p_partkey, band, outside FROM c WHERE rk = 1""")
def jn_07b(spark, d):
    p = t(spark, d, "part").withColumn("fl", F.floor("p_retailprice").cast("bigint"))
    b = p.groupBy("p_brand", F.col("p_size").alias("band")).agg(F.min("fl").alias("lo")).withColumn("hi", F.col("lo") + 20 * F.col("band"))
    b = b.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
    x = p.select("p_partkey", "p_brand", (F.col("fl") + F.col("p_size") % 7 * 100 - 300).alias("x"))
    return J.containing_band(x, b, ["p_brand"], "p_partkey", "x", "lo", "hi", "mid", "band", 14, 500).select("p_partkey", "band", "outside")


def _cust_supp(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.floor("c_acctbal") + 1000).cast("bigint").alias("x"), (F.col("c_custkey") * 37 % 1000).alias("y"))
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.floor("s_acctbal") + 1000).cast("bigint").alias("x"), (F.col("s_suppkey") * 53 % 1000).alias("y"))
    return c, s


_CS = """c AS (SELECT c_custkey, c_nationkey AS nation, CAST(floor(c_acctbal) AS BIGINT) + 1000 AS x, c_custkey * 37 % 1000 AS y FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS nation, CAST(floor(s_acctbal) AS BIGINT) + 1000 AS x, s_suppkey * 53 % 1000 AS y FROM supplier)"""


@query("jn_08_nearest_join", f"""WITH {_CS}, p AS (SELECT c_custkey, s_suppkey, 100 * abs(c.x - s.x) + 18 * abs(c.y - s.y) AS cost FROM c JOIN s USING (nation)),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY cost, s_suppkey) AS rk FROM p)
SELECT c_custkey, s_suppkey, cost, round(least(0.49::DOUBLE, greatest(0.10::DOUBLE, 0.49::DOUBLE * exp(-4 * (cost / 100.0::DOUBLE / 11000)))), 6) AS confidence FROM r WHERE rk = 1""")
def jn_08(spark, d):
    c, s = _cust_supp(spark, d)
    return J.nearest_join(c, s, ["nation"], "c_custkey", "s_suppkey", "x", "y", 10, F.lit(11000)).select("c_custkey", "s_suppkey", "cost", "confidence")


@query("jn_09_nearest_span", f"""WITH {_CS}, p AS (SELECT c_custkey, s_suppkey, s.x AS tm, row_number() OVER (PARTITION BY c_custkey ORDER BY 100 * abs(c.x - 400 - s.x) + 18 * abs(c.y - s.y), s_suppkey) AS a,
 row_number() OVER (PARTITION BY c_custkey ORDER BY 100 * abs(c.x + 400 - s.x) + 18 * abs(c.y - s.y), s_suppkey) AS b FROM c JOIN s USING (nation)),
j AS (SELECT a.c_custkey, a.s_suppkey AS sa, a.tm AS ta, b.s_suppkey AS sb, b.tm AS tb FROM p a JOIN p b ON a.c_custkey = b.c_custkey AND a.a = 1 AND b.b = 1)
SELECT c_custkey, CASE WHEN tb < ta THEN sb ELSE sa END AS start_id, CASE WHEN tb < ta THEN sa ELSE sb END AS end_id, least(ta, tb) AS start_time, greatest(ta, tb) AS end_time FROM j""")
def jn_09(spark, d):
    c, s = _cust_supp(spark, d)
    c = c.withColumns({"x0": F.col("x") - 400, "x1": F.col("x") + 400})
    return J.nearest_span(c, s, ["nation"], "c_custkey", "s_suppkey", "x0", "x1", "y", "x", "y", "x", 10).drop("nation")


@query("jn_10_asof_backward", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'click')
SELECT l.event_id, r.event_id AS click_id, r.cents AS click_cents FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us""")
def jn_10(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "cents", "event_type")
    return J.asof_backward(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"], "us", "us",
                           {"event_id": "click_id", "cents": "click_cents"}, ["event_id"], DAY).select("event_id", "click_id", "click_cents")


@query("jn_11_asof_forward", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'error'), r AS (SELECT * FROM ev WHERE event_type = 'purchase')
SELECT l.event_id, r.event_id AS purchase_id, coalesce(r.us, l.us) AS at_us, CASE WHEN r.us IS NULL THEN 'own_offset' ELSE 'next_event' END AS time_source
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us <= r.us""")
def jn_11(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    out = J.asof_forward(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id"], "us", "us",
                         {"event_id": "purchase_id", "us": "next_us"}, ["event_id"], DAY)
    return out.select("event_id", "purchase_id", F.coalesce("next_us", "us").alias("at_us"),
                      F.when(F.col("next_us").isNull(), "own_offset").otherwise("next_event").alias("time_source"))


@query("jn_12_prefer_join", f"""WITH {LI}, {OD}, l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, l_suppkey AS g, CASE WHEN qty > 5 THEN l_returnflag END AS staff, CAST(l_linenumber % 5 AS BIGINT) AS meas, day FROM li),
r AS (SELECT o_orderkey, o_custkey % 100 AS g, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS staff, o_orderkey % 5 AS meas, day FROM od),
c AS (SELECT l.*, r.o_orderkey, abs(l.day - r.day) AS gap, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, l.day ORDER BY
 CASE WHEN l.staff IS NULL OR l.staff = r.staff THEN 0 ELSE 1 END, CASE WHEN l.meas = r.meas THEN 0 ELSE 1 END, abs(l.day - r.day), r.o_orderkey) AS rk FROM l JOIN r ON l.g = r.g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, day, o_orderkey, gap FROM c WHERE rk = 1""")
def jn_12(spark, d):
    l = lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "day", F.col("l_suppkey").alias("g"),
                               F.when(F.col("qty") > 5, F.col("l_returnflag")).alias("staff"), (F.col("l_linenumber") % 5).cast("bigint").alias("meas"))
    staff = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    r = orders(spark, d).select("o_orderkey", (F.col("o_custkey") % 100).alias("g"), staff.alias("staff"), (F.col("o_orderkey") % 5).alias("meas"), "day")
    out = J.prefer_join(l, r, ["g"], ["staff", "meas"], "day", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "day"], "o_orderkey", 365).where("near is not null")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "day", F.col("near.id").alias("o_orderkey"), F.col("near.gap").alias("gap"))


@query("jn_13_lookup_one", f"""WITH {LI}, {OD}, r AS (SELECT l_orderkey, day, count(*) AS n, min(l_partkey) AS pk FROM li GROUP BY 1, 2)
SELECT o_orderkey, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN pk END AS l_partkey FROM od LEFT JOIN r ON r.l_orderkey = o_orderkey AND r.day = od.day + o_orderkey % 60""")
def jn_13(spark, d):
    o = orders(spark, d).select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (F.col("day") + F.col("o_orderkey") % 60).alias("day"))
    return J.lookup_one(o, lines(spark, d).select("l_orderkey", "day", "l_partkey"), ["l_orderkey", "day"], ["l_partkey"]).select("o_orderkey", "matches", "l_partkey")


@query("jn_13_lookup_one_near", f"""WITH {LI}, {OD} SELECT o_orderkey, count(l_orderkey) AS matches, CASE WHEN count(l_orderkey) = 1 THEN min(l_partkey) END AS l_partkey
FROM od LEFT JOIN li ON l_orderkey = o_orderkey AND abs(li.day - (od.day + o_orderkey % 60)) <= 3 GROUP BY o_orderkey""")
def jn_13b(spark, d):
    o = orders(spark, d).select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (F.col("day") + F.col("o_orderkey") % 60).alias("day"))
    return J.lookup_one_near(o, lines(spark, d).select("l_orderkey", "day", "l_partkey"), ["l_orderkey"], "day", "l_partkey", 3).select("o_orderkey", "matches", "l_partkey")


@query("jn_14_scope_join", """WITH s AS (SELECT s_suppkey, concat('p', s_nationkey) AS page_id, CAST(s_nationkey AS INTEGER) AS scan_page, CAST(s_suppkey % 6 AS INTEGER) AS scan_system FROM supplier),
o AS (SELECT concat('p', n_nationkey) AS page_id, CAST(n_regionkey AS INTEGER) AS scan_system, n_regionkey AS reg FROM nation)
SELECT s_suppkey, CASE WHEN reg = 0 OR (reg IS NULL AND s.scan_system NOT BETWEEN 1 AND 3) THEN 'outside_bpsd_scope' ELSE 'in_bpsd_scope' END AS movement_scope_status,
 CASE WHEN reg = 0 THEN 'xml_missing' WHEN reg = 1 THEN 'merged' WHEN reg IS NOT NULL THEN 'direct' WHEN s.scan_system BETWEEN 1 AND 3 THEN 'direct' ELSE 'xml_missing' END AS page_mapping_status,
 CASE WHEN reg = 0 THEN NULL WHEN reg IS NOT NULL THEN 7 WHEN s.scan_system BETWEEN 1 AND 3 THEN s.scan_page END AS xml_page,
 CASE WHEN reg = 0 THEN '' WHEN reg IS NOT NULL THEN '1,2' WHEN s.scan_system BETWEEN 1 AND 3 THEN CAST(s.scan_system AS VARCHAR) ELSE '' END AS xml_systems,
 CASE WHEN reg IS NOT NULL THEN 'scope_override' WHEN s.scan_system BETWEEN 1 AND 3 THEN 'page_and_system_identity' ELSE 'scan_system_beyond_xml_scope' END AS mapping_source,
 CASE WHEN reg = 1 OR reg = 4 THEN 'needs_review' ELSE 'not_required' END AS review_status
FROM s LEFT JOIN o USING (page_id, scan_system)""")
def jn_14(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("p"), "s_nationkey").alias("page_id"), F.col("s_nationkey").alias("scan_page"),
                                       (F.col("s_suppkey") % 6).cast("int").alias("scan_system"), F.lit(3).alias("xml_system_count"))
    reg = F.col("n_regionkey")
    o = t(spark, d, "nation").select(
        F.concat(F.lit("p"), "n_nationkey").alias("page_id"), reg.cast("int").alias("scan_system"), F.lit(7).alias("xml_page"), F.array(F.lit(1), F.lit(2)).alias("xml_systems"),
        F.when(reg == 1, "merged").when(reg.isin(2, 3), "direct").alias("mapping_status"), F.when(reg == 0, "outside_bpsd_scope").alias("movement_scope_status"))
    out = J.scope_join(s, o)
    return out.select("s_suppkey", "movement_scope_status", "page_mapping_status", "xml_page", F.array_join("xml_systems", ",").alias("xml_systems"), "mapping_source", "review_status")


@query("jn_15_dim_join", f"""WITH {LI} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, day, qty, o_orderstatus, o_orderkey IS NULL AS missing_l_orderkey, p_brand FROM li
LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def jn_15(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = J.dim_join(J.dim_join(lines(spark, d), o, ["l_orderkey"], ["o_orderstatus"], required=True), p, ["l_partkey"], ["p_brand"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "day", "qty", "o_orderstatus", "missing_l_orderkey", "p_brand")


@query("jn_16_exclude", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_16(spark, d):
    return J.exclude(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), ["doc_id"])


@query("jn_16_require", """WITH w AS (SELECT doc_id * 2 AS doc_id FROM labels) SELECT doc_id, 'present' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM w)
UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM w WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def jn_16b(spark, d):
    w = t(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    ok, unknown = J.require(t(spark, d, "documents").select("doc_id"), w, ["doc_id"])
    return ok.withColumn("state", F.lit("present")).unionByName(unknown.withColumn("state", F.lit("unknown")))


@query("jn_17_snap_points", """WITH e AS (SELECT vec_id, label, CAST(floor((embedding[1] + 1) * 500) AS BIGINT) AS x, CAST(floor((embedding[2] + 1) * 500) AS BIGINT) AS y FROM embeddings),
p AS (SELECT a.vec_id AS click_id, b.vec_id AS cand_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM e a JOIN e b ON a.label % 2 <> b.label % 2 AND a.label % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY d2, cand_id) AS rk FROM p)
SELECT click_id, CASE WHEN sqrt(d2) <= 8 THEN cand_id END AS cand_id, d2 AS distance2 FROM r WHERE rk = 1""")
def jn_17(spark, d):
    # single precision throughout: a literal without a type would make the vector's entries doubles
    at = lambda i: F.floor((F.get("embedding", F.lit(i)) + F.lit(1).cast("float")) * F.lit(500).cast("float")).cast("bigint")
    e = t(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("side"), F.lit(0).alias("block"), at(0).alias("x"), at(1).alias("y"))
    a = e.where("side = 0").withColumnRenamed("vec_id", "click_id")
    b = e.where("side <> 0").withColumnRenamed("vec_id", "cand_id")
    return J.snap_points(a, b, ["block"], "click_id", "cand_id", "x", "y", 8.0).drop("block")
