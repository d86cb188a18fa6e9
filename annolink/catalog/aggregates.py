"""AG and SET queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import quality as Q
from ..operators import reconcile as R
from ..operators.scan import cell_of
from ..sources.sinks import run_report
from ..streaming import attempts as AT
from ..streaming import incremental as I
from .base import DAY, EV, LI, OD, events, lines, orders, query, t

def day_cells():
    return [cell_of("us", DAY)]



@query("ag_01_count_by", """SELECT l_returnflag, l_linestatus, CASE WHEN GROUPING(l_returnflag) = 0 AND GROUPING(l_linestatus) = 0 THEN 'l_returnflag*l_linestatus' WHEN GROUPING(l_returnflag) = 0 THEN 'l_returnflag'
 WHEN GROUPING(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS "grouping", count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())""")
def ag_01(spark, d):
    return A.count_by(t(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"], [])


@query("ag_02_class_pivot", """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error,
 count(*) FILTER (event_type IN ('click','view','error')) AS total FROM events GROUP BY user_id""")
def ag_02(spark, d):
    return A.class_pivot(t(spark, d, "events"), "user_id", "event_type", ["click", "view", "error"])


@query("ag_03_score_inventory", """WITH n AS (SELECT user_id AS score_id, count(*) FILTER (event_type = 'click') AS measures, count(*) FILTER (event_type = 'view' AND value > 20) + 1 AS xml_pages,
 count(*) FILTER (event_type = 'error') AS repeats, 0::BIGINT AS endings, count(*) FILTER (event_type = 'purchase') AS notes FROM events GROUP BY 1),
p AS (SELECT o_custkey AS score_id, count(*) AS images, count(*) FILTER (o_orderstatus <> 'P') AS labels FROM orders GROUP BY 1)
SELECT score_id, measures, xml_pages, repeats, endings, notes, images, labels, CASE WHEN xml_pages = images AND images = labels THEN 'direct' ELSE 'needs_alignment' END AS mapping_status FROM n FULL JOIN p USING (score_id)""")
def ag_03(spark, d):
    et = F.col("event_type")
    tag = F.when(et == "click", "measure").when(et == "view", "print").when(et == "error", "repeat").when(et == "purchase", "note").otherwise("other")
    n = t(spark, d, "events").select(F.col("user_id").alias("score_id"), tag.alias("tag"), F.create_map(F.lit("new-page"), F.when(F.col("value") > 20, "yes").otherwise("no")).alias("attributes"))
    p = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("score_id")).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("o_orderstatus") != "P").alias("labels"))
    return A.score_inventory(n, p)


@query("ag_04_page_manifest", """WITH l AS (SELECT l_suppkey AS page_id, count(*) FILTER (l_discount > 0 OR l_suppkey % 3 > 0) AS label_rows, count(*) FILTER (NOT (l_discount > 0 OR l_suppkey % 3 > 0)) AS invalid_rows FROM lineitem GROUP BY 1),
i AS (SELECT s_suppkey + 3 AS page_id, s_nationkey AS length FROM supplier)
SELECT page_id, coalesce(label_rows, 0) AS label_rows, coalesce(invalid_rows, 0) AS invalid_rows, length, CASE WHEN length IS NULL THEN 'missing_image' WHEN coalesce(label_rows + invalid_rows, 0) = 0 THEN 'missing_labels'
 WHEN invalid_rows > 0 THEN 'invalid_labels' ELSE 'ready' END AS readiness FROM l FULL JOIN i USING (page_id)""")
def ag_04(spark, d):
    l = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_returnflag").alias("class"), ((F.col("l_discount") > 0) | (F.col("l_suppkey") % 3 > 0)).alias("valid"))
    return A.page_manifest(l, t(spark, d, "supplier").select((F.col("s_suppkey") + 3).alias("page_id"), F.col("s_nationkey").alias("length")))


@query("ag_04_page_classes", """SELECT page_id, string_agg(concat(c, '=', n), ',' ORDER BY c) AS class_counts FROM (SELECT l_suppkey AS page_id, l_returnflag AS c, count(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2) GROUP BY page_id""")
def ag_04b(spark, d):
    l = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_returnflag").alias("class"), (F.col("l_discount") > 0).alias("valid"))
    m = A.page_classes(l)
    return m.select("page_id", F.array_join(F.transform(F.map_entries("class_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("class_counts"))


_COV = """e AS (SELECT DISTINCT c_nationkey, c_custkey FROM customer), u AS (SELECT DISTINCT CAST(o_custkey % 25 AS INTEGER) AS nk, o_custkey FROM orders WHERE o_orderstatus = 'P'),
j AS (SELECT coalesce(c_nationkey, nk) AS c_nationkey, coalesce(c_custkey, o_custkey) AS c_custkey, c_custkey IS NOT NULL AS e, o_custkey IS NOT NULL AS u FROM e FULL JOIN u ON nk = c_nationkey AND o_custkey = c_custkey)"""


def _coverage(spark, d):
    u = t(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 25).cast("int").alias("c_nationkey"), F.col("o_custkey").alias("c_custkey"))
    return A.coverage(t(spark, d, "customer"), u, "c_custkey", "c_nationkey")


@query("ag_05_coverage", f"""WITH {_COV} SELECT c_nationkey, CASE WHEN GROUPING(c_nationkey) = 0 THEN 'group' ELSE 'total' END AS scope, count(*) FILTER (e) AS expected, count(*) FILTER (e AND u) AS referenced,
 CASE WHEN count(*) FILTER (e) = 0 THEN 1.0::DOUBLE ELSE round(CAST(count(*) FILTER (e AND u) AS DOUBLE) / greatest(count(*) FILTER (e), 1), 6) END AS coverage FROM j GROUP BY GROUPING SETS ((c_nationkey), ())""")
def ag_05(spark, d):
    return _coverage(spark, d)[0]


@query("ag_05_coverage_issues", f"""WITH {_COV} SELECT c_nationkey, c_custkey, CASE WHEN e THEN 'unreferenced' ELSE 'unknown_reference' END AS issue FROM j WHERE NOT (e AND u)""")
def ag_05b(spark, d):
    return _coverage(spark, d)[1]


_ACC = """x AS (SELECT lang AS class, n_chars % 7 = 0 AS rej, CASE WHEN n_chars % 5 = 0 THEN '' ELSE CAST(quality AS VARCHAR) END AS es, CAST(CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS VARCHAR) AS ms,
 CAST(toxic AS VARCHAR) AS et, CASE WHEN length(text) % 2 = 0 THEN '0' ELSE '1' END AS mt FROM documents JOIN labels USING (doc_id)),
f AS (SELECT class, 'staff' AS field, rej OR es <> '' AS el, es = ms AS ok FROM x UNION ALL SELECT class, 'start_meas', TRUE, et = mt FROM x
UNION ALL SELECT class, 'exact_row', TRUE, (NOT (rej OR es <> '') OR es = ms) AND et = mt FROM x)"""


def _acc_items(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return x.select(
        "doc_id", F.col("lang").alias("class"), F.when(F.col("n_chars") % 7 == 0, "reject").otherwise("correct").alias("action"),
        F.when(F.col("n_chars") % 5 == 0, "NA").otherwise(F.col("quality").cast("string")).alias("expected_staff"), F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("machine_staff"),
        F.col("toxic").cast("string").alias("expected_start_meas"), F.when(F.length("text") % 2 == 0, "0.0004").otherwise("1.0").alias("machine_start_meas"))


@query("ag_06_accuracy", f"""WITH {_ACC} SELECT CASE WHEN GROUPING(class) = 0 THEN 'class' ELSE 'overall' END AS scope, class, field, count(*) AS evaluated, count(*) FILTER (ok) AS correct,
 round(CAST(count(*) FILTER (ok) AS DOUBLE) / count(*), 6) AS accuracy FROM f WHERE el GROUP BY GROUPING SETS ((class, field), (field))""")
def ag_06(spark, d):
    return A.accuracy(_acc_items(spark, d), ["staff", "start_meas"], ["doc_id"])


@query("ag_07_evaluate", """WITH j AS (SELECT l.doc_id, d.doc_id IS NULL AS miss, CASE l.quality WHEN 1 THEN 'en' ELSE '' END AS tc, d.lang AS pc, CAST(l.toxic AS VARCHAR) AS e, CAST(d.n_chars % 2 AS VARCHAR) AS m
 FROM labels l LEFT JOIN (SELECT * FROM documents WHERE source <> 'src1') d USING (doc_id))
SELECT 'missing' AS kind, CAST(doc_id AS VARCHAR) AS item, 1::BIGINT AS n FROM j WHERE miss UNION ALL SELECT 'mismatch', CAST(doc_id AS VARCHAR), 1 FROM j WHERE NOT miss AND tc <> '' AND tc <> pc
UNION ALL SELECT 'correct', CASE WHEN tc <> '' THEN tc ELSE pc END, count(*) FILTER (e = m) FROM j WHERE NOT miss GROUP BY 2""")
def ag_07(spark, d):
    truth = t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("").alias("class"), F.col("toxic").cast("string").alias("expected_staff"))
    pred = t(spark, d, "documents").where("source <> 'src1'").select("doc_id", F.col("lang").alias("class"), (F.col("n_chars") % 2).cast("string").alias("staff"))
    rep, miss, mm = A.evaluate(truth, pred, ["doc_id"], ["staff"])
    one = F.lit(1).cast("bigint").alias("n")
    a = miss.select(F.lit("missing").alias("kind"), F.col("doc_id").cast("string").alias("item"), one)
    b = mm.select(F.lit("mismatch").alias("kind"), F.col("doc_id").cast("string").alias("item"), one)
    c = rep.where("scope = 'class' and field = 'staff'").select(F.lit("correct").alias("kind"), F.col("class").alias("item"), F.col("correct").alias("n"))
    return a.unionByName(b).unionByName(c)


@query("ag_08_sweep", f"""WITH {LI}, p(profile, lo, accept) AS (VALUES ('strict', 0.5, 0.9), ('loose', 0.1, 0.6), ('open', 0.0, 0.0)),
x AS (SELECT profile, qty / 50.0::DOUBLE >= lo AND l_returnflag <> 'R' AS kept, qty / 50.0::DOUBLE >= accept AS acc, l_linenumber = disc OR l_linenumber + 1 = disc AS hit FROM li, p)
SELECT profile, count(*) AS evaluated, count(*) FILTER (kept AND hit) AS exact, count(*) FILTER (kept AND NOT hit) AS wrong, count(*) FILTER (NOT kept) AS unresolved,
 count(*) FILTER (kept AND acc) AS auto_accepted, count(*) FILTER (kept AND acc AND hit) AS auto_exact, count(*) FILTER (kept AND acc AND NOT hit) AS auto_wrong FROM x GROUP BY profile""")
def ag_08(spark, d):
    none = F.array().cast("array<bigint>")
    li = lines(spark, d).select(
        F.when(F.col("l_returnflag") == "R", none).otherwise(F.array(F.col("l_linenumber").cast("bigint"), (F.col("l_linenumber") + 1).cast("bigint"))).alias("pred"), (F.col("qty") / 50.0).alias("conf"), F.array("disc").alias("truth"))
    return A.sweep(li, [{"name": "strict", "min_confidence": 0.5, "accept": 0.9}, {"name": "loose", "min_confidence": 0.1, "accept": 0.6}, {"name": "open", "min_confidence": 0, "accept": 0}], "pred", "conf", "truth")


_MAN = f"""{LI}, m AS (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'ambiguous' ELSE 'candidate' END AS st, qty / 100.0::DOUBLE AS conf,
 ((l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey) * 10 + l_linenumber) * 100 + qty AS bbox_id FROM li)"""


def _manual(spark, d):
    return lines(spark, d).select(
        "l_orderkey", (((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")) * 100 + F.col("qty")).alias("bbox_id"), F.col("l_returnflag").alias("class"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "ambiguous").otherwise("candidate").alias("source_status"), (F.col("qty") / 100.0).alias("confidence"))


@query("ag_09_manual_groups", f"""WITH {_MAN}, g AS (SELECT l_orderkey, count(*) AS group_size, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS classes, min(conf) AS min_confidence, max(conf) AS max_confidence,
 CASE WHEN bool_or(st = 'ambiguous') THEN 'P1_ambiguous' ELSE 'P2_candidate' END AS priority_tier FROM m GROUP BY l_orderkey)
SELECT *, row_number() OVER (ORDER BY priority_tier, min_confidence, l_orderkey) AS group_rank, printf('G%05d', row_number() OVER (ORDER BY priority_tier, min_confidence, l_orderkey)) AS group_id FROM g""")
def ag_09(spark, d):
    return A.manual_groups(_manual(spark, d), ["l_orderkey"]).withColumn("classes", F.array_join("classes", ",")).drop("statuses")


@query("ag_09_group_members", f"""WITH {_MAN}, g AS (SELECT l_orderkey, printf('G%05d', row_number() OVER (ORDER BY CASE WHEN bool_or(st = 'ambiguous') THEN 0 ELSE 1 END, min(conf), l_orderkey)) AS group_id FROM m GROUP BY l_orderkey)
SELECT l_orderkey, bbox_id, group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE st WHEN 'ambiguous' THEN 0 ELSE 1 END, conf, bbox_id) AS group_member_index FROM m JOIN g USING (l_orderkey)""")
def ag_09b(spark, d):
    m = _manual(spark, d)
    g = A.manual_groups(m, ["l_orderkey"])
    return A.group_members(m, g, ["l_orderkey"], cells=[F.col("__a"), F.col("__c")]).select("l_orderkey", "bbox_id", "group_id", "group_member_index")


@query("ag_10_batches", f"""WITH {_MAN}, q AS (SELECT *, l_orderkey // 100 AS batch_id, bbox_id AS queue_rank FROM m),
b AS (SELECT batch_id, count(*) AS rows, count(*) FILTER (st = 'ambiguous') AS ambiguous, count(*) FILTER (st = 'candidate') AS candidate, min(conf) AS min_confidence, max(conf) AS max_confidence, min(queue_rank) AS best_rank FROM q GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY best_rank, batch_id) AS batch_rank FROM b""")
def ag_10(spark, d):
    q = _manual(spark, d).withColumns({"batch_id": F.floor(F.col("l_orderkey") / 100), "queue_rank": F.col("bbox_id")})
    return A.batches(q)


@query("ag_11_take_next_n", f"""WITH {EV}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM ev),
m AS (SELECT * FROM s WHERE cents % 10 = 0 AND rn + 2 <= c)
SELECT m.user_id, m.event_type, m.event_id AS start_id, CAST(s.rn - m.rn AS INTEGER) AS member_index, s.event_id AS member_id FROM m JOIN s ON s.user_id = m.user_id AND s.event_type = m.event_type AND s.rn BETWEEN m.rn AND m.rn + 2""")
def ag_11(spark, d):
    e = events(spark, d).withColumn("n", F.lit(3).cast("bigint"))
    return A.take_next_n(e, ["user_id", "event_type"], ["us", "event_id"], "n", F.col("cents") % 10 == 0, "event_id", day_cells())[0]


@query("ag_12_collect_members", f"""WITH {LI} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, cents) AS member_index, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS members FROM li""")
def ag_12(spark, d):
    li = lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents")
    return A.collect_members(li, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "cents"], "l_partkey", [cell_of("l_partkey", 10_000)])


@query("ag_13_group_assets", """SELECT source, count(*) AS rows, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels FROM documents GROUP BY source""")
def ag_13(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    return A.group_assets(docs, "source", ["doc_id"], "doc_id", "lang")[0].withColumn("labels", F.array_join("labels", ","))


@query("ag_14_page_model", """WITH a AS (SELECT DISTINCT source AS page_id, lang FROM documents), n AS (SELECT source AS page_id, count(*) AS c FROM documents WHERE n_chars % 3 > 0 GROUP BY 1)
SELECT a.page_id, concat(a.page_id, '.png') AS review_overlay, string_agg(concat(lang, '=', lang, '.png'), ',' ORDER BY lang) AS classes, coalesce(max(c), 0) AS needs_review FROM a LEFT JOIN n USING (page_id) GROUP BY a.page_id""")
def ag_14(spark, d):
    docs = t(spark, d, "documents").select("source", "lang", "n_chars")
    c = docs.select(F.concat(F.lit("class_"), "source", F.lit("__"), "lang", F.lit("_overlay")).alias("name"), F.concat("lang", F.lit(".png")).alias("path")).distinct()
    r = docs.select(F.concat("source", F.lit("__review_overlay")).alias("name"), F.concat("source", F.lit(".png")).alias("path")).distinct()
    rows = docs.select(F.col("source").alias("page_id"), F.when(F.col("n_chars") % 3 == 0, "matched").otherwise("review").alias("status"))
    m = A.page_model(c.unionByName(r), rows)
    return m.withColumn("classes", F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("ag_15_batch_summary", f"""WITH {OD}, r AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS n, bool_or(cents % 997 = 0) AS bad FROM od GROUP BY 1), j AS (SELECT c_custkey, n, bad FROM customer LEFT JOIN r ON o_custkey = c_custkey),
s AS (SELECT CASE WHEN bad THEN 'failed' WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'completed' END AS status, n FROM j)
SELECT status, count(*) AS units, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows FROM s GROUP BY status""")
def ag_15(spark, d):
    r = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") != "P").alias("rows"), F.bool_or(F.col("cents") % 997 == 0).alias("bad"))
    return A.batch_summary(t(spark, d, "customer"), r.select("c_custkey", "rows", F.when(F.col("bad"), "bad total").alias("error")), "c_custkey")


@query("set_01_tagged_union", """SELECT 'order' AS source_record_type, o_orderkey, o_orderstatus, NULL::BIGINT AS event_id, NULL AS event_type FROM orders UNION ALL SELECT 'event', NULL, NULL, event_id, event_type FROM events""")
def set_01(spark, d):
    return R.tagged_union({"order": t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "event": t(spark, d, "events").select("event_id", "event_type")})


@query("set_02_build_links", f"""WITH {EV}, n AS (SELECT event_id, user_id, event_type, cents % 60 AS note_id, us // {DAY} AS page, cents % 2 AS staff, us // 1000000000 AS tk FROM ev WHERE event_type IN ('click','view')),
b AS (SELECT event_id AS bbox_id, user_id, cents % 60 AS note_id, us // {DAY} AS page, cents % 3 AS staff, us // 1000000000 AS tk FROM ev WHERE event_type = 'purchase'),
c AS (SELECT b.bbox_id, n.event_id, row_number() OVER (PARTITION BY b.bbox_id ORDER BY CASE WHEN n.page = b.page THEN 0 ELSE 1 END, CASE WHEN n.event_type = 'click' THEN 0 ELSE 3 END, CASE WHEN n.staff = b.staff THEN 0 ELSE 1 END,
 abs(n.tk - b.tk), n.event_id) AS rk FROM b JOIN n ON n.user_id = b.user_id AND n.note_id = b.note_id)
SELECT bbox_id, lpad(CAST(event_id AS VARCHAR), 9, '0') AS xml_event_id, 'target_note' AS relation_type, 'bps_note_anchor' AS link_method, TRUE AS is_primary FROM c WHERE rk = 1""")
def set_02(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", (F.col("cents") % 60).alias("note_id"), F.floor(F.col("us") / DAY).alias("page"), "cents", (F.floor(F.col("us") / 1_000_000_000) / 1000.0).alias("m"))
    none = lambda c, ty: F.lit(None).cast(ty).alias(c)
    boxes = e.where("event_type = 'purchase'").select(
        F.col("user_id").alias("score_id"), F.col("event_id").alias("bbox_id"), F.lit("fingering1").alias("class"), F.lit("candidate").alias("alignment_status"), F.lit("false").alias("human_approved"),
        F.lit("note").alias("target_type"), F.concat(F.lit("["), "note_id", F.lit("]")).alias("note_ids"), F.lit("NA").alias("connected_note"), none("start_note", "bigint"), none("end_note", "bigint"),
        (F.col("cents") % 3).cast("string").alias("staff"), F.col("page").alias("xml_page"), F.lit("").alias("xml_measure"), F.lit("NA").alias("xml_symbol"), F.col("m").alias("start_meas"), F.lit("0.5").alias("confidence"), F.lit("").alias("review_status"))
    n = e.where("event_type in ('click','view')").withColumn("xid", F.lpad(F.col("event_id").cast("string"), 9, "0"))
    evs = n.select(F.col("user_id").alias("score_id"), F.col("xid").alias("xml_event_id"), F.col("event_id").alias("ord"), F.lit("note").alias("event_type"), F.lit("note").alias("event_subtype"), F.lit("note").alias("class"), "page",
                   (F.col("cents") % 2).alias("staff"), F.lit("1").alias("xml_measure"), F.col("m").alias("start_meas"), none("dynamic", "string"), none("marker", "string"), F.array().cast("array<string>").alias("anchors"))
    occ = n.select(F.col("user_id").alias("score_id"), F.col("xid").alias("xml_event_id"), "note_id", F.col("m").alias("start_meas"), F.when(F.col("event_type") == "click", "exact").otherwise("unmatched").alias("note_match_status"))
    return R.build_links(boxes, evs, occ).select("bbox_id", "xml_event_id", "relation_type", "link_method", "is_primary")


@query("ag_15_isolated_units", """WITH b AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey IN (20, 77)), u AS (SELECT c_nationkey, count(*) AS n, c_nationkey IN (SELECT c_nationkey FROM b) AS bad FROM customer GROUP BY 1)
SELECT CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, count(*) AS units, CAST(sum(CASE WHEN bad THEN 0 ELSE n END) AS BIGINT) AS rows, CAST(sum(CASE WHEN bad THEN 0 ELSE n END) AS BIGINT) AS stored FROM u GROUP BY bad""")
def ag_15_units(spark, d):
    src = t(spark, d, "customer").select(F.col("c_nationkey").alias("unit_id"), "c_custkey", "c_acctbal")
    out = AT.scratch(spark)
    todo = I.pending(I.unit_digest(src, ["unit_id"], ["c_custkey", "c_acctbal"]), spark.createDataFrame([], "unit_id int, digest string, version string, status string, row_count bigint"))
    bad = F.when(F.col("c_custkey").isin(20, 77), F.raise_error(F.concat(F.lit("unreadable row "), "c_custkey")).cast("double")).otherwise(F.col("c_acctbal"))
    AT.run_units(todo, src, lambda df: df.withColumn("c_acctbal", bad), f"{out}/rows", f"{out}/ledger", "")
    ledger = spark.read.parquet(f"{out}/ledger")
    found = AT.committed(spark, f"{out}/rows", f"{out}/ledger").groupBy("unit_id").agg(F.count(F.lit(1)).alias("stored"))
    state = AT.last_entries(ledger).join(found, "unit_id", "left")
    counts = A.batch_summary(src.select("unit_id").distinct(), AT.unit_results(ledger), "unit_id")
    return counts.join(state.groupBy("status").agg(F.sum(F.coalesce("stored", F.lit(0))).alias("stored")), "status")


@query("set_03_combine_lossless", """WITH l AS (SELECT o_custkey AS bbox_id, o_orderkey AS eid FROM orders WHERE o_orderstatus <> 'F'), p AS (SELECT bbox_id, count(*) AS n, min(eid) AS f FROM l GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'yolo' AS row_origin, CASE WHEN n > 0 AND c_nationkey % 3 = 0 THEN 'aligned' WHEN n > 0 AND c_nationkey % 3 = 1 THEN 'candidate' WHEN n > 0 THEN 'xml_missing' WHEN c_nationkey % 3 = 2 THEN 'yolo_only' ELSE 'unresolved' END AS combined_status,
 coalesce(n, 0) AS event_count, CAST(f AS VARCHAR) AS primary_event FROM customer LEFT JOIN p ON bbox_id = c_custkey
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'xml', 'xml_only', 1, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT eid FROM l)""")
def set_03(spark, d):
    s = F.col("c_nationkey") % 3
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("bbox_id"), F.when(s == 0, "matched").when(s == 1, "candidate").otherwise("xml_missing").alias("alignment_status"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("xml_event_id"), F.col("o_custkey").alias("bbox_id"), "o_orderstatus", F.lit(False).alias("is_primary"))
    return R.combine_lossless(b, o, o.where("o_orderstatus <> 'F'"))


@query("set_03_combined_rows", """WITH e AS (SELECT o_orderkey AS xml_event_id, o_custkey AS bbox_id, o_orderpriority AS class, o_orderstatus AS event_type, o_custkey % 7 = 0 AS linked, o_orderkey % 5 = 0 AS is_primary,
  to_json({'xml_event_id': o_orderkey, 'class': o_orderpriority, 'event_type': o_orderstatus, 'page': o_custkey % 9}) AS js, o_custkey % 9 AS page FROM orders),
p AS (SELECT bbox_id, count(*) AS n, string_agg(CAST(xml_event_id AS VARCHAR), ',' ORDER BY NOT is_primary, xml_event_id) AS ids, string_agg(CAST(js AS VARCHAR), ',' ORDER BY NOT is_primary, xml_event_id) AS events,
  first(xml_event_id ORDER BY NOT is_primary, xml_event_id) AS fi, first(page ORDER BY NOT is_primary, xml_event_id) AS fp FROM e WHERE NOT linked GROUP BY 1),
b AS (SELECT c_custkey AS bbox_id, c_mktsegment AS class, c_nationkey AS hint, CASE c_nationkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'candidate' ELSE 'xml_missing' END AS st FROM customer)
SELECT CAST(b.bbox_id AS VARCHAR) AS record_id, 'yolo' AS row_origin, CASE WHEN n > 0 AND st = 'matched' THEN 'aligned' WHEN n > 0 THEN st WHEN st = 'xml_missing' THEN 'yolo_only' ELSE 'unresolved' END AS combined_status, st AS source_alignment_status,
 class, hint, coalesce(n, 0) AS event_count, md5(concat('[', coalesce(ids, ''), ']')) AS ids, md5(concat('[', coalesce(events, ''), ']')) AS events, fi AS event_id, fp AS event_page FROM b LEFT JOIN p USING (bbox_id)
UNION ALL SELECT CAST(xml_event_id AS VARCHAR), 'xml', 'xml_only', 'xml_only', class, NULL, 1, md5(concat('[', xml_event_id, ']')), md5(concat('[', CAST(js AS VARCHAR), ']')), xml_event_id, page FROM e WHERE linked""")
def set_03_rows(spark, d):
    s = F.col("c_nationkey") % 3
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("bbox_id"), F.col("c_mktsegment").alias("class"), F.col("c_nationkey").alias("hint"),
                                       F.when(s == 0, "matched").when(s == 1, "candidate").otherwise("xml_missing").alias("alignment_status"))
    o = t(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("xml_event_id"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("event_type"), (F.col("o_custkey") % 9).alias("page"))
    links = o.where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("bbox_id"), F.col("o_orderkey").alias("xml_event_id"), (F.col("o_orderkey") % 5 == 0).alias("is_primary"))
    out = R.combine_rows(b, e, links)
    return out.select("record_id", "row_origin", "combined_status", "source_alignment_status", "class", "hint", F.col("xml_event_count").cast("bigint").alias("event_count"),
                      F.md5("xml_event_ids_json").alias("ids"), F.md5("xml_events_json").alias("events"), F.col("event_xml_event_id").alias("event_id"), "event_page")


@query("set_05_set_checks", """SELECT 'missing_on_the_right' AS rule, CAST(c_custkey AS VARCHAR) AS detail FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT DISTINCT 'missing_on_the_left', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT 'in_both', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'duplicate_key', concat(l_orderkey, '|', l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def set_05(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return Q.expect_same_keys(c, o, ["k"]).unionByName(Q.expect_disjoint(c, s, ["k"])).unionByName(Q.expect_unique(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("set_06_unchanged", """SELECT 'changed_field' AS rule, concat(o_orderkey, ':', concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'o_orderpriority' END, CASE WHEN o_custkey % 10 = 0 THEN 'o_totalprice' END)) AS detail FROM orders WHERE o_orderstatus = 'P' OR o_custkey % 10 = 0""")
def set_06(spark, d):
    o = t(spark, d, "orders")
    new = o.withColumns({"o_orderpriority": F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), "o_totalprice": F.when(F.col("o_custkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return Q.expect_unchanged(o, new, ["o_orderkey"], ["o_orderpriority", "o_totalprice"])


@query("set_07_refs", """WITH p AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT 'dangling_reference' AS rule, concat(event_id, '->', r) AS detail FROM (SELECT event_id, unnest([k, k * 1000]) AS r FROM p) WHERE r NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'invalid_json', CAST(event_id AS VARCHAR) FROM p WHERE k % 10 = 0""")
def set_07(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = t(spark, d, "events").select("event_id", F.array(k, k * 1000).alias("refs"), F.when(k % 10 == 0, F.concat(F.lit("["), "props")).otherwise(F.col("props")).alias("props"))
    return Q.expect_refs(e, ["event_id"], "refs", t(spark, d, "part"), "p_partkey").unionByName(Q.expect_json(e, ["event_id"], "props"))


@query("inc_05_validate_inputs", f"""WITH {LI} SELECT 'bad_geometry' AS rule, concat(l_orderkey, '|', l_partkey) AS detail FROM li WHERE disc = 0 OR tax = 0
UNION ALL SELECT 'unknown_class', concat(l_orderkey, '|', l_partkey) FROM li WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 3)
UNION ALL SELECT 'page_not_positive_integer', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 0 OR s_suppkey % 11 = 0
UNION ALL SELECT 'duplicate_key', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_nationkey > 0 AND s_suppkey % 11 > 0 GROUP BY s_nationkey HAVING count(*) > 1""")
def inc_05(spark, d):
    li = lines(spark, d).select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("class_id"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), (F.col("disc") / 100).alias("w"), (F.col("tax") / 100).alias("h"))
    s = t(spark, d, "supplier")
    edits = s.select(F.col("s_suppkey").alias("stem"), F.when(F.col("s_suppkey") % 11 == 0, "1.5").otherwise(F.col("s_nationkey").cast("string")).alias("page_text"))
    a = Q.validate_boxes(li, ["l_orderkey", "l_partkey"], s.where("s_nationkey > 3").select(F.col("s_suppkey").alias("id")))
    return a.unionByName(Q.validate_mapping(edits, s.select(F.col("s_suppkey").alias("stem"))))


@query("snk_02_run_report", """WITH m AS (SELECT o_orderstatus AS stage, 'rows' AS metric, o_orderpriority AS key, count(*) AS value FROM orders GROUP BY 1, 3), e AS (SELECT o_orderstatus AS stage, 'low' AS rule FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 5000)
SELECT stage, metric, key, value FROM m UNION ALL SELECT stage, 'validation_errors', rule, count(*) FROM e GROUP BY 1, 3 UNION ALL SELECT stage, 'passed', '', CASE WHEN stage IN (SELECT stage FROM e) THEN 0 ELSE 1 END FROM (SELECT DISTINCT stage FROM m)""")
def snk_02(spark, d):
    o = t(spark, d, "orders")
    m = o.groupBy(F.col("o_orderstatus").alias("stage"), F.lit("rows").alias("metric"), F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    e = o.where("o_orderstatus = 'P' and o_totalprice < 5000").select(F.col("o_orderstatus").alias("stage"), F.lit("low").alias("rule"), F.col("o_orderkey").cast("string").alias("detail"))
    return run_report(m, e)
