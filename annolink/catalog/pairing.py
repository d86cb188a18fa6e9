"""PR queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing as P
from ..operators.scan import cell_of, number_rows
from .base import DAY, EV, LI, OD, events, lines, orders, query, t

def day_cells():
    return [cell_of("us", DAY)]

_W = "OVER (PARTITION BY {k} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"


def _lifo_sql(src: str, keys: str) -> str:
    w = _W.format(k=keys)
    return f"""a AS (SELECT *, sum(CASE kind WHEN 'start' THEN 1 ELSE -1 END) {w} AS s FROM {src}),
b AS (SELECT *, least(0, min(s) {w}) AS m FROM a), c AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY {keys} ORDER BY us, event_id), 0) AS pm FROM b),
dd AS (SELECT *, kind = 'stop' AND m < pm AS orphan, s - m + CASE kind WHEN 'stop' THEN 1 ELSE 0 END AS lvl FROM c),
n AS (SELECT *, lead(event_id) OVER (PARTITION BY {keys}, lvl ORDER BY us, event_id) AS nid FROM dd WHERE NOT orphan),
pairs AS (SELECT {keys}, event_id AS start_id, nid AS end_id, CASE WHEN nid IS NULL THEN 'start_without_stop' ELSE 'paired' END AS status FROM n WHERE kind = 'start'
UNION ALL SELECT {keys}, NULL, event_id, 'stop_without_start' FROM dd WHERE orphan)"""


@query("pr_01_pair_lifo", f"""WITH {EV}, src AS (SELECT user_id, us, event_id, CASE event_type WHEN 'signup' THEN 'start' ELSE 'stop' END AS kind FROM ev WHERE event_type IN ('signup','purchase')),
{_lifo_sql('src', 'user_id')} SELECT * FROM pairs""")
def pr_01(spark, d):
    e = events(spark, d).where("event_type in ('signup','purchase')").select(
        "user_id", "us", "event_id", F.when(F.col("event_type") == "signup", "start").otherwise("stop").alias("kind"))
    return P.pair_lifo(e, ["user_id"], ["us", "event_id"], "event_id", cells=day_cells())


@query("pr_02_pair_ties")
def pr_02(spark, d):
    e = events(spark, d).where("event_type in ('signup','purchase','click','view')").select(
        (F.col("user_id") % 7).alias("staff"), (F.col("user_id") % 50).alias("midi"), "us", "event_id", (F.col("user_id") % 3).alias("voice"),
        F.when(F.col("event_type").isin("signup", "click"), "start").otherwise("stop").alias("kind"))
    return P.pair_ties(e, ["staff", "midi"], ["us", "event_id"], "event_id", "voice", cells=day_cells())


@query("pr_03_build_spans", f"""WITH {EV}, m AS (SELECT user_id % 5 AS score_id, us, event_id, user_id % 3 AS voice, user_id % 2 AS staff, us // {DAY} AS page,
 CASE event_type WHEN 'signup' THEN 'slur' WHEN 'purchase' THEN 'slur' WHEN 'click' THEN 'pedal' ELSE 'pedal' END AS knd,
 CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' WHEN 'click' THEN 'start' ELSE 'stop' END AS kind FROM ev WHERE event_type <> 'error'),
src AS (SELECT *, CASE knd WHEN 'slur' THEN voice ELSE staff END AS scope FROM m), {_lifo_sql('src', 'score_id, knd, scope')}
SELECT p.score_id, p.knd AS span_type, p.start_id AS start_xml_event_id, p.end_id AS end_xml_event_id, p.status, CASE WHEN p.status = 'paired' THEN s.page <> e.page END AS cross_page
FROM pairs p LEFT JOIN src s ON s.event_id = p.start_id LEFT JOIN src e ON e.event_id = p.end_id""")
def pr_03(spark, d):
    et = F.col("event_type")
    e = events(spark, d).where("event_type <> 'error'").select(
        (F.col("user_id") % 5).alias("score_id"), F.col("event_id").alias("xml_event_id"), F.col("us").alias("seq"),
        F.when(et.isin("signup", "purchase"), "notation").otherwise("direction").alias("event_type"), F.when(et.isin("signup", "purchase"), "slur").otherwise("pedal").alias("event_subtype"),
        F.lit("x").alias("class"), (F.col("user_id") % 3).alias("voice"), (F.col("user_id") % 2).alias("staff"), F.floor(F.col("us") / DAY).alias("page"), F.lit("1").alias("xml_measure"),
        F.lit(0.0).alias("start_meas"), F.lit(0.0).alias("end_meas"), F.lit(1).alias("start_note"), F.lit(1).alias("end_note"), F.lit(60).alias("midi_pitch"),
        F.create_map(F.lit("type"), F.when(et.isin("signup", "click"), "start").when(et == "purchase", "stop").otherwise("change")).alias("attributes"), F.array().cast("array<bigint>").alias("anchors"))
    return P.build_spans(e, cells=[cell_of("seq", DAY)]).select("score_id", "span_type", "start_xml_event_id", "end_xml_event_id", "status", "cross_page")


@query("pr_04_fingerprints", """WITH x AS (SELECT conv_id, md5(concat(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text), '|', role, ':', text)) AS h FROM conversations)
SELECT conv_id, count(*) AS items, concat(count(*), ':', CAST(sum(CAST(CAST(concat('0x', substr(h, 1, 15)) AS UBIGINT) AS HUGEINT)) AS VARCHAR), ':',
 CAST(sum(CAST(CAST(concat('0x', substr(h, 16, 15)) AS UBIGINT) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM x GROUP BY conv_id""")
def pr_04(spark, d):
    c = t(spark, d, "conversations")
    return P.fingerprints(c, ["conv_id"], ["turn", "role", "text"], F.concat("role", F.lit(":"), "text"), [cell_of("turn", 1000)])


_SEQ = f"""{LI}, sq AS (SELECT l_suppkey, l_returnflag, l_partkey AS token, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day, l_orderkey, l_partkey, l_linenumber, cents) - 1 AS pos FROM li),
sa AS (SELECT l_suppkey, pos, token FROM sq WHERE l_returnflag = 'A'), sb AS (SELECT l_suppkey, pos, token FROM sq WHERE l_returnflag = 'N')"""


def _sequences(spark, d):
    li = lines(spark, d)
    s = number_rows(li, ["l_suppkey", "l_returnflag"], ["day", "l_orderkey", "l_partkey", "l_linenumber", "cents"], "rn", [F.floor(F.col("day") / 30)])
    s = s.select("l_suppkey", "l_returnflag", (F.col("rn") - 1).alias("pos"), F.col("l_partkey").alias("token"))
    return s.where("l_returnflag = 'A'").drop("l_returnflag"), s.where("l_returnflag = 'N'").drop("l_returnflag")


@query("pr_05_match_blocks", f"""WITH {_SEQ}, p AS (SELECT sa.l_suppkey, sa.pos AS pa, sb.pos AS pb, sb.pos - sa.pos AS dg FROM sa JOIN sb USING (l_suppkey, token)),
g AS (SELECT *, pa - row_number() OVER (PARTITION BY l_suppkey, dg ORDER BY pa) AS isl FROM p)
SELECT l_suppkey, min(pa) AS a_start, min(pb) AS b_start, count(*) AS length FROM g GROUP BY l_suppkey, dg, isl""")
def pr_05(spark, d):
    a, b = _sequences(spark, d)
    return P.match_blocks(a, b, ["l_suppkey"], cells=[cell_of("pos", 100_000)])


@query("pr_06_align_sequences")
def pr_06(spark, d):
    a, b = _sequences(spark, d)
    return P.align_sequences(a, b, ["l_suppkey"])


@query("pr_07_fill_gaps", f"""WITH {EV}, s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM ev),
m AS (SELECT user_id, pos, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN pos + 3 ELSE pos END AS v FROM s),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS lp, last_value(v IGNORE NULLS) OVER b AS lv,
 first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS rp, first_value(v IGNORE NULLS) OVER f AS rv FROM m
 WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, pos, CASE WHEN v IS NOT NULL THEN v WHEN rv - lv = rp - lp THEN lv + pos - lp END AS mapped,
 CASE WHEN v IS NOT NULL THEN 'matched_fingerprint' WHEN rv - lv = rp - lp THEN 'matched_contextual' ELSE 'unresolved' END AS mapping_status FROM x""")
def pr_07(spark, d):
    e = number_rows(events(spark, d), ["user_id"], ["us", "event_id"], "pos", day_cells())
    m = e.select("user_id", "pos", F.when(F.col("event_type") == "error", F.col("pos") + 3).when(F.col("event_type") != "click", F.col("pos")).alias("mapped"))
    return P.fill_bounded_gaps(m, ["user_id"], cells=[cell_of("pos", 10_000)])


@query("pr_08_repeat_rows", f"""WITH {LI}, m AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN qty = 1 THEN NULL ELSE l_partkey END AS mapped FROM (SELECT DISTINCT ON (l_suppkey, l_orderkey, l_linenumber) * FROM li ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey, qty, cents)),
o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, mapped ORDER BY pos) AS occ, count(*) OVER (PARTITION BY l_suppkey, mapped) AS cnt FROM m WHERE mapped IS NOT NULL),
r AS (SELECT DISTINCT l_suppkey, mapped FROM o WHERE cnt > 1), g AS (SELECT *, mapped - row_number() OVER (PARTITION BY l_suppkey ORDER BY mapped) AS isl FROM r),
h AS (SELECT l_suppkey, mapped, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY isl) AS gid FROM g)
SELECT l_suppkey, pos, mapped, occ AS repeat_occurrence, cnt AS repeat_occurrence_count, CASE WHEN gid IS NOT NULL THEN printf('R%02d', gid) END AS repeat_group_id, cnt > 1 AS is_repeated FROM o LEFT JOIN h USING (l_suppkey, mapped)
UNION ALL SELECT l_suppkey, pos, NULL, NULL, NULL, NULL, NULL FROM m WHERE mapped IS NULL""")
def pr_08(spark, d):
    first = F.min(F.struct("l_partkey", "qty", "cents")).alias("f")
    m = lines(spark, d).groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(first).select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("f.qty") != 1, F.col("f.l_partkey")).alias("mapped"))
    return P.repeat_rows(m, ["l_suppkey"], cells=[cell_of("pos", 1_000_000)], value_cells=[cell_of("mapped", 10_000)])


@query("pr_09_expand_occurrences", f"""WITH {LI}, {OD}, x AS (SELECT od.o_orderkey AS event_id, od.cents % 64 AS w, li.* FROM od LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, qty FROM li WHERE l_returnflag <> 'A') li ON l_orderkey = o_orderkey)
SELECT event_id, l_partkey, l_suppkey, coalesce(CAST(l_linenumber AS BIGINT), event_id) AS unfolded_index, coalesce(l_linenumber, 1) AS repeat_occurrence, CASE WHEN l_linenumber IS NULL THEN 'written_fallback' ELSE l_returnflag END AS mapping_status,
 coalesce(CAST(l_linenumber AS BIGINT), event_id) - 1 + 1 + w / 64.0::DOUBLE AS start_meas, coalesce(CAST(l_linenumber AS BIGINT), event_id) - 1 + 1 + w / 64.0::DOUBLE + 0.25::DOUBLE AS end_meas FROM x""")
def pr_09(spark, d):
    ev = orders(spark, d).select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("written"), (F.col("cents") % 64 / 64.0).alias("within"),
                                 F.lit(0.25).alias("duration_measures"), F.lit(1).alias("timeline_offset"))
    rm = lines(spark, d).where("l_returnflag <> 'A'").select(
        F.col("l_orderkey").alias("written"), "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("unfolded_index"), F.col("l_linenumber").alias("repeat_occurrence"),
        F.lit(7).alias("repeat_occurrence_count"), F.lit("R01").alias("repeat_group_id"), F.col("l_returnflag").alias("mapping_status"))
    return P.expand_occurrences(ev, rm, [], "written").select("event_id", "l_partkey", "l_suppkey", "unfolded_index", "repeat_occurrence", "mapping_status", "start_meas", "end_meas")


@query("pr_09_first_occurrence", f"""WITH {LI} SELECT l_orderkey, l_partkey AS first_part, l_linenumber AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, day, l_partkey) AS rk FROM li) WHERE rk = 1""")
def pr_09b(spark, d):
    li = lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("repeat_occurrence"), (F.col("day") * 10_000_000 + F.col("l_partkey")).alias("unfolded_index"),
                                F.col("l_partkey").alias("first_part"), F.col("l_linenumber").alias("occurrence"))
    return P.first_occurrence(li, ["l_orderkey"], ["first_part", "occurrence"])


@query("pr_10_zip_clamped", f"""WITH {LI}, x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, day, qty, disc, unnest(generate_series(1, greatest(l_linenumber, disc % 4))) AS occurrence FROM li)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, day, qty, CAST(occurrence AS INTEGER) AS occurrence, CAST(least(occurrence, l_linenumber) AS INTEGER) AS first_item,
 CASE WHEN disc % 4 > 0 THEN CAST(least(occurrence, disc % 4) AS INTEGER) END AS second_item FROM x""")
def pr_10(spark, d):
    seq = lambda n: F.slice(F.array(*map(F.lit, range(1, 8))), 1, n.cast("int"))
    li = lines(spark, d).withColumns({"a": seq(F.col("l_linenumber")), "b": seq(F.col("disc") % 4)})
    z = li.withColumn("z", F.explode(P.zip_clamped("a", "b")))
    return z.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "day", "qty", "z.occurrence", F.col("z.first").alias("first_item"), F.col("z.second").alias("second_item"))


@query("pr_11_expand_timeline", """WITH p AS (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
x AS (SELECT *, unnest(generate_series(1, CASE WHEN k % 3 = 0 THEN 1 ELSE k % 3 END)) AS i FROM p)
SELECT 'xml_event' AS source_record_type, CAST(event_id AS VARCHAR) AS record_id, CAST(i AS INTEGER) AS occurrence, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE k % 3 END AS INTEGER) AS occurrence_count,
 CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) ELSE CAST(k + i AS VARCHAR) END AS start_meas, CASE WHEN k % 3 = 0 THEN 'own' ELSE CAST(i AS VARCHAR) END AS start_note FROM x""")
def pr_11(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    one = lambda i: F.concat(F.lit('{"bps_time":'), k + i, F.lit(f',"note_id":{i}}}'))
    js = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("["), one(1), F.lit("]"))).otherwise(F.concat(F.lit("["), one(1), F.lit(","), one(2), F.lit("]")))
    e = t(spark, d, "events").select("event_id", js.alias("repeat_json"), k.alias("start_meas"), F.lit("own").alias("start_note"))
    return P.expand_timeline(e, "repeat_json", "xml_event", "event_id").select("source_record_type", "record_id", "occurrence", "occurrence_count", "start_meas", "start_note")
