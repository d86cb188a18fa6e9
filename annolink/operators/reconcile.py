"""Set operations that lose no row: tagged unions, links, lossless combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.classes import allowed_notations, const_map
from ..functions.geometry import ticks
from ..functions.projections import relation_type
from ..functions.text import norm_text, resolve_ids
from .joins import prefer_join


# SET-01 -----------------------------------------------------------------
def tagged_union(sources: dict[str, DataFrame], tag: str = "source_record_type") -> DataFrame:
    """Union of different schemas; every row says where it comes from."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# SET-02 -----------------------------------------------------------------
def build_links(boxes: DataFrame, events: DataFrame, occurrences: DataFrame, width: int | None = None) -> DataFrame:
    """Links between boxes and events with one primary link per box.

    boxes: score_id, bbox_id, class, alignment_status, human_approved (text), target_type,
    note_ids, connected_note, start_note, end_note, staff, xml_page, xml_measure, xml_symbol,
    start_meas, confidence, review_status. events: score_id, xml_event_id, ord (numeric order
    of the id), event_type, event_subtype, class, page, staff, xml_measure, start_meas,
    dynamic, marker (start/stop), anchors array<string>. occurrences: score_id,
    xml_event_id, note_id, start_meas, note_match_status (one row per performance of a note).

    Four ways to find an event: the note itself, notations on that note, dynamics by measure
    and symbol, rests. Every wish (page, staff, measure, agreement) is a preference join.
    """
    b = boxes.where(F.col("alignment_status").isin(S.LINKABLE)).withColumns({
        "__tick": F.coalesce(ticks("start_meas"), F.lit(0)), "__timed": F.col("start_meas").isNotNull(),
        "staff": norm_text("staff"), "xml_measure": norm_text("xml_measure"), "page": F.col("xml_page"), "note_ids": resolve_ids("note_ids", "connected_note", "start_note", "end_note")})
    key = ["score_id", "bbox_id"]
    slim = b.select(*key, "class", "target_type", F.col("start_note").cast("bigint").alias("start_note"), F.col("end_note").cast("bigint").alias("end_note"),
                    "note_ids", "staff", "page", "xml_measure", "xml_symbol", "__tick", "__timed")
    ev = events.select("score_id", "xml_event_id", "ord", "event_type", "event_subtype", "page", F.col("staff").cast("string").alias("staff"),
                       F.col("xml_measure").cast("string").alias("xml_measure"), F.coalesce(ticks("start_meas"), F.lit(0)).alias("__tick"), "dynamic", "marker", "anchors")

    # notes: how well the occurrence agrees with its note comes right after the page
    rank = F.coalesce(F.try_element_at(const_map(S.MATCH_METHOD_RANK), F.col("note_match_status")), F.lit(3))
    occ = occurrences.select("score_id", "xml_event_id", "note_id", F.coalesce(ticks("start_meas"), F.lit(0)).alias("__tick"), rank.alias("__r")).join(
        ev.where("event_type = 'note'").drop("__tick"), ["score_id", "xml_event_id"])
    asks = slim.select("*", F.explode("note_ids").alias("note_id"))
    best = _pick(asks, occ, ["score_id", "note_id"], ["page"], ["staff", "xml_measure"], width, ranked=True)
    role = relation_type("target_type", "note_id", "start_note", "end_note")
    note_links = best.select(*key, "class", "target_type", "note_id", role.alias("relation_type"), F.col("hit").alias("xml_event_id"))
    marks = ev.where("event_type = 'notation'").select("score_id", F.explode("anchors").alias("anchor"), F.col("xml_event_id").alias("mark_id"), "event_subtype", "marker")

    def notations(links):
        n = links.withColumnRenamed("xml_event_id", "anchor").join(marks, ["score_id", "anchor"]).where(F.array_contains(allowed_notations("class"), F.col("event_subtype")))
        want = F.when(F.col("relation_type") == "span_start", "start").when(F.col("relation_type") == "span_end", "stop")
        n = n.withColumns({"__t": F.coalesce(F.col("marker") == want, F.lit(False)), "__note": F.coalesce("note_id", F.lit(-1))})
        some = n.groupBy(*key, "__note", "anchor").agg(F.bool_or("__t").alias("__any"))
        n = n.join(some, [*key, "__note", "anchor"]).where(F.col("__t") | ~F.col("__any"))
        return n.select(*key, "note_id", F.col("mark_id").alias("xml_event_id"), F.lit("semantic_event").alias("relation_type"), F.lit("xml_notation_anchor").alias("link_method"))

    parts = [
        note_links.select(*key, "note_id", "xml_event_id", "relation_type", F.lit("bps_note_anchor").alias("link_method")),
        notations(note_links),
    ]
    none = F.lit(None).cast("bigint").alias("note_id")
    dyn = slim.where(F.col("class").startswith("dynamic") & norm_text("xml_symbol").isNotNull()).withColumn("dynamic", F.col("xml_symbol"))
    devs = ev.where("event_type = 'direction' and event_subtype = 'dynamic'")
    # a stated measure must agree; without one every measure is allowed
    any_measure = F.explode(F.array_compact(F.array("xml_measure", F.lit("*")))).alias("__meas")
    wanted = F.coalesce("xml_measure", F.lit("*")).alias("__meas")
    hit = _pick(dyn.select("*", wanted), devs.select("*", any_measure), ["score_id", "dynamic", "__meas"], ["page"], ["staff"], width)
    parts.append(hit.select(*key, none, F.col("hit").alias("xml_event_id"), F.lit("semantic_event").alias("relation_type"), F.lit("xml_direction_measure_symbol").alias("link_method")))
    rest = slim.where("target_type = 'rest'")
    revs = ev.where("event_type = 'rest'")
    hit = _pick(rest.select("*", wanted), revs.select("*", any_measure), ["score_id", "__meas"], ["staff", "page"], [], width)
    rl = hit.select(*key, "class", "target_type", none, F.lit("target_rest").alias("relation_type"), F.col("hit").alias("xml_event_id"))
    parts += [rl.select(*key, "note_id", "xml_event_id", "relation_type", F.lit("xml_rest_anchor").alias("link_method")), notations(rl)]
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    links = links.dropDuplicates([*key, "xml_event_id", "relation_type", "note_id", "link_method"])
    first = F.when(F.col("link_method").isin("xml_notation_anchor", "xml_direction_measure_symbol"), 0).otherwise(1)
    order = [first, F.col("xml_event_id"), F.col("relation_type"), F.coalesce("note_id", F.lit(-1))]
    w = Window.partitionBy(*key).orderBy(*order)
    links = links.withColumn("link_rank", F.row_number().over(w)).withColumn("is_primary", F.col("link_rank") == 1)
    info = boxes.select(*key, F.col("class").alias("yolo_class"), "alignment_status", "human_approved", "review_status", "confidence")
    approved = F.coalesce(F.lower("human_approved") == "true", F.lit(False))
    return links.join(info, key).withColumns({
        "link_status": F.when(approved, "confirmed").otherwise(F.col("alignment_status")),
        "validation_status": F.when(approved, "confirmed").otherwise("source_candidate_not_revalidated")})


def _pick(asks, cands, hard, first, then, width, ranked: bool = False) -> DataFrame:
    """Preferred event per ask: wishes, then nearest time (if the ask has one), then the smaller event order.

    An ask without a time stands at time zero against a copy of the events that does too.
    """
    prefs = [*first, *then]
    asks = asks.withColumn("__tick", F.when(F.col("__timed"), F.col("__tick")).otherwise(0))
    c = cands.select(*hard, *[p for p in prefs if p not in hard], *(["__r"] if ranked else []), "__tick", F.struct("ord", "xml_event_id").alias("oid"))
    c = c.withColumn("__timed", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__tick", F.when(F.col("__timed"), F.col("__tick")).otherwise(0))
    uid = [k for k in ("score_id", "bbox_id", "note_id") if k in asks.columns]
    extra = {"rank": "__r", "ranks": 4, "rank_after": len(first)} if ranked else {}
    out = prefer_join(asks, c, [*hard, "__timed"], prefs, "__tick", uid, "oid", width, **extra)
    return out.where("near is not null").withColumn("hit", F.col("near.id.xml_event_id")).drop("near")


# SET-03 -----------------------------------------------------------------
def combine_lossless(boxes: DataFrame, events: DataFrame, links: DataFrame, box_key: str = "bbox_id", event_key: str = "xml_event_id",
                     status: str = "alignment_status") -> DataFrame:
    """Every box once with its first linked event and link count, plus every event without a link.

    The linked events themselves are the link table; only the primary one is brought along.
    """
    per = links.groupBy(box_key).agg(F.count(F.lit(1)).alias("event_count"), F.min_by(event_key, F.struct((~F.col("is_primary")).alias("p"), F.col(event_key))).alias("primary_event"))
    b = boxes.join(per, box_key, "left").fillna(0, ["event_count"])
    s = (F.when((F.col("event_count") > 0) & (F.col(status) == "matched"), "aligned").when(F.col("event_count") > 0, F.col(status))
         .when(F.col(status) == "xml_missing", "yolo_only").otherwise("unresolved"))
    left = b.select(F.col(box_key).cast("string").alias("record_id"), F.lit("yolo").alias("row_origin"), s.alias("combined_status"), "event_count",
                    F.col("primary_event").cast("string").alias("primary_event"))
    lone = events.select(event_key).join(links.select(event_key), event_key, "left_anti")
    right = lone.select(F.col(event_key).cast("string").alias("record_id"), F.lit("xml").alias("row_origin"), F.lit("xml_only").alias("combined_status"),
                        F.lit(1).cast("bigint").alias("event_count"), F.col(event_key).cast("string").alias("primary_event"))
    return left.unionByName(right)


CONTROL = ["record_id", "row_origin", "combined_status", "source_alignment_status", "xml_event_ids_json", "xml_event_count", "xml_events_json"]  # fixed values
#: Box columns that a row of an event alone takes from its event (fixed values).
FROM_EVENT = {"score_id": "score_id", "xml_path": "source_xml_path", "xml_page": "page", "xml_measure": "xml_measure", "staff": "staff", "target_type": "event_type"}


def combine_rows(boxes: DataFrame, events: DataFrame, links: DataFrame, official=S.OFFICIAL) -> DataFrame:
    """The full combined row: official columns, control columns, the boxes' own columns, and event_* of the primary event.

    boxes: bbox_id, alignment_status and any others. events: xml_event_id and any others. links: bbox_id, xml_event_id,
    is_primary; each link counts. Every box is one row with all its linked events as JSON (primary ones first, then by
    id); every event without a link is one row of its own. Columns that a side lacks are null.
    """
    extra = [c for c in events.columns if c not in official]
    whole = F.to_json(F.struct(*events.columns))
    ev = events.withColumn("__json", whole)
    row = F.struct((~F.col("is_primary")).alias("p"), F.col("xml_event_id").alias("i"), F.col("__json").alias("j"), F.struct(*extra).alias("e"))
    met = links.select("bbox_id", "xml_event_id", "is_primary").join(ev.select(*dict.fromkeys(["xml_event_id", "__json", *extra])), "xml_event_id").select("bbox_id", row.alias("r"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    per = met.groupBy("bbox_id").agg(F.array_sort(F.collect_list(F.struct("r.p", "r.i", "r.j"))).alias("__l"), F.min_by("r.e", F.struct("r.p", "r.i")).alias("__first"))
    ids = lambda c: listed(F.transform(c, lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)))
    b = boxes.join(per, "bbox_id", "left").withColumn("__n", F.coalesce(F.size("__l"), F.lit(0)))
    some, status = F.col("__n") > 0, F.col("alignment_status")
    state = F.when(some & (status == "matched"), "aligned").when(some, status).when(status == "xml_missing", "yolo_only").otherwise("unresolved")
    own = [c for c in boxes.columns if c not in official and c not in CONTROL]
    kind = dict(boxes.dtypes)
    at = lambda c, cols: F.col(c) if c in cols else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    left = b.select(
        *[at(c, boxes.columns).alias(c) for c in official], F.col("bbox_id").cast("string").alias("record_id"), F.lit("yolo").alias("row_origin"), state.alias("combined_status"),
        status.alias("source_alignment_status"), F.coalesce(ids(F.transform("__l", lambda x: x["i"])), listed(none)).alias("xml_event_ids_json"), F.col("__n").alias("xml_event_count"),
        F.coalesce(listed(F.transform("__l", lambda x: x["j"])), listed(none)).alias("xml_events_json"), *own, *[F.col(f"__first.{c}").alias(f"event_{c}") for c in extra])
    lone = ev.join(links.select("xml_event_id"), "xml_event_id", "left_anti")
    given = {c: F.col(e) for c, e in FROM_EVENT.items() if e in events.columns}
    more = [c for c in given if c not in official and c not in own]
    fill = lambda c: given[c].cast(kind[c]) if c in given else F.lit(None).cast(kind[c])
    right = lone.select(
        *[(F.col(c).cast(kind.get(c, "string")) if c in events.columns else F.lit(None).cast(kind.get(c, "string"))).alias(c) for c in official],
        F.col("xml_event_id").cast("string").alias("record_id"), F.lit("xml").alias("row_origin"), F.lit("xml_only").alias("combined_status"), F.lit("xml_only").alias("source_alignment_status"),
        ids(F.array("xml_event_id")).alias("xml_event_ids_json"), F.lit(1).alias("xml_event_count"), listed(F.array("__json")).alias("xml_events_json"),
        *[fill(c).alias(c) for c in own], *[given[c].alias(c) for c in more], *[F.col(c).alias(f"event_{c}") for c in extra])
    return left.unionByName(right, allowMissingColumns=True)
