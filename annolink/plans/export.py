"""Score export: node table to semantic events, note ids, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import classify_event
from ..functions.geometry import pitch_columns
from ..functions.text import norm_text, try_float
from ..operators.aggregates import coverage
from ..operators.joins import resolve_tiers
from ..operators.pairing import expand_occurrences
from ..operators.windows import assign_ids, carry_forward, onset_cursor
from ..session import settle

MICRO = 1_000_000  # ticks per measure in joins
GROUPS = ["articulations", "ornaments", "technical"]  # fixed values: notation groups whose children are the marks


def score_events(nodes: DataFrame, cell: int = 50_000) -> DataFrame:
    """Semantic events of every document: notes, rests, directions, notations, attributes, barlines.

    nodes: the output of node_context. All steps are joins on (doc_id, node id), ordered
    scans over preorder and conditional aggregates over children.
    """
    n = settle(nodes.select("doc_id", "node_id", "parent_id", "tag", "text", "attributes", "part_id", "measure_node", "measure_index", "measure_number", "page", "system").where("measure_node is not null"))
    at = lambda k, c="attributes": F.try_element_at(c, F.lit(k))
    kid = lambda t: F.max(F.when(F.col("tag") == t, F.trim("text")))
    kids = n.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        *[kid(t).alias(f"k_{t}") for t in ("duration", "offset", "staff", "voice", "stem", "divisions", "beats", "step", "alter", "octave", "type", "accidental")],
        F.max(F.when(F.col("tag") == "beat-type", F.trim("text"))).alias("k_beat_type"),
        *[F.bool_or(F.col("tag") == t).alias(f"has_{t}") for t in ("chord", "rest", "grace")],
        F.max(F.when(F.col("tag") == "pitch", F.col("node_id"))).alias("pitch_node"))
    kids = settle(kids)
    # measures: signature in force, nominal length
    top = n.where("parent_id = measure_node")
    attrs = top.where("tag = 'attributes'").select("doc_id", "measure_node", "node_id")
    time = n.where("tag = 'time'").select("doc_id", F.col("parent_id").alias("attr"), F.col("node_id"))
    time = time.join(kids.select("doc_id", "node_id", "k_beats", "k_beat_type"), ["doc_id", "node_id"], "left").select("doc_id", F.col("attr").alias("node_id"), "k_beats", "k_beat_type")
    sig = attrs.join(kids.select("doc_id", "node_id", "k_divisions"), ["doc_id", "node_id"], "left").join(time, ["doc_id", "node_id"], "left")
    sig = sig.groupBy("doc_id", "measure_node").agg(F.min_by(F.struct("k_divisions", "k_beats", "k_beat_type"), "node_id").alias("s")).select("doc_id", "measure_node", "s.*")
    meas = n.where("tag = 'measure' and node_id = measure_node").select("doc_id", "part_id", "measure_node", "measure_index")
    meas = meas.join(sig, ["doc_id", "measure_node"], "left").select(
        "doc_id", "part_id", "measure_node", "measure_index", try_float("k_divisions").cast("int").alias("divisions"), try_float("k_beats").cast("int").alias("beats"), try_float("k_beat_type").cast("int").alias("beat_type"))
    by_part = [F.floor(F.col("measure_node") / cell)]
    meas = carry_forward(meas, ["doc_id", "part_id"], ["measure_node"], {"divisions": 1, "beats": 4, "beat_type": 4}, by_part)
    meas = meas.withColumn("nominal", F.col("divisions") * F.col("beats") * 4 / F.col("beat_type"))
    # onset of everything directly inside a measure
    flow = top.where(F.col("tag").isin("note", "backup", "forward", "direction", "barline")).join(kids, ["doc_id", "node_id"], "left")
    kind = F.when(F.col("tag") == "note", F.when(F.coalesce("has_chord", F.lit(False)), "chord").otherwise("note")).when(F.col("tag").isin("backup", "forward"), F.col("tag")).otherwise("other")
    flow = flow.withColumns({"kind": kind, "duration": F.coalesce(try_float("k_duration"), F.lit(0.0))})
    flow = settle(onset_cursor(flow, ["doc_id", "measure_node"], ["node_id"], cells=[F.floor(F.col("node_id") / cell)]))
    reach = flow.groupBy("doc_id", "measure_node").agg(F.max("extent").alias("extent"))
    meas = meas.join(reach, ["doc_id", "measure_node"], "left")
    first = meas.where("measure_index = 1").select("doc_id", "part_id", F.greatest(F.col("nominal") - F.coalesce("extent", F.lit(0.0)), F.lit(0.0)).alias("pickup"))
    meas = settle(meas.join(first, ["doc_id", "part_id"]).select(
        "doc_id", "measure_node", "divisions", F.concat_ws("/", "beats", "beat_type").alias("time_signature"), "nominal", "pickup", F.when(F.col("pickup") > 0, 0).otherwise(1).alias("timeline_offset")))

    base = ["doc_id", "part_id", "measure_node", "measure_index", "measure_number", "page", "system"]
    s_ = lambda v: F.lit(v).cast("string")
    pk = kids.select("doc_id", F.col("node_id").alias("pitch_node"), F.col("k_step").alias("step"), F.col("k_alter").try_cast("double").cast("int").alias("alter"), F.col("k_octave").try_cast("int").alias("octave"))
    notes = flow.where("tag = 'note'").join(pk, ["doc_id", "pitch_node"], "left")
    notes = pitch_columns(notes, repeat_sign=True)
    rest = F.coalesce("has_rest", F.lit(False))
    note_rows = notes.select(
        *base, "node_id", F.lit(0).alias("mark_no"), F.when(rest, "rest").otherwise("note").alias("event_type"), F.when(rest, "rest").otherwise("note").alias("event_subtype"), "attributes", "text",
        F.coalesce("k_staff", F.lit("1")).alias("staff"), F.coalesce("k_voice", F.lit("")).alias("voice"), "onset", "duration", "midi", "pitch_name", (F.col("kind") == "chord").alias("is_chord"),
        F.coalesce("has_grace", F.lit(False)).alias("is_grace"), F.when(F.col("k_stem") == "down", 0).when(F.col("k_stem") == "up", 1).alias("stem_dir"), s_(None).alias("dynamic"), F.lit(None).cast("bigint").alias("anchor_node"), s_(None).alias("placement"))
    blank = lambda df, et, st, **kw: df.select(
        *base, "node_id", F.lit(1).alias("mark_no"), F.lit(et).alias("event_type"), st.alias("event_subtype"), "attributes", "text", kw.get("staff", s_("")).alias("staff"), kw.get("voice", s_("")).alias("voice"),
        kw["onset"].alias("onset"), kw.get("duration", F.lit(0.0)).alias("duration"), F.lit(None).cast("int").alias("midi"), s_(None).alias("pitch_name"), F.lit(False).alias("is_chord"), F.lit(False).alias("is_grace"),
        F.lit(None).cast("int").alias("stem_dir"), kw.get("dynamic", s_(None)).alias("dynamic"), kw.get("anchor", F.lit(None).cast("bigint")).alias("anchor_node"), kw.get("placement", at("placement")).alias("placement"))
    # marks below a note: notations/x, notations/group/x and ties; they share the note's time
    owner = notes.select("doc_id", F.col("node_id").alias("owner"), F.coalesce("k_staff", F.lit("1")).alias("o_staff"), F.coalesce("k_voice", F.lit("")).alias("o_voice"), F.col("onset").alias("o_onset"), F.col("duration").alias("o_dur"))
    up = n.select("doc_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("p_tag"), F.col("parent_id").alias("grand_id"))
    up2 = n.select("doc_id", F.col("node_id").alias("grand_id"), F.col("tag").alias("g_tag"), F.col("parent_id").alias("great_id"))
    below = n.join(up, ["doc_id", "parent_id"]).join(up2, ["doc_id", "grand_id"], "left")
    flat = below.where((F.col("p_tag") == "notations") & ~F.col("tag").isin(GROUPS)).withColumn("owner", F.col("grand_id"))
    deep = below.where(F.col("p_tag").isin(GROUPS) & (F.col("g_tag") == "notations")).withColumn("owner", F.col("great_id"))
    ties = below.where((F.col("p_tag") == "note") & (F.col("tag") == "tie")).withColumn("owner", F.col("parent_id"))
    marks = flat.unionByName(deep).unionByName(ties).where(~F.col("tag").startswith("#")).join(owner, ["doc_id", "owner"])
    mark_rows = blank(marks, "notation", F.col("tag"), onset=F.col("o_onset"), duration=F.col("o_dur"), staff=F.col("o_staff"), voice=F.col("o_voice"), anchor=F.col("owner"))
    # directions: direction/direction-type/x, and the children of dynamics
    dirs = flow.where("tag = 'direction'").select(
        "doc_id", F.col("node_id").alias("dir"), F.coalesce("k_staff", F.lit("")).alias("o_staff"), F.coalesce("k_voice", F.lit("")).alias("o_voice"), (F.col("onset") + F.coalesce(try_float("k_offset"), F.lit(0.0))).alias("o_onset"), at("placement").alias("o_side"))
    word = below.where((F.col("p_tag") == "direction-type") & (F.col("tag") != "dynamics") & ~F.col("tag").startswith("#")).withColumn("dir", F.col("grand_id")).join(dirs, ["doc_id", "dir"])
    dyn = below.where((F.col("p_tag") == "dynamics") & (F.col("g_tag") == "direction-type") & ~F.col("tag").startswith("#"))
    up3 = n.select("doc_id", F.col("node_id").alias("great_id"), F.col("tag").alias("gg_tag"))
    dyn = dyn.join(up3, ["doc_id", "great_id"]).where("gg_tag = 'direction'").withColumn("dir", F.col("great_id")).join(dirs, ["doc_id", "dir"])
    kw = {"onset": F.col("o_onset"), "staff": F.col("o_staff"), "voice": F.col("o_voice"), "placement": F.col("o_side")}
    dir_rows = blank(word, "direction", F.col("tag"), **kw).unionByName(blank(dyn, "direction", F.lit("dynamic"), dynamic=F.col("tag"), **kw))
    bar_rows = blank(flow.where("tag = 'barline'"), "barline", F.lit("barline"), onset=F.lit(None).cast("double"))
    att = n.where(F.col("tag").isin("clef", "key", "time")).join(attrs.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"])
    att_rows = blank(att, "attribute", F.when(F.col("tag") == "time", "time_signature").otherwise(F.col("tag")), onset=F.lit(0.0), staff=F.coalesce(at("number"), F.lit("")))
    ev = note_rows.unionByName(mark_rows).unionByName(dir_rows).unionByName(bar_rows).unionByName(att_rows).join(meas, ["doc_id", "measure_node"])
    onset = F.coalesce("onset", "nominal")
    shift = F.when((F.col("measure_index") == 1), F.col("pickup")).otherwise(0.0)
    ev = ev.withColumns({
        "onset": onset, "within": (shift + onset) / F.col("nominal"), "duration_measures": F.col("duration") / F.col("nominal"), "beat_position": 1 + (shift + onset) / F.col("divisions"),
        "class": classify_event("event_type", "event_subtype", "placement", "text", "dynamic", at("type")), "score_id": F.col("doc_id")})
    cells = [F.floor(F.col("node_id") / cell)]
    ev = assign_ids(ev, ["score_id"], ["node_id", "mark_no"], "%s:E%07d", "xml_event_id", cells)
    anchor = ev.where("event_type in ('note', 'rest')").select("doc_id", F.col("node_id").alias("anchor_node"), F.col("xml_event_id").alias("anchor_event_id"))
    return ev.join(anchor, ["doc_id", "anchor_node"], "left")


def link_notes(events: DataFrame, repeat_map: DataFrame, notes: DataFrame, bits: int = 34) -> tuple[DataFrame, DataFrame]:
    """(occurrences with note ids, events with their first note).

    repeat_map: score_id, measure_index, unfolded_index, repeat_occurrence,
    repeat_occurrence_count, repeat_group_id, mapping_status. notes: score_id, note_id,
    start_meas, end_meas, midi. Exact time and pitch, then 0.0015, then containment.
    """
    occ = settle(expand_occurrences(events, repeat_map, ["score_id"], "measure_index"))
    tick = lambda c: F.round(F.col(c) * MICRO).cast("bigint")
    left = occ.where("event_type = 'note' and midi is not null").select("score_id", "midi", F.struct("xml_event_id", "unfolded_index").alias("oid"), tick("start_meas").alias("tick"), "xml_event_id", "unfolded_index")
    left = left.withColumn("oid", F.concat_ws("@", "xml_event_id", F.format_string("%09d", "unfolded_index")))
    right = notes.select("score_id", "midi", "note_id", tick("start_meas").alias("s"), tick("end_meas").alias("e"))
    hit = resolve_tiers(left.select("score_id", "midi", "oid", "tick"), right, ["score_id", "midi"], "oid", "note_id", "tick", "s", "e", 1500, bits, left_order=["tick", "oid"], exact_unit=1000, width=100 * MICRO, levels=21)
    occ = occ.withColumn("oid", F.concat_ws("@", "xml_event_id", F.format_string("%09d", "unfolded_index")))
    occ = occ.join(hit.select("score_id", "oid", "note_id", F.when(F.col("tier") == "unmatched", F.lit(None)).otherwise(F.col("tier")).alias("note_match_status")), ["score_id", "oid"], "left")
    first = occ.where("note_id is not null").groupBy("xml_event_id").agg(F.min_by("note_id", "unfolded_index").alias("start_note"))
    out = events.join(first, "xml_event_id", "left")
    status = F.when(F.col("event_type") == "note", F.when(F.col("start_note").isNotNull(), "bps_note_matched").otherwise("bps_note_unmatched"))
    return occ, out.withColumns({"end_note": F.col("start_note"), "validation_status": status})


def note_coverage(occurrences: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many annotated notes the events refer to, per score and in total, with the left-overs."""
    return coverage(notes, occurrences.select("score_id", "note_id"), "note_id", "score_id")


def event_table(events: DataFrame) -> DataFrame:
    """Events in the shape that links and spans expect."""
    return events.select(
        "score_id", "xml_event_id", F.col("node_id").alias("ord"), F.col("node_id").alias("seq"), "event_type", "event_subtype", "class", "page", "staff", "voice", F.col("measure_number").alias("xml_measure"),
        (F.col("measure_index") - 1 + F.col("timeline_offset") + F.col("within")).alias("start_meas"),
        (F.col("measure_index") - 1 + F.col("timeline_offset") + F.col("within") + F.col("duration_measures")).alias("end_meas"),
        "dynamic", norm_text(F.try_element_at("attributes", F.lit("type"))).alias("marker"), "attributes",
        F.when(F.col("anchor_event_id").isNotNull(), F.array("anchor_event_id")).otherwise(F.array().cast("array<string>")).alias("anchors"), F.col("midi").alias("midi_pitch"))
