"""Pairing of markers, sequence alignment, repeats and occurrences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _c
from ..session import settle
from .scan import Fold, number_rows, scan, shift


# PR-01 -----------------------------------------------------------------
def pair_lifo(df: DataFrame, keys, order, row_id: str, kind: str = "kind", cells=()) -> DataFrame:
    """Pair every stop with the latest open start of its key; orphans of both kinds are reported.

    kind is start or stop. Depth is a running +1/-1 sum corrected by its running minimum; a
    stop that reaches a new minimum is an orphan; a start and its stop are neighbours on one
    depth level. Returns keys, start_id, end_id, status.
    """
    keys, order = list(keys), list(order)
    k = F.col(kind)
    d = df.select(*keys, *[o for o in order if o != row_id], row_id, kind, *[c.alias(f"__cell{i}") for i, c in enumerate(cells)])
    cell = [F.col(f"__cell{i}") for i in range(len(cells))]
    d = scan(d, keys, order, [Fold("__s", "sum", F.when(k == "start", 1).otherwise(-1))], cell)
    d = scan(d, keys, order, [Fold("__m", "min", F.col("__s")), Fold("__p", "min", F.col("__s"), inclusive=False)], cell)
    low, before = F.least(F.col("__m"), F.lit(0)), F.least(F.coalesce("__p", F.lit(0)), F.lit(0))
    orphan = (k == "stop") & (F.col("__s") < before)
    level = F.col("__s") - low + F.when(k == "stop", 1).otherwise(0)
    d = d.withColumns({"__orphan": orphan, "__level": level})
    inner = d.where(~F.col("__orphan"))
    nxt = shift(inner, [*keys, "__level"], order, {"__nid": F.col(row_id)}, cell, ahead=True)
    starts = nxt.where(k == "start").select(
        *keys, F.col(row_id).alias("start_id"), F.col("__nid").alias("end_id"),
        F.when(F.col("__nid").isNull(), "start_without_stop").otherwise("paired").alias("status"))
    orphans = d.where("__orphan").select(*keys, F.lit(None).cast(df.schema[row_id].dataType).alias("start_id"), F.col(row_id).alias("end_id"),
                                         F.lit("stop_without_start").alias("status"))
    return starts.unionByName(orphans)


# PR-02 -----------------------------------------------------------------
def pair_ties(df: DataFrame, keys, order, row_id: str, voice: str, kind: str = "kind", cells=()) -> DataFrame:
    """Tie pairing: latest open start of the same voice, else the only open start, else ambiguous.

    Where a key has one voice this is plain last-in-first-out and runs as windows. Keys with
    several voices depend on every earlier choice; they run as a state machine that reads
    sorted partitions row by row and keeps the open starts only. Unknown (NULL) voices are one voice.
    """
    keys, order = list(keys), list(order)
    solo = df.groupBy(*keys).agg(((F.count_distinct(voice) > 1) | ((F.count(voice) > 0) & (F.count(voice) < F.count(F.lit(1))))).alias("__mixed"))
    d = df.join(solo, keys)
    simple = pair_lifo(d.where(~F.col("__mixed")), keys, order, row_id, kind, cells)
    names = {"stop_without_start": "tie_stop_without_start", "start_without_stop": "tie_start_without_stop"}
    status = F.col("status")
    for a, b in names.items():
        status = F.when(F.col("status") == a, b).otherwise(status)
    simple = simple.withColumn("status", status)
    mixed = d.where("__mixed").select(*keys, *[o for o in order if o != row_id], row_id, voice, kind)
    idtype = df.schema[row_id].dataType.simpleString()
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"start_id {idtype}", f"end_id {idtype}", "status string"])

    def walk(batches):
        current, open_ = None, []

        def flush():
            return [(*current, r, None, "tie_start_without_stop") for r, _ in open_] if current is not None else []

        cols = [*keys, "start_id", "end_id", "status"]
        for pdf in batches:
            rows = []
            for *key, rid, v, kd in zip(*[pdf[c] for c in keys], pdf[row_id], pdf[voice], pdf[kind]):
                if key != current:
                    rows += flush()
                    current, open_ = key, []
                if kd == "start":
                    open_.append((rid, v))
                    continue
                same = [i for i, (_, w) in enumerate(open_) if w == v or (pd.isna(w) and pd.isna(v))]
                at = same[-1] if same else 0 if len(open_) == 1 else None
                if at is not None:
                    rows.append((*key, open_.pop(at)[0], rid, "paired"))
                else:
                    rows.append((*key, None, rid, "ambiguous_cross_voice_tie_stop" if open_ else "tie_stop_without_start"))
            out = pd.DataFrame(rows, columns=cols)
            for c in ("start_id", "end_id"):
                out[c] = out[c].astype("Int64") if idtype in ("bigint", "int") else out[c]
            yield out
        tail = pd.DataFrame(flush(), columns=cols)
        for c in ("start_id", "end_id"):
            tail[c] = tail[c].astype("Int64") if idtype in ("bigint", "int") else tail[c]
        yield tail

    sorted_ = mixed.repartition(*keys).sortWithinPartitions(*keys, *order)
    return simple.unionByName(sorted_.mapInPandas(walk, schema))


# PR-03 -----------------------------------------------------------------
def span_marker(event_type, subtype, marker, number) -> Column:
    """struct(kind, marker, number) of an event that opens or closes a span, else NULL."""
    et, st = _c(event_type), _c(subtype)
    m = F.lower(F.coalesce(_c(marker), F.lit("")))
    n = F.coalesce(_c(number), F.lit("1"))
    kind = F.when(st.isin("tie", "tied"), "tie").when(st == "slur", "slur")
    note_mark = F.when(kind.isNotNull() & m.isin("start", "stop", "continue"), F.struct(kind.alias("kind"), m.alias("marker"), n.alias("number")))
    closes = F.when(st == "pedal", m.isin("stop", "change")).otherwise(m == "stop")
    direction = F.when(
        (et == "direction") & st.isin("wedge", "octave-shift", "pedal"),
        F.struct(st.alias("kind"), F.when(closes, "stop").otherwise("start").alias("marker"), n.alias("number")))
    return F.coalesce(note_mark, direction)


def build_spans(events: DataFrame, order: str = "seq", cells=()) -> DataFrame:
    """Whole-score spans (slur, tie, wedge, octave-shift, pedal) with their anchors.

    events: score_id, xml_event_id, seq, event_type, event_subtype, class, voice, staff, page,
    xml_measure, start_meas, end_meas, start_note, end_note, midi_pitch, attributes map,
    anchors array. A tie coded twice at one anchor counts once; "continue" marks are skipped.
    """
    m = span_marker("event_type", "event_subtype", F.try_element_at("attributes", F.lit("type")), F.try_element_at("attributes", F.lit("number")))
    e = events.withColumn("__m", m)
    notes = events.where("event_type = 'note'").select(
        "score_id", F.col("xml_event_id").alias("__aid"), F.struct("start_meas", "end_meas", "start_note", "end_note", "midi_pitch").alias("__anchor"))
    e = e.where("__m is not null").withColumn("__aid", F.get("anchors", F.lit(0))).join(notes, ["score_id", "__aid"], "left")
    e = e.select("*", "__m.kind", "__m.marker", "__m.number")
    ties = e.where("kind = 'tie'").withColumn("__who", F.to_json(F.struct("anchors")))
    w = Window.partitionBy("score_id", "__who", "marker", "number").orderBy(order)
    ties = ties.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__who")
    e = e.where("kind <> 'tie'").unionByName(ties).where("marker <> 'continue'")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scope = (
        F.when(F.col("kind") == "tie", F.concat_ws("|", text("staff"), text("voice"), F.coalesce(F.col("__anchor.midi_pitch").cast("string"), F.lit(""))))
        .when(F.col("kind") == "slur", text("voice")).otherwise(text("staff")))
    e = settle(e.withColumn("scope", scope))
    keys = ["score_id", "kind", "scope", "number"]
    pairs = pair_lifo(e, keys, [order], order, "marker", cells)
    a = e.select(*keys, F.col(order).alias("start_id"), F.struct("*").alias("__s"))
    b = e.select(*keys, F.col(order).alias("end_id"), F.struct("*").alias("__e"))
    out = pairs.join(a, [*keys, "start_id"], "left").join(b, [*keys, "end_id"], "left")
    s, t = F.col("__s"), F.col("__e")
    paired = F.col("status") == "paired"
    sn, en = s["__anchor"]["start_note"], t["__anchor"]["end_note"]
    return out.select(
        "score_id", F.coalesce(s["class"], t["class"]).alias("class"), F.col("kind").alias("span_type"), "number",
        s["xml_event_id"].alias("start_xml_event_id"), t["xml_event_id"].alias("end_xml_event_id"),
        F.when(paired, F.coalesce(s["__anchor"]["start_meas"], s["start_meas"])).otherwise(s["start_meas"]).alias("start_meas"),
        F.when(paired, F.coalesce(t["__anchor"]["end_meas"], t["end_meas"])).otherwise(t["end_meas"]).alias("end_meas"),
        F.when(paired, sn).alias("start_note"), F.when(paired, en).alias("end_note"),
        F.when(paired, F.array_compact(F.array(sn, en))).alias("connected_note"),
        s["page"].alias("start_page"), t["page"].alias("end_page"), s["xml_measure"].alias("start_xml_measure"), t["xml_measure"].alias("end_xml_measure"),
        s["staff"].alias("start_staff"), t["staff"].alias("end_staff"), F.coalesce(s["voice"], t["voice"]).alias("voice"),
        F.when(paired, ~s["page"].eqNullSafe(t["page"])).alias("cross_page"), "status", F.coalesce(F.col("start_id"), F.col("end_id")).alias("span_order"))


# PR-04 -----------------------------------------------------------------
def fingerprints(items: DataFrame, keys, order, token: Column, cells=()) -> DataFrame:
    """Order-sensitive digest of a group's tokens: keys, items, fingerprint.

    Each (position, token) is hashed and the 120 bits are summed, so the digest is built with
    partial sums and no group is collected.
    """
    keys = list(keys)
    d = number_rows(items.withColumn("__tok", token), keys, order, "__pos", cells)
    h = F.md5(F.concat_ws("|", F.col("__pos").cast("string"), "__tok"))
    part = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(20,0)")
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.sum(part(1)).alias("__a"), F.sum(part(16)).alias("__b")
    ).select(*keys, "items", F.concat_ws(":", F.col("items").cast("string"), F.col("__a").cast("string"), F.col("__b").cast("string")).alias("fingerprint"))


def note_token() -> Column:
    """Token of a pitched note: pitch, staff, chord and grace flags; durations and rests play no part."""
    return F.concat_ws(":", "step", F.coalesce("alter", F.lit(0)).cast("string"), F.col("octave").cast("string"),
                       F.coalesce("staff", F.lit("1")), F.col("is_chord").cast("string"), F.col("is_grace").cast("string"))


# PR-05 -----------------------------------------------------------------
def match_blocks(a: DataFrame, b: DataFrame, group, pos: str = "pos", token: str = "token", cells=()) -> DataFrame:
    """All maximal common runs of two sequences: group, a_start, b_start, length.

    Only the first and last pair of each run leave the join (the neighbours are compared
    inside it); the k-th start of a diagonal goes with its k-th end.
    """
    group = list(group)

    def around(df, p):
        d = shift(df.select(*group, pos, token), group, [pos], {f"{p}prev": F.col(token)}, cells)
        d = shift(d, group, [pos], {f"{p}next": F.col(token)}, cells, ahead=True)
        return d.withColumnRenamed(pos, f"{p}pos")

    x, y = around(a, "a"), around(b, "b")
    both = x.join(y, [*group, token])
    diag = F.col("bpos") - F.col("apos")
    first = both.where(F.col("aprev").isNull() | F.col("bprev").isNull() | (F.col("aprev") != F.col("bprev")))
    last = both.where(F.col("anext").isNull() | F.col("bnext").isNull() | (F.col("anext") != F.col("bnext")))
    s = number_rows(first.select(*group, diag.alias("__d"), "apos", "bpos"), [*group, "__d"], ["apos"], "__k")
    t = number_rows(last.select(*group, diag.alias("__d"), F.col("apos").alias("__end")), [*group, "__d"], ["__end"], "__k")
    return s.join(t, [*group, "__d", "__k"]).select(
        *group, F.col("apos").alias("a_start"), F.col("bpos").alias("b_start"), (F.col("__end") - F.col("apos") + 1).alias("length"))


# PR-06 -----------------------------------------------------------------
def align_sequences(a: DataFrame, b: DataFrame, group, pos: str = "pos", token: str = "token", small: int = 20_000) -> DataFrame:
    """Map every position of b to a position of a: longest run first, then left and right of it,
    then again inside each gap of b over the whole of a until nothing is added.

    Positions count from 0; ties go to the earliest in a, then in b. Groups of up to `small`
    common runs are settled inside one task from those runs alone. Larger groups run as
    rounds that settle the longest run of every open range at once. Returns group, pos,
    mapped (NULL if none).
    """
    group = list(group)
    base = match_blocks(a, b, group, pos, token)
    size = base.groupBy(*group).agg(F.count(F.lit(1)).alias("__runs"))
    base = settle(base.join(size, group))
    schema = ", ".join([*(f"`{g}` {a.schema[g].dataType.simpleString()}" for g in group), f"`{pos}` bigint", "mapped bigint"])

    def solve(pdf):
        pairs = _settle_runs(list(zip(pdf["length"], pdf["a_start"], pdf["b_start"])))
        out = pd.DataFrame(pairs, columns=[pos, "mapped"])
        for g in group:
            out[g] = pdf[g].iloc[0]
        return out[[*group, pos, "mapped"]]

    done = base.where(F.col("__runs") <= small).drop("__runs").groupBy(*group).applyInPandas(solve, schema)
    big = base.where(F.col("__runs") > small).drop("__runs")
    if not big.isEmpty():
        done = done.unionByName(_align_rounds(big, b.join(big.select(*group).distinct(), group, "left_semi"), group, pos))
    return b.select(*group, pos).join(done, [*group, pos], "left")


def _settle_runs(runs):
    """Longest-run choice over one group's common runs (length, a, b): list of (b position, a position)."""
    runs = [tuple(int(v) for v in r) for r in runs]
    mapped = {}
    end = max((b + n for n, _, b in runs), default=0)
    while True:
        before, lo = len(mapped), 0
        while lo < end:
            if lo in mapped:
                lo += 1
                continue
            hi = lo
            while hi < end and hi not in mapped:
                hi += 1
            todo = [[(min(b + n, hi) - max(b, lo), a + max(0, lo - b), max(b, lo)) for n, a, b in runs if b < hi and b + n > lo]]
            while todo:
                live = todo.pop()
                if not live:
                    continue
                n0, a0, b0 = max(live, key=lambda r: (r[0], -r[1], -r[2]))
                mapped.update((b0 + i, a0 + i) for i in range(n0))
                left = [(min(n, a0 - a, b0 - b), a, b) for n, a, b in live]
                right = [(n - c, a + c, b + c) for n, a, b in live for c in [max(0, a0 + n0 - a, b0 + n0 - b)]]
                todo += [[r for r in left if r[0] > 0], [r for r in right if r[0] > 0]]
            lo = hi
        if len(mapped) == before:
            return sorted(mapped.items())


def _align_rounds(base: DataFrame, b: DataFrame, group, pos) -> DataFrame:
    cells = base.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1))).select(
        *group, F.col("a_start").alias("__ba"), F.col("b_start").alias("__bb"), (F.col("b_start") + F.col("__i")).alias(pos))
    cells = settle(cells)
    mapped = settle(b.select(*group, pos).withColumn("mapped", F.lit(None).cast("bigint")))
    while True:
        gaps = _open_gaps(mapped, group, pos)
        live = cells.join(gaps, [*group, pos]).groupBy(*group, F.col("__gap").cast("string").alias("rid"), "__ba", "__bb").agg(
            F.min(pos).alias("pb"), F.count(F.lit(1)).alias("len")).select(*group, "rid", (F.col("__ba") + F.col("pb") - F.col("__bb")).alias("pa"), "pb", "len")
        found = _longest_first(live, group)
        if found is None:
            return mapped.where("mapped is not null")
        new = found.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1))).select(
            *group, (F.col("pb") + F.col("__i")).alias(pos), (F.col("pa") + F.col("__i")).alias("__new"))
        mapped = settle(mapped.join(new, [*group, pos], "left").select(*group, pos, F.coalesce("mapped", "__new").alias("mapped")))


def _open_gaps(mapped, group, pos) -> DataFrame:
    """Unmapped positions with the first position of their run."""
    d = shift(mapped, group, [pos], {"__pm": F.col("mapped"), "__pp": F.col(pos)})
    start = F.when(F.col("mapped").isNull() & (F.col("__pp").isNull() | F.col("__pm").isNotNull()), F.col(pos))
    d = scan(d, group, [pos], [Fold("__gap", "last", start)])
    return d.where("mapped is null").select(*group, pos, "__gap")


def _longest_first(live: DataFrame, group) -> DataFrame | None:
    """Recursive longest-run choice inside every range at once."""
    live, out = settle(live), None
    while not live.isEmpty():
        best = live.groupBy(*group, "rid").agg(F.max(F.struct("len", (-F.col("pa")).alias("na"), (-F.col("pb")).alias("nb"))).alias("m"))
        best = settle(best.select(*group, "rid", (-F.col("m.na")).alias("a0"), (-F.col("m.nb")).alias("b0"), F.col("m.len").alias("l0")))
        step = best.select(*group, F.col("a0").alias("pa"), F.col("b0").alias("pb"), F.col("l0").alias("len"))
        out = step if out is None else out.unionByName(step)
        j = live.join(best, [*group, "rid"])
        left = F.least(F.col("len"), F.col("a0") - F.col("pa"), F.col("b0") - F.col("pb"))
        cut = F.greatest(F.lit(0), F.col("a0") + F.col("l0") - F.col("pa"), F.col("b0") + F.col("l0") - F.col("pb"))
        parts = F.array(
            F.struct(F.concat("rid", F.lit("l")).alias("rid"), F.col("pa").alias("pa"), F.col("pb").alias("pb"), left.alias("len")),
            F.struct(F.concat("rid", F.lit("r")).alias("rid"), (F.col("pa") + cut).alias("pa"), (F.col("pb") + cut).alias("pb"), (F.col("len") - cut).alias("len")))
        live = settle(j.select(*group, F.explode(parts).alias("p")).select(*group, "p.*").where("len > 0"))
    return out


# PR-07 -----------------------------------------------------------------
def fill_bounded_gaps(mapped: DataFrame, group, pos: str = "pos", value: str = "mapped", cells=()) -> DataFrame:
    """Fill a gap only when as many positions are missing as indices lie between its two anchors."""
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    d = scan(mapped, group, [pos], [Fold("__l", "last", at), Fold("__r", "first", at)], cells)
    fits = F.col("__r.v") - F.col("__l.v") == F.col("__r.p") - F.col("__l.p")
    fill = F.when(F.col(value).isNull() & fits, F.col("__l.v") + F.col(pos) - F.col("__l.p"))
    method = F.when(F.col(value).isNotNull(), "matched_fingerprint").when(fill.isNotNull(), "matched_contextual").otherwise("unresolved")
    return d.withColumns({"mapping_status": method, value: F.coalesce(F.col(value), fill)}).drop("__l", "__r")


# PR-08 -----------------------------------------------------------------
def repeat_rows(mapped: DataFrame, group, pos: str = "pos", value: str = "mapped", cells=(), value_cells=()) -> DataFrame:
    """Occurrence number and count per written index, and a group id per run of repeated indices."""
    group = list(group)
    have = number_rows(mapped.where(F.col(value).isNotNull()), [*group, value], [pos], "repeat_occurrence", cells)
    counts = have.groupBy(*group, value).agg(F.count(F.lit(1)).alias("repeat_occurrence_count"))
    rep = shift(counts.where("repeat_occurrence_count > 1"), group, [value], {"__p": F.col(value)}, value_cells)
    start = F.when(F.col("__p").isNull() | (F.col(value) != F.col("__p") + 1), 1)
    rep = scan(rep, group, [value], [Fold("__g", "sum", start)], value_cells).select(*group, value, F.format_string("R%02d", "__g").alias("repeat_group_id"))
    done = have.join(counts, [*group, value]).join(rep, [*group, value], "left").withColumn("is_repeated", F.col("repeat_occurrence_count") > 1)
    return done.unionByName(mapped.where(F.col(value).isNull()), allowMissingColumns=True)


# PR-09 -----------------------------------------------------------------
def expand_occurrences(events: DataFrame, repeat_map: DataFrame, key, written: str, fallback: bool = True) -> DataFrame:
    """One row per event and performance of its measure, with the time recomputed.

    events: key, written index, within, duration_measures, timeline_offset. repeat_map: key,
    written index, unfolded_index, repeat_occurrence, repeat_occurrence_count,
    repeat_group_id, mapping_status. Events without a mapping keep their written time
    (status written_fallback) or, with fallback off, are left out.
    """
    key = list(key)
    out = events.join(repeat_map, [*key, written], "left" if fallback else "inner")
    lone = F.col("unfolded_index").isNull()
    index = F.coalesce(F.col("unfolded_index"), F.col(written))
    start = index - 1 + F.col("timeline_offset") + F.col("within")
    return out.withColumns({
        "mapping_status": F.when(lone, "written_fallback").otherwise(F.col("mapping_status")),
        "repeat_occurrence": F.coalesce("repeat_occurrence", F.lit(1)), "repeat_occurrence_count": F.coalesce("repeat_occurrence_count", F.lit(1)),
        "unfolded_index": index, "start_meas": start, "end_meas": start + F.col("duration_measures")})


def first_occurrence(expanded: DataFrame, event_id, cols) -> DataFrame:
    """Scalar columns of the first performance of each event."""
    pick = F.min_by(F.struct(*cols), F.struct("repeat_occurrence", "unfolded_index")).alias("__f")
    return expanded.groupBy(*event_id).agg(pick).select(*event_id, "__f.*")


# PR-10 -----------------------------------------------------------------
def zip_clamped(a, b) -> Column:
    """Pairs (first, second) of two lists; the shorter one repeats its last item; an empty one gives NULL."""
    a, b = _c(a), _c(b)
    n = F.greatest(F.size(a), F.size(b))
    at = lambda x, i: F.when(F.size(x) > 0, F.get(x, F.least(i, F.size(x)) - 1))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("occurrence"), at(a, i).alias("first"), at(b, i).alias("second")))
    return F.when(n > 0, pairs).otherwise(F.slice(F.transform(F.sequence(F.lit(1), F.lit(1)), lambda i: F.struct(i.alias("occurrence"), at(a, i).alias("first"), at(b, i).alias("second"))), 1, 0))


# PR-11 -----------------------------------------------------------------
OCCURRENCE = (
    "array<struct<repeat_occurrence:int,repeat_occurrence_count:int,repeat_group_id:string,start_meas:string,end_meas:string,"
    "bps_time:string,start_note:string,end_note:string,note_id:string>>"
)


def expand_timeline(df: DataFrame, occurrences: str, source_type: str, record_id: str) -> DataFrame:
    """One scalar row per performance of a record; occurrence fields fall back to the record's own."""
    occ = F.from_json(F.col(occurrences), OCCURRENCE)
    d = df.withColumn("__occ", occ).select("*", F.posexplode_outer("__occ").alias("__i", "__o"))
    o = F.col("__o")
    own = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    new = {
        "source_record_type": F.lit(source_type), "record_id": F.col(record_id).cast("string"),
        "occurrence": F.coalesce(o["repeat_occurrence"], F.col("__i") + 1, F.lit(1)),
        "occurrence_count": F.coalesce(o["repeat_occurrence_count"], F.when(F.size("__occ") > 0, F.size("__occ")), F.lit(1)),
        "repeat_group_id": F.coalesce(o["repeat_group_id"], own("repeat_group_id")),
        "start_meas": F.coalesce(o["start_meas"], o["bps_time"], own("start_meas")), "end_meas": F.coalesce(o["end_meas"], o["bps_time"], own("end_meas")),
        "start_note": F.coalesce(o["start_note"], o["note_id"], own("start_note")), "end_note": F.coalesce(o["end_note"], o["note_id"], own("end_note")),
    }
    return d.withColumns(new).drop("__occ", "__i", "__o", occurrences)
