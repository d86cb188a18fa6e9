"""Box geometry, pitch arithmetic, positions and timeline arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c


# PRJ-08 -----------------------------------------------------------------
def box_pixels(df: DataFrame, width, height) -> DataFrame:
    w, h = _c(width), _c(height)
    return df.withColumns(
        {
            "center_x": F.col("x") * w,
            "center_y": F.col("y") * h,
            "width_px": F.col("w") * w,
            "height_px": F.col("h") * h,
            "left_px": (F.col("x") - F.col("w") / 2) * w,
            "right_px": (F.col("x") + F.col("w") / 2) * w,
            "top_px": (F.col("y") - F.col("h") / 2) * h,
            "bottom_px": (F.col("y") + F.col("h") / 2) * h,
        }
    )


def valid_box(x, y, w, h, allow_empty: bool = False) -> Column:
    """Normalised box inside the page; zero size passes only in the inventory rule."""
    x, y, w, h = map(_c, (x, y, w, h))
    size = (w >= 0) & (h >= 0) if allow_empty else (w > 0) & (h > 0)
    return F.coalesce(x.between(0, 1) & y.between(0, 1) & size & (w <= 1) & (h <= 1), F.lit(False))


# PRJ-06 -----------------------------------------------------------------
# Semitones above C, and the diatonic order of the steps.
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
DIATONIC = {"C": 0, "D": 1, "E": 2, "F": 3, "G": 4, "A": 5, "B": 6}
CLEF_REFERENCE = {"G": 32, "F": 24, "C": 28}
# End of fixed values.


def pitch_columns(df: DataFrame, step="step", alter="alter", octave="octave", repeat_sign=False) -> DataFrame:
    """MIDI number, spelled name and diatonic index; NULL step gives NULL columns."""
    from .classes import lookup

    s, a, o = _c(step), F.coalesce(_c(alter), F.lit(0)), F.coalesce(_c(octave), F.lit(4))
    if repeat_sign:
        sign = F.when(a > 0, F.repeat(F.lit("#"), a)).when(a < 0, F.repeat(F.lit("b"), -a)).otherwise("")
    else:
        sign = F.when(a == 1, "#").when(a == -1, "b").otherwise("")
    return df.withColumns(
        {
            "midi": (o + 1) * 12 + lookup(SEMITONES, s) + a,
            "pitch_name": F.concat(s, sign, o.cast("string")),
            "diatonic": o * 7 + lookup(DIATONIC, s),
        }
    )


def clef_middle(sign, line) -> Column:
    """Diatonic index of the middle staff line under a clef."""
    from .classes import lookup

    ref = F.coalesce(lookup(CLEF_REFERENCE, F.coalesce(_c(sign), F.lit("G"))), F.lit(32))
    return ref + (3 - F.coalesce(_c(line), F.lit(2))) * 2


# PRJ-09 -----------------------------------------------------------------
def clamp01(c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(c)))


def event_position(events: DataFrame, systems: DataFrame, measure_map: DataFrame, keys=("page_id", "system")) -> DataFrame:
    """x by the measure's own borders, else by the whole system; y from pitch and clef.

    events need: keys, system_measure_index, measure_x_norm, x_norm, staff, diatonic,
    clef_sign, clef_line. systems: keys, x_left, x_right, upper_center, lower_center,
    line_spacing. measure_map: keys, measure_index, left_x, right_x.
    """
    keys = list(keys)
    mm = measure_map.select(*keys, F.col("measure_index").alias("system_measure_index"), "left_x", "right_x")
    out = events.join(systems, keys, "left").join(mm, [*keys, "system_measure_index"], "left")
    local = F.col("left_x") + clamp01("measure_x_norm") * (F.col("right_x") - F.col("left_x"))
    whole = F.col("x_left") + F.col("x_norm") * (F.col("x_right") - F.col("x_left"))
    center = F.when(F.col("staff") == 1, F.col("upper_center")).otherwise(F.col("lower_center"))
    y = center - (F.col("diatonic") - clef_middle("clef_sign", "clef_line")) * F.col("line_spacing") / 2
    return out.withColumns({"px": F.coalesce(local, whole), "py": y})


# PRJ-10 -----------------------------------------------------------------
def timeline(df: DataFrame) -> DataFrame:
    """Timeline position of an event inside its measure.

    Needs onset, duration, nominal, measure_index, is_pickup (the score opens with a
    short measure), pickup (length of what is missing), divisions.
    """
    shift = F.when(F.col("measure_index") == 1, F.col("pickup")).otherwise(0.0)
    within = F.when(F.col("nominal") > 0, (shift + F.col("onset")) / F.col("nominal")).otherwise(0.0)
    length = F.when(F.col("nominal") > 0, F.col("duration") / F.col("nominal")).otherwise(0.0)
    offset = F.when(F.col("is_pickup"), 0).otherwise(1)
    start = F.col("measure_index") - 1 + offset + within
    return df.withColumns(
        {
            "timeline_offset": offset,
            "within": within,
            "duration_measures": length,
            "start_meas": start,
            "end_meas": start + length,
            "beat_position": F.when(F.col("divisions") > 0, 1 + (shift + F.col("onset")) / F.col("divisions")),
            "duration_quarters": F.when(F.col("divisions") > 0, F.col("duration") / F.col("divisions")),
        }
    )


def ticks(c, per_unit: int = 1000) -> Column:
    """Integer ticks, half away from zero; the one rounding rule used for keys."""
    return F.round(_c(c).cast("double") * per_unit).cast("bigint")


# PRJ-15 -----------------------------------------------------------------
def printed_measure(printed, xml_measure, start_meas) -> Column:
    """Displayed measure: explicit label, else the timeline measure when it is within one, else the XML label."""
    from .text import try_float, try_int

    explicit = F.trim(F.coalesce(_c(printed).cast("string"), F.lit("")))
    xml = F.trim(F.coalesce(_c(xml_measure).cast("string"), F.lit("")))
    line = try_float(start_meas).cast("bigint")
    near = F.abs(try_int(xml) - line) <= 1
    return F.when(explicit != "", explicit).when(near, line.cast("string")).otherwise(xml)


def note_label(measure, staff, pitch, order) -> Column:
    """Readable label of a note for a reviewer."""
    hand = F.when(_c(staff) == "1", "upper staff").when(_c(staff) == "2", "lower staff").otherwise(
        F.concat(F.lit("staff "), F.coalesce(_c(staff), F.lit("-")))
    )
    nth = F.coalesce(F.concat(F.lit("note "), _c(order).cast("string")), F.lit("note"))
    return F.concat_ws(
        " · ",
        F.concat(F.lit("measure "), F.coalesce(F.when(_c(measure) != "", _c(measure)), F.lit("-"))),
        hand,
        F.coalesce(_c(pitch), F.lit("pitch unknown")),
        nth,
    )


# PRJ-21 -----------------------------------------------------------------
def transfer_position(points: DataFrame, ref_map: DataFrame, tgt_map: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """Move x from a reference layout to a target layout, measure by measure.

    points: page, *keys (locating a measure), x. Maps: page, *keys, left_x, right_x.
    A point whose measure is missing or whose fraction lies outside -0.08..1.08 marks its
    whole page, which then keeps no transferred position (page_ok false).
    """
    r = ref_map.select(page, *keys, F.col("left_x").alias("_rl"), F.col("right_x").alias("_rr"))
    t = tgt_map.select(page, *keys, F.col("left_x").alias("_tl"), F.col("right_x").alias("_tr"))
    out = points.join(r, [page, *keys], "left").join(t, [page, *keys], "left")
    frac = F.when(F.col("_rr") > F.col("_rl"), (F.col("x") - F.col("_rl")) / (F.col("_rr") - F.col("_rl")))
    ok = F.coalesce(frac.between(-0.08, 1.08) & F.col("_tl").isNotNull(), F.lit(False))
    out = out.withColumns({"fraction": frac, "_ok": ok})
    pages = out.groupBy(page).agg(F.bool_and("_ok").alias("page_ok"))
    moved = F.col("_tl") + clamp01("fraction") * (F.col("_tr") - F.col("_tl"))
    return (
        out.join(pages, page, "left")
        .withColumn("x_target", F.when(F.col("page_ok"), moved))
        .drop("_rl", "_rr", "_tl", "_tr", "_ok")
    )
