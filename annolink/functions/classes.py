"""Class names: event classifier, rule families, thresholds, status recoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, camel_words

# They must equal the published class vocabulary.
NOTATION_NAMES = {
    "slur": "slur",
    "tie": "tie",
    "tied": "tie",
    "tuplet": "tuplet",
    "trill-mark": "ornamentTrill",
    "wavy-line": "ornamentWiggleTrill",
    "turn": "ornamentTurn",
    "inverted-turn": "ornamentTurnInverted",
}
SIDED_NOTATIONS = {
    "staccato": "articStaccato",
    "staccatissimo": "articStaccatissimo",
    "accent": "articAccent",
    "strong-accent": "articMarcato",
}
ATTRIBUTE_NAMES = {"clef": "xmlClef", "key": "xmlKeySignature", "time_signature": "xmlTimeSignature"}
TEMPO_WORDS = {
    "a tempo": "tempoATempo",
    "adagio": "tempoAdagio",
    "allegretto": "tempoAllegretto",
    "allegro": "tempoAllegro",
    "andante": "tempoAndante",
    "grave": "tempoGrave",
    "in tempo": "tempoInTempo",
    "largo": "tempoLargo",
    "moderato": "tempoModerato",
    "prestissimo": "tempoPrestissimo",
    "presto": "tempoPresto",
    "vivace": "tempoVivace",
}
POINT_RULES = [  # (class prefix, kind, mark); the first that fits wins
    ("articStaccatissimo", "articulation", "staccatissimo"),
    ("articStaccato", "articulation", "staccato"),
    ("articAccent", "articulation", "accent"),
    ("articMarcato", "articulation", "strong-accent"),
    ("fermata", "fermata", "fermata"),
    ("ornamentTrill", "ornament", "trill-mark"),
    ("ornamentShortTrill", "ornament", "trill-mark"),
    ("ornamentWiggleTrill", "ornament", "wavy-line"),
    ("ornamentTurnInverted", "ornament", "inverted-turn"),
    ("ornamentTurn", "ornament", "turn"),
]
SPAN_CLASSES = ["slur", "tie", "ottavaBracket", "keyboardPedalPed", "ornamentWiggleTrill"]
SPAN_PREFIXES = ["tuplet", "dynamicCrescendo", "dynamicDiminuendo"]
CLASS_NOTATIONS = {  # class -> notation marks it may stand for
    "articStaccatoAbove": ["staccato"],
    "articStaccatoBelow": ["staccato"],
    "articAccentAbove": ["accent"],
    "articAccentBelow": ["accent"],
    "articMarcatoAbove": ["strong-accent"],
    "articMarcatoBelow": ["strong-accent"],
    "fermataAbove": ["fermata"],
    "fermataBelow": ["fermata"],
    "slur": ["slur"],
    "tie": ["tied"],
    "tuplet3": ["tuplet"],
    "tuplet5": ["tuplet"],
    "tuplet6": ["tuplet"],
    "tupletBracket": ["tuplet"],
}
THRESHOLDS = {
    "fingering": 0.95,
    "slur": 0.82,
    "tie": 0.60,
    "articulation": 0.65,
    "fermata": 0.65,
    "tuplet": 0.60,
}
THRESHOLD_FAMILIES = [
    ("fingering", "fingering"), ("tuplet", "tuplet"), ("fermata", "fermata"), ("artic", "articulation"),
]
STATUS_DATASET = {"matched": "matched", "inferred": "candidate", "review": "ambiguous"}
STATUS_REVIEW = {"matched": "matched", "inferred": "ambiguous", "review": "ambiguous"}
BLOCKED_CLASSES = ["fingering1", "fingering2", "fingering3", "fingering4", "fingering5"]
# End of fixed values.


def const_map(values: dict) -> Column:
    """A constant table inside the expression: no join, no broadcast."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: dict, key) -> Column:
    return F.try_element_at(const_map(values), _c(key))


# PRJ-04 -----------------------------------------------------------------
def classify_event(event_type, subtype, placement, text, dynamic=None, marker=None) -> Column:
    """Readable class of an event from its type, subtype, side, text, dynamic and marker type."""
    et, st = _c(event_type), _c(subtype)
    side = F.lower(F.coalesce(_c(placement), F.lit("")))
    suffix = F.when(side == "above", "Above").when(side == "below", "Below").otherwise("")
    text = F.trim(F.coalesce(_c(text), F.lit("")))
    dyn = F.coalesce(_c(dynamic) if dynamic is not None else F.lit(""), F.lit(""))
    mark = F.coalesce(_c(marker) if marker is not None else F.lit(""), F.lit(""))

    notation = (
        F.when(lookup(SIDED_NOTATIONS, st).isNotNull(), F.concat(lookup(SIDED_NOTATIONS, st), suffix))
        .when(st == "fermata", F.concat(F.lit("fermata"), F.when(suffix == "", "Above").otherwise(suffix)))
        .otherwise(F.coalesce(lookup(NOTATION_NAMES, st), F.concat(F.lit("xmlNotation"), camel_words(st))))
    )
    plain = F.regexp_replace(F.lower(text), r"[. ]+$", "")
    words = (
        F.when(lookup(TEMPO_WORDS, plain).isNotNull(), lookup(TEMPO_WORDS, plain))
        .when(plain.rlike("^(rit|rall)"), "tempoRitardando")
        .when(plain.startswith("cresc"), "dynamicCrescendo")
        .when(plain.rlike("^(dim|decresc)"), "dynamicDiminuendo")
        .when(text != "", F.concat(F.lit("term"), camel_words(text)))
        .otherwise("xmlWords")
    )
    wedge = F.when(mark == "crescendo", "dynamicCrescendoHairpin").when(
        mark == "diminuendo", "dynamicDiminuendoHairpin"
    ).otherwise("dynamicHairpinStop")
    direction = (
        F.when(st == "dynamic", F.concat(F.lit("dynamic"), F.upper(dyn)))
        .when(st == "wedge", wedge)
        .when(st == "pedal", F.when(mark.isin("stop", "change"), "keyboardPedalUp").otherwise("keyboardPedalPed"))
        .when(st == "octave-shift", "ottavaBracket")
        .when(st == "words", words)
        .otherwise(F.concat(F.lit("xmlDirection"), camel_words(st)))
    )
    attribute = F.coalesce(lookup(ATTRIBUTE_NAMES, st), F.concat(F.lit("xml"), camel_words(st)))
    return (
        F.when(et.isin("note", "rest", "barline"), et)
        .when(et == "attribute", attribute)
        .when(et == "notation", notation)
        .when(et == "direction", direction)
        .otherwise(F.concat(F.lit("xml"), camel_words(et), camel_words(st)))
    )


# PRJ-05 -----------------------------------------------------------------
def class_rule(class_name, rules=POINT_RULES) -> Column:
    """struct(kind, mark) of the first rule whose prefix fits, else NULL."""
    c, out = _c(class_name), None
    for prefix, kind, mark in rules:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(mark).alias("mark"))
        out = F.when(c.startswith(prefix), value) if out is None else out.when(c.startswith(prefix), value)
    return out


def is_span_class(class_name) -> Column:
    c = _c(class_name)
    out = c.isin(SPAN_CLASSES)
    for prefix in SPAN_PREFIXES:
        out = out | c.startswith(prefix)
    return out


def allowed_notations(class_name) -> Column:
    table = F.create_map(
        *[x for k, v in CLASS_NOTATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    return F.coalesce(F.try_element_at(table, _c(class_name)), F.array().cast("array<string>"))


# PRJ-13 -----------------------------------------------------------------
def threshold_for(class_name, default: float, overrides: dict | None = None) -> Column:
    """Acceptance threshold: the class itself, then its family, then the default."""
    table = dict(THRESHOLDS)
    for name, value in (overrides or {}).items():
        if not 0 <= float(value) <= 1:
            raise ValueError(f"threshold for {name} must lie in [0, 1]")
        table[str(name)] = float(value)
    c = _c(class_name)
    family = None
    for prefix, name in THRESHOLD_FAMILIES:
        hit = F.lit(table[name])
        family = F.when(c.startswith(prefix), hit) if family is None else family.when(c.startswith(prefix), hit)
    return F.coalesce(lookup(table, c), family, F.lit(float(default)))


# PRJ-11 -----------------------------------------------------------------
def recode_status(status, table: dict = STATUS_DATASET, default: str = "unresolved") -> Column:
    return F.coalesce(lookup(table, status), F.lit(default))


# PRJ-07 -----------------------------------------------------------------
def explode_glyphs(df, symbol, letters: str = "fps"):
    """One row per kept letter of a composite symbol; the index counts kept letters only."""
    kept = F.regexp_extract_all(F.lower(_c(symbol)), F.lit(f"([{letters}])"), 1)
    return df.select("*", F.posexplode(kept).alias("component_index", "glyph"))
