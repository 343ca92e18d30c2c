"""Callouts in drawing texts: the text patterns, their values in millimetres, qualifiers and annotations, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measures import TO_MM, _map, ocr_corrected, unit_name

# Patterns of callouts, in the order they are tried, regardless of case.
PATTERNS = {
    "dim_3d": r"(\d+(?:\.\d+)?)\s*[xX×]\s*(\d+(?:\.\d+)?)\s*[xX×]\s*(\d+(?:\.\d+)?)(?:\s*(mm|cm|m|in|inch|\"|ft|'|yd))?(?:\b|$)",
    "dim_2d": r"(\d+(?:\.\d+)?)\s*[xX×\*]\s*(\d+(?:\.\d+)?)(?:\s*(mm|cm|m|in|inch|\"|ft|'|yd))?(?:\b|$)",
    "dim_mm": r"(\d+(?:\.\d+)?)\s*(mm)(?:\b|$)",
    "dim_m": r"(\d+(?:\.\d+)?)\s*(m)(?!m)(?:\b|$)",
    "dim_inch": r"(\d+(?:\.\d+)?)\s*(\"|in(?:ch(?:es)?)?)(?:\b|$)",
    "dim_feet": r"(\d+(?:\.\d+)?)\s*(ft|feet|')(?:\b|$)",
    "thickness": r"(?:thk|thkns|thick|thickness)\.?\s*[=:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|inch|\"|ft|'|yd)?",
    "t_equals": r"\bt\s*=\s*(\d+(?:\.\d+)?)\s*(mm|cm|m)?",
    "spacing_cc": r"@\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|inch|\")?\s*(?:c/?c|cts|ctrs)",
    "spacing_at": r"@\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|inch|\")?",
    "diameter": r"[ØøΦφ⌀]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "dia_prefix": r"(?:dia)\.?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "depth": r"(?:depth|dp)\s*[=:\-]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "height": r"(?:height|ht|hgt)\s*[=:\-]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "width": r"(?:width|wid|wd)\s*[=:\-]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "min_dim": r"(?:min\.?|minimum)\s*[=:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "max_dim": r"(?:max\.?|maximum)\s*[=:\-]?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|\")?",
    "fraction": r"(\d+)\s+(\d+)/(\d+)",
    "alloy": r"(?:alloy|grade|temper|series)\s*[=:\-]?\s*([0-9A-Z][0-9A-Z\-T]{1,10})",
    "finish": r"(?:finish|coating|surface|anodis(?:e|ing)|powder(?:\s*coat)?)\s*[=:\-]?\s*([A-Z0-9][^\n,;]{0,30})",
    "count_nos": r"(\d+)\s*(?:nos?|pcs?|units?|no\.?)",
    "scale": r"(?:scale)\s*[=:\-]?\s*1\s*[:/]\s*(\d+)",
    "scale_ratio": r"\b1\s*:\s*(\d+)\b",
    "angle_deg": r"(\d+(?:\.\d+)?)\s*°",
    "angle_word": r"(\d+(?:\.\d+)?)\s*(?:deg|degrees?)",
    "typical": r"\b(?:typ(?:ical)?\.?)\b",
    "nts": r"\b(?:NTS|not\s+to\s+scale)\b",
}
# Units looked for around a number that has none, in this order.
UNITS_AROUND = ("mm", "cm", " m ", "in", "ft")
UNIT_WINDOW = 80
#: Group of a pattern's unit; its values are the groups before.
_UNIT_GROUP = {"dim_3d": 4, "dim_2d": 3}
_ANGLES, _BARE, _ANNOTATIONS = ("angle_deg", "angle_word"), ("count_nos", "scale", "scale_ratio"), ("alloy", "finish")
# Formatting codes of multi-line texts.
MTEXT_CODE = r"\\[AaBbCcFfHhIiLlNnOoPpQqSsTtWw][^;]*;|\\[UuOoLl]|\\~|\\P|\{\}"
MTEXT_CHARACTER = r"\\U\+([0-9A-Fa-f]{4})"

#: Fields of a match, in order.
MATCH = ("position", "pattern", "raw_text", "values", "unit", "mm_values", "qualifier", "annotation")


def _regex(name: str) -> str:
    return f"(?iu){PATTERNS[name]}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def plain_mtext(raw: Column) -> Column:
    """A text without its formatting codes, escaped characters decoded and white space made single. Null stays null."""
    codes, between = F.regexp_extract_all(raw, F.lit(MTEXT_CHARACTER), F.lit(1)), F.split(raw, MTEXT_CHARACTER, -1)
    decoded = F.array_join(F.zip_with(between, codes, lambda t, c: F.concat(t, F.coalesce(F.decode(F.unhex(c), "UTF-16BE"), F.lit("")))), "")
    bare = F.regexp_replace(F.regexp_replace(decoded, MTEXT_CODE, " "), "[{}]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _hits(text: Column, name: str) -> Column:
    """Array of (position, raw_text) of a pattern: a hit begins after all that lies between and in the hits before it."""
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s))

    def placed(hits: Column) -> Column:
        place = lambda between: F.transform(hits, lambda m, i: F.struct((total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(hits, F.lit(1), i))).alias("position"), m.alias("raw_text")))
        return F.when(F.size(hits) > 0, _let(F.split(text, _regex(name), -1), place)).otherwise(F.array().cast("array<struct<position:int,raw_text:string>>"))

    return _let(F.regexp_extract_all(text, F.lit(_regex(name)), F.lit(0)), placed)


def unit_around(text: Column, position: Column) -> Column:
    """The first known unit within 80 characters of a place, as a part of any word; null without one."""
    start = F.greatest(position - UNIT_WINDOW, F.lit(0))
    snippet = F.lower(F.substring(text, start + 1, position + UNIT_WINDOW - start))
    return F.coalesce(*[F.when(F.contains(snippet, F.lit(u)), F.lit(u.strip())) for u in UNITS_AROUND])


def _of(text: Column, name: str, qualifier: Column) -> Column:
    """The matches of one pattern, ranked (-length, order of the pattern), with their values and what they say of a unit.

    kind is `length` (in the unit said or one around), `inch`, `angle` or `bare`.
    """
    pattern, none = _regex(name), F.array().cast("array<double>")

    def match(h: Column) -> Column:
        group = lambda k: F.regexp_extract(h["raw_text"], pattern, k)
        number = lambda k: group(k).cast("double")
        values, kind, said, q, note = none, "bare", F.lit(""), qualifier, F.lit(None).cast("string")
        if name in _ANNOTATIONS:
            note = F.trim(group(1))
        elif name == "nts":
            q = F.lit("NTS")
        elif name == "fraction":
            values, kind = F.array(number(1) + number(2) / number(3)), "inch"
        elif name in _ANGLES:
            values, kind = F.array(number(1)), "angle"
        elif name in _BARE:
            values = F.array(number(1))
        else:
            at = _UNIT_GROUP.get(name, 2)
            values, kind, said = F.array(*[number(k) for k in range(1, at)]), "length", group(at)
            if name in ("min_dim", "max_dim"):
                q = F.lit(name[:3].upper())
        rank = -1 if name == "nts" else list(PATTERNS).index(name)
        return F.struct(
            h["position"].alias("position"), (-F.length(h["raw_text"])).alias("shorter"), F.lit(rank).alias("rank"), F.lit(name).alias("pattern"), h["raw_text"].alias("raw_text"),
            values.alias("values"), F.lit(kind).alias("kind"), said.alias("said"), q.alias("qualifier"), note.alias("annotation"),
        )

    hits = _hits(text, name)
    if name == "fraction":
        hits = F.filter(hits, lambda h: F.regexp_extract(h["raw_text"], pattern, 3).cast("double") > 0)
    return F.transform(F.slice(hits, 1, 1) if name == "nts" else hits, match)


def _measured(text: Column, m: Column) -> Column:
    """A match as a MATCH struct: its unit, and its values in millimetres (as they are in a unit that is not known)."""
    kind = m["kind"]
    near = F.when(kind == "length", F.coalesce(F.nullif(m["said"], F.lit("")), unit_around(text, m["position"]), F.lit("mm")))

    def form(unit: Column) -> Column:
        factor = F.when(kind == "angle", 1.0).when(kind != "bare", F.coalesce(F.try_element_at(_map(TO_MM), unit), F.lit(1.0)))
        mm = F.when(factor.isNull(), F.array().cast("array<double>")).otherwise(_let(factor, lambda f: F.transform(m["values"], lambda v: v * f)))
        columns = {"position": m["position"], "pattern": m["pattern"], "raw_text": m["raw_text"], "values": m["values"], "unit": unit, "mm_values": mm, "qualifier": m["qualifier"], "annotation": m["annotation"]}
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    return _let(F.when(kind == "length", unit_name(near)).when(kind == "inch", "in").when(kind == "angle", "deg").otherwise(""), form)


def without_overlaps(matches: Column) -> Column:
    """From left to right, the longest first at a place: matches that begin at or after the end of the last one kept."""
    start = F.struct(F.lit(-1).alias("end"), F.filter(matches, lambda m: F.lit(False)).alias("kept"))
    step = lambda a, m: F.when(m["position"] >= a["end"], F.struct((m["position"] + F.length(m["raw_text"])).alias("end"), F.array_append(a["kept"], m).alias("kept"))).otherwise(a)
    return F.aggregate(F.array_sort(matches), start, step, lambda a: a["kept"])


def text_matches(source: Column, is_ocr: bool = False) -> Column:
    """Array of structs of the fields MATCH: the callouts of a text, none overlapping another, in order of place. Null text: none.

    NTS comes before TYP; MIN and MAX qualify a text that has neither. A number without a unit takes the first unit around it,
    else millimetres. Angles stay degrees; counts and scales have no millimetres.
    """
    plain = F.coalesce(plain_mtext(source), F.lit(""))
    names = ("nts", *(p for p in PATTERNS if p not in ("nts", "typical")))

    def found(text: Column) -> Column:
        says = lambda n: text.rlike(_regex(n))
        qualifier = F.when(says("nts"), "NTS").when(says("typical"), "TYP").when(says("min_dim"), "MIN").when(says("max_dim"), "MAX")
        every = _let(qualifier, lambda q: F.flatten(F.array(*[_of(text, n, q) for n in names])))
        return F.transform(_let(every, without_overlaps), lambda m: _measured(text, m))

    return _let(ocr_corrected(plain) if is_ocr else plain, found)
