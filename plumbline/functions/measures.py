"""Measurement text: OCR repair, units, scales, dimensions and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that OCR takes for digits.
OCR_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8", "Z": "2", "G": "6"}
# Millimetres in a unit, and other spellings of units.
TO_MM = {"mm": 1.0, "cm": 10.0, "dm": 100.0, "m": 1000.0, "km": 1_000_000.0, "in": 25.4, "inch": 25.4, '"': 25.4, "ft": 304.8, "feet": 304.8, "'": 304.8, "yd": 914.4, "yard": 914.4}
ALIASES = {
    "millimeter": "mm", "millimetre": "mm", "millimeters": "mm", "centimeter": "cm", "centimetre": "cm", "centimeters": "cm", "meter": "m", "metre": "m",
    "meters": "m", "kilometer": "km", "kilometre": "km", "inch": "in", "inches": "in", "foot": "ft", "feet": "ft", "yard": "yd", "yards": "yd", "mm.": "mm",
    "mm,": "mm", "m.": "m", "m,": "m",
}
# Millimetres in the drawing unit of a code.
INSUNITS = {0: 1.0, 1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0, 7: 1_000_000.0, 10: 914.4, 13: 0.001, 14: 100.0}
# Codes of drawing units by name, millimetres in a point and in a pixel of a page at scale 1.
UNIT_CODES = {"mm": 4, "m": 6, "in": 1, "ft": 2}
PAGE_UNITS = {"pt": 0.3528, "px": 25.4 / 300}
# Denominators of drawing scales, and types of dimensions by code.
DENOMINATORS = (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000)
DIMENSION_TYPES = {32: "LINEAR", 33: "ALIGNED", 35: "ANGULAR", 36: "DIAMETER", 37: "RADIUS", 38: "ORDINATE", 160: "ARC_LENGTH"}
# Confidences of scales from a title block, from one not to scale, from the header and from a measured length near or off a standard scale.
SCALE_TEXT, SCALE_NTS, SCALE_HEADER, SCALE_NEAR, SCALE_OFF, NEAR_STANDARD = 0.90, 0.85, 0.70, 0.80, 0.60, 0.05
# A number with its unit.
VALUE_WITH_UNIT = r"(?i)(-?\d+(?:[.,]\d+)?)\s*(mm|cm|dm|m(?!m)|km|in(?:ch(?:es)?)?|ft|feet|foot|yd|yard(?:s)?|\"|')\b"
#: Degrees by which a line may be off its axis.
AXIS_TOLERANCE = 3.0


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def ocr_corrected(text: Column) -> Column:
    """Letters next to a digit of the original text become the digit they look like; repairs don't chain."""
    chars = F.split(text, "")
    digit = lambda c: F.coalesce(c.rlike("^[0-9]$"), F.lit(False))
    table = _map(OCR_DIGITS)
    return F.transform(F.array(chars), lambda a: F.array_join(F.transform(a, lambda c, i: F.when((digit(F.get(a, i - 1)) & (i > 0)) | digit(F.get(a, i + 1)), F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), ""))[0]


def unit_name(unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    return F.coalesce(F.try_element_at(_map(ALIASES), u), u)


def to_mm(value: Column, unit: Column) -> Column:
    """A length in millimetres; null for an unknown unit."""
    return value * F.try_element_at(_map(TO_MM), unit_name(unit))


def from_mm(mm: Column, unit: Column) -> Column:
    """A length of millimetres in `unit`; null for an unknown unit."""
    return mm / F.try_element_at(_map(TO_MM), unit_name(unit))


def imperial_mm(whole: Column, numerator: Column, denominator: Column) -> Column:
    """Millimetres of whole inches and a fraction; null over zero."""
    return (whole + numerator / F.nullif(denominator, F.lit(0))) * TO_MM["in"]


def value_with_unit(text: Column) -> Column:
    """Struct (mm, unit) of the first number with a unit, a comma read as a point; null without one."""
    unit = unit_name(F.regexp_extract(text, VALUE_WITH_UNIT, 2))
    value = F.regexp_replace(F.regexp_extract(text, VALUE_WITH_UNIT, 1), ",", ".").try_cast("double")
    return F.when(text.rlike(VALUE_WITH_UNIT), F.struct(to_mm(value, unit).alias("mm"), unit.alias("unit")))


def insunits_factor(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(INSUNITS), code.cast("int")), F.lit(1.0))


def scale_denominator(text: Column) -> Column:
    """n of `1:n` or `1/n`, else of `1=n`; null without one, or where the text says not to scale."""
    colon = F.regexp_extract(text, r"1\s*[:/]\s*(\d{1,6})", 1)
    equal = F.regexp_extract(text, r"1\s*=\s*(\d{1,6})", 1)
    n = F.coalesce(F.nullif(colon, F.lit("")), F.nullif(equal, F.lit(""))).cast("int")
    return F.when(~not_to_scale(text) & (n > 0), n)


def not_to_scale(text: Column) -> Column:
    return text.rlike(r"(?i)\bNTS\b|not\s+to\s+scale")


def dimension_values_mm(text: Column) -> Column:
    """Millimetres of each `n mm` in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?)\s*mm\b"), F.lit(1)), lambda x: x.cast("double"))


def dimension_pairs_mm(text: Column) -> Column:
    """[width, height] of each `a x b mm` in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)[0-9]+(?:\.[0-9]+)?\s*[x×]\s*[0-9]+(?:\.[0-9]+)?\s*mm\b"), F.lit(0))
    return F.transform(found, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda v: v.cast("double")))


def line_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def line_orientation(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """HORIZONTAL or VERTICAL within three degrees, else DIAGONAL."""
    angle = F.degrees(F.atan2(F.abs(y1 - y0), F.abs(x1 - x0)))
    return F.when(angle <= AXIS_TOLERANCE, "HORIZONTAL").when(angle >= 90 - AXIS_TOLERANCE, "VERTICAL").otherwise("DIAGONAL")


def output_status(found: Column, conflict: Column, confidence: Column, spec: Column) -> Column:
    return F.when(~found, "NOT_FOUND").when(conflict, "CONFLICT").when(confidence < 0.75, "LOW_CONFIDENCE").when(spec, "MATCH").otherwise("NO_SPEC")


def _scale(denominator: Column, source: str, confidence: Column, mm_per_unit: Column, nts: Column) -> Column:
    columns = {"denominator": denominator.cast("int"), "source": F.lit(source), "confidence": confidence, "mm_per_unit": mm_per_unit.cast("double"), "nts": nts}
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def text_scale(texts: Column, unit: str = "mm") -> Column:
    """Scale struct of the first of an array of texts that names one or says not to scale; null without any."""
    factor = INSUNITS[UNIT_CODES.get(unit, 4)]
    first = F.get(F.filter(texts, lambda t: F.coalesce(not_to_scale(t), F.lit(False)) | scale_denominator(t).isNotNull()), F.lit(0))

    def said(text: Column) -> Column:
        nts, n = not_to_scale(text), scale_denominator(text)
        return F.when(nts, _scale(F.lit(1), "TITLEBLOCK", F.lit(SCALE_NTS), F.lit(1.0), F.lit(True))).when(n.isNotNull(), _scale(n, "TITLEBLOCK", F.lit(SCALE_TEXT), factor / n, F.lit(False)))

    return F.transform(F.array(first), said)[0]


def header_scale(code: Column) -> Column:
    """Scale struct of a drawing that only says its unit: full size."""
    return _scale(F.lit(1), "HEADER", F.lit(SCALE_HEADER), insunits_factor(code), F.lit(False))


def empirical_scale(length: Column, annotated_mm: Column, code: Column) -> Column:
    """Scale struct from a drawn length and the millimetres written at it, at the nearest standard denominator (the smaller on a
    tie); null unless both are positive."""
    ratio = annotated_mm / (length * insunits_factor(code))
    nearest = F.array_min(F.transform(F.array(*[F.lit(n) for n in DENOMINATORS]), lambda n: F.struct(F.abs(n - ratio).alias("off"), n.alias("n"))))
    snapped = lambda s: _scale(s["n"], "EMPIRICAL", F.when(s["off"] / s["n"] < NEAR_STANDARD, SCALE_NEAR).otherwise(SCALE_OFF), insunits_factor(code) / s["n"], F.lit(False))
    return F.when((length > 0) & (annotated_mm > 0), F.transform(F.array(nearest), snapped)[0])


def detected_scale(texts: Column, code: Column, length: Column, annotated_mm: Column, known_length: Column, known_mm: Column, unit: str = "mm") -> Column:
    """Scale struct: what the texts say, else of a dimension, else of a known length, else of the header's unit."""
    return F.coalesce(text_scale(texts, unit), empirical_scale(length, annotated_mm, code), empirical_scale(known_length, known_mm, code), header_scale(code))


def scale_check(mm_per_unit: Column, unit: Column, length: Column, annotated_mm: Column, tolerance: float = 0.05) -> Column:
    """Struct (consistent, deviation) of a scale against a dimension; deviation 1 where nothing can be foretold."""
    named = F.coalesce(F.try_element_at(_map(UNIT_CODES), unit), F.lit(UNIT_CODES["mm"]))
    foretold = length * mm_per_unit * insunits_factor(named)
    off = F.when((length > 0) & (foretold != 0), F.abs(foretold - annotated_mm) / F.nullif(annotated_mm, F.lit(0.0)))
    return F.struct(F.coalesce(off <= tolerance, F.lit(False)).alias("consistent"), F.coalesce(off, F.lit(1.0)).alias("deviation"))


def page_scale(denominator: Column, mm_per_unit: Column, unit: Column) -> Column:
    """Millimetres a page unit: pixels by the denominator, points only where no unit was known (1), others unchanged."""
    size = F.try_element_at(_map(PAGE_UNITS), unit) / F.greatest(denominator, F.lit(1))
    return F.when((unit == "px") | (unit == "pt") & (mm_per_unit == 1), size).otherwise(mm_per_unit)


def resolved_dimension(override: Column, length: Column, factor: Column, code: Column) -> Column:
    """Struct (value_mm, raw_text, kind) of a dimension entity; null without a value.

    The override's number, or the first in it, counts; one that is empty or `<>` gives way to the measured length. Without a
    length the override is in drawing units. Unknown codes are LINEAR.
    """
    said, measured = F.coalesce(F.trim(override), F.lit("")), F.coalesce(length, F.lit(0.0))
    bare = F.trim(F.replace(said, F.lit("<>"), F.lit("")))
    whole = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    run = F.regexp_extract(bare, r"[\d.]+", 0)
    named = (said != "") & (said != "<>") & (whole.isNotNull() | (run != ""))
    number = F.coalesce(whole, run.try_cast("double"))
    value = F.when(named, F.when(measured == 0, number * factor).otherwise(number)).when(measured > 0, measured * factor)
    kind = F.coalesce(F.try_element_at(_map(DIMENSION_TYPES), F.coalesce(code, F.lit(0)).bitwiseAND(255)), F.lit("LINEAR"))
    return F.when(value.isNotNull(), F.struct(value.alias("value_mm"), F.when(named, said).otherwise((measured * factor).cast("string")).alias("raw_text"), kind.alias("kind")))
