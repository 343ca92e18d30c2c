"""Measurements of drawing sheets: the passes over dimensions, texts, line pairs, circles, spacings and schedules, in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry
from .scratch import broadcast_within
from .sheets import matched_texts

# Confidences of the passes, and factors to them.
DIMENSION, TEXT, ANNOTATION, SCHEDULE, PAIR, NAMELESS_PAIR, CIRCLE = 0.95, 0.72, 0.70, 0.65, 0.62, 0.48, 0.60
PATTERN_BASE, PATTERN_SPAN, PATTERN_CAP, PATTERN_FULL = 0.45, 0.20, 0.65, 10
UNKNOWN_SCALE, WITH_UNIT, WITHOUT_UNIT, CONTEXT_WORDS = 0.70, 1.05, 0.90, 10
# Context words of circles and spacings.
CIRCLE_WORDS = ("diameter", "circle")
SPACING_WORDS = {"HORIZONTAL": ("horizontal", "modulation", "bay", "spacing"), "VERTICAL": ("vertical", "floor", "storey", "spacing")}

FIELDS = ("sheet", "method", "value_mm", "unit", "confidence", "source_text", "x", "y", "direction", "qualifier", "annotation", "values_mm", "context_words")


def _form(rows: DataFrame, **columns: Column) -> DataFrame:
    """The common columns; those not given are null, the unit mm, the direction ANY."""
    words, numbers, place = F.array().cast("array<string>"), F.array().cast("array<double>"), F.lit(None).cast("double")
    usual = {"sheet": F.col("sheet"), "unit": F.lit("mm"), "source_text": F.lit(""), "x": place, "y": place, "direction": F.lit("ANY"), "qualifier": F.lit(None).cast("string"), "annotation": F.lit(None).cast("string"), "values_mm": numbers, "context_words": words}
    given = usual | columns
    return rows.select(*[given[f].alias(f) for f in FIELDS])


def _penalty() -> Column:
    return F.when(F.col("known"), 1.0).otherwise(UNKNOWN_SCALE).alias("penalty")


def _scaled(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Rows with mm_per_unit (1 where unknown) and the factor to confidences of their sheet."""
    known = broadcast_within(scales.select("sheet", "mm_per_unit", _penalty()), geometry.SCALE_ROWS)
    return rows.drop("mm_per_unit", "penalty").join(known, "sheet", "left").withColumn("mm_per_unit", F.coalesce(F.nullif("mm_per_unit", F.lit(0.0)), F.lit(1.0))).withColumn("penalty", F.coalesce("penalty", F.lit(UNKNOWN_SCALE)))


def _words(text: Column) -> Column:
    return F.slice(F.array_remove(F.split(text, r"\s+"), ""), 1, CONTEXT_WORDS)


def dimension_pass(dimensions: DataFrame, texts: DataFrame, scales: DataFrame) -> DataFrame:
    """Positive dimensions (sheet, dim_no, kind, value, x, y, def_x, def_y, length, override_text) with the words around them."""
    rows = _scaled(dimensions.where("value > 0").join(geometry.nearby_words(dimensions, texts), ["sheet", "dim_no"], "left"), scales)
    way = geometry.dimension_direction(*[F.col(c) for c in ("kind", "length", "x", "y", "def_x", "def_y")])
    return _form(rows, method=F.lit("DIMENSION_ENTITY"), value_mm=F.col("value"), confidence=DIMENSION * F.col("penalty"), x=F.col("x"), y=F.col("y"), direction=way, qualifier=geometry.override_qualifier(F.col("override_text")), context_words=F.col("words"))


def text_pass(texts: DataFrame, dimensions: DataFrame, lines: DataFrame, scales: DataFrame) -> DataFrame:
    """Callouts of texts (sheet, text_no, text, layer, x, y) that no dimension covers: lengths, and annotations at value 0.

    A pair of lines at that separation (in millimetres) near the text raises the confidence, on sheets of known scale. The
    direction is that of the nearest line, ANY where that is diagonal.
    """
    free = geometry.uncovered(texts, dimensions)
    found = matched_texts(free)
    found = _scaled(found.withColumn("value", F.get("m.mm_values", F.lit(0))).where("value > 0 or (size(m.mm_values) = 0 and m.annotation is not null)"), scales)
    values = F.when(F.size("m.mm_values") > 1, F.col("m.mm_values")).otherwise(F.array().cast("array<double>"))
    asked = F.when((F.col("value") > 0) & (F.col("penalty") == 1), F.col("value") / F.col("mm_per_unit"))
    slim = found.select("sheet", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text", "layer", "value", "penalty", asked.alias("asked"), "m.unit", "m.qualifier", "m.annotation", values.alias("values"))
    rows = geometry.beside_lines(slim, lines)
    note = F.col("value").isNull()
    certain = F.col("penalty") * F.when(F.col("unit") != "", WITH_UNIT).otherwise(WITHOUT_UNIT) * F.when(F.col("confirmed"), geometry.CONFIRM_BONUS).otherwise(1.0)
    return _form(
        rows, method=F.when(note | F.contains(F.upper("layer"), F.lit("MTEXT")), "MTEXT").otherwise("TEXT"), value_mm=F.coalesce("value", F.lit(0.0)), unit=F.when(note, "").otherwise(F.col("unit")),
        confidence=F.when(note, ANNOTATION * F.col("penalty")).otherwise(F.least(F.lit(1.0), TEXT * certain)), source_text=F.col("text"), x=F.col("x"), y=F.col("y"),
        direction=F.when(note | (F.col("orientation") == "DIAGONAL"), "ANY").otherwise(F.coalesce("orientation", F.lit("ANY"))), qualifier=F.col("qualifier"), annotation=F.col("annotation"),
        values_mm=F.col("values"), context_words=_words(F.col("text")),
    )


def pair_pass(lines: DataFrame, scales: DataFrame) -> DataFrame:
    """Separations of parallel lines, one for each tenth of a millimetre, with the words of their layers and the middle of their
    ends; less sure where neither line's layer has a name."""
    # Pairs bring the factor of their sheet along: joined to them it would take a shuffle of all pairs.
    rows = geometry.line_pairs(lines, scales.select("sheet", "mm_per_unit", _penalty()), kept=("penalty",))
    sure = F.least(F.lit(1.0), F.when(F.col("layer").isNotNull(), PAIR).otherwise(NAMELESS_PAIR) * F.coalesce("penalty", F.lit(UNKNOWN_SCALE)))
    return _form(rows, method=F.lit("GEOMETRY"), value_mm=F.col("value_mm"), confidence=sure, source_text=F.format_string("%.1fmm (geometry)", F.col("value_mm")), x=F.col("x"), y=F.col("y"), direction=F.col("orientation"), context_words=F.col("words"))


def circle_pass(circles: DataFrame, scales: DataFrame) -> DataFrame:
    """Diameters of circles (sheet, cx, cy, radius), whose radius is in millimetres."""
    wide = F.col("radius") * 2
    return _form(_scaled(circles, scales), method=F.lit("GEOMETRY"), value_mm=wide, confidence=CIRCLE * F.col("penalty"), source_text=F.format_string("⌀%.1f", wide), x=F.col("cx"), y=F.col("cy"), context_words=F.array(*[F.lit(w) for w in CIRCLE_WORDS]))


def spacing_pass(lines: DataFrame, circles: DataFrame, scales: DataFrame) -> DataFrame:
    """Repeated spacings of midpoints and centres along both axes."""

    def along(axis: str, direction: str) -> DataFrame:
        marks = lines.select("sheet", ((F.col(f"{axis}0") + F.col(f"{axis}1")) / 2).alias("p")).unionAll(circles.select("sheet", F.col(f"c{axis}").alias("p")))
        rows = _scaled(geometry.spacing_histogram(_scaled(marks, scales).select("sheet", (F.col("p") * F.col("mm_per_unit")).alias("p"))), scales)
        sure = PATTERN_BASE + PATTERN_SPAN * F.least(F.lit(1.0), F.col("n") / PATTERN_FULL)
        return _form(rows, method=F.lit("PATTERN"), value_mm=F.col("spacing"), confidence=F.least(F.lit(PATTERN_CAP), sure * F.col("penalty")), direction=F.lit(direction), context_words=F.array(*[F.lit(w) for w in SPACING_WORDS[direction]]))

    return along("x", "HORIZONTAL").unionByName(along("y", "VERTICAL"))


def schedule_pass(texts: DataFrame) -> DataFrame:
    """Lengths in the value cells of rows of SCHEDULE and DETAIL sheets, with the words of the row's label."""
    cells = geometry.schedule_rows(texts).select("sheet", "label", F.explode("values").alias("cell"))
    rows = matched_texts(cells.withColumnRenamed("cell", "text")).withColumnRenamed("text", "cell").where(F.size("m.mm_values") > 0)
    return _form(rows, method=F.lit("SCHEDULE"), value_mm=F.get("m.mm_values", F.lit(0)), unit=F.coalesce(F.nullif("m.unit", F.lit("")), F.lit("mm")), confidence=F.lit(SCHEDULE), source_text=F.col("cell"), context_words=_words(F.lower(F.trim("label"))))


def all_measurements(dimensions: DataFrame, texts: DataFrame, lines: DataFrame, circles: DataFrame, scales: DataFrame, schedules: DataFrame) -> DataFrame:
    """The measurements of all passes; `schedules` are the texts of schedule and detail sheets."""
    passes = [text_pass(texts, dimensions, lines, scales), pair_pass(lines, scales), circle_pass(circles, scales), spacing_pass(lines, circles, scales), schedule_pass(schedules)]
    every = dimension_pass(dimensions, texts, scales)
    for p in passes:
        every = every.unionByName(p)
    return every
