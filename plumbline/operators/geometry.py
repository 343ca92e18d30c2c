"""Spatial operators over drawing entities. Range conditions become equi-joins on grid cells, so work follows the neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .scratch import broadcast_within, written

NEARBY, MAX_CONTEXT_WORDS = 200.0, 30
DIRECTION_TOLERANCE = 10.0
CONFIRM_RADIUS, CONFIRM_TOLERANCE, CONFIRM_BONUS = 400.0, 0.05, 1.10
TICK_LENGTH, TICK_RADIUS, MERGE_RADIUS, ANGLE_WEIGHT = 30.0, 50.0, 20.0, 5.0
MIN_OVERLAP, MIN_SEPARATION, MAX_SEPARATION = 5.0, 0.5, 5000.0
#: Lines of a sheet up to which one task takes it whole, and pairs that it looks at together.
SHEET_ROWS, TASK_PAIRS = 20_000, 1_000_000
#: Sheets up to which their scales are broadcast.
SCALE_ROWS = 500_000
#: Width of the least cells in which parallel lines meet, along the lines, and how much wider those of the next step are.
OVERLAP_CELL, CELL_STEP = 64.0, 4


def _cells(x: Column, radius: float) -> Column:
    c = F.floor(x / radius).cast("long")
    return F.explode(F.array(c - 1, c, c + 1))


def near(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (sheet, lx, ly) and right (sheet, rx, ry) within `radius`, with their distance. Cells are as wide as the radius.

    Joined by shuffle: Spark sizes the left side without its nine cells a row, so it would broadcast what the driver can't hold.
    """
    a = left.withColumn("cx", _cells(F.col("lx"), radius)).withColumn("cy", _cells(F.col("ly"), radius))
    b = right.withColumn("cx", F.floor(F.col("rx") / radius).cast("long")).withColumn("cy", F.floor(F.col("ry") / radius).cast("long"))
    return a.join(b.hint("merge"), ["sheet", "cx", "cy"]).withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).where(F.col("distance") <= radius).drop("cx", "cy")


def _large_sheets(rows: DataFrame, sheet_rows: int) -> DataFrame | None:
    """The sheets (__large) of more than `sheet_rows` rows; none without one."""
    counts = rows.where("sheet is not null").groupBy("sheet").agg(F.count("*").alias("n")).where(F.col("n") > sheet_rows).select(F.col("sheet").alias("__large"))
    large = written(counts, "large-sheets")
    return broadcast_within(large) if large.limit(1).count() else None


def _of(rows: DataFrame, large: DataFrame | None, how: str) -> DataFrame:
    """`rows` on large sheets (left_semi) or on the others (left_anti)."""
    if large is None:
        return rows if how == "left_anti" else rows.where("false")
    return rows.join(large, F.col("sheet") == F.col("__large"), how)


def nearby_words(dimensions: DataFrame, texts: DataFrame, radius: float = NEARBY, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """sheet, dim_no, words: distinct lower-case words of texts within the radius of a dimension, in text order, at most 30.

    A dimension meets the list of its sheet's texts, so texts are shuffled once and pairs are no rows; those of sheets of more than
    `sheet_rows` texts meet by cell.
    """
    spots = dimensions.select("sheet", "dim_no", F.col("x").alias("lx"), F.col("y").alias("ly"))
    placed = texts.where("text is not null").select("sheet", "text_no", "text", F.col("x").alias("rx"), F.col("y").alias("ry"))
    large = _large_sheets(placed, sheet_rows)
    words = lambda near_texts: F.slice(F.array_distinct(F.array_remove(F.flatten(F.transform(near_texts, lambda t: F.split(F.lower(t["text"]), " +"))), "")), 1, MAX_CONTEXT_WORDS).alias("words")
    lists = _of(placed, large, "left_anti").where("sheet is not null").groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("text_no", "text", "rx", "ry"))).alias("texts"))
    of_dim = _of(spots, large, "left_anti").groupBy("sheet", "dim_no").agg(F.collect_set(F.struct("lx", "ly")).alias("spots"))
    within = lambda t: F.exists("spots", lambda p: F.hypot(p["lx"] - t["rx"], p["ly"] - t["ry"]) <= radius)
    found = of_dim.join(lists.hint("merge"), "sheet").select("sheet", "dim_no", words(F.filter("texts", within)))
    if large is not None:
        pairs = near(_of(spots, large, "left_semi"), _of(placed, large, "left_semi"), radius)
        found = found.unionByName(pairs.groupBy("sheet", "dim_no").agg(words(F.array_sort(F.collect_list(F.struct("text_no", "text"))))))
    return dimensions.select("sheet", "dim_no").join(found, ["sheet", "dim_no"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def nearest_line(points: DataFrame, lines: DataFrame, radius: float = NEARBY, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """sheet, point_no, line_no, orientation of the line whose midpoint is nearest within the radius, the first on ties."""
    spots = points.where("x is not null and y is not null").select("sheet", "point_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = beside_lines(spots, lines, radius, sheet_rows=sheet_rows).where("distance is not null")
    best = F.struct("distance", "line_no")
    return found.groupBy("sheet", "point_no").agg(F.min_by("line_no", best).alias("line_no"), F.min_by("orientation", best).alias("orientation"))


def beside_lines(points: DataFrame, lines: DataFrame, radius: float = NEARBY, confirm_radius: float = CONFIRM_RADIUS, tolerance: float = CONFIRM_TOLERANCE, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """`points` (sheet, x, y, ...) with line_no, orientation and distance of the line whose midpoint is nearest within the radius (null without
    one), and confirmed: whether two parallel lines near them are `asked` apart (see geometry_confirmed), false where that is null or absent.

    Points and lines are shuffled once by sheet, and a task meets those of a sheet as arrays: pairs are no rows, and what is found needs no join.
    Sheets of more than `sheet_rows` lines or points are joined by cell.
    """
    points = points if "asked" in points.columns else points.withColumn("asked", F.lit(None).cast("double"))
    mid = lines.where("sheet is not null").select("sheet", F.col("line_no").alias("__no"), F.col("orientation").alias("__way"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    mid = mid.where("x is not null and y is not null")
    sides = (mid.select("sheet", F.lit(False).alias("side")), points.select("sheet", F.lit(True).alias("side")))
    counts = sides[0].unionByName(sides[1]).where("sheet is not null").groupBy("sheet", "side").agg(F.count("*").alias("n")).where(F.col("n") > sheet_rows).select(F.col("sheet").alias("__large")).distinct()
    large = written(counts, "large-sheets")
    large = broadcast_within(large) if large.limit(1).count() else None
    found = _beside_in_tasks(_of(points, large, "left_anti"), _of(mid, large, "left_anti"), radius, confirm_radius, tolerance)
    if large is None:
        return found
    return found.unionByName(_beside_by_joins(_of(points, large, "left_semi"), lines.join(large, F.col("sheet") == F.col("__large"), "left_semi"), radius, confirm_radius, tolerance))


def _beside_by_joins(points: DataFrame, lines: DataFrame, radius: float, confirm_radius: float, tolerance: float) -> DataFrame:
    # Ids differ from one reading to another, so they are written.
    held = written(points.withColumn("__id", F.monotonically_increasing_id()), "points")
    mid = lines.select("sheet", "line_no", "orientation", ((F.col("x0") + F.col("x1")) / 2).alias("rx"), ((F.col("y0") + F.col("y1")) / 2).alias("ry"))
    pairs = near(held.select("sheet", "__id", F.col("x").alias("lx"), F.col("y").alias("ly")), mid, radius)
    best = F.min(F.struct("distance", "line_no", "orientation")).alias("__best")
    nearest = pairs.groupBy("__id").agg(best).select("__id", "__best.*")
    sure = geometry_confirmed(held.select("sheet", F.col("__id").alias("text_no"), "x", "y", F.col("asked").alias("value")), lines, confirm_radius, tolerance).select(F.col("text_no").alias("__id"), F.lit(True).alias("__sure"))
    both = held.join(nearest, "__id", "left").join(sure, "__id", "left")
    return both.select(*points.columns, "line_no", "orientation", "distance", F.coalesce("__sure", F.lit(False)).alias("confirmed"))


def _beside_in_tasks(points: DataFrame, mid: DataFrame, radius: float, confirm_radius: float, tolerance: float) -> DataFrame:
    kinds, of_line = dict(points.dtypes), dict(mid.dtypes)
    names = points.columns
    rest = [c for c in names if c not in ("sheet", "x", "y")]
    both = mid.select("sheet", "x", "y", F.lit(False).alias("__point"), "__no", "__way", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    own = points.select("sheet", "x", "y", F.lit(True).alias("__point"), F.lit(None).cast(of_line["__no"]).alias("__no"), F.lit(None).cast("string").alias("__way"), *rest)
    rows = both.unionByName(own).repartition("sheet").sortWithinPartitions("sheet", "__point", "__no")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sheets in _whole_sheets(batches):
            found = _beside(sheets, radius, confirm_radius, tolerance)
            yield from found.select([*names, "line_no", "orientation", "distance", "confirmed"]).to_batches()

    form = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.mapInArrow(meet, f"{form}, line_no {of_line['__no']}, orientation string, distance double, confirmed boolean")


def _beside(rows: pa.Table, radius: float, confirm_radius: float, tolerance: float) -> pa.Table:
    """The points of whole sheets, whose lines are sorted and come before them, with what is found of the lines."""
    number = lambda c: rows.column(c).to_numpy().astype(float)
    x, y, asked, point = number("x"), number("y"), number("asked"), rows.column("__point").to_numpy()
    ways = [pc.fill_null(pc.equal(rows.column("__way"), way), False).to_numpy() for way in ("HORIZONTAL", "VERTICAL")]
    best, distance, sure = np.full(len(x), -1, np.int64), np.full(len(x), np.nan), np.zeros(len(x), bool)
    starts = _starts(rows, "sheet")
    before = np.concatenate([[0], np.cumsum(~point)])
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        split = start + int(before[end] - before[start])
        held = start + np.nonzero(~(np.isnan(x[start:split]) | np.isnan(y[start:split])))[0]
        if not len(held):
            continue
        across = [(line := held[way[held]])[np.argsort(at[line], kind="stable")] for way, at in zip(ways, (y, x), strict=True)]
        step = max(1, TASK_PAIRS // len(held))
        for at in range(split, end, step):
            to = min(end, at + step)
            d = np.sqrt((x[at:to, None] - x[held]) ** 2 + (y[at:to, None] - y[held]) ** 2)
            nearest = d.argmin(axis=1)
            least = d[np.arange(to - at), nearest]
            hit = np.nonzero(least <= radius)[0]
            best[at + hit], distance[at + hit] = held[nearest[hit]], least[hit]
            asking = at + np.nonzero(asked[at:to] > tolerance)[0]
            for line, place in zip(across, (y, x), strict=True):
                if len(asking) and len(line) > 1:
                    close = np.sqrt((x[asking, None] - x[line]) ** 2 + (y[asking, None] - y[line]) ** 2) <= confirm_radius
                    sure[asking] |= _any_separated(close, place[line], asked[asking], tolerance)
    at = pa.array(best[point], mask=best[point] < 0)
    out = rows.filter(rows.column("__point"))
    for name, column in (("line_no", rows.column("__no").take(at)), ("orientation", rows.column("__way").take(at)), ("distance", pa.array(distance[point], mask=best[point] < 0)), ("confirmed", pa.array(sure[point]))):
        out = out.append_column(name, column)
    return out


def _any_separated(close: np.ndarray, places: np.ndarray, value: np.ndarray, tolerance: float) -> np.ndarray:
    """For each row of `close`, which tells the lines near a text, whether two of them are its value apart; places are sorted. See _separated."""
    n = len(places)
    slack = tolerance * np.maximum(value, 1.0)
    after = np.searchsorted(places, (places[None, :] + value[:, None] - slack[:, None]).ravel(), side="right").reshape(close.shape)
    # The next line near the text from each place on.
    ahead = np.full((len(close), n + 1), n, np.int64)
    ahead[:, :n] = np.minimum.accumulate(np.where(close, np.arange(n), n)[:, ::-1], axis=1)[:, ::-1]
    following = np.take_along_axis(ahead, after, axis=1)
    beyond = np.append(places, np.inf)[following]
    return (close & (beyond < places[None, :] + value[:, None] + slack[:, None])).any(axis=1)


def _layer_words(layer: Column) -> Column:
    """The lower-case words of a layer's name, none without one."""
    return F.when(F.length(layer) > 0, F.split(F.lower(layer), r"(?U)[\W_\-]+", -1)).otherwise(F.array().cast("array<string>"))


def line_pairs(lines: DataFrame, scales: DataFrame | None = None, max_separation: float = MAX_SEPARATION, sheet_rows: int = SHEET_ROWS, kept: tuple[str, ...] = ()) -> DataFrame:
    """Parallel axis-aligned lines of a sheet that face each other over 5 units or more: the first pair, by line numbers, for each
    separation to a tenth of a millimetre.

    sheet, orientation, value (the separation in millimetres to one place), a_no, b_no, value_mm (in full), layer (that of
    the first line, of the second where that has none; null without), x, y (the middle of all ends), words (those of both
    layers) and the columns `kept` of scales. `scales` (sheet, mm_per_unit) turns units into millimetres, one for one where it has none. Lines
    with the same number make no pair; `layer` may be absent.

    Lines are shuffled once by sheet, and a task meets those of a sheet as arrays, so neither pairs nor what is found of cells are rows.
    The pairs of sheets of more than `sheet_rows` lines are joined by cell, so no task holds one.
    """
    layer = F.nullif("layer", F.lit("")) if "layer" in lines.columns else F.lit(None).cast("string")
    flat = lines.where(F.col("orientation").isin("HORIZONTAL", "VERTICAL")).select("sheet", "orientation", "line_no", layer.alias("layer"), "x0", "y0", "x1", "y1")
    counts = flat.where("sheet is not null").groupBy("sheet").agg(F.count("*").alias("n")).where(F.col("n") > sheet_rows).select(F.col("sheet").alias("__large"))
    large = broadcast_within(written(counts, "large-sheets"))
    of_large = F.col("sheet") == F.col("__large")
    factor = F.nullif(F.col("mm_per_unit").cast("double"), F.lit(0.0)) if scales is not None else F.lit(1.0)
    known = broadcast_within(scales.select("sheet", factor.alias("mm"), *kept), SCALE_ROWS) if scales is not None else None
    small = _pairs_in_tasks(flat.join(large, of_large, "left_anti"), known, max_separation, kept)
    return small.unionByName(_pairs_by_joins(_scaled(flat.join(large, of_large, "left_semi"), known), max_separation, kept))


def _scaled(flat: DataFrame, known: DataFrame | None) -> DataFrame:
    """Lines with mm, the millimetres of a unit on their sheet."""
    return flat.join(known, "sheet", "left").withColumn("mm", F.coalesce("mm", F.lit(1.0))) if known is not None else flat.withColumn("mm", F.lit(1.0))


def _pairs_in_tasks(flat: DataFrame, known: DataFrame | None, max_separation: float, kept: tuple[str, ...]) -> DataFrame:
    # Scales follow the shuffle, so that they don't travel.
    ends = ("x0", "y0", "x1", "y1")
    whole = flat.where(" and ".join(f"{c} is not null" for c in ("sheet", "line_no", *ends))).repartition("sheet")
    rows = _scaled(whole, known).select(*flat.columns, "mm", *kept).sortWithinPartitions("sheet", "orientation", "line_no", *ends, "layer")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sheets in _whole_sheets(batches):
            yield from _first_pairs(sheets, max_separation, kept)

    kinds = dict(rows.dtypes)
    form = [("sheet", kinds["sheet"]), ("orientation", "string"), ("value", "double"), ("a_no", kinds["line_no"]), ("b_no", kinds["line_no"]), ("value_mm", "double"), ("a_layer", "string"), ("b_layer", "string"), ("x", "double"), ("y", "double"), *[(c, kinds[c]) for c in kept]]
    found = rows.mapInArrow(meet, ", ".join(f"`{c}` {kind}" for c, kind in form))
    words = F.concat(_layer_words(F.col("a_layer")), _layer_words(F.col("b_layer")))
    return found.select("sheet", "orientation", "value", "a_no", "b_no", "value_mm", F.coalesce("a_layer", "b_layer").alias("layer"), "x", "y", words.alias("words"), *kept)


def _measurable(rows: pa.Table) -> pa.Table:
    """Lines that another one can face, with their place across (p) and their ends along (lo, hi)."""
    level = pc.equal(rows.column("orientation"), "HORIZONTAL").to_numpy()
    x0, y0, x1, y1 = (rows.column(c).to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1"))
    along, across = (np.where(level, x0, y0), np.where(level, x1, y1)), np.where(level, y0 + y1, x0 + x1) / 2
    # As in Spark, not-a-number is above all numbers.
    lo, hi = np.fmin(*along), np.maximum(*along)
    for c, v in (("p", across), ("lo", lo), ("hi", hi)):
        rows = rows.append_column(c, pa.array(v))
    return rows.filter(pa.array(~(hi - lo < MIN_OVERLAP)))


def _starts(rows: pa.Table, *keys: str) -> np.ndarray:
    """Where runs of equal keys begin, and the end; a null equals none."""
    n = rows.num_rows
    differ = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        column = rows.column(key)
        differ |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))), True).to_numpy()
    return np.concatenate([[0], np.nonzero(differ)[0] + 1, [n]]).astype(np.int64)


def _whole_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by sheet, cut where sheets end: the last one of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(_starts(pa.Table.from_batches([batch]), "sheet")[-2])
        if not cut and held and held[-1].column("sheet")[-1] == batch.column("sheet")[0]:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
        if whole.num_rows:
            yield whole
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tenths(x: np.ndarray) -> np.ndarray:
    """Numbers to one place as Spark's bround gives them: half to even by the digits that a number is written with."""
    t = x * 10
    value = np.rint(t) / 10
    # Where the product may have been rounded onto a half or off it the digits decide.
    with np.errstate(invalid="ignore"):
        unsure = np.isfinite(x) & (np.abs(t - np.floor(t) - 0.5) <= 1e-9 * np.maximum(1.0, np.abs(t)))
    if unsure.any():
        asked, at = np.unique(x[unsure], return_inverse=True)
        value[unsure] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) if abs(v) < 1e15 else v for v in asked])[at]
    return value


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each value occurs first."""
    tenths = np.rint(values * 10)
    if len(values) and 0 <= tenths.min() and tenths.max() < 1 << 20:
        # Values are whole tenths: the last to be put in a place is the first of all, read from behind.
        place = np.full(int(tenths.max()) + 1, -1, np.int64)
        place[tenths[::-1].astype(np.int64)] = np.arange(len(values) - 1, -1, -1)
        return place[place >= 0]
    return np.unique(values, return_index=True)[1]


def _first_pairs(rows: pa.Table, max_separation: float, kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The first pairs of the lines of whole sheets, which are sorted by sheet, orientation, line_no, ends and layer."""
    rows = _measurable(rows).combine_chunks()
    p, lo, hi, mm = (rows.column(c).to_numpy() for c in ("p", "lo", "hi", "mm"))
    starts = _starts(rows, "sheet", "orientation")
    number = np.zeros(rows.num_rows, np.int64)
    numbers = _starts(rows, "sheet", "orientation", "line_no")
    number[numbers[1:-1]] = 1
    number = np.cumsum(number)
    found, n_found = [], 0
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - start < 2:
            continue
        own = slice(start, end)
        i, j, value = _of_sheet(p[own], lo[own], hi[own], mm[start], number[own] - number[start], max_separation)
        found.append((i + start, j + start, value))
        n_found += len(i)
        if n_found > TASK_PAIRS:
            yield _pair_rows(rows, found, kept)
            found, n_found = [], 0
    if found:
        yield _pair_rows(rows, found, kept)


def _of_sheet(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, mm: float, number: np.ndarray, max_separation: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, value: the first pair of each separation among lines in order; number tells those of the same line number."""
    n, shared = len(p), number[-1] < len(p) - 1
    parts = []

    def least(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if shared:
            order = np.argsort(number[i] * n + number[j], kind="stable")
            i, j, value = i[order], j[order], value[order]
        first = np.sort(_firsts(value))
        return i[first], j[first], value[first]

    step = max(1, TASK_PAIRS // n)
    for start in range(0, n, step):
        a, b = slice(start, min(n, start + step)), slice(start, n)
        sep = np.abs(p[b] - p[a, None])
        facing = (number[b] > number[a, None]) & (sep >= MIN_SEPARATION) & (sep <= max_separation)
        facing &= ~(np.fmin(hi[b], hi[a, None]) - np.maximum(lo[b], lo[a, None]) < MIN_OVERLAP)
        i, j = np.nonzero(facing)
        parts.append(least(i + start, j + start, _tenths(sep[i, j] * mm)))
    return parts[0] if len(parts) == 1 else least(*(np.concatenate([part[k] for part in parts]) for k in range(3)))


def _pair_rows(rows: pa.Table, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kept: tuple[str, ...]) -> pa.RecordBatch:
    i, j, value = (np.concatenate([part[k] for part in found]) for k in range(3))
    own = lambda c, at: rows.column(c).take(pa.array(at)).combine_chunks()
    ends = {c: rows.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "p", "mm")}
    middle = lambda c: (ends[f"{c}0"][i] + ends[f"{c}1"][i] + ends[f"{c}0"][j] + ends[f"{c}1"][j]) / 4
    columns = {"sheet": own("sheet", i), "orientation": own("orientation", i), "value": pa.array(value), "a_no": own("line_no", i), "b_no": own("line_no", j), "value_mm": pa.array(np.abs(ends["p"][i] - ends["p"][j]) * ends["mm"][i]), "a_layer": own("layer", i), "b_layer": own("layer", j), "x": pa.array(middle("x")), "y": pa.array(middle("y"))}
    columns |= {c: own(c, i) for c in kept}
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], list(columns))


def _pairs_by_joins(flat: DataFrame, max_separation: float, kept: tuple[str, ...]) -> DataFrame:
    """A line lies in cells as wide as its own length up to the next step, so in two at most, whatever its length; two lines
    meet in the cells of the longer one, and in strips of the other axis max_separation wide. Each pair meets once.
    """
    horizontal = F.col("orientation") == "HORIZONTAL"
    flat = flat.withColumns({
        "p": F.when(horizontal, F.col("y0") + F.col("y1")).otherwise(F.col("x0") + F.col("x1")) / 2,
        "lo": F.when(horizontal, F.least("x0", "x1")).otherwise(F.least("y0", "y1")), "hi": F.when(horizontal, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")),
    }).where(F.col("hi") - F.col("lo") >= MIN_OVERLAP)
    level = F.greatest(F.lit(0), F.ceil(F.log(float(CELL_STEP), (F.col("hi") - F.col("lo")) / OVERLAP_CELL))).cast("int")
    flat = flat.withColumn("level", level).withColumn("strip", F.floor(F.col("p") / max_separation).cast("long"))
    # A handful of numbers: the steps of length that occur, and whether lines lie in more than one strip.
    found = flat.agg(F.array_sort(F.collect_set("level")).alias("levels"), (F.max("strip") > F.min("strip")).alias("many")).first()
    levels, beside = found.levels or [0], (-1, 0, 1) if found.many else (0,)
    cells = lambda step: F.sequence(F.floor(F.col("lo") / (OVERLAP_CELL * F.pow(F.lit(float(CELL_STEP)), step))), F.floor(F.col("hi") / (OVERLAP_CELL * F.pow(F.lit(float(CELL_STEP)), step))))
    about = lambda side: [F.col("line_no").alias(f"{side}_no"), F.col("p").alias(f"{side}p"), F.col("lo").alias(f"{side}l"), F.col("hi").alias(f"{side}h"), F.col("first").alias(f"{side}f")]
    home = flat.withColumn("cells", cells(F.col("level"))).withColumn("first", F.get("cells", F.lit(0)))
    home = home.select("sheet", "orientation", "level", "strip", "mm", *about("a"), F.explode("cells").alias("cell"))
    guest = flat.select("*", F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("level"))).alias("at")).withColumn("own", F.col("level")).withColumn("cells", cells(F.col("at"))).withColumn("first", F.get("cells", F.lit(0)))
    guest = guest.select("sheet", "orientation", F.col("at").alias("level"), "own", *about("b"), "strip", F.explode("cells").alias("cell"))
    guest = guest.withColumn("strip", F.explode(F.array(*[F.col("strip") + k for k in beside])))
    # Lines are few where their pairs are many: a join by shuffle spreads these by cell, a broadcast leaves them in the scan's tasks.
    pairs = home.join(guest.hint("merge"), ["sheet", "orientation", "level", "cell", "strip"]).withColumn("sep", F.abs(F.col("bp") - F.col("ap")))
    once = (F.col("cell") == F.greatest("af", "bf")) & ((F.col("own") < F.col("level")) | (F.col("a_no") < F.col("b_no")))
    pairs = pairs.where(once & (F.least("ah", "bh") - F.greatest("al", "bl") >= MIN_OVERLAP) & F.col("sep").between(MIN_SEPARATION, max_separation) & (F.col("a_no") != F.col("b_no")))
    at = ["level", "cell", "strip"]
    first = pairs.select("sheet", "orientation", *at, F.bround(F.col("sep") * F.col("mm"), 1).alias("value"), F.least("a_no", "b_no").alias("a_no"), F.greatest("a_no", "b_no").alias("b_no"))
    # The least pair of each cell, where the pairs are, and then of all: one row a value and cell is shuffled, in place of all pairs. In
    # two steps of plain numbers each: the least struct would be aggregated by sorting all pairs.
    for cell in (at, []):
        of_line = first.groupBy("sheet", "orientation", *cell, "value", "a_no").agg(F.min("b_no").alias("b_no"))
        first = of_line.groupBy("sheet", "orientation", *cell, "value").agg(F.min("a_no").alias("a_no"), F.min_by("b_no", "a_no").alias("b_no"))
    ends = ("x0", "y0", "x1", "y1")
    side = lambda k: flat.select("sheet", "orientation", F.col("line_no").alias(f"{k}_no"), *[F.col(c).alias(f"{k}_{c}") for c in (*ends, "layer", "p", "lo", "hi", "mm", *kept)])
    both = first.join(side("a"), ["sheet", "orientation", "a_no"]).join(side("b"), ["sheet", "orientation", "b_no"]).withColumn("sep", F.abs(F.col("a_p") - F.col("b_p")))
    # Where lines share a number, that of the least coordinates which makes the pair.
    both = both.where((F.bround(F.col("sep") * F.col("a_mm"), 1) == F.col("value")) & F.col("sep").between(MIN_SEPARATION, max_separation) & (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo") >= MIN_OVERLAP))
    middle = lambda c: ((F.col(f"a_{c}0") + F.col(f"a_{c}1") + F.col(f"b_{c}0") + F.col(f"b_{c}1")) / 4).alias(c)
    found = F.struct(
        (F.col("sep") * F.col("a_mm")).alias("value_mm"), F.coalesce("a_layer", "b_layer").alias("layer"), middle("x"), middle("y"),
        F.concat(_layer_words(F.col("a_layer")), _layer_words(F.col("b_layer"))).alias("words"), *[F.col(f"a_{c}").alias(c) for c in kept],
    )
    least = F.struct(*[f"{k}_{c}" for k in "ab" for c in (*ends, "layer")])
    pairs = both.groupBy("sheet", "orientation", "value", "a_no", "b_no").agg(F.min_by(found, least).alias("f"))
    return pairs.select("sheet", "orientation", "value", "a_no", "b_no", "f.*")


def _gap_counts(batches: Iterator[pa.RecordBatch], low: float, high: float) -> Iterator[pa.RecordBatch]:
    """sheet, gap, n of rows (sheet, own, beyond): how often each gap from low to high lies between a mark of `own` and a later one of either."""
    for batch in batches:
        (own, at), (beyond, next_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("own"), batch.column("beyond")))
        for i in range(batch.num_rows):
            marks = np.unique(own[at[i] : at[i + 1]])
            later = np.concatenate([marks, np.unique(beyond[next_at[i] : next_at[i + 1]])])
            step, gaps, counts = max(1, 1_000_000 // max(1, len(later))), np.zeros(0), np.zeros(0, np.int64)
            for start in range(0, len(marks), step):
                d = later[None, :] - marks[start : start + step, None]
                found, n = np.unique(d[(d >= low) & (d <= high)], return_counts=True)
                # Gaps are few where pairs are many: those of the blocks before are added.
                gaps, where = np.unique(np.concatenate([gaps, found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(gaps)).astype(np.int64)
            if len(gaps):
                yield pa.RecordBatch.from_arrays([batch.column("sheet").take(pa.array(np.full(len(gaps), i))), pa.array(gaps), pa.array(counts)], ["sheet", "gap", "n"])


def spacing_histogram(marks: DataFrame, low: float = 50, high: float = 10_000, top: int = 3, least: int = 2) -> DataFrame:
    """sheet, bin, n, spacing: the most frequent spacings between distinct marks (sheet, p) of a sheet; spacing is 5 above the bin's edge.

    The bins are (max + 10) / (floor(max / 10) + 1) wide, max being the sheet's greatest spacing; at most `top` with `least` hits.

    Marks have one decimal place, so a strip `high` wide has a bounded number of them, whatever the sheet. A task meets strips with
    their next ones and counts each gap, so pairs are no rows.
    """
    strip = F.floor(F.col("p") / high).cast("long")
    placed = marks.select("sheet", F.bround("p", 1).alias("p")).where(F.col("sheet").isNotNull() & F.col("p").isNotNull())
    both = placed.select("sheet", "p", F.inline(F.array(F.struct(strip.alias("strip"), F.lit(False).alias("next")), F.struct((strip - 1).alias("strip"), F.lit(True).alias("next")))))
    side = lambda is_next: F.collect_set(F.when(F.col("next") == is_next, F.col("p")))
    strips = both.groupBy("sheet", "strip").agg(side(False).alias("own"), side(True).alias("beyond")).where(F.size("own") > 0).select("sheet", "own", "beyond")
    gaps = strips.mapInArrow(lambda batches: _gap_counts(batches, low, high), f"sheet {dict(marks.dtypes)['sheet']}, gap double, n long")
    width = (F.col("m") + 10) / (F.floor(F.col("m") / 10) + 1)
    binned = gaps.withColumn("m", F.max("gap").over(Window.partitionBy("sheet"))).withColumn("w", width).withColumn("bin", F.floor(F.col("gap") / F.col("w")).cast("long"))
    counts = binned.groupBy("sheet", "bin").agg(F.sum("n").alias("n"), F.bround(F.first(F.col("bin") * F.col("w")) + 5, 1).alias("spacing")).where(F.col("n") >= least)
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("sheet").orderBy(F.col("n").desc(), "bin"))).where(F.col("r") <= top).drop("r")


def schedule_rows(texts: DataFrame, bucket: float = 5.0) -> DataFrame:
    """sheet, row_y, label, values: texts in rows by their y; the first by x is the label, the others are its values."""
    rows = texts.withColumn("row_y", (F.bround(F.col("y") / bucket) * bucket).cast("double"))
    cells = rows.groupBy("sheet", "row_y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "text_no", "text"))), lambda c: c["text"]).alias("cells"))
    return cells.select("sheet", "row_y", F.col("cells")[0].alias("label"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("values"))


def uncovered(texts: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Texts that no dimension shares its rounded place with."""
    at = lambda: [F.bround("x", 1).alias("kx"), F.bround("y", 1).alias("ky")]
    keys = dimensions.select("sheet", *at()).distinct()
    return texts.select("*", *at()).join(keys, ["sheet", "kx", "ky"], "left_anti").drop("kx", "ky")


def geometry_confirmed(texts: DataFrame, lines: DataFrame, radius: float = CONFIRM_RADIUS, tolerance: float = CONFIRM_TOLERANCE) -> DataFrame:
    """sheet, text_no of texts (sheet, text_no, x, y, value) that two parallel lines near them confirm: their separation differs
    from the value by less than the tolerance times the greater of value and 1.

    Neither pairs of lines nor pairs of a text and a line are rows: a text lies in one cell, twice as wide as the radius, that lists all
    lines within the radius of its texts, so a line in four. Among the lines near a text in the order of their places, the first one
    beyond place + value - tolerance must lie before place + value + tolerance. Values must be above the tolerance.
    """
    wide = 2 * radius
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / wide).cast("long"), F.floor((F.col(c) + radius) / wide).cast("long")))
    flat = lines.where(F.col("orientation").isin("HORIZONTAL", "VERTICAL")).select("sheet", (F.col("orientation") == "HORIZONTAL").alias("level"), ((F.col("x0") + F.col("x1")) / 2).alias("rx"), ((F.col("y0") + F.col("y1")) / 2).alias("ry"))
    held = flat.select("*", reach("rx").alias("cx")).select("*", reach("ry").alias("cy")).repartition("sheet", "cx", "cy")
    side = lambda c, level: F.collect_list(F.when(F.col("level") == level, F.col(c)))
    cells = held.groupBy("sheet", "cx", "cy").agg(*[side(c, level).alias(f"{k}{c}") for k, level in (("h", True), ("v", False)) for c in ("rx", "ry")])
    asked = texts.where((F.col("value") > tolerance) & F.col("x").isNotNull() & F.col("y").isNotNull()).select("sheet", "text_no", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("value").cast("double").alias("value"))
    asked = asked.withColumn("cx", F.floor(F.col("lx") / wide).cast("long")).withColumn("cy", F.floor(F.col("ly") / wide).cast("long"))
    # Texts are few where their lines are many: a broadcast would hold all of one side in the driver.
    near_lines = asked.join(cells.hint("merge"), ["sheet", "cx", "cy"]).drop("cx", "cy")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("lx", "ly", "value")]
            lists = [[batch.column(c) for c in pair] for pair in (("hrx", "hry"), ("vrx", "vry"))]
            spans = [(a.values.to_numpy(), b.values.to_numpy(), a.offsets.to_numpy()) for a, b in lists]
            found = [any(_separated(x, y, value, xs[at[i] : at[i + 1]], ys[at[i] : at[i + 1]], level, radius, tolerance) for (xs, ys, at), level in zip(spans, (True, False), strict=True)) for i, (x, y, value) in enumerate(zip(*own, strict=True))]
            yield batch.select(["sheet", "text_no"]).filter(pa.array(found, pa.bool_()))

    kinds = dict(near_lines.dtypes)
    return near_lines.mapInArrow(confirmed, f"sheet {kinds['sheet']}, text_no {kinds['text_no']}").distinct()


def _separated(x: float, y: float, value: float, xs: np.ndarray, ys: np.ndarray, level: bool, radius: float, tolerance: float) -> bool:
    """Whether two of the lines with these midpoints within the radius of (x, y) are `value` apart."""
    close = np.sqrt((xs - x) ** 2 + (ys - y) ** 2) <= radius
    places = np.sort((ys if level else xs)[close])
    slack = tolerance * max(value, 1.0)
    after = np.searchsorted(places, places + value - slack, side="right")
    some = after < len(places)
    return bool((places[after[some]] < places[some] + value + slack).any())


def dimension_regions(lines: DataFrame, tick_length: float = TICK_LENGTH, radius: float = TICK_RADIUS) -> DataFrame:
    """sheet, line_no, cx, cy of lines longer than a tick with an end of a tick near both their ends; (cx, cy) is the midpoint."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    ends = F.inline(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"x{e}").alias("ex"), F.col(f"y{e}").alias("ey")) for e in (0, 1)]))
    ticks = lines.where(length <= tick_length).select("sheet", ends).select("sheet", F.col("ex").alias("rx"), F.col("ey").alias("ry")).distinct()
    long = lines.where(length > tick_length)
    hit = near(long.select("sheet", "line_no", ends).select("sheet", "line_no", "end", F.col("ex").alias("lx"), F.col("ey").alias("ly")), ticks, radius)
    both = hit.groupBy("sheet", "line_no").agg(F.countDistinct("end").alias("n")).where("n = 2").drop("n")
    return long.join(both, ["sheet", "line_no"]).select("sheet", "line_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


_BOXES = ("sheet", "first_no", "n_lines", "x0", "y0", "x1", "y1")


def merged_segments(lines: DataFrame, radius: float = MERGE_RADIUS, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """sheet, first_no, n_lines, x0, y0, x1, y1: chains of segments within `radius` of each other in midpoint and five times the
    angle become the box of their ends, a segment alone stays as it is. Segments with the same midpoint and angle link as one;
    line_no is unique in a sheet.

    Lines are shuffled once by sheet, and a task links those of a few sheets at a time. Sheets of more than `sheet_rows` lines are
    linked in cells and rounds of joins, so no task holds one.
    """
    slim = lines.select("sheet", "line_no", "x0", "y0", "x1", "y1").where("sheet is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    counts = slim.groupBy("sheet").agg(F.count("*").alias("n")).where(F.col("n") > sheet_rows).select(F.col("sheet").alias("__large"))
    large = written(counts, "large-sheets")
    if not large.limit(1).count():
        return _merged_in_tasks(slim, radius)
    of_large = F.col("sheet") == F.col("__large")
    small = slim.join(broadcast_within(large), of_large, "left_anti")
    return _merged_in_tasks(small, radius).unionByName(_merged_by_joins(slim.join(broadcast_within(large), of_large, "left_semi"), radius))


def _placed(lines: DataFrame) -> DataFrame:
    """sheet, line_no and ends of lines with their midpoint (mx, my) and weighed angle (ma)."""
    angle = (F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))) + 180) % 180
    return lines.select("sheet", "line_no", "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"), (angle * ANGLE_WEIGHT).alias("ma"))


def _merged_in_tasks(lines: DataFrame, radius: float) -> DataFrame:
    # Midpoints and angles follow the shuffle, so that they don't travel.
    rows = _placed(lines.repartition("sheet").sortWithinPartitions("sheet", F.asc_nulls_last("line_no")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last sheet of a batch may go on in the next one.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks()
            sheet = whole.column("sheet").to_numpy()
            cut = int(np.searchsorted(sheet, sheet[-1]))
            held = whole.slice(cut).to_batches()
            if cut:
                yield _boxes(whole.slice(0, cut), radius)
        if held:
            yield _boxes(pa.Table.from_batches(held), radius)

    kinds = dict(lines.dtypes)
    return rows.mapInArrow(merge, f"sheet {kinds['sheet']}, first_no {kinds['line_no']}, n_lines long, x0 double, y0 double, x1 double, y1 double")


def _boxes(rows: pa.Table, radius: float) -> pa.RecordBatch:
    """The chains of the lines of whole sheets, which are sorted by sheet and line_no."""
    sheet, (x0, y0, x1, y1, mx, my, ma) = rows.column("sheet").to_numpy(), (rows.column(c).to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1", "mx", "my", "ma"))
    label = _chains(sheet, mx, my, ma, radius)
    # A chain is named by its first row, so labels in order keep sheets in order.
    order = np.argsort(label, kind="stable")
    first, start, n = np.unique(label[order], return_index=True, return_counts=True)
    low = lambda a, b: np.where(n == 1, a[first], np.minimum.reduceat(np.minimum(a, b)[order], start))
    high = lambda a, b: np.where(n == 1, b[first], np.maximum.reduceat(np.maximum(a, b)[order], start))
    named = [rows.column(c).take(pa.array(first)).combine_chunks() for c in ("sheet", "line_no")]
    return pa.RecordBatch.from_arrays([*named, pa.array(n.astype(np.int64)), *map(pa.array, (low(x0, x1), low(y0, y1), high(x0, x1), high(y0, y1)))], list(_BOXES))


def _chains(sheet: np.ndarray, mx: np.ndarray, my: np.ndarray, ma: np.ndarray, radius: float, pairs: int = 1_000_000) -> np.ndarray:
    """The least row that each row reaches by links. Rows are sorted by sheet and strip of the radius's width, so a row's neighbours to the right
    are a range; some `pairs` are looked at at a time."""
    _, group = np.unique(sheet, return_inverse=True)
    strip = np.unique(np.floor(mx / radius), return_inverse=True)
    step = np.searchsorted(strip[0], strip[0] + 1, side="right")
    # Where the next strip is empty the range ends with the own one.
    width = np.int64(len(strip[0]) + 1)
    key = group * width + strip[1]
    order = np.lexsort((mx, key))
    key, x, y, a = key[order], mx[order], my[order], ma[order]
    until = np.searchsorted(key, group[order] * width + step[strip[1][order]], side="left")
    todo = until - np.arange(len(key)) - 1
    label = np.arange(len(sheet))
    ends = np.cumsum(todo)
    at = 0
    links = []
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, side="right")))
        i = np.repeat(np.arange(at, to), todo[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(todo[at:to]) - todo[at:to], todo[at:to])
        d = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 + (a[i] - a[j]) ** 2
        near = d <= radius * radius
        links.append((order[i[near]], order[j[near]]))
        at = to
    a, b = (np.concatenate([p[k] for p in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (label[a], label[b], a, b):
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _merged_by_joins(lines: DataFrame, radius: float) -> DataFrame:
    placed = _placed(lines)
    spots = placed.groupBy("sheet", "mx", "my", "ma").agg(F.min("line_no").alias("spot"))
    a = spots.select("sheet", F.col("spot").alias("a"), F.col("mx").alias("lx"), F.col("my").alias("ly"), F.col("ma").alias("la"))
    b = spots.select("sheet", F.col("spot").alias("b"), F.col("mx").alias("rx"), F.col("my").alias("ry"), F.col("ma").alias("ra"))
    turned = F.col("la") - F.col("ra")
    links = near(a, b, radius).where((F.col("a") < F.col("b")) & (F.col("distance") * F.col("distance") + turned * turned <= radius * radius))
    labels = components(links, "sheet").select("sheet", F.col("node").alias("spot"), "label")
    chained = placed.join(spots, ["sheet", "mx", "my", "ma"]).join(labels, ["sheet", "spot"], "left").withColumn("first_no", F.coalesce("label", "spot"))
    box = chained.groupBy("sheet", "first_no").agg(
        F.count("*").alias("n_lines"), F.min_by(F.struct("x0", "y0", "x1", "y1"), "line_no").alias("alone"),
        F.min(F.least("x0", "x1")).alias("bx0"), F.min(F.least("y0", "y1")).alias("by0"), F.max(F.greatest("x0", "x1")).alias("bx1"), F.max(F.greatest("y0", "y1")).alias("by1"),
    )
    return box.select("sheet", "first_no", "n_lines", *[F.when(F.col("n_lines") == 1, F.col(f"alone.{c}")).otherwise(F.col(f"b{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def dimension_direction(kind: Column, length: Column, x: Column, y: Column, def_x: Column, def_y: Column) -> Column:
    """ANGULAR by kind; HORIZONTAL or VERTICAL where the definition point lies within 10 degrees of the axis; else ANY. A definition
    point at 0 counts as missing."""
    placed = (length > 0) & (def_x != 0) & (def_y != 0) & ((F.abs(x - def_x) + F.abs(y - def_y)) > 0)
    angle = F.degrees(F.atan2(F.abs(y - def_y), F.abs(x - def_x)))
    return F.when(kind == "ANGULAR", "ANGULAR").when(placed & (angle < DIRECTION_TOLERANCE), "HORIZONTAL").when(placed & (F.abs(angle - 90) < DIRECTION_TOLERANCE), "VERTICAL").otherwise("ANY")


def override_qualifier(override: Column) -> Column:
    """TYP, MIN, MAX or NTS, the first that the override text of a dimension holds; null without one."""
    t = F.lower(override)
    return F.coalesce(*[F.when(F.contains(t, F.lit(q)), F.lit(q.upper())) for q in ("typ", "min", "max", "nts")])
