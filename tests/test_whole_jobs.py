"""Registered queries at the reference's constants, against plain Python."""

from __future__ import annotations

import decimal
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import callouts
from plumbline.operators import blocks, geometry, measurements, scratch, sheets
from plumbline.plans import document_queries, drawing_queries, registry, sheet_queries

SF = "/root/testdata/sf0.001"


def _by_sheet(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sheet].append(r)
    return out


def _middle(n):
    return (n.x0 + n.x1) / 2, (n.y0 + n.y1) / 2


def _confirmed(x, y, value, lines):
    near = [n for n in lines if n.orientation != "DIAGONAL" and math.dist(_middle(n), (x, y)) <= 400]
    place = {o: sorted({_middle(n)[o == "HORIZONTAL"] for n in near if n.orientation == o}) for o in ("HORIZONTAL", "VERTICAL")}
    return any(abs(b - a - value) / max(value, 1) < 0.05 for ps in place.values() for i, a in enumerate(ps) for b in ps[i + 1 :])


def _nearest(x, y, lines):
    return min(((math.dist(_middle(n), (x, y)), n.line_no, n.orientation) for n in lines if math.dist(_middle(n), (x, y)) <= 200), default=None)


def _words(x, y, texts):
    near = sorted((t.text_no, t.text) for t in texts if math.dist((t.x, t.y), (x, y)) <= 200)
    return list(dict.fromkeys(w for _, text in near for w in text.lower().split()))[:30]


def test_spatial_queries_at_the_reference_radii(spark):
    ask = lambda name: registry.queries()[name](spark, SF).collect()
    lines, texts = _by_sheet(drawing_queries._lines(spark, SF).collect()), _by_sheet(drawing_queries._texts(spark, SF).collect())
    dims = drawing_queries._dimensions(spark, SF).collect()
    assert {(r.sheet, r.text_no) for r in ask("geometry_confirmation_whole")} == {(s, t.text_no) for s, ts in texts.items() for t in ts if _confirmed(t.x, t.y, t.text_no % 90 + 10.0, lines[s])}
    assert {(r.sheet, r.dim_no): r.words for r in ask("nearby_words_whole")} == {(m.sheet, m.dim_no): " ".join(_words(m.x, m.y, texts[m.sheet])) for m in dims}
    best = {(m.sheet, m.dim_no): _nearest(m.x, m.y, lines[m.sheet]) for m in dims}
    assert {(r.sheet, r.point_no): (r.line_no, r.orientation) for r in ask("nearest_line_whole")} == {k: v[1:] for k, v in best.items() if v}

    keyed = _by_sheet(sheet_queries._keyed(drawing_queries._lines(spark, SF), "sheet", "line_no").collect())
    regions, boxes = {}, {}
    for s, ns in keyed.items():
        ends = {n.line_no: ((n.x0, n.y0), (n.x1, n.y1)) for n in ns}
        ticks = [e for pair in ends.values() if math.dist(*pair) <= 30 for e in pair]
        regions |= {(s, n.line_no): _middle(n) for n in ns if math.dist(*ends[n.line_no]) > 30 and all(any(math.dist(e, t) <= 50 for t in ticks) for e in ends[n.line_no])}
        spot = {n.line_no: (*_middle(n), math.degrees(math.atan2(n.y1 - n.y0, n.x1 - n.x0)) % 180 * 5) for n in ns}
        label = {k: k for k in spot}
        links, moved = [(a, b) for a in spot for b in spot if a < b and math.dist(spot[a], spot[b]) <= 20], True
        while moved:
            moved = False
            for a, b in links:
                if label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
        chains = defaultdict(list)
        for n in ns:
            chains[label[n.line_no]].append(n)
        for k, c in chains.items():
            xs, ys = [x for n in c for x in (n.x0, n.x1)], [y for n in c for y in (n.y0, n.y1)]
            boxes[s, k] = (len(c), min(xs), min(ys), max(xs), max(ys)) if len(c) > 1 else (1, c[0].x0, c[0].y0, c[0].x1, c[0].y1)
    assert {(r.sheet, r.line_no): (r.cx, r.cy) for r in ask("dimension_regions_whole")} == regions
    assert {(r.sheet, r.first_no): (r.n_lines, r.x0, r.y0, r.x1, r.y1) for r in ask("merged_segments")} == boxes


def test_measurements_at_the_reference_radii(spark):
    m = {k: scratch.written(v.where("sheet < 5"), k) for k, v in sheet_queries._measured(spark, SF).items()}
    got = measurements.all_measurements(m["dimensions"], m["texts"], m["lines"], m["circles"], m["scales"], m["texts"].where("sheet % 2 = 0")).collect()
    lines, texts, known = _by_sheet(m["lines"].collect()), _by_sheet(m["texts"].collect()), {r.sheet: r.known for r in m["scales"].collect()}
    dims = m["dimensions"].collect()
    want = sorted((n.sheet, n.value, n.x, n.y, _words(n.x, n.y, texts[n.sheet])) for n in dims if n.value > 0)
    assert sorted((r.sheet, r.value_mm, r.x, r.y, r.context_words) for r in got if r.method == "DIMENSION_ENTITY") == want
    covered = {(n.sheet, n.x, n.y) for n in dims}
    want, bonuses = [], set()
    for t in m["texts"].select("*", F.explode(callouts.text_matches(F.col("text"))).alias("m")).collect():
        if (t.sheet, t.x, t.y) in covered or not t.m.mm_values or t.m.mm_values[0] <= 0:
            continue
        value = t.m.mm_values[0]
        bonus = 1.1 if known.get(t.sheet) and _confirmed(t.x, t.y, value, lines[t.sheet]) else 1.0
        bonuses.add(bonus)
        line = _nearest(t.x, t.y, lines[t.sheet])
        sure = min(1.0, 0.72 * (1.0 if known.get(t.sheet) else 0.7) * (1.05 if t.m.unit else 0.9) * bonus)
        want.append((t.sheet, t.text, value, t.x, t.y, round(sure, 9), line[2] if line and line[2] != "DIAGONAL" else "ANY"))
    assert bonuses == {1.0, 1.1}
    assert sorted((r.sheet, r.source_text, r.value_mm, r.x, r.y, round(r.confidence, 9), r.direction) for r in got if r.method in ("TEXT", "MTEXT") and r.value_mm > 0) == sorted(want)


LAYERS = {0: ("A-WALL", ["a", "wall"]), 1: ("_Glass", ["", "glass"]), 2: ("", []), 3: (None, [])}


def test_line_pairs_by_layer_and_scale(spark):
    rng, rows = random.Random(3), []
    for sheet in range(4):
        for n in range(70):
            along, across = rng.choice([0, 3, 50, 900, 4_990, 5_003, 12_000]) + rng.random() * 40, rng.choice([0.0, 0.3, 7.25, 7.25, 4_900, 9_000]) + rng.choice([0, 0.2, 3])
            long = rng.choice([4.9, 5.0, 20, 64, 65, 300, 5_000, 1_000_000])
            ends = (along, across, along + long, across) if n % 2 else (across, along + long, across, along)
            rows.append((sheet, 10 * n, *map(float, ends), "HORIZONTAL" if n % 2 else "VERTICAL", LAYERS[rng.randrange(4) if sheet else 3][0]))
    scale = {0: 1.0, 1: 25.4, 2: 0.0}
    want = {}
    for sheet in range(4):
        own = [r for r in rows if r[0] == sheet]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if a[6] != b[6]:
                    continue
                lo, hi, at = (2, 4, 3) if a[6] == "HORIZONTAL" else (3, 5, 2)
                facing = min(max(a[lo], a[hi]), max(b[lo], b[hi])) - max(min(a[lo], a[hi]), min(b[lo], b[hi]))
                gap = abs((a[at] + a[at + 2]) / 2 - (b[at] + b[at + 2]) / 2)
                short = min(abs(a[lo] - a[hi]), abs(b[lo] - b[hi])) < 5
                if facing < 5 or short or not 0.5 <= gap <= 5_000:
                    continue
                mm = gap * (scale.get(sheet) or 1.0)
                words = [w for layer, ws in LAYERS.values() for w in ws if layer == a[7]] + [w for layer, ws in LAYERS.values() for w in ws if layer == b[7]]
                want.setdefault((sheet, a[6], float(decimal.Decimal(repr(mm)).quantize(decimal.Decimal("0.1"), decimal.ROUND_HALF_EVEN))), (a[1], b[1], mm, a[7] or b[7] or None, (a[2] + a[4] + b[2] + b[4]) / 4, (a[3] + a[5] + b[3] + b[5]) / 4, words))
    df = spark.createDataFrame(rows, "sheet int, line_no int, x0 double, y0 double, x1 double, y1 double, orientation string, layer string").repartition(4)
    scales = spark.createDataFrame([(s, v, s == 1) for s, v in scale.items()], "sheet int, mm_per_unit double, known boolean")
    got = {(r.sheet, r.orientation, r.value): (r.a_no, r.b_no, r.value_mm, r.layer, r.x, r.y, r.words) for r in geometry.line_pairs(df, scales).collect()}
    assert got == want and len(want) > 200
    made = measurements.pair_pass(df, scales).collect()
    assert {(r.sheet, round(r.confidence, 6)) for r in made} == {(0, 0.336), (1, 0.62), (1, 0.48), (2, 0.434), (2, 0.336), (3, 0.434), (3, 0.336)}
    assert geometry.line_pairs(df.where("false")).count() == 0 and geometry.line_pairs(df.drop("layer")).where("layer is not null").count() == 0


def test_sheet_parents_at_the_reference_cap(spark):
    sheets_of = defaultdict(list)
    for r in sheet_queries._sheet_chunks(spark, SF).collect():
        sheets_of[r.document, r.sheet].append((r.chunk_no, r.text))
    full = {k: f"=== BOQ: {k[1]} ({k[0]}) ===\n\n" + "\n\n".join(t for _, t in sorted(v)) for k, v in sheets_of.items()}
    assert max(len(t.split()) for t in full.values()) > 40
    want = {k: (min(len(t.split()), 3000), t if len(t.split()) <= 3000 else " ".join(t.split()[:3000])) for k, t in full.items()}
    assert {(r.document, r.sheet): (r.n_words, r.text) for r in registry.queries()["sheet_parents_whole"](spark, SF).collect()} == want


def test_sheet_parents_cut(spark):
    chunks = [("d", "a", n, f"{n} x y") for n in range(1200)] + [("d", "b", 0, "x  y")]
    got = {r.sheet: r for r in blocks.sheet_parents(spark.createDataFrame(chunks, "document string, sheet string, chunk_no int, text string")).collect()}
    assert got["a"].n_words == 3000 and got["a"].text == " ".join("=== BOQ: a (d) ===".split() + [w for c in chunks[:1200] for w in c[3].split()][:2995])
    assert (got["b"].n_words, got["b"].text) == (7, "=== BOQ: b (d) ===\n\nx  y")


def test_grid_text_is_kept(spark):
    rows = _by_sheet(drawing_queries._grid(spark, SF).collect())
    want = {}
    for s, rs in rows.items():
        names = next(r.cells for r in rs if r.row_no == 1)
        filled = [(r.row_no, v) for r in rs if r.row_no > 1 and (v := [c for c in r.cells if c])]
        lines = [t for _, t in sorted((n, f"Row {n}: " + " | ".join(f"{h}: {c}" for h, c in zip(names, v))) for n, v in filled)]
        for k in range(0, len(lines), 25):
            want[s, k // 25] = (len(lines[k : k + 25]), "\n".join(lines[k : k + 25]))
    assert {(r.sheet, r.chunk_no): (r.n_rows, r.text) for r in registry.queries()["grid_text_chunks_whole"](spark, SF).collect()} == want


def test_spacings_on_both_axes(spark):
    got = {(r.axis, r.sheet, r.bin): (r.n, r.spacing) for r in registry.queries()["spacing_hist_whole"](spark, SF).collect()}
    want = {}
    for s, ns in _by_sheet(drawing_queries._lines(spark, SF).collect()).items():
        for axis in (0, 1):
            marks = sorted({_middle(n)[axis] for n in ns})
            gaps = [b - a for i, a in enumerate(marks) for b in marks[i + 1 :] if 50 <= b - a <= 10_000]
            if gaps:
                width = (max(gaps) + 10) / (max(gaps) // 10 + 1)
                bins = Counter(math.floor(g / width) for g in gaps)
                for k, n in sorted(bins.items(), key=lambda x: (-x[1], x[0]))[:3]:
                    if n >= 2:
                        want["xy"[axis], s, k] = (n, k * width + 5)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and {k[0] for k in got} == {"x", "y"}
    assert all(abs(got[k][1] - want[k][1]) <= 0.0501 for k in want)


def test_previews_are_kept(spark):
    chunks = document_queries._chunks(spark, SF).collect()
    got = {r.record_id: r.preview for r in registry.queries()["vector_records_whole"](spark, SF).collect()}
    assert got == {f"{c.doc_id}_{c.chunk_index}": " ".join(c.words)[:200] for c in chunks}


def test_repeated_turns_are_kept(spark, tmp_path):
    turns = [("c", n // 2, "user" if n % 2 else "assistant", f"t{n}") for n in range(10)] + [("c", 4, "user", "t0")]
    spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = [(t[1], t[2], n) for n, t in enumerate(sorted(turns, key=lambda t: t[1:])[-6:], 1)]
    assert sorted((r.turn, r.role, r.place) for r in registry.queries()["recent_turns"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("limit", [1_000, 10])
def test_inserts_of_few_blocks_are_many_tasks(spark, limit):
    """One block has most of the inserts and entities, and its rows lie in many tasks all the same."""
    inserts = spark.range(400).selectExpr("id div 10 sheet", "id insert_no", "if(id % 20 = 0, 'b', if(id % 33 = 1, null, 'a')) block_name").coalesce(1)
    entities = spark.range(90).selectExpr("if(id % 30 = 0, 'b', 'a') block_name", "id entity_no", "concat('t', id) text").unionByName(spark.sql("select cast(null as string) block_name, 7L entity_no, 'x' text"))
    got = sheets.block_inserts(inserts, entities, 1_500, limit)
    want = sorted((r.block_name, r.sheet, r.insert_no, e.entity_no, e.text) for r in inserts.collect() for e in entities.collect() if r.block_name is not None and r.block_name == e.block_name)
    assert sorted(map(tuple, got.collect())) == want
    tasks = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(tasks) < len(want) / 4


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_inserts_are_written_in_runs(spark, tmp_path, limit):
    """Files hold a run of inserts for each entity, so that they take a fraction of a byte a row, not a number a row."""
    inserts = spark.range(1_200).selectExpr("id div 4 sheet", "if(id % 5 = 0, null, id % 4) insert_no", "if(id % 100 = 7, 'c', 'b') block_name").repartition(3)
    entities = spark.range(2_020).selectExpr("if(id < 20, 'c', 'b') block_name", "id * 7919 entity_no", "if(id % 9 = 0, null, concat('text ', id)) text")
    sheets.block_inserts(inserts, entities, 1_500_000, limit).write.parquet(f"{tmp_path}/rows")
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert got.columns == ["block_name", "sheet", "insert_no", "entity_no", "text"]
    want = inserts.join(entities, "block_name").select(got.columns)
    key = lambda df: df.select(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38)"))).first()
    assert key(got) == key(want) and key(want)[0] == 1_188 * 2_000 + 12 * 20
    assert sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet")) < 2_200_000


def _shuffled(spark, ask, number="shuffleWriteRecords"):
    """What `ask` gives, and the rows (or bytes) that its stages shuffled."""
    gateway = spark.sparkContext._gateway

    def stages() -> dict[int, int]:
        new = gateway.jvm.java.util.ArrayList
        every = spark._jsc.sc().statusStore().stageList(new(), False, False, gateway.new_array(gateway.jvm.double, 0), new())
        return {s.stageId(): getattr(s, number)() for s in (every.apply(i) for i in range(every.size()))}

    before = stages()
    out = ask()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def test_lines_of_a_sheet_are_shuffled_once(spark):
    """Sheets merged in tasks equal those merged by joins, and a line is shuffled once, not once for each of nine cells and each round."""
    rng = random.Random(3)
    at = [(i % 7 % 5, i, float(rng.randrange(900)), float(rng.randrange(900)), i % 2) for i in range(6_000)]
    lines = spark.createDataFrame([(s, i, x, y, x + 4 * k, y + 4 * (1 - k)) for s, i, x, y, k in at], "sheet long, line_no long, x0 double, y0 double, x1 double, y1 double")
    rows = lambda *limit: sorted(map(tuple, geometry.merged_segments(lines, 15.0, *limit).collect()))
    got, n = _shuffled(spark, rows)
    assert n < 2 * 6_000
    assert sum(r[2] for r in got) == 6_000 and len(got) > 100 and max(r[2] for r in got) > 5
    assert got == rows(0) == rows(1_000)


def test_lines_that_pair_are_shuffled_once(spark):
    """Pairs of sheets met in tasks equal those met by joins, with numbers and places in common, and are no rows: a line is shuffled once."""
    rng = random.Random(5)
    rows = []
    for i in range(1_500):
        along, across, long = rng.randrange(60) * 7.0, rng.choice([i % 200, rng.randrange(900) / 4, rng.randrange(300) * 0.05]), rng.choice([4.9, 5.0, 60.0, 700.0])
        ends = (along, across, along + long, across) if i % 2 else (across, along + long, across, along)
        rows.append((i % 7 % 4, rng.randrange(900), *map(float, ends), "HORIZONTAL" if i % 2 else "VERTICAL", rng.choice(["A-x", "", None, "B_y z"])))
    rows += [(1, None, 0.0, 0.0, 90.0, 0.0, "HORIZONTAL", "c"), (None, 3, 0.0, 9.0, 90.0, 9.0, "HORIZONTAL", "c"), (1, 3, 0.0, None, 90.0, 0.0, "HORIZONTAL", "c"), (2, 3, 0.0, 0.0, 90.0, 90.0, "DIAGONAL", "c")]
    lines = spark.createDataFrame(rows, "sheet long, line_no long, x0 double, y0 double, x1 double, y1 double, orientation string, layer string")
    scales = spark.createDataFrame([(0, 1.0, "a"), (1, 25.4, "b"), (2, 0.35, "c")], "sheet long, mm_per_unit double, mark string")
    pairs = lambda *limit: sorted(map(repr, geometry.line_pairs(lines, scales, 5_000.0, *limit, kept=("mark",)).collect()))
    got, n = _shuffled(spark, pairs)
    assert n < 2 * len(rows) < len(got)
    assert got == pairs(0) == pairs(400)


def test_tenths_are_those_of_the_digits(spark):
    x = [0.05, 0.15, 0.25, 0.35, 1.45, 2.675, 0.15000000000000002, 0.24999999999999997, 8.85 * 25.4, 1e15 + 0.5, 3e18, 4999.95, 0.0] + [k * 0.05 * 25.4 for k in range(400)] + [k / 20 for k in range(2_000)]
    want = [r.v for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").orderBy("i").select(F.bround("x", 1).alias("v")).collect()]
    assert geometry._tenths(np.array(x)).tolist() == want
    assert sorted(geometry._firsts(np.array(want)).tolist()) == sorted({v: want.index(v) for v in want}.values())


def test_points_meet_the_lines_of_their_sheet(spark):
    """What is found in tasks equals what is found by joins and in plain Python; points and lines are shuffled once, pairs are no rows."""
    rng = random.Random(9)
    lines = [(i % 5, rng.randrange(300), *(p := (rng.randrange(120) * 5.0, rng.randrange(120) * 5.0)), p[0] + 8 * (i % 2), p[1] + 8 * (1 - i % 2), "HORIZONTAL" if i % 2 else "VERTICAL") for i in range(800)]
    points = [(i % 6 if i % 50 else None, i, rng.randrange(600) * 1.0 if i % 31 else None, rng.randrange(600) * 1.0, rng.choice([None, 0.01, 7.0, 20.0, 35.5]), f"t{i}") for i in range(600)]
    of_lines = spark.createDataFrame([*lines, (None, 1, 0.0, 0.0, 8.0, 0.0, "HORIZONTAL")], "sheet long, line_no long, x0 double, y0 double, x1 double, y1 double, orientation string")
    of_points = spark.createDataFrame(points, "sheet long, point_no long, x double, y double, asked double, text string")
    ask = lambda *limit: {r.point_no: (r.text, r.line_no, r.orientation, r.distance and round(r.distance, 9), r.confirmed) for r in geometry.beside_lines(of_points, of_lines, 25.0, 60.0, 0.05, *limit).collect()}
    got, n = _shuffled(spark, ask)
    want = {}
    for sheet, no, x, y, asked, text in points:
        near = [] if None in (sheet, x) else [(math.dist((x, y), ((n[2] + n[4]) / 2, (n[3] + n[5]) / 2)), n[1], n[6], (n[3] + n[5]) / 2 if n[6] == "HORIZONTAL" else (n[2] + n[4]) / 2) for n in lines if n[0] == sheet]
        best = min([m for m in near if m[0] <= 25], default=None)
        sure = asked is not None and asked > 0.05 and any(a[2] == b[2] and abs(b[3] - a[3] - asked) < 0.05 * max(asked, 1) for a in near for b in near if a[0] <= 60 and b[0] <= 60)
        want[no] = (text, best and best[1], best and best[2], best and round(best[0], 9), sure)
    short = lambda rows: {k: (v[0], v[1], v[3], v[4]) for k, v in rows.items()}
    assert short(got) == short(want) == short(ask(0)) and short(ask(90)) == short(want)
    assert {v[4] for v in want.values()} == {True, False} and n < 2 * (len(lines) + len(points))


def test_words_near_dimensions_are_no_rows_of_pairs(spark):
    rng = random.Random(11)
    texts = spark.createDataFrame([(i % 4, i, rng.choice(["Typ  Wall", "a b", "", None, f"N {i}"]), rng.randrange(300) * 1.0, rng.randrange(300) * 1.0) for i in range(900)], "sheet long, text_no long, text string, x double, y double")
    dims = spark.createDataFrame([(i % 5, i // 2, rng.randrange(300) * 1.0, rng.randrange(300) * 1.0) for i in range(200)], "sheet long, dim_no long, x double, y double")
    ask = lambda *limit: sorted((r.sheet, r.dim_no, r.words) for r in geometry.nearby_words(dims, texts, 120.0, *limit).collect())
    got, n = _shuffled(spark, ask)
    near = lambda sheet, no: [t for t in sorted(texts.where(f"sheet = {sheet} and text is not null").collect(), key=lambda t: t.text_no) if any(math.dist((t.x, t.y), (m.x, m.y)) <= 120 for m in of[sheet, no])]
    of = defaultdict(list)
    for m in dims.collect():
        of[m.sheet, m.dim_no].append(m)
    want = [(s, no, list(dict.fromkeys(w for t in near(s, no) for w in t.text.lower().split(" ") if w))[:30]) for s, no in list(of)[:25]]
    assert all(w in got for w in want) and got == ask(0) == ask(210) and n < 900 + 5 * 200


def test_batches_are_made_without_texts(spark, tmp_path):
    """Chunks are numbered by what is known of their sections' sizes: their words are neither shuffled nor written."""
    rng = random.Random(13)
    line = lambda: rng.choice(["", "   ", "Head", "A subheading of some words here", "x " * 300, "tab\there  and   double spaces that are longer than forty characters", " ".join(f"{rng.random()}" for _ in range(rng.randrange(5, 400)))])
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(40))) if i % 9 else [None, "", "Only", " \n"][i // 9 % 4], f"s{i % 3}") for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    chunks = document_queries._chunks(spark, str(tmp_path)).where("chunk_level = 0")
    places = blocks.parent_places(blocks.lines_as_blocks(document_queries.table(spark, str(tmp_path), "documents")), 300, 50)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "project", "chunk_index", "n_words", "n_tokens").collect()))
    assert rows(places) == rows(chunks) and places.select("chunk_index", "n_words", "n_tokens").dtypes == chunks.select("chunk_index", "n_words", "n_tokens").dtypes
    want = sorted((r.project, r.ordinal, (r.ordinal - 1) // 25) for r in blocks.interleaved(chunks).collect())
    got, n = _shuffled(spark, lambda: sorted(map(tuple, registry.queries()["fixed_batches"](spark, str(tmp_path)).collect())), "shuffleWriteBytes")
    assert got == want and want
    assert n < sum(len(text or "") for _, text, _ in docs) / 4
