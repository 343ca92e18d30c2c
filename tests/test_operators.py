"""Operators that SQL can't hold, against plain Python."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import callouts, measures, routing
from plumbline.operators import blocks, geometry, matching, results, retrieval, sheets, successors
from plumbline.sources import grid
from plumbline.streaming import intake


def test_context_windows(spark):
    rows = [("p", i, t) for i, t in enumerate([500, 40, 40, 40, 40, 90, 10], 1)]
    got = {}
    for r in blocks.context_windows(spark.createDataFrame(rows, "project string, ordinal long, n_tokens long"), 120).collect():
        got.setdefault(r.window_no, []).append(r.ordinal)
    assert {k: sorted(v) for k, v in got.items()} == {0: [1], 1: [1, 2], 2: [1, 2, 3], 3: [1, 2, 3, 4], 4: [2, 3, 4, 5], 5: [3, 4, 5, 6], 6: [4, 5, 6, 7]}
    assert blocks.context_windows(spark.createDataFrame([], "project string, ordinal long, n_tokens long"), 120).count() == 0


def test_token_estimate(spark):
    row = spark.range(1).select(*[blocks.estimated_tokens(F.lit(n)).alias(f"c{n}") for n in (0, 1, 10)]).first()
    assert tuple(row) == (0, 1, 13)


def test_sanitised_cuts_between_characters(spark):
    texts = ["é" * 6000, "a" + "é" * 6000, "x\x00y�", " ", None, "😀" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, clean in df.select("i", retrieval.sanitised(F.col("text"))).collect():
        want = "".join(c for c in (texts[i] or "") if ord(c) > 31 and c != "�").strip() or retrieval.EMPTY_TEXT
        assert clean == want.encode()[: retrieval.MAX_BYTES].decode(errors="ignore")


def test_embedding_hook_bisects(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a", "bad", "ccc"])], "id string, text string")
    assert {r.text: r.embedding for r in retrieval.embedded(rows, embed).collect()} == {"a": [1.0], "bad": None, "ccc": [3.0]}


def test_file_types(spark):
    cases = {"tender_spec.pdf": "pdf_spec", "facade_drawing_rev2.pdf": "pdf_drawing", "a.DOCX": "docx_spec", "b.csv": "excel_boq", "c.dwg": "dwg_drawing", "image.png": None}
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    assert {r[0]: r[1] for r in df.select("f", routing.file_type(F.col("f"))).collect()} == cases


def test_ocr_does_not_chain(spark):
    df = spark.createDataFrame([("1OI",), ("IO1",), ("OIl",), ("",)], "t string")
    assert [r[0] for r in df.select(measures.ocr_corrected(F.col("t"))).collect()] == ["10I", "I01", "OIl", ""]


def test_answers(spark):
    answers = spark.createDataFrame([(1, '{"a": {"found": true, "value": "", "confidence": 0.9}}'), (2, '{"a": {"fou')], "answer_id long, response_text string")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "answer_id long, parameter string")
    got = {(r.answer_id, r.parameter): (r.found, r.confidence, r.reason) for r in results.parsed_answers(answers, expected).collect()}
    assert got == {(1, "a"): (True, 0.0, None), (1, "b"): (False, 0.0, "Missing in response"), (2, "a"): (False, 0.0, "JSON parse failed")}


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "doc_id long, text string")
    once = results.replace_documents(old, new)
    assert sorted(map(tuple, results.replace_documents(once, new).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (2, "d")]


def test_merge_stream_equals_batch(spark, tmp_path):
    rows = [("p", f"q{i % 3}", float(i), i, float(i % 7), (i * 37 % 100) / 100, (i * 13 % 3) * 20) for i in range(60)]
    schema = "project string, parameter string, seconds double, event_id long, value double, confidence double, priority long"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = intake.merged_values_stream(stream).writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = {(r.project, r.parameter): r.change_count for r in spark.table("merged").groupBy("project", "parameter").agg(F.max("change_count").alias("change_count")).collect()}
    batch = {(r.project, r.parameter): r.change_count for r in intake.merged_values(spark.createDataFrame(rows, schema)).collect()}
    assert last == batch


def test_bursts(spark):
    times = [0, 1, 2, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 31]
    events = spark.createDataFrame([("p", i, float(t)) for i, t in enumerate(times)], "project string, event_id long, seconds double")
    got = [(r.n_events, r.fired_at) for r in intake.bursts(events).orderBy("burst_no").collect()]
    assert got == [(3, 5.0), (10, 30.0), (2, 34.0)]
    assert math.isclose(sum(n for n, _ in got), len(times))


def test_burst_stream_equals_batch(spark, tmp_path):
    times = [0, 1, 2, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 31, 50, 52.5]
    rows = [(p, i + 100 * p, 1000.0 + t + p) for i, t in enumerate(times) for p in range(2)]
    batch = {(r.project, r.n_events, r.fired_at) for r in intake.bursts(spark.createDataFrame([(str(p), i, t) for p, i, t in rows], "project string, event_id long, seconds double")).collect()}
    schema = "project string, event_id long, ts timestamp"
    rows.sort(key=lambda r: r[2] + 4 * (r[1] % 3))  # some events come late, within what the watermark allows
    parts = [rows[:9], rows[9:20], rows[20:], [(9, 999, 1500.0)], [(9, 998, 1501.0)]]
    for part in parts:
        late = spark.createDataFrame([(str(p), i, t) for p, i, t in part], "project string, event_id long, t double")
        late.select("project", "event_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = intake.burst_stream(stream).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.project, r.n_events, r.fired_at) for r in spark.table("bursts").where("project <> '9'").collect()]
    assert len(got) == len(set(got)) and set(got) == batch


def test_title_zone_and_merge(spark):
    texts = spark.createDataFrame([(1, n, float(n), float(100 - n)) for n in range(100)] + [(2, n, 1.0, 99.0) for n in range(50)] + [(3, 0, None, None)], "sheet int, text_no int, x double, y double")
    pages = spark.createDataFrame([(s, 100.0, 100.0) for s in (1, 2, 3)], "sheet int, width double, height double")
    got = [(r.sheet, r.text_no) for r in sheets.title_zone(texts, pages).collect()]
    assert sorted(got) == [(1, n) for n in range(75, 100)] + [(2, n) for n in range(40)] + [(3, 0)]
    a = spark.createDataFrame([(1, "t", None), (2, None, "n")], "sheet int, title string, number string")
    b = spark.createDataFrame([(1, "u", "m"), (3, "v", None)], "sheet int, title string, number string")
    assert sorted(tuple(r) for r in sheets.merged_titleblocks(a, b).collect()) == [(1, "t", "m"), (2, None, "n"), (3, "v", None)]


def test_rectangle_segments(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 0.5), (1, 2, 0.0, 0.0, 2.0, 3.0)], "sheet int, rectangle_no int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r)[1:] for r in sheets.rectangle_segments(df).collect())
    assert got == [(1, 0, 0.0, 0.0, 4.0, 0.0), (1, 2, 4.0, 0.5, 0.0, 0.5), (2, 0, 0.0, 0.0, 2.0, 0.0), (2, 1, 2.0, 0.0, 2.0, 3.0), (2, 2, 2.0, 3.0, 0.0, 3.0), (2, 3, 0.0, 3.0, 0.0, 0.0)]


def test_tables_in_sections(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a", None), (1, 2, 1, "b", "c"), (1, 3, 2, "b", None)], "doc_id int, block_no int, page int, section string, subsection string")
    tables = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "doc_id int, page int, text string")
    assert sorted(tuple(r)[2:] for r in blocks.tables_in_sections(tables, rows).collect()) == [("x", "b", "c"), ("y", "b", None), ("z", None, None)]


def test_result_json(spark, tmp_path):
    rows = spark.createDataFrame([("f", "b", 1.0), ("f", "a", None), ("g", "a", 2.0)], "file string, parameter string, value double")
    results.result_json(rows, str(tmp_path / "out"))
    got = {r.file: [(x.parameter, x.value) for x in r.results] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"f": [("a", None), ("b", 1.0)], "g": [("a", 2.0)]}


def test_scales_of_odd_input(spark):
    df = spark.createDataFrame([(None, None, None), ("", 0.0, 0.0), ("SCALE 1:0", -1.0, 5.0)], "t string, a double, b double")
    got = df.select(measures.detected_scale(F.array("t"), F.lit(None).cast("int"), F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("s"), measures.scale_check(F.lit(1.0), F.lit("mm"), F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.s.source, r.s.denominator, r.s.mm_per_unit) for r in got] == [("HEADER", 1, 1.0)] * 3 and [tuple(r.c) for r in got] == [(False, 1.0)] * 3
    dims = [(None, None, 1.0, None), ("...", 5.0, 2.0, 32), ("<>", 5.0, 2.0, 292), ("<>", 0.0, 2.0, 32), ("1d", 0.0, 2.0, 32), ("1e2", 3.0, 2.0, 33)]
    rows = spark.createDataFrame(dims, "o string, l double, f double, c int").select(measures.resolved_dimension(*[F.col(c) for c in "olfc"]).alias("d")).collect()
    assert [r.d and (r.d.value_mm, r.d.kind) for r in rows] == [None, None, (10.0, "DIAMETER"), None, (2.0, "LINEAR"), (100.0, "ALIGNED")]
    assert spark.range(1).select(measures.imperial_mm(F.lit(1), F.lit(1), F.lit(2)), measures.imperial_mm(F.lit(1), F.lit(1), F.lit(0)), measures.from_mm(F.lit(50.8), F.lit("inch"))).first()[:] == (38.099999999999994, None, 2.0)


def test_empty_batch_totals(spark):
    empty = spark.createDataFrame([], "sheet int, n_extracted long, n_conflicts long, mean_confidence double")
    assert tuple(matching.batch_totals(empty).first()) == (0, 0, 0, 0.0)


def _python_matches(text):
    """Callouts of a plain text by Python's regular expressions: (position, pattern, raw_text), without overlaps."""
    found = []
    for rank, (name, pattern) in enumerate(callouts.PATTERNS.items()):
        if name == "typical":
            continue
        for k, m in enumerate(re.finditer(pattern, text, re.IGNORECASE)):
            if not (name == "nts" and k) and not (name == "fraction" and int(m.group(3)) == 0):
                found.append((m.start(), -len(m.group()), -1 if name == "nts" else rank, name, m.group()))
    kept, end = [], -1
    for start, shorter, _, name, raw in sorted(found):
        if start >= end:
            kept.append((start, name, raw))
            end = start - shorter
    return kept


def test_text_matches(spark):
    parts = ["150 mm", '6"', "1500x600mm", "150×75×6mm", "thk 6mm", "@600 c/c", "@ 300", "dia 25", "Ø12", "1 1/2", "3 1/0", "alloy 6063-T6", "finish: PVDF", "4 nos", "scale 1:50", "90°", "NTS", "typ.", "min 5 m", "t = 3 cm", "no number"]
    texts = ["", " ", None, *parts, *[f"{a} {b}, {a}" for a in parts for b in parts]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", callouts.text_matches(F.col("text")).alias("m")).collect():
        assert [(m.position, m.pattern, m.raw_text) for m in r.m] == _python_matches(" ".join((texts[r.i] or "").split())), texts[r.i]
    cases = {"150 mm": [150.0], '6"': [6 * 25.4], "1500x600mm": [1500.0, 600.0], "150×75×6mm": [150.0, 75.0, 6.0], "dia 25": [25.0], "1 1/2": [1.5 * 25.4], "2 m": [2000.0], "4 nos": [], "90°": [90.0]}
    rows = spark.createDataFrame([(c,) for c in cases], "text string").select("text", callouts.text_matches(F.col("text"))[0].alias("m")).collect()
    assert {r.text: [round(v, 6) for v in r.m.mm_values] for r in rows} == {k: [round(v, 6) for v in vs] for k, vs in cases.items()}
    coded = spark.createDataFrame([(r"{\fArial|b0;GLASS \U+00D8 25mm\Ptyp.}",)], "text string").select(callouts.plain_mtext(F.col("text")), callouts.text_matches(F.col("text"))[0].alias("m")).first()
    assert coded[0] == "GLASS Ø 25mm typ." and (coded.m.pattern, coded.m.qualifier, coded.m.mm_values) == ("diameter", "TYP", [25.0])


def test_merged_segments(spark):
    rng = random.Random(5)
    rows = [(s, n, float(rng.randrange(150)), float(rng.randrange(150)), 0.0, 0.0) for s in range(3) for n in range(40)]
    rows = [(s, n, x, y, x + 4 * (n % 2), y + 4 * (1 - n % 2)) for s, n, x, y, _, _ in rows]
    spot = {(s, n): ((x0 + x1) / 2, (y0 + y1) / 2, math.degrees(math.atan2(y1 - y0, x1 - x0)) % 180 * 5) for s, n, x0, y0, x1, y1 in rows}
    label = {k: k for k in spot}
    for _ in spot:
        for a in spot:
            for b in spot:
                if a[0] == b[0] and math.dist(spot[a], spot[b]) <= 20:
                    label[a] = label[b] = min(label[a], label[b])
    got = geometry.merged_segments(spark.createDataFrame(rows, "sheet int, line_no int, x0 double, y0 double, x1 double, y1 double")).collect()
    want = {}
    for s, n, *ends in rows:
        want.setdefault(label[s, n], []).append(ends)
    assert {(r.sheet, r.first_no): (r.n_lines, r.x0, r.y0, r.x1, r.y1) for r in got} == {k: (len(v), min(e[0] for e in v), min(e[1] for e in v), max(e[2] for e in v), max(e[3] for e in v)) for k, v in want.items()}
    assert geometry.merged_segments(spark.createDataFrame([], "sheet int, line_no int, x0 double, y0 double, x1 double, y1 double")).count() == 0


def test_overlap_chunks(spark):
    rows = [("a b c", 1, "s", 0), ("head", 1, "s", 1), ("d e", 1, "s", 0), ("f g h i", 2, "t", 0), ("j", 2, None, 0), ("", 3, "t", 0)]
    df = spark.createDataFrame([(1, i, p, s, None, t, h) for i, (t, p, s, h) in enumerate(rows)], "doc_id long, block_no long, page int, section string, subsection string, text string, heading int")
    got = lambda size, overlap: [tuple(r)[1:7] for r in blocks.overlap_chunks(df, size, overlap).orderBy("chunk_no").collect()]
    assert got(5, 1) == [(0, 0, 2, 5, 1, 2), (1, 2, 3, 6, 2, 2), (2, 3, 5, 5, 2, 3)]
    assert got(100, 100) == [(0, 0, 5, 10, 1, 3)]
    assert blocks.overlap_chunks(df.where("false")).count() == 0


def filled(tokens, budget):
    """Windows of a greedy fill, by hand: (window_no, place) of each taken row."""
    out, window, used, number = [], [], 0, 0
    for i, t in enumerate(tokens):
        if window and used + t > budget:
            out += [(number, w) for w in window]
            number, window = number + 1, window[-blocks.OVERLAP_CHUNKS :]
            used = sum(tokens[w] for w in window)
        window.append(i)
        used += t
    return out + [(number, w) for w in window]


@pytest.mark.parametrize("block_rows", [4, 7, 50_000])
def test_windows_in_blocks_of_any_size(spark, block_rows):
    rng = random.Random(block_rows)
    groups = {"hot": [rng.randrange(0, 30) for _ in range(400)], "one": [99], "zero": [0] * 9, None: [rng.randrange(1, 9) for _ in range(25)], "big": [60, 5, 70, 1, 1, 80, 2]}
    rows = [(g, 10 * i, t) for g, tokens in groups.items() for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "project string, ordinal long, n_tokens long").repartition(5)
    got = sorted((r.project or "", r.window_no, r.ordinal) for r in blocks.context_windows(df, 50, block_rows).collect())
    assert got == sorted((g or "", n, 10 * i) for g, tokens in groups.items() for n, i in filled(tokens, 50))
    assert blocks.context_windows(df.where("false"), 50).count() == 0


def overlapped(rows, size, overlap):
    """Chunks of (block_no, page, section, subsection, n_words), by a fold."""
    out, pieces, used, pages, section, subsection = [], [], 0, set(), None, None
    for no, page, s, u, n in rows:
        pages.add(page)
        section, subsection = s or section, u or subsection
        if pieces and used + n > size:
            out.append((len(out), pieces[0][0], pieces[-1][1], used, min(pages), max(pages), section, subsection))
            kept = pieces[-overlap:]
            used = sum(k[2] for k in kept)
            pieces, pages, section, subsection = [(kept[0][0], kept[-1][1], used)], {page}, s or None, u or None
        pieces.append((no, no, n))
        used += n
    return [*out, (len(out), pieces[0][0], pieces[-1][1], used, min(pages), max(pages), section, subsection)] if pieces else out


@pytest.mark.parametrize("size, overlap, block_rows", [(12, 1, 6), (12, 2, 50_000), (40, 3, 5), (40, 9, 8), (100, 100, 11)])
def test_overlapping_chunks_in_blocks_of_any_size(spark, size, overlap, block_rows):
    rng, rows, want = random.Random(size + overlap), [], []
    for doc, n in ((1, 300), (2, 1), (3, 40), (4, 2)):
        own = [(3 * i, 1 + i // 7, rng.choice(["s", "t", "", None]), rng.choice(["u", None]), rng.choice([0, 1, 1, 2, 3, 20])) for i in range(n)]
        rows += [(doc, b, p, s, u, " ".join(["w"] * w), 0) for b, p, s, u, w in own] + [(doc, 3 * n, 9, "head", None, "title", 1)]
        want += [(doc, *c) for c in overlapped(own, size, overlap)]
    df = spark.createDataFrame(rows, "doc_id long, block_no long, page int, section string, subsection string, text string, heading int").repartition(4)
    assert sorted(map(tuple, blocks.overlap_chunks(df, size, overlap, block_rows).collect())) == sorted(want)


def test_overlapping_chunks_are_folded_in_one_reading(spark):
    """Documents of usual size need no chain of successors, of which each step is a job with tables of its own."""
    rng, rows, want = random.Random(1), [], []
    for doc in range(30):
        own = [(i, 1 + i // 7, rng.choice(["s", "t", None]), rng.choice(["u", None]), rng.choice([0, 1, 2, 3, 20])) for i in range(rng.randrange(1, 120))]
        rows += [(doc, b, p, s, u, " ".join(["w"] * w), 0) for b, p, s, u, w in own]
        want += [(doc, *c) for c in overlapped(own, 40, 5)]
    df = spark.createDataFrame(rows, "doc_id long, block_no long, page int, section string, subsection string, text string, heading int").repartition(4)
    spark.sparkContext.setJobGroup("overlap-chunks", "overlap_chunks")
    try:
        got = sorted(map(tuple, blocks.overlap_chunks(df, 40, 5).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("overlap-chunks"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(want)
    assert jobs < 12


def test_no_task_of_a_chain_holds_a_hot_group(spark):
    n, block = 30_000, 1_000
    steps = spark.range(n).select(F.lit("hot").alias("g"), F.col("id").alias("at"), F.when(F.col("id") < n - 1, F.least(F.col("id") + 1 + F.col("id") % 3, F.lit(n - 1))).alias("next"))
    at, want = 0, []
    while at < n - 1:
        at = min(at + 1 + at % 3, n - 1)
        want.append(at)
    found = successors.chain(steps, "g", block)
    assert [r.at for r in found.orderBy("number").collect()] == want and found.where("number < 1").count() == 0
    sizes = steps.groupBy("g", F.floor(F.col("at") / block)).count().agg(F.max("count")).first()[0]
    assert sizes <= block


def test_grid_text_keeps_digits(spark):
    df = spark.createDataFrame([("s", 0, ["Sl No", "Description", "Qty"]), ("s", 1, ["11", " item 2 ", "212"]), ("s", 2, ["2", None, ""])], "sheet string, row_no long, cells array<string>")
    assert grid.grid_text_chunks(df, grid.header_rows(df)).first().text == "Row 1: Sl No: 11 | Description: item 2 | Qty: 212\nRow 2: Sl No: 2"


def test_cut_off_answers(spark):
    texts = ['{"a": {"found": true, "value": "1", "confidence": 0.5}, "b": {"found": tr', '{"a": {"found": true, "value": "1"', "garbage", "", None]
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id int, response_text string")
    expected = answers.select("answer_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("parameter"))
    got = {(r.answer_id, r.parameter): (r.found, r.reason) for r in results.parsed_answers(answers, expected).collect()}
    assert got[0, "a"] == (True, None) and got[0, "b"] == (False, "Missing in response")
    assert all(got[i, p] == (False, "JSON parse failed") for i in range(1, 5) for p in "ab")


def recovered(text):
    """The reading of cut-off JSON by trying every prefix that ends at a brace, longest first."""
    for end in range(len(text), 0, -1):
        if text[end - 1] != "}":
            continue
        for closers in range(8):
            try:
                return json.loads(text[:end] + "}" * closers)
            except json.JSONDecodeError:
                continue
    return None


def test_cut_off_json_is_read_in_one_pass(spark):
    whole = json.dumps({"a": {"found": True, "value": 'x } " { y', "list": [{"k": 1}, {"k": "]"}]}, "b": {"value": "back\\slash \\", "deep": {"er": {"c": 1}}}, "c": {"value": "ü😀"}}, ensure_ascii=False)
    texts = [whole[:n] for n in range(len(whole) + 1)] + [whole + " said {so}", "{}", "}{", "no json", '{"a": {"value": "' + "x" * 200_000 + '"}, "b": {"v', '{"a": {"value": "' + '\\"' * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", results.closed_prefix(F.col("text")).alias("p")).collect()
    for r in rows:
        want = recovered(texts[r.n]) if len(texts[r.n]) < 1_000 else None
        if len(texts[r.n]) < 1_000:
            assert (json.loads(r.p) if r.p is not None else None) == want, texts[r.n]
    long = {r.n: r.p for r in rows if len(texts[r.n]) > 1_000}
    assert sorted(p is None for p in long.values()) == [False, True] and max(len(p or "") for p in long.values()) == 200_020


def test_what_is_missing_is_asked_for_once_more(spark):
    asked = spark.createDataFrame([("whole", "w", ["a", "b"]), ("cut", "c", ["a", "b", "c", "d", "e"]), ("little", "l", ["a", "b", "c"]), ("fails", "f", ["a"]), ("again", "g", ["a", "b", "c"])], "answer_id string, context string, names array<string>")

    def ask(context, names):
        if context == "f" or context == "g" and len(names) < 3:
            raise ValueError("no answer")
        full = [f'"{n}": {{"found": true, "value": "{n}{len(names)}", "confidence": 0.5}}' for n in names]
        if context == "c" and len(names) == 3:
            return "{" + full[0] + ', "d": {"found": false}}'
        kept = {"c": 2, "l": 1, "g": 2}.get(context)
        return "{" + ", ".join(full[:kept]) + (', "' if kept else "}")

    got = {(r.answer_id, r.parameter): (r.found, r.value, r.again) for r in results.answered_with_retry(asked, ask).collect()}
    # cut: two of five are read, the others are asked for again, of which one is found. little: two of three are missing, too many to ask again.
    # again: one of three is asked for again and fails. fails: nothing is read, all is missing.
    assert got == {
        ("whole", "a"): (True, "a2", False), ("whole", "b"): (True, "b2", False),
        ("cut", "a"): (True, "a5", False), ("cut", "b"): (True, "b5", False), ("cut", "c"): (True, "c3", True), ("cut", "d"): (False, None, True), ("cut", "e"): (False, None, True),
        ("little", "a"): (True, "a3", False), ("little", "b"): (False, None, False), ("little", "c"): (False, None, False), ("fails", "a"): (False, None, False),
        ("again", "a"): (True, "a3", False), ("again", "b"): (True, "b3", False), ("again", "c"): (False, None, True),
    }


def test_hooks_and_retries(spark):
    rows = results.prompts(spark.createDataFrame([("p", 0, "c")], "project string, window_no long, context string"), spark.createDataFrame([(str(i), i) for i in range(30)], "name string, place int"))
    got = {r.batch_no: r.response_text for r in results.answered(rows, lambda c, names: f"{c}{len(names)}").collect()}
    assert got == {0: "c25", 1: "c5"}
    parsed = spark.createDataFrame([(1, p, True, None if p < "c" else "Missing") for p in "abcd"] + [(2, "a", False, "Missing")], "answer_id int, parameter string, unparsed boolean, reason string")
    assert sorted(tuple(r) for r in results.asked_again(parsed).collect()) == [(1, "c"), (1, "d")]


def test_phrases_over_several_texts(spark):
    rng, rows = random.Random(8), []
    pieces = ["floor", "plan", "", " ", "floor plan", "front", "elevation", "site", "the", "x" * 40, "wall section", "typical", "Floor", "ground", "plans", None]
    for sheet in range(6):
        rows += [(sheet, i, rng.choice(pieces)) for i in range(60 if sheet else 25)]
    titles = {s: t for s, t in enumerate(["plan", "", None, "typical", "section", "floor plan"])}
    want = {}
    for sheet, title in titles.items():
        text = " ".join(t for s, _, t in rows if s == sheet and t is not None).lower() + (" " + title.lower() if title else "") * 3
        scores = {kind: sum(len(re.findall(rf"\b{re.escape(k)}\b", text)) for k in words) for kind, words in sheets.SHEET_KEYWORDS.items()}
        top = max(scores.values())
        want[sheet] = (next(k for k in sheets.SHEET_PRIORITY if scores[k] == top), top, round(min(1.0, top / sum(scores.values()) * len(scores)), 3))
    texts = spark.createDataFrame(rows, "sheet int, text_no long, text string").repartition(4)
    heads = spark.createDataFrame(list(titles.items()), "sheet int, title string")
    got = {r.sheet: (r.sheet_type, r.score, r.confidence) for r in sheets.sheet_types(texts, heads).collect()}
    assert got == want
    assert sheets.sheet_types(texts.drop("text_no"), heads).where("sheet_type is not null").count() == 6
