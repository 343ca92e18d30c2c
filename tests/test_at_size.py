"""What decides whether a query holds at size: how rows are joined, how much is made, and that results stay the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.functions import callouts
from plumbline.operators import geometry, retrieval, sheets


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sheet(spark, n: int = 60):
    lines = spark.createDataFrame([(i % 2, i, float(i * 37 % 300), float(i * 53 % 200), float(i * 37 % 300 + (i % 3 > 0) * 12), float(i * 53 % 200 + (i % 3 == 0) * 12), "VERTICAL" if i % 3 == 0 else "HORIZONTAL") for i in range(n)], "sheet long, line_no long, x0 double, y0 double, x1 double, y1 double, orientation string")
    texts = spark.createDataFrame([(i % 2, i, float(i * 29 % 300), float(i * 31 % 200), float(i % 23 + 1)) for i in range(n)], "sheet long, text_no long, x double, y double, value double")
    return lines, texts


def test_neighbours_are_not_broadcast_by_cell(spark):
    lines, texts = _sheet(spark)
    points = texts.withColumnRenamed("text_no", "point_no")
    for df in (geometry.nearest_line(points, lines), geometry.geometry_confirmed(texts, lines), geometry.geometry_confirmed(texts, lines, 30.0)):
        assert "Broadcast" not in plan(df)


def test_confirmed_texts_are_those_of_all_pairs(spark):
    lines, texts = _sheet(spark)
    for radius in (25.0, 60.0, 400.0):
        got = {tuple(r) for r in geometry.geometry_confirmed(texts, lines, radius).collect()}
        expected = set()
        held = lines.collect()
        for t in texts.collect():
            mid = [((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2, r.orientation) for r in held if r.sheet == t.sheet]
            close = [m for m in mid if ((m[0] - t.x) ** 2 + (m[1] - t.y) ** 2) ** 0.5 <= radius]
            for way, axis in (("HORIZONTAL", 1), ("VERTICAL", 0)):
                p = [m[axis] for m in close if m[2] == way]
                if any(a < b and abs(b - a - t.value) < 0.05 * max(t.value, 1) for a in p for b in p):
                    expected.add((t.sheet, t.text_no))
        assert got == expected and (radius == 25.0 or expected)


def test_vector_pairs_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 3)
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", 5)
    rows = [(i, i % 2, [float(i * 7 % 11 - 5), float(i * 5 % 7 - 3), 1.0]) for i in range(40)] + [(100 + i, 0, [1.0, 2.0, 3.0]) for i in range(15)]
    rows += [(200, 0, None), (201, 0, [0.0, 0.0, 0.0]), (202, 1, [1.0, None, 2.0]), (203, 1, [1.0, 2.0]), (204, None, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, project long, embedding array<double>")
    queries = vectors.where("vec_id % 5 = 0 or vec_id > 200").selectExpr("vec_id query_id", "project", "embedding query_vector")
    found = retrieval.vector_topk(queries, vectors, 4)
    assert "FlatMapCoGroupsInArrow" in plan(found) and "BroadcastNestedLoop" not in plan(found)
    good = [r for r in rows if r[2] and None not in r[2] and any(r[2])]
    expected = set()
    for q in (r for r in good if r[0] % 5 == 0 or r[0] > 200):
        of = [(-round(sum(a * b for a, b in zip(q[2], v[2])) / (sum(a * a for a in q[2]) * sum(b * b for b in v[2])) ** 0.5, 4), v[0]) for v in good if v[1] == q[1] is not None and len(v[2]) == len(q[2])]
        expected |= {(q[0], v, -s, i + 1) for i, (s, v) in enumerate(sorted(x for x in of if -x[0] >= retrieval.MIN_SCORE)[:4])}
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect()} == expected


def test_spacings_are_counted_without_rows_of_pairs(spark):
    marks = [(s, round(i * i * 7.3 % 25_000 - 900, 2)) for s in (1, 2) for i in range(s * 40)] + [(1, None), (None, 5.0), (3, 1.0)]
    found = geometry.spacing_histogram(spark.createDataFrame(marks, "sheet long, p double"))
    assert "Join" not in plan(found)
    expected = set()
    for sheet in (1, 2):
        p = sorted({r[0] for r in spark.createDataFrame(marks, "sheet long, p double").where(f"sheet = {sheet}").select(F.bround("p", 1)).distinct().collect() if r[0] is not None})
        gaps = [b - a for a in p for b in p if 50 <= b - a <= 10_000]
        width = (max(gaps) + 10) / (max(gaps) // 10 + 1)
        bins = [int(g // width) for g in gaps]
        ranked = sorted(((-bins.count(x), x) for x in set(bins)))[:3]
        expected |= {(sheet, x, -n) for n, x in ranked if -n >= 2}
    assert {(r.sheet, r.bin, r.n) for r in found.collect()} == expected


def test_least_pairs_are_found_before_the_shuffle(spark):
    lines, _ = _sheet(spark, 30)
    # The first aggregate of pairs has the keys that cells are dealt by, so it needs no shuffle.
    assert re.search(r"keys=\[sheet#\d+L, orientation#\d+, level#\d+", plan(geometry.line_pairs(lines)))


def test_each_distinct_text_is_matched_once(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["10 mm thk", "10 mm thk", None, "", "none", "2 x 3 mm", "10 mm thk"])], "text_no long, text string")
    found = sheets.matched_texts(texts)
    # The patterns are applied to what was written, once a distinct text, not to the rows.
    assert "regexp" not in plan(found).lower()
    whole = texts.select("*", F.posexplode(callouts.text_matches(F.col("text"))).alias("match_no", "m"))
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.count()
