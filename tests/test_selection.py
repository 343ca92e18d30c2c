"""Catalog files, delimited files in odd forms, hooks that fail, and numbering in ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import matching, retrieval, scratch
from plumbline.sources import catalog, grid

YAML = """parameters:
  - {id: 2, name: Panel Height, aliases: [floor height], dimension_direction: VERTICAL, relevant_sheet_types: [SECTION], confidence_threshold: 0.5}
  - {id: 5, name: Glass}
spec_references:
  - {parameter_name: Glass, spec_value: 6, tolerance: 0.5, direction: MIN}
  - {parameter_name: Joint, spec_value: 15}
layer_groups:
  glazing: {keywords: [glass, pane], threshold: 2}
  fixings: {keywords: [bolt]}
"""


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    path = f"file://{tmp_path}/c.yaml"
    assert [tuple(r) for r in catalog.catalog(spark, path).collect()] == [(2, "Panel Height", ["floor height"], "mm", "VERTICAL", ["SECTION"], 0.5), (5, "Glass", [], "mm", "ANY", [], 0.4)]
    assert [tuple(r) for r in catalog.specifications(spark, path).collect()] == [("Glass", 6.0, 0.5, "MIN"), ("Joint", 15.0, 0.0, "EXACT")]
    assert [tuple(r) for r in catalog.layers(spark, path).collect()] == [("glazing", ["glass", "pane"], 2), ("fixings", ["bolt"], 1)]


def test_delimited_files(spark, tmp_path):
    files = {
        "comma.csv": "a,b,c\n1,2\n\n3,\"x, \"\"y\"\"\",4\n5,6,7,8\n".encode(),  # a short line is filled, a long one left out
        "semi.csv": "naïve;b\r\n1,5;2\r\n".encode("latin-1"),
        "one row.csv": b"a;b;c\n",  # no delimiter gives two rows: the first one counts
        "plain.csv": b"word\nother, line\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in grid.delimited_grid(spark, f"file://{tmp_path}").orderBy("file", "row_no").collect():
        got.setdefault(r.file.split("/")[-1].replace("%20", " "), []).append(r.cells)
    assert got == {
        "comma.csv": [["a", "b", "c"], ["1", "2", ""], ["3", 'x, "y"', "4"]], "semi.csv": [["naïve", "b"], ["1,5", "2"]],
        "one row.csv": [["a;b;c"]], "plain.csv": [["word"]],
    }


def test_scores_of_a_match(spark):
    entries = [(1, "Panel Width", ["bay width"], "HORIZONTAL", ["PLAN"]), (2, "Bay", [], "ANY", [])]
    measures = [(1, ["bay", "width"], "", "HORIZONTAL", "PLAN"), (2, ["bay", "width"], "x", "VERTICAL", "SECTION"), (3, ["nothing"], "here", None, None), (4, [], "bay", None, None), (5, ["PANEL"], "width 10 mm 5", "ANY", "UNKNOWN")]
    m = spark.createDataFrame(measures, "measure_id long, context_words array<string>, source_text string, direction string, sheet_type string")
    c = spark.createDataFrame(entries, "entry_id long, name string, aliases array<string>, direction string, sheet_types array<string>")
    got = {r.measure_id: tuple(r)[1:] for r in matching.fuzzy_match(m, c).collect()}
    # 2: the alias lies in the text, which is halved by the direction and 0.7 of it by the sheet; the other entry has neither.
    # 4: the text lies in an alias whose other word doesn't occur, so it is no hit. 3: four characters of 23 twice are 0.35.
    assert got == {1: (1, 1.0, 1.0, True, True, True), 2: (2, 1.0, 1.0, True, True, True), 4: (1, 1.0, 1.0, False, True, True), 5: (1, 1.0, 1.0, True, True, True)}


#: Scores worked out by hand: lengths of what is shared and left over, and of the longest common subsequence of the rest.
RATIOS = [
    ("mullion depth aluminium section typical 150", "mullion depth", 1.0),
    ("mullions dept", "mullion depth", 24 / 26),
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0),
    ("new york mets", "new york yankees", 16 / 21),
    ("a long text with width", "bay width", 10 / 14),
    ("abc", "xyz", 0.0),
    ("", "bay", 0.0),
    ("", "", 0.0),
]


@pytest.mark.parametrize("a, b, ratio", RATIOS)
def test_token_set_ratios_by_hand(a, b, ratio):
    got = matching.token_set_ratio(set(a.split()), set(b.split()))
    assert got == pytest.approx(ratio) == matching.token_set_ratio(set(b.split()), set(a.split()))


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randrange(90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(0 for _ in b)] if not b else [0, *_next_row(row, x, b)]
        assert matching.common_subsequence(a, b) == row[-1]


def _next_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out[1:]


def test_no_pair_is_lost_before_it_is_compared(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randrange(1, 6)))
    texts = sorted({" ".join(sorted({word() for _ in range(rng.randrange(1, 9))})) for _ in range(300)})
    entries = [(i, [sorted({word() for _ in range(rng.randrange(0, 4))}) for _ in range(rng.randrange(1, 4))]) for i in range(60)]
    want = {}
    for t in texts:
        for i, names in entries:
            ratio = max(matching.token_set_ratio(set(t.split()), set(n)) for n in names)
            if ratio >= 0.4:
                want[t, i] = ratio, any(all(w in t for w in n) for n in names)
    rows = spark.createDataFrame([(t,) for t in texts], "tokens string"), spark.createDataFrame(entries, "entry_id long, names array<array<string>>")
    for n_texts, n_entries in ((1, 1), (90_000, 7_000)):
        got = matching.overlaps(*rows, n_texts, n_entries).collect()
        assert len(got) == len(want) and {(r.tokens, r.entry_id): (r.overlap, r.keyword_hit) for r in got} == want


def test_matches_of_equal_and_empty_measurements(spark):
    c = spark.createDataFrame([(1, "Mullion Depth", None, None, None), (2, "", ["  "], None, None)], "entry_id long, name string, aliases array<string>, direction string, sheet_types array<string>")
    m = spark.createDataFrame([(i, ["mullion\u00a0depth", "Section"], None, None, None) for i in range(50)] + [(90, [], None, None, None), (91, ["mullions"], "dept", None, None)], "measure_id long, context_words array<string>, source_text string, direction string, sheet_type string")
    got = {r.measure_id: (r.entry_id, r.overlap, r.score) for r in matching.fuzzy_match(m, c).collect()}
    assert got == {i: (1, 1.0, 1.0) for i in range(50)} | {91: (1, 0.9231, 0.9231)}
    assert matching.fuzzy_match(m.where("false"), c).count() == matching.fuzzy_match(m, c.where("false")).count() == 0


def test_agreement_of_small_values(spark):
    m = spark.createDataFrame([(1, 1, 0.5, 0.8, 1.0), (1, 2, 0.54, 0.7, 1.0), (2, 3, 0.5, 0.8, 1.0), (2, 4, 0.56, 0.7, 1.0)], "entry_id long, measure_id long, value double, confidence double, score double")
    out = {r.entry_id: r.confidence for r in matching.best_candidates(m, spark.createDataFrame([(1, 0.5), (2, 0.5)], "entry_id long, threshold double")).collect()}
    assert out == {1: pytest.approx(0.88), 2: 0.8}


def test_embedding_tries_again_and_halves(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError(texts)
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(12)], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in retrieval.embedded(rows, embed, batch=5, tries=2).collect()}
    assert got == {i: None if i == 5 else [float(i)] for i in range(12)}
    one, two = retrieval.hashed_words(["a b a", "b a a"])
    assert one == two and sum(map(abs, one)) == 3.0


def test_numbers_in_ranges(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 1000, i) for i in range(900)] + [(None, 1, 1000), (None, 0, 1001)]
    df = spark.createDataFrame(rows, "g string, a long, b long")
    got = {(r.g, r.a, r.b): r.n for r in scratch.numbered(df, "g", ["a", "b"], "n").collect()}
    for g in ("hot", "cold", None):
        own = sorted((a, b) for x, a, b in rows if x == g)
        assert [got[g, a, b] for a, b in own] == list(range(1, len(own) + 1))


def test_guard_and_folder(spark):
    q = spark.createDataFrame([("glas", "glass"), ("glas", None), ("ab", "x" * 10), ("ab", " xxxxxxxxx ")], "raw string, fixed string")
    assert [r[0] for r in q.select(retrieval.guarded_query(F.col("raw"), F.col("fixed"))).collect()] == ["glass", "glas", "ab", "xxxxxxxxx"]

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master, applicationId = "yarn", "none"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(Cluster)


def test_default_embedding_of_whole_texts(spark):
    from plumbline.plans import registry

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.embedding for r in registry.queries()["text_embedding"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", retrieval.sanitised(F.col("text")).alias("text")).collect()}
    assert got == {i: retrieval.hashed_words([t])[0] for i, t in texts.items()}
