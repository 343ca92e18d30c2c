"""Delimited files in many splits against Python's reader over the whole text."""

from __future__ import annotations

import csv
import io
import random

import pytest

from plumbline.sources import delimited


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(text: str, mark: str) -> list[list[str]]:
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=mark) if r]
    return [r + [""] * (len(rows[0]) - len(r)) for r in rows if len(r) <= len(rows[0])]


def table(seed: int, mark: str, end: str) -> str:
    rng, rows = random.Random(seed), [mark.join(("item", "description", "qty"))]
    for i in range(60):
        texts = ["plain", "", "5\" pipe", '"a quoted, cell; with | marks\tin it"', f'"two{end}lines"', f'"{end}{end}"', '"say ""yes"""', '"x"y', "naïve ß", f'"a ""b""{end}c{mark}d"', '""']
        cells = [str(i), rng.choice(texts), rng.choice(["1", '"2"', f'"3{end}"', ""])]
        rows.append(mark.join(cells[: rng.choice([3, 3, 3, 2])] + ["more"] * (rng.random() < 0.1)))
        rows += [""] * (rng.random() < 0.1)
    return end.join(rows) + rng.choice(["", end])


def test_files_in_many_splits_equal_the_whole(spark, small_splits, tmp_path):
    want = {}
    for k, mark in enumerate(delimited.DELIMITERS):
        for encoding, end in (("utf-8", "\n"), ("latin-1", "\r\n"), ("utf-16", "\n"), ("utf-8-sig", "\r\n")):
            name, text = f"{k}-{encoding}.csv", table(10 * k + len(encoding), mark, end)
            (tmp_path / name).write_bytes(text.encode(encoding))
            want[name] = whole(text, mark)
    (tmp_path / "be.csv").write_bytes(b"\xfe\xff" + table(99, ";", "\r\n").encode("utf-16-be"))
    want["be.csv"] = whole(table(99, ";", "\r\n"), ";")
    lines = delimited.text_lines(spark, f"file://{tmp_path}")
    assert lines.select("file", "split").distinct().count() > 2 * len(want)
    got = {}
    for r in delimited.delimited_grid(spark, f"file://{tmp_path}").orderBy("file", "row_no").collect():
        rows = got.setdefault(r.file.split("/")[-1], [])
        assert r.row_no == len(rows)
        rows.append(list(r.cells))
    assert got == want


def test_odd_files(spark, small_splits, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b"a,b\r1,2\r\r3,\"x\ry\"\r")
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"never closed\n2,3\n')
    (tmp_path / "other.csv").write_bytes(b'a;b,c\n1;"x, y"\n"u;v";2\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "bom.csv").write_bytes(b"\xff\xfe")
    got = {}
    for r in delimited.delimited_grid(spark, f"file://{tmp_path}").orderBy("file", "row_no").collect():
        got.setdefault(r.file.split("/")[-1], []).append(list(r.cells))
    assert got.pop("bom.csv", [[""]]) == [[""]]
    assert got == {"mac.csv": [["a", "b"], ["1", "2"], ["3", "x\ry"]], "open.csv": [["a", "b"], ["1", "never closed"], ["2", "3"]], "other.csv": [["a;b", "c"], ['1;"x', ' y"'], ["u;v;2", ""]]}


@pytest.mark.parametrize("seed", range(4))
def test_what_a_line_does_equals_a_walk(seed):
    rng = random.Random(seed)
    for _ in range(2_000):
        line = "".join(rng.choices('a",; ', k=rng.randrange(12)))
        for state in (0, 1):
            at, mode = 0, "quoted" if state else "start"
            for c in line:
                if mode == "quoted":
                    mode = "closed" if c == '"' else mode
                elif mode == "closed":
                    mode = "quoted" if c == '"' else "start" if c == "," else "plain"
                else:
                    mode = "start" if c == "," else "quoted" if mode == "start" and c == '"' else "plain"
                at += 1
            assert bool(delimited.moves(line, ",") >> state & 1) == (mode == "quoted"), (line, state)


def test_lines_stay_where_they_are_read(spark, small_splits, tmp_path):
    """No line is shuffled or sorted, however many delimiters a file is tried with; some cells go on over many splits."""
    want = {}
    for k, mark in enumerate(delimited.DELIMITERS):
        long = "\n".join(f'line {i} ""of{mark}"" a cell' for i in range(200))
        text = table(k, mark, "\n").rstrip("\n") + f'\n1{mark}"{long}"{mark}2\n3{mark}4{mark}5\n' + "more\n" * (k % 2)
        (tmp_path / f"{k}.csv").write_text(text)
        want[f"{k}.csv"] = whole(text, mark)
    # Its first row has two columns in two delimiters, but in the first one no other row fits.
    (tmp_path / "late.csv").write_text("a,b|c\n" + "1,2,3|4\n" * 300 + "5,x,y|6\n")
    want["late.csv"] = whole((tmp_path / "late.csv").read_text(), "|")
    jvm = spark.sparkContext._gateway.jvm

    def stages() -> dict[int, int]:
        every = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (every.apply(i) for i in range(every.size()))}

    ran = set(stages())
    rows = delimited.delimited_grid(spark, f"file://{tmp_path}").collect()
    shuffled = [n for stage, n in stages().items() if stage not in ran]
    assert shuffled and max(shuffled) < sum(p.read_text().count("\n") for p in tmp_path.iterdir()) / 2
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.row_no)):
        own = got.setdefault(r.file.split("/")[-1], [])
        assert r.row_no == len(own)
        own.append(list(r.cells))
    assert got == want
