"""Delimited text files of any size: split by bytes, with quoted line breaks, three encodings and a delimiter chosen for each file."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scratch import BROADCAST_ROWS, broadcast_within, written

DELIMITERS = (",", ";", "\t", "|")
_SURVEY = pa.schema([("no", pa.int64()), ("split", pa.int64()), ("k", pa.int32()), ("move", pa.int32()), ("width", pa.int32()), ("fits", pa.int32())])
_PARTS = pa.schema([("no", pa.int64()), ("split", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.string())), ("text", pa.string())])
csv.field_size_limit(1 << 30)


def moves(line: str, delimiter: str) -> int:
    """What a line does to a reader: bit 0 is set if it ends inside quotes when it begins outside, bit 1 if when it begins inside.

    Quotes open at the beginning of a cell only, two of them inside quotes are one, and what follows a closing one belongs to
    the cell.
    """
    if '"' not in line:
        return 0b10
    return _ends_inside(line, delimiter, 0, False) | _ends_inside(line, delimiter, 0, True) << 1


def _ends_inside(line: str, delimiter: str, at: int, inside: bool) -> bool:
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(delimiter, at) + 1
                if at == 0:
                    return False
                continue
            at += 1
        while True:
            at = line.find('"', at) + 1
            if at == 0:
                return True
            if line[at : at + 1] != '"':
                break
            at += 1
        at = line.find(delimiter, at) + 1
        if at == 0:
            return False
        inside = False


def _physical(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """file, split, mark (order inside the split), and the bytes of each line as they lie in the file.

    Files are cut into splits by bytes; the text source gives each line to the split in which it begins."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if encoding:
        reader = reader.option("encoding", encoding)
    lines = reader.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("mark"), F.col("value").cast("binary").alias("value"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, a number `no`, and encoding of the files below `path`, written."""
    raw = _physical(spark, path, None)
    lead = F.hex(F.min_by(F.when(F.col("split") == 0, F.substring("value", 1, 2)), F.when(F.col("split") == 0, F.col("mark"))))
    facts = raw.groupBy("file").agg(lead.alias("lead"), F.every(F.is_valid_utf8(F.col("value").cast("string"))).alias("valid"))
    encoding = F.when(F.col("lead") == "FFFE", "UTF-16LE").when(F.col("lead") == "FEFF", "UTF-16BE").when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")
    return written(facts.select("file", F.monotonically_increasing_id().alias("no"), encoding.alias("encoding")), "files")


def _with(lines: DataFrame, facts: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """`lines` with `facts`, the lines of a split still side by side and in order: few facts are broadcast, so the lines stay where
    they are read; else splits are sorted again."""
    small = facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = lines.join(F.broadcast(facts) if small else facts, on)
    return joined if small else joined.repartition(order[0], order[1]).sortWithinPartitions(*order)


def _lines(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """no, split, mark and line, up to its line feed, of all lines, in order inside each split."""
    lines = None
    for kind in sorted(r.encoding for r in files.select("encoding").distinct().collect()):
        wide = kind if kind.startswith("UTF-16") else None
        text = F.col("value").cast("string") if kind == "UTF-8" else F.decode("value", kind)
        own = _with(_physical(spark, path, wide), files.where(F.col("encoding") == kind).select("file", "no"), ["file"], ["no", "split", "mark"])
        own = own.select("no", "split", "mark", text.alias("line"))
        lines = own if lines is None else lines.unionByName(own)
    if lines is None:
        lines = _physical(spark, path, None).where("false").select(F.lit(0).cast("long").alias("no"), "split", "mark", F.lit("").alias("line"))
    lines = lines.withColumn("line", F.when((F.col("split") == 0) & F.startswith("line", F.lit("﻿")), F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line")))
    return lines


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, mark, part, line and ending (what parts it from the next) of all lines below `path`, written.

    A file that begins with the mark of UTF-16 is read in that, one that is valid UTF-8 in that, any other as Latin-1. In
    UTF-16 a line break is told by its bytes, so the pairs U+0Axx U+yy00 and U+xx00 U+0Ayy would be taken for one. A lone carriage return
    ends a line too.
    """
    files = _files(spark, path)
    lines = _lines(spark, path, files).join(files, "no")
    # Carriage returns end lines as well; one before the line feed is a part of the break.
    cut = F.split("line", "\r", -1)
    parts = lines.select("file", "split", "mark", F.posexplode(cut).alias("part", "line"), (F.size(cut) - 1).alias("last"), F.col("line").alias("whole"))
    # In "a\r" before a line feed the empty rest is no line of its own.
    rest = (F.col("part") == F.col("last")) & (F.col("last") > 0) & (F.col("line") == "")
    ending = F.when(F.col("part") == F.col("last"), "\n").when(F.col("part") == F.col("last") - 1, F.when(F.endswith("whole", F.lit("\r")), "\r\n").otherwise("\r")).otherwise("\r")
    return written(parts.where(~rest).select("file", "split", "mark", "part", "line", ending.alias("ending")), "lines")


class _Cutter:
    """Cuts the lines of a split into records: a line that begins inside quotes goes on with the one before, line break included.

    What goes on from the split before is its head, what goes on in the next one its tail; where quotes don't count each line is a
    record. Records of spaces are left out.
    """

    def __init__(self, delimiter: str, inside: bool, plain: bool):
        self.delimiter, self.opening, self.inside, self.plain = delimiter, f'{delimiter}"', inside, plain
        self.before, self.held, self.head = inside, [], None

    def add(self, lines: list[str], endings: list[str]) -> list[str]:
        if self.plain:
            return [x for x in lines if x.strip(" ")]
        out, inside, delimiter, opening = [], self.inside, self.delimiter, self.opening
        for line, ending in zip(lines, endings, strict=True):
            # Outside, only a cell that begins with a quote opens them.
            after = inside
            if '"' in line and (inside or opening in line or line[0] == '"'):
                after = _ends_inside(line, delimiter, 0, inside)
            if not inside and not after:
                if line.strip(" "):
                    out.append(line)
                continue
            self.held.append(line)
            inside = after
            if after:
                self.held.append(ending)
                continue
            text, self.held = "".join(self.held), []
            if self.before:
                self.head, self.before = text, False
            elif text.strip(" "):
                out.append(text)
        self.inside = inside
        return out

    def rest(self) -> tuple[str | None, str | None]:
        """Head and tail, null without one; a split that is inside quotes as a whole is a head."""
        text = "".join(self.held) if self.held else None
        return (text, None) if self.before else (self.head, text)


def _rows(texts: list[str], delimiter: str, plain: bool) -> list[list[str]]:
    """The cells of records. Quotes that a record leaves open would take in the next one, so such records are read one by one."""
    if not plain:
        rows = list(csv.reader(texts, delimiter=delimiter))
        if len(rows) == len(texts):
            return rows
    return [next(csv.reader(iter([t]), delimiter=delimiter), [""]) for t in texts]


def _endings(lines: pa.Array) -> tuple[list[str], list[str]]:
    """Lines and what parts each from the next. Carriage returns end lines as well; one before the line feed is a part of the break,
    so in "a\r" the empty rest is no line of its own."""
    if not pc.any(pc.match_substring(lines, "\r")).as_py():
        return lines.to_pylist(), ["\n"] * len(lines)
    texts, endings = [], []
    for whole in lines.to_pylist():
        own = whole.split("\r")
        ends = ["\r"] * (len(own) - 1) + ["\n"]
        if len(own) > 1 and own[-1] == "":
            own, ends = own[:-1], [*ends[:-2], "\r\n"]
        texts += own
        endings += ends
    return texts, endings


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The parts of a batch that are of one split, with its file's number and its begin."""
    no, split = batch.column("no").to_numpy(), batch.column("split").to_numpy()
    cuts = [0, *(np.flatnonzero((no[1:] != no[:-1]) | (split[1:] != split[:-1])) + 1).tolist(), len(no)]
    for a, b in pairwise(cuts):
        if b > a:
            yield (int(no[a]), int(split[a])), batch.slice(a, b - a)


def _surveyed(lines: DataFrame, delimiters: tuple[str, ...]) -> DataFrame:
    """no, split, k, move, width, fits for each split and each delimiter k, the last one without quotes: what the split does to a reader
    (see moves), and of the first split the cells of its first record and how many records, two at most, have no more."""
    tried, openings = [(d, False) for d in delimiters] + [(delimiters[0], True)], [f'{d}"' for d in delimiters]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def told() -> pa.RecordBatch:
            own = [(*last, k, a | b << 1, *seen) for k, ((a, b), seen) in enumerate(zip([*states, [False, False]], found, strict=True))]
            return pa.RecordBatch.from_pylist([dict(zip(_SURVEY.names, r, strict=True)) for r in own], _SURVEY)

        for batch in batches:
            for key, run in _runs(batch):
                if key != last:
                    if last is not None:
                        yield told()
                    last, states, found = key, [[False, True] for _ in delimiters], [[None, 0] for _ in tried]
                    heads = [_Cutter(d, False, plain) for d, plain in tried] if key[1] == 0 else []
                texts, endings = _endings(run.column("line"))
                for text in texts:
                    if '"' in text:
                        for state, d, opening in zip(states, delimiters, openings, strict=True):
                            if state[0] == state[1]:
                                if state[0] or opening in text or text[0] == '"':
                                    state[0] = state[1] = _ends_inside(text, d, 0, state[0])
                            else:
                                code = moves(text, d)
                                state[:] = [bool(code >> s & 1) for s in state]
                for seen, head in zip(found, heads, strict=False):
                    if seen[1] < 2:
                        for cells in _rows(head.add(texts, endings), head.delimiter, head.plain):
                            seen[0] = len(cells) if seen[0] is None else seen[0]
                            seen[1] = min(2, seen[1] + (len(cells) <= seen[0]))
        if last is not None:
            yield told()

    kinds = "no long, split long, k int, move int, width int, fits int"
    return written(lines.select("no", "split", "line").mapInArrow(survey, kinds), "survey")


def _begun(survey: DataFrame) -> DataFrame:
    """`survey` with `begins`, whether a split begins inside quotes, and `after`, whether it ends there.

    A split leaves the state as it is, swaps it, or sets it. So the state before it is what the last split that sets it sets, swapped
    as often as splits after that do.
    """
    flip = lambda state, n: state != (n % 2 == 1)
    inside = Window.partitionBy("no", "k").orderBy("split")
    swaps = survey.withColumn("turned", F.sum((F.col("move") == 0b01).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.when(F.col("move").isin(0b00, 0b11), F.struct((F.col("move") == 0b11).alias("state"), F.col("turned").alias("at")))
    rows = swaps.withColumn("known", known).withColumn("last", F.last("known", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.col("turned") - (F.col("move") == 0b01).cast("long")
    rows = rows.withColumn("begins", F.coalesce(flip(F.col("last.state"), before - F.col("last.at")), before % 2 == 1))
    return rows.select(*survey.columns, "begins", F.when(F.col("begins"), F.col("move").bitwiseAND(2) > 0).otherwise(F.col("move").bitwiseAND(1) > 0).alias("after"))


def _parsed(lines: DataFrame, plan: DataFrame, delimiters: tuple[str, ...]) -> DataFrame:
    """no, split, n, cells of the records of the splits in `plan` (no, split, k, width, begins), numbered from 1 in the split in which
    they begin. Rows above `width` are left out, shorter ones filled; where it is null all stay as they are."""
    last = len(delimiters)

    def fitted(rows: list[list[str]], width: int | None) -> list[list[str]]:
        return rows if width is None else [r if len(r) == width else r + [""] * (width - len(r)) for r in rows if len(r) <= width]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, n = None, None, 0

        def rest() -> Iterator[pa.RecordBatch]:
            for at, text in zip((0, n + 1), cutter.rest(), strict=True):
                if text is not None:
                    yield pa.RecordBatch.from_pylist([{"no": now[0], "split": now[1], "n": at, "cells": None, "text": text}], _PARTS)

        for batch in batches:
            for key, run in _runs(batch):
                if key != now:
                    if now is not None:
                        yield from rest()
                    k, width, begins = (run.column(c)[0].as_py() for c in ("k", "width", "begins"))
                    now, n, plain = key, 0, k == last
                    delimiter = delimiters[0] if plain else delimiters[k]
                    cutter = _Cutter(delimiter, begins, plain)
                rows = fitted(_rows(cutter.add(*_endings(run.column("line"))), delimiter, plain), width)
                if rows:
                    place = [pa.array(np.full(len(rows), x)) for x in key]
                    yield pa.RecordBatch.from_arrays([*place, pa.array(np.arange(n + 1, n + 1 + len(rows))), pa.array(rows, pa.list_(pa.string())), pa.nulls(len(rows), pa.string())], schema=_PARTS)
                    n += len(rows)
        if now is not None:
            yield from rest()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["text"].strip(" "):
                    out += [{**{c: r[c] for c in ("no", "split", "n")}, "cells": c} for c in fitted(_rows([r["text"]], delimiters[r["k"]], False), r["width"])]
            yield pa.RecordBatch.from_pylist(out, pa.schema([f for f in _PARTS if f.name != "text"]))

    own = _with(lines, plan, ["no", "split"], ["no", "split", "mark"])
    parts = written(own.select("no", "split", "line", "k", "width", "begins").mapInArrow(parse, "no long, split long, n long, cells array<string>, text string"), "parts")
    # A record that goes on in other splits is a tail and the heads after it.
    torn = parts.where("text is not null").withColumn("g", F.sum((F.col("n") > 0).cast("long")).over(Window.partitionBy("no").orderBy("split", "n")))
    pieces = F.array_sort(F.collect_list(F.struct("split", "n", "text")))
    torn = torn.groupBy("no", "g").agg(F.min("split").alias("split"), F.max("n").alias("n"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))
    torn = torn.join(plan.select("no", "split", "k", "width"), ["no", "split"])
    return parts.where("text is null").drop("text").unionByName(torn.mapInArrow(joined, "no long, split long, n long, cells array<string>"))


def delimited_grid(spark: SparkSession, path: str, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """file, row_no, cells of the delimited text files at `path`.

    The first delimiter, in this order, that gives a file two columns in its first row, two rows, and no quotes left open counts,
    else the first one, without quoted line breaks where quotes are left open. Cells may be quoted and hold line breaks. Empty
    rows and rows with more cells than the first are left out, shorter ones are filled with empty cells; row_no counts from 0.

    A file is as many tasks as it has splits, and no line is shuffled. Splits are read once with all delimiters at a time for what
    they do to quotes, from which follows where each begins; then once with the delimiter of their file. Only where the first
    split doesn't tell whether a delimiter is the one, all of its file is read with it before.
    """
    files = _files(spark, path)
    lines, last = _lines(spark, path, files), len(delimiters)
    begun = written(_begun(_surveyed(lines, delimiters)), "begun")
    told = begun.groupBy("no", "k").agg(F.max("width").alias("width"), F.max("fits").alias("fits"), F.count("*").alias("splits"), F.max_by("after", "split").alias("open"))
    plain, known = F.col("k") == last, F.col("width").isNotNull()
    counts = plain | ((F.col("width") > 1) & (F.col("fits") > 1))
    verdict = F.when(F.col("open") | (~plain & known & (F.col("width") < 2)), False).when(known & counts, True).when(F.col("splits") == 1, False)
    told = written(told.select("no", "k", "width", verdict.alias("chosen")), "told")
    sure = told.where("chosen")
    first = sure.groupBy(F.col("no").alias("__no")).agg(F.min("k").alias("__k"))
    unsure = told.where("chosen is null").join(first, F.col("no") == F.col("__no"), "left").where("__k is null or k < __k").select("no", "k")
    for k in sorted(r.k for r in unsure.select("k").distinct().collect()):
        asked = unsure.where(F.col("k") == k).join(begun, ["no", "k"]).select("no", "split", "k", F.lit(None).cast("int").alias("width"), "begins")
        rows = _parsed(lines, asked, delimiters)
        width = rows.groupBy("no").agg(F.min_by(F.size("cells"), F.struct("split", "n")).alias("width"))
        fits = rows.join(width, "no").where(F.size("cells") <= F.col("width")).groupBy("no", "width").agg(F.count("*").alias("fits"))
        sure = sure.unionByName(written(fits.withColumn("k", F.lit(k)).where(counts).select("no", "k", "width", F.lit(True).alias("chosen")), "told"))
    chosen = sure.groupBy("no").agg(F.min("k").alias("k"), F.min_by("width", "k").alias("width"))
    plan = written(chosen.join(begun.drop("width"), ["no", "k"]).select("no", "split", "k", "width", "begins"), "plan")
    rows = _parsed(lines, plan, delimiters)
    upto = Window.partitionBy("no").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("no", "split").agg(F.count("*").alias("rows")).select("no", "split", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    numbered = rows.join(broadcast_within(written(before, "rows-before")), ["no", "split"]).join(broadcast_within(files.select("no", "file")), "no")
    return numbered.select("file", (F.col("before") + F.col("n") - 1).cast("long").alias("row_no"), "cells")


__all__ = ["delimited_grid", "moves", "text_lines"]
