"""Blocks, sections, hierarchical chunks and context windows of documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import broadcast_within, numbered, written
from .successors import BLOCK_ROWS, chain, last_within, summed

PARENT_WORDS, CHILD_WORDS = 3000, 200
TOKENS_PER_WORD = 1.35
OVERLAP_CHUNKS = 3


def estimated_tokens(n_words: Column) -> Column:
    """Whole tokens of so many words."""
    return F.floor(n_words * F.lit(TOKENS_PER_WORD)).cast("long")


def lines_as_blocks(docs: DataFrame, section_chars: int = 20, subsection_chars: int = 40, page_lines: int = 10) -> DataFrame:
    """doc_id, project, block_no, page, text, heading (1 section, 2 subsection, 0 text): a block for each line that is not blank."""
    lines = docs.select("doc_id", F.col("source").alias("project"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    text = F.trim("line")
    heading = F.when(F.length(text) <= section_chars, 1).when(F.length(text) <= subsection_chars, 2).otherwise(0)
    return lines.where(text != "").select("doc_id", "project", F.col("line_no").cast("long").alias("block_no"), (F.floor(F.col("line_no") / page_lines) + 1).cast("int").alias("page"), text.alias("text"), heading.alias("heading"))


def heading_fill(blocks: DataFrame) -> DataFrame:
    """Adds section and subsection: the last heading above; a section heading clears the subsection."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = blocks.withColumn("section", F.last(F.when(F.col("heading") == 1, F.col("text")), ignorenulls=True).over(seen))
    filled = filled.withColumn("section_run", F.sum((F.col("heading") == 1).cast("int")).over(seen))
    inside = Window.partitionBy("doc_id", "section_run").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("subsection", F.last(F.when(F.col("heading") == 2, F.col("text")), ignorenulls=True).over(inside))


def _runs(filled: DataFrame) -> DataFrame:
    """Adds run: the number of the run of blocks under equal headings (null equals null), over all blocks of a document."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    same = F.col("section").eqNullSafe(F.lag("section").over(w)) & F.col("subsection").eqNullSafe(F.lag("subsection").over(w)) & F.lag("doc_id").over(w).isNotNull()
    return filled.withColumn("run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def section_groups(filled: DataFrame, keep_run: bool = False) -> DataFrame:
    """One row for each run of text blocks under equal headings (null equals null): section_no, pages and ordered words.

    Runs are told over all blocks, so a section without text still breaks one; headings themselves are left out.
    """
    grouped = _runs(filled).where("heading = 0").groupBy("doc_id", "project", "run").agg(
        F.first("section").alias("section"),
        F.first("subsection").alias("subsection"),
        F.min_by("page", "block_no").alias("page_start"),
        F.max_by("page", F.when(F.col("page").isNotNull(), F.col("block_no"))).alias("page_end"),
        F.count("*").alias("n_blocks"),
        F.array_remove(F.split(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), " "), " +"), "").alias("words"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    rows = grouped.withColumn("section_no", number.cast("int"))
    return rows if keep_run else rows.drop("run")


def section_flags(filled: DataFrame) -> DataFrame:
    """section_groups with is_table, true where every block of the section is a table, and source_type, that of its first block
    (null allowed) unless any is pdf_drawing; blocks also have is_table and source_type."""
    first = F.min_by(F.struct("source_type"), "block_no")["source_type"]
    drawn = F.coalesce(F.bool_or(F.col("source_type") == "pdf_drawing"), F.lit(False))
    flags = _runs(filled).where("heading = 0").groupBy("doc_id", "run").agg(F.every("is_table").alias("is_table"), F.when(drawn, "pdf_drawing").otherwise(first).alias("source_type"))
    return section_groups(filled, keep_run=True).join(flags, ["doc_id", "run"]).drop("run")


def _per_parent(parent_words: int, child_words: int) -> int:
    """A whole parent and its children."""
    return 1 + -(-parent_words // child_words)


def _n_chunks(n: Column, parent_words: int, child_words: int) -> Column:
    """Chunks of both levels of a section of n words."""
    rest = n % parent_words
    return F.floor(n / parent_words) * _per_parent(parent_words, child_words) + F.when(rest > 0, 1 + F.ceil(rest / child_words)).otherwise(0)


def parent_child_chunks(sections: DataFrame, parent_words: int = PARENT_WORDS, child_words: int = CHILD_WORDS) -> DataFrame:
    """Level 0 chunks of up to parent_words words, each followed by level 1 chunks of up to child_words of it.

    chunk_index runs through a document; parent_index is null at level 0; prev and next link siblings inside one parent. The
    number of chunks of a section follows from its words, so indexes are sums over sections and no chunk is sorted.
    """
    per_parent, n = _per_parent(parent_words, child_words), F.size("words")
    n_chunks = _n_chunks(n, parent_words, child_words)
    before = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    based = sections.withColumn("base", F.coalesce(F.sum(n_chunks).over(before), F.lit(0)).cast("int")).where(n > 0)
    slices = lambda words, step: F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda at: F.slice(words, at + 1, F.lit(step)))
    about = ["doc_id", "project", "base", "section", "subsection", "page_start"]
    parents = based.select(*about, F.posexplode(slices(F.col("words"), parent_words)).alias("p", "whole"))
    both = parents.select(*about, "p", F.ceil(F.size("whole") / child_words).cast("int").alias("n"), F.posexplode(F.concat(F.array("whole"), slices(F.col("whole"), child_words))).alias("c", "words"))
    parent = F.col("base") + F.col("p") * per_parent
    child = F.col("c") > 0
    return both.select(
        "doc_id", "project", (parent + F.col("c")).alias("chunk_index"), child.cast("int").alias("chunk_level"),
        F.when(child, parent).alias("parent_index"),
        F.when(F.col("c") > 1, parent + F.col("c") - 1).alias("prev_index"),
        F.when(child & (F.col("c") < F.col("n")), parent + F.col("c") + 1).alias("next_index"),
        "section", "subsection", "page_start", F.size("words").cast("long").alias("n_words"), estimated_tokens(F.size("words")).alias("n_tokens"), "words",
    )


def parent_places(blocks: DataFrame, parent_words: int = PARENT_WORDS, child_words: int = CHILD_WORDS) -> DataFrame:
    """doc_id, project, chunk_index, n_words, n_tokens of the level 0 chunks that parent_child_chunks makes of the sections of `blocks` (see
    lines_as_blocks). They follow from numbers of words, so only headings travel as texts."""
    sized = blocks.select("doc_id", "project", "block_no", "heading", F.when(F.col("heading") > 0, F.col("text")).alias("text"), F.when(F.col("heading") == 0, F.size(F.array_remove(F.split("text", " +"), ""))).alias("n_words"))
    sections = _runs(heading_fill(sized)).where("heading = 0").groupBy("doc_id", "project", "run").agg(F.sum("n_words").cast("int").alias("n"))
    per_parent, n = _per_parent(parent_words, child_words), F.col("n")
    before = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    based = sections.withColumn("base", F.coalesce(F.sum(_n_chunks(n, parent_words, child_words)).over(before), F.lit(0)).cast("int")).where(n > 0)
    parents = based.select("doc_id", "project", "base", "n", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / parent_words).cast("int"))).alias("p"))
    size = F.least(F.lit(parent_words), n - F.col("p") * parent_words)
    return parents.select("doc_id", "project", (F.col("base") + F.col("p") * per_parent).alias("chunk_index"), size.cast("long").alias("n_words"), estimated_tokens(size).alias("n_tokens"))


def interleaved(chunks: DataFrame) -> DataFrame:
    """Adds turn (rank in the document) and ordinal: documents of a project take turns. No task holds a whole project."""
    turn = F.row_number().over(Window.partitionBy("project", "doc_id").orderBy("chunk_index"))
    return numbered(chunks.withColumn("turn", turn), "project", ["turn", "doc_id"], "ordinal")


def context_windows(ordered: DataFrame, budget: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """project, window_no, ordinal: a greedy fill of ordered (project, ordinal, n_tokens) rows up to a token budget.

    A window that is full closes; the next begins with the last OVERLAP_CHUNKS rows of it, which count toward the budget,
    and takes the next row without a second look, so it may exceed the budget; a first row above it stands alone.

    A window that follows one that ends at row e begins at e - 2, or at the first row, and ends where the sum from there is
    last within the budget, at e + 1 at least. So windows are a chain of ends, and no task holds a project.
    """
    rows = summed(ordered.select("project", "ordinal", "n_tokens"), "project", ["ordinal"], "n_tokens")
    size = rows.groupBy("project").agg(F.max("n").alias("__size"))
    # Limits of the windows after each end; that of the first window belongs to end 0.
    limit = F.lit(budget) + F.col("total")
    ends = rows.select("project", (F.col("n") + OVERLAP_CHUNKS - 1).alias("at"), (limit - F.col("n_tokens")).alias("limit"))
    starts = size.select("project", F.explode(F.array(*[F.lit(i).cast("long") for i in range(OVERLAP_CHUNKS)])).alias("at"), F.lit(budget).cast("long").alias("limit"))
    last = last_within(rows, ends.unionByName(starts), "project")
    steps = last.join(size.withColumnRenamed("project", "__p"), F.col("project").eqNullSafe(F.col("__p"))).where(F.col("at") <= F.col("__size"))
    following = F.when(F.col("at") < F.col("__size"), F.greatest(F.col("last"), F.col("at") + 1))
    found = chain(written(steps.select("project", "at", following.alias("next")), "window-ends"), "project", block_rows)
    before = found.select(F.col("project").alias("__p"), (F.col("number") + 1).alias("__n"), F.col("at").alias("__end"))
    windows = found.join(before, F.col("project").eqNullSafe(F.col("__p")) & (F.col("number") == F.col("__n")), "left")
    first = F.when(F.col("__end").isNull(), 1).otherwise(F.greatest(F.col("__end") - (OVERLAP_CHUNKS - 1), F.lit(1)))
    taken = windows.select(F.col("project").alias("__p"), (F.col("number") - 1).alias("window_no"), F.explode(F.sequence(first, F.col("at"))).alias("__i"))
    return rows.join(taken, F.col("project").eqNullSafe(F.col("__p")) & (F.col("n") == F.col("__i"))).select("project", "window_no", "ordinal")


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds batch_no: consecutive rows of a group in batches of `size`. No task holds a whole group."""
    return numbered(rows, group, [order], "__number").withColumn("batch_no", F.floor((F.col("__number") - 1) / size).cast("long")).drop("__number")


def document_inventory(windowed: DataFrame) -> DataFrame:
    """Per group and document: its chunks, distinct sections and tokens."""
    return windowed.groupBy("project", "doc_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("section").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"))


def level_fallback(chunks: DataFrame) -> DataFrame:
    """Level 0 chunks, and level 1 chunks of projects that have none."""
    top = chunks.where("chunk_level = 0")
    return top.unionByName(chunks.where("chunk_level = 1").join(top.select("project").distinct(), "project", "left_anti"))


def overlap_chunks(blocks: DataFrame, size: int = 800, overlap: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, chunk_no, first_block, last_block, n_words, start_page, end_page, section, subsection of blocks (doc_id, block_no,
    page, section, subsection, text, heading).

    A chunk closes when the next block would take it above `size` words; the next begins with the last `overlap` pieces of it, a
    piece being a block or what a chunk began with, so with few blocks the whole chunk is carried over. The page of the block
    that closes a chunk counts for both, as do its section and subsection, of which a chunk has the last that is not empty.
    Headings are left out.

    Blocks are folded in order, with the last `overlap` of them as state. Documents of more than `block_rows` blocks are cut by a
    chain of successors, so no task holds one.
    """
    n_words = F.size(F.array_remove(F.split("text", "\\s+"), "")).cast("long").alias("n_words")
    slim = blocks.where("heading = 0").select("doc_id", "block_no", "page", F.nullif("section", F.lit("")).alias("section"), F.nullif("subsection", F.lit("")).alias("subsection"), n_words)
    slim = written(slim, "slim-blocks")
    large = written(slim.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select(F.col("doc_id").alias("__large")), "large-documents")
    if not large.limit(1).count():
        return _folded_chunks(slim, size, overlap)
    of_large = F.col("doc_id").eqNullSafe(F.col("__large"))
    small = _folded_chunks(slim.join(broadcast_within(large), of_large, "left_anti"), size, overlap)
    return small.unionByName(_chained_chunks(slim.join(broadcast_within(large), of_large, "left_semi"), size, overlap, block_rows))


def _folded_chunks(slim: DataFrame, size: int, overlap: int) -> DataFrame:
    kinds = dict(slim.dtypes)
    rows = slim.repartition("doc_id").sortWithinPartitions("doc_id", "block_no")

    names = ["doc_id", "chunk_no", "first_block", "last_block", "n_words", "start_page", "end_page", "section", "subsection"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, doc, types = None, None, None
        for batch in batches:
            done: list[tuple] = []
            columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "block_no", "page", "section", "subsection", "n_words")}
            for d, *block in zip(*columns.values(), strict=True):
                if chunks is None or d != doc:
                    if chunks is not None:
                        done.append((doc, *chunks.closed()))
                    chunks, doc = _Chunks(size, overlap), d
                if (chunk := chunks.add(*block)) is not None:
                    done.append((doc, *chunk))
            id_, no, page = (batch.schema.field(c).type for c in ("doc_id", "block_no", "page"))
            types = [id_, pa.int64(), no, no, pa.int64(), page, page, pa.string(), pa.string()]
            if done:
                yield told(done, types)
        if chunks is not None:
            yield told([(doc, *chunks.closed())], types)

    def told(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    kinds = [kinds["doc_id"], "long", *[kinds["block_no"]] * 2, "long", *[kinds["page"]] * 2, "string", "string"]
    return rows.mapInArrow(fold, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))


class _Chunks:
    """The chunks of one document's blocks in order; of earlier blocks it holds the last `overlap`."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        # The last blocks as (block_no, words); the pieces of the open chunk are what it carried over and its own blocks.
        self.recent: deque[tuple[int, int]] = deque(maxlen=overlap)
        self.number, self.pieces, self.words, self.first, self.last = 0, 0, 0, None, None
        self.pages: list[int] = []
        self.section = self.subsection = None

    def add(self, block_no: int, page: int, section: str | None, subsection: str | None, words: int) -> tuple | None:
        """Takes the next block; the chunk that it closes, if it closes one."""
        done = None
        closes = self.last is not None and self.words + words > self.size
        self._see(page, section, subsection)
        if closes:
            done = self.closed()
            self.number += 1
            if self.pieces > self.overlap:
                self.first, self.words = self.recent[0][0], sum(w for _, w in self.recent)
            # What is carried over is one piece.
            self.pieces = 1
            self.pages, self.section, self.subsection = [], None, None
            self._see(page, section, subsection)
        if self.last is None:
            self.first = block_no
        self.recent.append((block_no, words))
        self.pieces += 1
        self.words += words
        self.last = block_no
        return done

    def _see(self, page: int | None, section: str | None, subsection: str | None) -> None:
        if page is not None:
            self.pages = [min([*self.pages[:1], page]), max([*self.pages[1:], page])]
        self.section = section if section is not None else self.section
        self.subsection = subsection if subsection is not None else self.subsection

    def closed(self) -> tuple:
        low, high = self.pages or (None, None)
        return (self.number, self.first, self.last, self.words, low, high, self.section, self.subsection)


def _chained_chunks(slim: DataFrame, size: int, overlap: int, block_rows: int) -> DataFrame:
    """overlap_chunks of documents of any size: a chunk of more pieces than `overlap` is followed by one that begins with its last blocks, so
    ends follow from ends. One with fewer is carried over whole: from there on every block ends a chunk, and all of these begin at
    the same block.
    """
    rows = summed(slim, "doc_id", ["block_no"], "n_words")
    sizes = rows.groupBy("doc_id").agg(F.max("n").alias("__size"))
    of_doc = lambda c: F.col("doc_id").eqNullSafe(F.col(c))
    # After end e a chunk begins at e - overlap + 1. Ends nearer to the beginning are reached by the first chunk only.
    ends = rows.select("doc_id", (F.col("n") + overlap - 1).alias("at"), (F.lit(size) + F.col("total") - F.col("n_words")).alias("limit"))
    first = sizes.select("doc_id", F.lit(0).cast("long").alias("at"), F.lit(size).cast("long").alias("limit"))
    last = last_within(rows, ends.unionByName(first), "doc_id").join(sizes.withColumnRenamed("doc_id", "__d"), of_doc("__d")).where("at < __size").drop("__d")
    reach = F.greatest(F.col("last"), F.col("at") + 1)
    steps = last.select("doc_id", "at", reach.alias("to"), "__size", F.when(F.col("at") == 0, reach < overlap).otherwise(reach - F.col("at") + 1 <= overlap).alias("held"))
    steps = written(steps, "chunk-ends")
    # A chain stops at the first end whose chunk is carried over whole. The end of a document has no step of its own.
    stops = rows.join(sizes.withColumnRenamed("doc_id", "__d"), of_doc("__d")).where("n = __size").select("doc_id", F.col("n").alias("at"))
    links = steps.select("doc_id", "at", F.when(~F.col("held"), F.col("to")).alias("next"))
    links = links.unionByName(stops.withColumn("next", F.lit(None).cast("long")))
    free = written(chain(written(links, "chunk-links"), "doc_id", block_rows), "chunk-chain")
    begun = free.select("doc_id", "number", "at").unionByName(sizes.select("doc_id", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("at")))
    start_of = lambda at: F.greatest(at - (overlap - 1), F.lit(1))
    # Each reached end opens the next chunk: one more of the chain, or the first of those that are held.
    opened = begun.join(steps.select(F.col("doc_id").alias("__d"), F.col("at").alias("__a"), "to", "held", "__size"), of_doc("__d") & (F.col("at") == F.col("__a")))
    opened = opened.select("doc_id", "number", F.when(F.col("at") == 0, 1).otherwise(start_of(F.col("at"))).alias("first"), F.col("at").alias("prior"), F.explode(F.sequence(F.col("to"), F.when(F.col("held"), F.col("__size")).otherwise(F.col("to")))).alias("end"), "to")
    chunks = opened.select("doc_id", (F.col("number") + F.col("end") - F.col("to")).alias("chunk_no"), F.col("first").cast("long").alias("first"), "end", F.when(F.col("end") == F.col("to"), F.col("prior")).otherwise(F.col("end") - 1).alias("prior"))
    chunks = written(chunks, "chunks")
    at = lambda c, *names: rows.select(F.col("doc_id").alias("__d"), F.col("n").alias("__i"), *[F.col(n).alias(a) for n, a in names]).join(chunks, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__i") == F.col(c)))
    closing = at("end", ("block_no", "last_block"), ("total", "__until")).select("doc_id", "chunk_no", "last_block", "__until")
    opening = at("first", ("block_no", "first_block"), ("total", "__from"), ("n_words", "__own")).select(F.col("doc_id").alias("__d"), F.col("chunk_no").alias("__c"), "first_block", (F.col("__from") - F.col("__own")).alias("__from"))
    # The blocks whose pages and sections count: those since the end before, and the one that closes the chunk.
    counted = chunks.select("doc_id", "chunk_no", F.explode(F.sequence(F.col("prior") + 1, F.col("end") + 1)).alias("__at"))
    seen = rows.select(F.col("doc_id").alias("__d"), "n", "page", "section", "subsection").join(counted, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("__at")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    seen = seen.groupBy(F.col("doc_id").alias("__s"), F.col("chunk_no").alias("__k")).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), latest("section"), latest("subsection"))
    joined = closing.join(opening, of_doc("__d") & (F.col("chunk_no") == F.col("__c"))).join(seen, of_doc("__s") & (F.col("chunk_no") == F.col("__k")))
    return joined.select("doc_id", "chunk_no", "first_block", "last_block", (F.col("__until") - F.col("__from")).alias("n_words"), "start_page", "end_page", "section", "subsection")


def tables_in_sections(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tables (doc_id, page, ...) with the section and subsection that were in force at the end of their page; null without a block there."""
    state = blocks.groupBy("doc_id", "page").agg(F.max_by(F.struct("section", "subsection"), "block_no").alias("__s"))
    return tables.join(state, ["doc_id", "page"], "left").select(*tables.columns, "__s.section", "__s.subsection")


def table_texts(rows: DataFrame) -> DataFrame:
    """table_id, text of table rows (table_id, row_no, cells): cells joined by ` | `, null cells empty, rows by newlines; tables without text go."""
    line = F.array_join(F.transform("cells", lambda c: F.trim(c)), " | ", "")
    lines = rows.withColumn("line", line).where(F.regexp_replace("line", "[| ]", "") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n")
    return lines.groupBy("table_id").agg(joined.alias("text"))


def sheet_parents(chunks: DataFrame, max_words: int = PARENT_WORDS) -> DataFrame:
    """document, sheet, n_words, text: one parent for each sheet of grid chunks (document, sheet, chunk_no, text), under a title line.

    A parent above `max_words` is its first words, joined by spaces. Chunks past the limit are cut off before they are gathered.
    """
    words = F.size(F.array_remove(F.split("text", "\\s+"), ""))
    before = F.coalesce(F.sum(words).over(Window.partitionBy("document", "sheet").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda c: c["text"]), "\n\n")
    joined = chunks.withColumn("__b", before).where(F.col("__b") <= max_words).groupBy("document", "sheet").agg(body.alias("body"))
    text = F.concat(F.lit("=== BOQ: "), F.col("sheet"), F.lit(" ("), F.col("document"), F.lit(") ===\n\n"), F.col("body"))
    split = F.array_remove(F.split(F.col("full"), "\\s+"), "")
    return joined.withColumn("full", text).select("document", "sheet", F.least(F.size(split), F.lit(max_words)).cast("long").alias("n_words"), F.when(F.size(split) > max_words, F.array_join(F.slice(split, 1, max_words), " ")).otherwise(F.col("full")).alias("text"))


def sheet_child_links(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (document, child_no, is_item, category, text) with section and parent_id of parents (document, sheet, parent_id).

    Items go to `BOQ - category`, else `BOQ Items`; texts to the sheet that their first line names after `Sheet:`, else `BOQ`.
    Children without such a parent have none; of parents with one name the smallest id counts.
    """
    item, first_line = F.col("is_item"), F.substring_index("text", "\n", 1)
    named = F.trim(F.replace(first_line, F.lit("Sheet:"), F.lit("")))
    section = F.when(item, F.coalesce("category", F.lit(""))).when(first_line.startswith("Sheet:"), named).otherwise("")
    own = F.when(item & (F.col("section") != ""), F.concat(F.lit("BOQ - "), F.col("section"))).when(item, "BOQ Items").otherwise(F.col("section"))
    rows = children.withColumn("section", section).withColumn("own", own).withColumn("usual", F.when(item, "BOQ Items").otherwise("BOQ"))
    ids = parents.groupBy("document", "sheet").agg(F.min("parent_id").alias("id"))
    for name in ("own", "usual"):
        rows = rows.join(ids.select("document", F.col("sheet").alias(name), F.col("id").alias(f"{name}_id")), ["document", name], "left")
    return rows.select(*children.columns, "section", F.coalesce("own_id", "usual_id").alias("parent_id"))
