"""The change feed of the incremental merge: what each pass found, and one row for each value that a pass adds or changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from .intake import MARGIN

NEW, UPDATED, UNCHANGED = "new", "updated", "unchanged"
CHANGES = "project string, parameter string, pass_no long, kind string, old_value double, value double, confidence double, priority long, change_no long"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def wins(confidence: float, priority: int, sure: float, rank: int) -> bool:
    """Whether an answer takes the place of one of confidence `sure` and document priority `rank`."""
    return confidence >= sure + MARGIN or abs(confidence - sure) < MARGIN and priority > rank


class _Key:
    """The answer to one (project, parameter), and what it was before the pass at hand. No earlier values are held."""

    __slots__ = ("value", "confidence", "priority", "changes", "pass_no", "old")

    def __init__(self, state: tuple | None = None):
        self.value, self.confidence, self.priority, self.changes = state or (None, None, None, 0)
        self.pass_no, self.old = None, self.value

    def add(self, value: float, confidence: float, priority: int) -> None:
        if self.value is None or wins(confidence, priority, self.confidence, self.priority):
            self.value, self.confidence, self.priority = value, confidence, priority

    def closed(self, key: tuple) -> tuple:
        """The change that the pass at hand made."""
        kind = NEW if self.old is None else UPDATED if self.value != self.old else UNCHANGED
        self.changes += kind == UPDATED
        row = (*key, self.pass_no, kind, self.old, self.value, self.confidence, self.priority, self.changes)
        self.pass_no, self.old = None, self.value
        return row


_FOUND = ["pass_no", "value", "confidence", "priority"]


def _passes(held: _Key, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The change of each pass of one key's `rows` but of the last."""
    for pass_no, value, confidence, priority in rows:
        if held.pass_no is not None and pass_no != held.pass_no:
            yield held.closed(key)
        held.pass_no = pass_no
        held.add(value, confidence, priority)


def value_changes(found: DataFrame) -> DataFrame:
    """A row for each (project, parameter) and pass that found a value for it: new, updated or unchanged.

    found: project, parameter, pass_no, seconds, event_id, value, confidence, priority; rows without a value are left out.
    Values merge in order as in merged_values(); what a pass did shows in the answer before and after it. `change_no` counts
    the updates so far. Keys are sorted in tasks and read once, so a key's rows are never held.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for pdf in frames:
            out = []
            for project, parameter, *row in pdf[["project", "parameter", *_FOUND]].itertuples(index=False):
                if (project, parameter) != at:
                    if held is not None:
                        out.append(held.closed(at))
                    at, held = (project, parameter), _Key()
                out += _passes(held, at, iter([row]))
            yield pd.DataFrame(out, columns=_NAMES)
        if held is not None:
            yield pd.DataFrame([held.closed(at)], columns=_NAMES)

    rows = found.where("value is not null").select("project", "parameter", "pass_no", "seconds", "event_id", "value", "confidence", "priority")
    in_order = rows.repartition("project", "parameter").sortWithinPartitions("project", "parameter", "pass_no", "seconds", "event_id")
    return in_order.mapInPandas(fold, CHANGES)


def value_changes_stream(found: DataFrame) -> DataFrame:
    """value_changes() of a stream: rows of one pass come in one micro-batch, passes of a key in order.

    State of a key is its answer and a count, of fixed size; earlier values are in the feed that comes out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        rows = rows[rows["value"].notna()].sort_values(["pass_no", "seconds", "event_id"])
        held = _Key(tuple(state.get) if state.exists else None)
        out = list(_passes(held, key, rows[_FOUND].itertuples(index=False)))
        if held.pass_no is not None:
            out.append(held.closed(key))
            state.update((float(held.value), float(held.confidence), int(held.priority), int(held.changes)))
        yield pd.DataFrame(out, columns=_NAMES)

    kept = "value double, confidence double, priority long, changes long"
    return found.groupBy("project", "parameter").applyInPandasWithState(step, CHANGES, kept, "append", GroupStateTimeout.NoTimeout)


def update_events(changes: DataFrame) -> DataFrame:
    """What listeners are told: a row for each value that is new or changed."""
    return changes.where(F.col("kind") != UNCHANGED)


def value_counts(changes: DataFrame, read: DataFrame) -> DataFrame:
    """A row for each pass of `read` (coordinated_passes, pass_metrics): n_updated, n_new, n_unchanged and n_found beside its
    documents. n_found: parameters of the project that have a value after the pass. A pass that finds nothing has zeros
    and the n_found of the one before."""
    each = changes.groupBy("project", "pass_no").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (UPDATED, NEW, UNCHANGED)])
    counts = read.groupBy("project", "pass_no", "is_final", "n_indexed", "fired_at").agg(F.count("*").alias("n_documents"))
    rows = counts.join(each, ["project", "pass_no"], "left").fillna(0, [f"n_{k}" for k in (UPDATED, NEW, UNCHANGED)])
    # A project has a handful of passes.
    return rows.withColumn("n_found", F.sum("n_new").over(Window.partitionBy("project").orderBy("pass_no")))


def changes_sink(changes: DataFrame, folder: str):
    """Writes update_events of each micro-batch of value_changes_stream below `events` and its counts by pass and kind below
    `counts`, partitions of their own that a batch replaces when it runs again; returns the writer."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            update_events(batch).write.mode("overwrite").parquet(f"{folder}/events/epoch={epoch}")
            batch.groupBy("project", "pass_no", "kind").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/epoch={epoch}")
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(each)


__all__ = ["changes_sink", "update_events", "value_changes", "value_changes_stream", "value_counts"]
