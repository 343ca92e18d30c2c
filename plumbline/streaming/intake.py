"""Event-driven intake: debounced bursts, the gate of a first pass, and incremental merging of values, as batch jobs and streams."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.scratch import numbered, placed, written
from .ledger import Ledger
from .pass_state import Passes, Rules

QUIET_SECONDS, CEILING_SECONDS = 3.0, 20.0
MAX_INCREMENTAL_PASSES, GATE_DOCUMENTS, GATE_PRIORITY = 3, 2, 80
#: Seconds of event time for which the stream remembers that a project has ended.
KEEP_SECONDS = 86_400.0
#: By so much a new confidence must exceed the old to win outright.
MARGIN = 0.05
BURSTS = "project string, burst_no long, n_events long, fired_at double, event_ids array<long>"
STREAMED = "project string, first_at double, n_events long, fired_at double, event_ids array<long>"
MERGED = "project string, parameter string, value double, confidence double, priority long, change_count long, history array<double>"
PASSES = "project string, pass_no long, is_final boolean, document_id string, place long, n_indexed long, fired_at double"


_MERGED = ["project", "parameter", "value", "confidence", "priority", "change_count", "history"]
_MERGED_TYPES = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]


def _cut(events: list[tuple[float, int]], quiet: float, ceiling: float) -> list[tuple[list[tuple[float, int]], float]]:
    """Bursts of (seconds, event_id) in order of time, each with the moment it fires."""
    out: list[tuple[list[tuple[float, int]], float]] = []
    for event in sorted(events):
        if not out or event[0] >= out[-1][1]:
            out.append(([], 0.0))
        burst = out[-1][0]
        burst.append(event)
        out[-1] = (burst, min(event[0] + quiet, burst[0][0] + ceiling))
    return out


def bursts(events: DataFrame, quiet: float = QUIET_SECONDS, ceiling: float = CEILING_SECONDS) -> DataFrame:
    """Per project: events (project, event_id, seconds) in bursts that fire after `quiet` seconds without any, or `ceiling` seconds
    after the first.

    Events are cut natively wherever `quiet` seconds pass without any, in ranges of time, so no task holds a project; only
    within such a stretch of slim rows a fold cuts at the ceiling.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = sorted(zip(pdf["project"].tolist(), pdf["stretch"].tolist(), pdf["seconds"].tolist(), pdf["event_id"].tolist(), strict=True))
        for (project, _), stretch in itertools.groupby(rows, key=lambda r: r[:2]):
            out += [(project, burst[0][0], len(burst), due, [e for _, e in burst]) for burst, due in _cut([r[2:] for r in stretch], quiet, ceiling)]
        return pd.DataFrame(out, columns=["project", "first_at", "n_events", "fired_at", "event_ids"])

    rows = placed(events.select("project", "event_id", "seconds"), "project", ["seconds", "event_id"])
    n_rows = rows.count()
    inside = Window.partitionBy("project", "__pid").orderBy("seconds", "event_id")
    earlier = Window.partitionBy("__p").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(F.col("project").alias("__p"), F.col("__pid").alias("__r")).agg(F.max("seconds").alias("m")).select("__p", "__r", F.max("m").over(earlier).alias("__before"))
    rows = rows.join(last, F.col("project").eqNullSafe(F.col("__p")) & (F.col("__pid") == F.col("__r"))).drop("__p", "__r")
    gap = F.col("seconds") - F.coalesce(F.lag("seconds").over(inside), "__before")
    rows = rows.withColumn("__start", F.when(gap.isNull() | (gap >= quiet), F.col("seconds")))
    starts = rows.groupBy(F.col("project").alias("__p"), F.col("__pid").alias("__r")).agg(F.max("__start").alias("m")).select("__p", "__r", F.max("m").over(earlier).alias("__carried"))
    rows = rows.join(starts, F.col("project").eqNullSafe(F.col("__p")) & (F.col("__pid") == F.col("__r")))
    stretch = F.coalesce(F.max("__start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__carried")
    # Some thousand rows of stretches share a group.
    groups = max(8, n_rows // 16_384)
    rows = rows.select("project", "event_id", "seconds", stretch.alias("stretch"))
    cut = rows.withColumn("__g", F.pmod(F.xxhash64("project", "stretch"), F.lit(groups))).groupBy("__g").applyInPandas(fold, STREAMED)
    return numbered(cut, "project", ["first_at"], "burst_no").select("project", (F.col("burst_no") - 1).alias("burst_no"), "n_events", "fired_at", "event_ids")


def _second(firsts: DataFrame, order: str) -> DataFrame:
    """project and the second smallest `order` of its rows, null without one."""
    least = firsts.groupBy("project").agg(F.min(order).alias("__least"))
    return firsts.join(least, "project").groupBy("project").agg(F.min(F.when(F.col(order) > F.col("__least"), F.col(order))).alias("second"))


def first_pass(events: DataFrame) -> DataFrame:
    """project, event_no: the first event at which the project has two documents, or one of priority 80 or more.

    That is the second of its documents' first events, or the first with that priority; its number counts the events up to it.
    """
    at = F.struct("seconds", "event_id")
    firsts = events.groupBy("project", "document_id").agg(F.min(at).alias("at"), F.min(F.when(F.col("priority") >= GATE_PRIORITY, at)).alias("high"))
    gate = _second(firsts, "at").join(firsts.groupBy("project").agg(F.min("high").alias("high")), "project")
    gate = gate.select("project", F.least("second", "high").alias("gate")).where("gate is not null")
    return events.select("project", at.alias("at")).join(gate, "project").where(F.col("at") <= F.col("gate")).groupBy("project").agg(F.count("*").cast("int").alias("event_no"))


def new_documents(indexed: DataFrame, extracted: DataFrame) -> DataFrame:
    """What is indexed and was not extracted yet."""
    return indexed.join(extracted, ["project", "document_id"], "left_anti")


def passes(fired: DataFrame) -> DataFrame:
    """bursts with pass_no; only the first three run as incremental passes, the rest wait for the final pass."""
    return numbered(fired, "project", ["burst_no"], "pass_no").withColumn("runs", F.col("pass_no") <= MAX_INCREMENTAL_PASSES)


def coordinated_passes(events: DataFrame, completed: DataFrame) -> DataFrame:
    """project, pass_no, is_final, document_id, place, n_indexed, fired_at: which documents each pass of a project reads.

    events: project, event_id, seconds, document_id, priority. Passes run when a burst fires, from the first at which the
    project has two documents or one of priority 80 or more; each reads the documents that no pass has read, by priority
    (place), and after three the rest wait. Projects in `completed` (project, seconds) have a final pass over all documents; no
    burst fires and no event counts after that. A document's priority is the same in all its events.
    """
    ends = completed.select("project", F.col("seconds").alias("__end"))
    events = events.join(ends, "project", "left").where(F.col("__end").isNull() | (F.col("seconds") < F.col("__end")))
    fired = written(bursts(events), "bursts")
    in_time = fired.join(ends, "project", "left").where(F.col("__end").isNull() | (F.col("fired_at") <= F.col("__end")))
    member = fired.select("project", "burst_no", "fired_at", F.explode("event_ids").alias("event_id"))
    docs = events.join(member, ["project", "event_id"]).groupBy("project", "document_id").agg(F.min("burst_no").alias("burst_no"), F.max("priority").alias("priority"))
    docs = written(docs, "burst-documents")
    of_burst = docs.groupBy("project", "burst_no").agg(F.count("*").alias("n"), F.max("priority").alias("top"))
    so_far = Window.partitionBy("project").orderBy("burst_no")
    of_burst = of_burst.withColumn("n_indexed", F.sum("n").over(so_far)).withColumn("top", F.max("top").over(so_far))
    open_ = of_burst.where((F.col("n_indexed") >= GATE_DOCUMENTS) | (F.col("top") >= GATE_PRIORITY))
    open_ = open_.join(in_time.select("project", "burst_no", "fired_at"), ["project", "burst_no"])
    runs = open_.withColumn("pass_no", F.row_number().over(so_far)).where(F.col("pass_no") <= MAX_INCREMENTAL_PASSES)
    runs = runs.select("project", F.col("burst_no").alias("at"), "pass_no", "n_indexed", "fired_at")
    gate = runs.groupBy("project").agg(F.min("at").alias("gate"))
    read = docs.join(gate, "project").withColumn("at", F.greatest("burst_no", "gate")).join(runs, ["project", "at"]).withColumn("is_final", F.lit(False))
    done = completed.select("project", F.col("seconds").alias("fired_at")).join(runs.groupBy("project").agg(F.max("pass_no").alias("n")), "project", "left")
    done = done.select("project", "fired_at", (F.coalesce("n", F.lit(0)) + 1).alias("pass_no"))
    last = docs.join(done, "project").withColumn("n_indexed", F.count("*").over(Window.partitionBy("project"))).withColumn("is_final", F.lit(True))
    fields = ["project", "pass_no", "is_final", "document_id", "priority", "n_indexed", "fired_at"]
    every = read.select(*fields).unionByName(last.select(*fields))
    place = F.row_number().over(Window.partitionBy("project", "pass_no").orderBy(F.col("priority").desc(), "document_id"))
    return every.select("project", F.col("pass_no").cast("long").alias("pass_no"), "is_final", "document_id", place.cast("long").alias("place"), "n_indexed", "fired_at")


def pass_metrics(read: DataFrame) -> DataFrame:
    """A row for each pass of coordinated_passes or pass_stream: its documents, those indexed by then, and when it fired."""
    return read.groupBy("project", "pass_no", "is_final", "n_indexed", "fired_at").agg(F.count("*").alias("n_documents"))


def metrics_sink(read_stream: DataFrame, folder: str):
    """Writes pass_metrics of each micro-batch of pass_stream as a partition of its own, so a batch that runs again replaces its
    rows; returns the writer."""

    def each(batch: DataFrame, epoch: int) -> None:
        pass_metrics(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return read_stream.writeStream.foreachBatch(each)


def _merged(state: tuple | None, rows: Iterable[tuple]) -> tuple:
    for value, confidence, priority in rows:
        if state is None:
            state = (value, confidence, priority, 0, [])
            continue
        old, sure, rank, changes, history = state
        wins = confidence >= sure + MARGIN or abs(confidence - sure) < MARGIN and priority > rank
        if wins:
            if value != old:
                history.append(old)
            state = (value, confidence, priority, changes + (value != old), history)
    return state


def merged_values(values: DataFrame) -> DataFrame:
    """The value of each (project, parameter) after all of `values` (project, parameter, seconds, event_id, value, confidence,
    priority) in order: a confidence higher by 0.05 wins, within that margin the higher document priority. change_count and
    history tell how often the value changed and what it was before. It stays tentative until a final pass; see lifecycle()."""

    rows = values.select("project", "parameter", "seconds", "event_id", "value", "confidence", "priority").repartition("project", "parameter")
    rows = rows.sortWithinPartitions("project", "parameter", F.asc_nulls_last("seconds"), F.asc_nulls_last("event_id"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Values lie in order, so a task holds the state of one key at a time and not its rows.
        now, state = None, None
        for batch in batches:
            keys = list(zip(batch.column("project").to_pylist(), batch.column("parameter").to_pylist(), strict=True))
            pdf, done = batch.select(["value", "confidence", "priority"]).to_pandas(), []
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            columns = [pdf[c].tolist() for c in pdf]
            for i, j in itertools.pairwise(cuts):
                if i == j:
                    continue
                if state is not None and keys[i] != now:
                    done.append((*now, *state))
                    state = None
                now, state = keys[i], _merged(state, zip(*[c[i:j] for c in columns], strict=True))
            if done:
                yield merged(done)
        if state is not None:
            yield merged([(*now, *state)])

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True).cast(t) for c, t in zip(zip(*rows, strict=True), _MERGED_TYPES, strict=True)], _MERGED)

    return rows.mapInArrow(fold, MERGED)


def merged_values_stream(values: DataFrame) -> DataFrame:
    """merged_values of a stream: keyed state, an update for each key that a micro-batch touches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seconds", "event_id"])
        v, c, p, n, history = _merged((*state.get[:4], list(state.get[4])) if state.exists else None, rows[["value", "confidence", "priority"]].itertuples(index=False))
        state.update((float(v), float(c), int(p), int(n), [float(x) for x in history]))
        yield pd.DataFrame([(*key, v, c, p, n, history)], columns=_MERGED)

    return values.groupBy("project", "parameter").applyInPandasWithState(step, MERGED, "value double, confidence double, priority long, changes long, history array<double>", "update", GroupStateTimeout.NoTimeout)


def lifecycle(merged: DataFrame, read: DataFrame) -> DataFrame:
    """Merged values with lifecycle_status: `final` once a final pass of their project ran (coordinated_passes), else `tentative`."""
    final = read.where("is_final").select("project").distinct().withColumn("__final", F.lit(True))
    return merged.join(final, "project", "left").withColumn("lifecycle_status", F.when(F.col("__final"), "final").otherwise("tentative")).drop("__final")


def burst_stream(events: DataFrame, quiet: float = QUIET_SECONDS, ceiling: float = CEILING_SECONDS, late: str = "10 seconds") -> DataFrame:
    """bursts of a stream (project, event_id, ts): each comes out once the watermark, `late` behind the latest event, is past its end.

    State holds a project's events of bursts still open, none after their end. Events later than `late` are dropped by the watermark.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for pdf in frames:
                held += zip(pdf["seconds"].tolist(), pdf["event_id"].tolist(), strict=True)
        passed, out, still = state.getCurrentWatermarkMs() / 1000, [], []
        cut = _cut(held, quiet, ceiling)
        for burst, due in cut:
            if due <= passed:
                out.append((key[0], burst[0][0], len(burst), due, [e for _, e in burst]))
            else:
                still += burst
        if still:
            state.update(([float(s) for s, _ in still], [int(e) for _, e in still]))
            state.setTimeoutTimestamp(math.ceil(next(due for _, due in cut if due > passed) * 1000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["project", "first_at", "n_events", "fired_at", "event_ids"])

    marked = events.withWatermark("ts", late).select("project", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("seconds"))
    return marked.groupBy("project").applyInPandasWithState(step, STREAMED, "seconds array<double>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def pass_stream(events: DataFrame, late: str = "10 seconds", quiet: float = QUIET_SECONDS, ceiling: float = CEILING_SECONDS, keep: float = KEEP_SECONDS) -> DataFrame:
    """coordinated_passes of a stream (project, event_id, ts, document_id, priority, complete): each pass comes out once the
    watermark, `late` behind the latest event, is past its burst's end.

    State has a row for each document of a project (see Passes), so a micro-batch writes as much as it brings. It is kept by
    the query's checkpoint: after a restart no document is read twice. An event marked complete (its document_id is null)
    ends the project: its final pass reads all documents, and what comes within `keep` seconds of event time is ignored; then
    its state goes. The session's state store must be RocksDB: spark.sql.streaming.stateStore.providerClass.
    """
    rules = Rules(_cut, quiet, ceiling, MAX_INCREMENTAL_PASSES, GATE_DOCUMENTS, GATE_PRIORITY, keep)
    marked = events.withWatermark("ts", late).select("project", "event_id", "ts", "document_id", "priority", "complete", (F.unix_micros("ts") / 1e6).alias("seconds"))
    return marked.groupBy("project").transformWithStateInPandas(Passes(rules), PASSES, "Append", "EventTime")


def intake(documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], out: str, parts: int = 1024):
    """Sends each document (doc_id, text, ...) of a stream through `chunk` once; returns the writer.

    Below `out`, a folder for each micro-batch holds `chunks`, what chunk() gives (with doc_id), and `status`: doc_id, state and
    reason. A batch that runs again replaces its own folder. Documents that an earlier batch has processed are left out, so a
    file that comes twice is read once; their ids lie in `ids`, a few sorted segments (see Ledger), so a batch opens as many
    files however many went before. A row without id or text is `rejected`. Where chunk() fails on a batch it is tried once
    more; then the batch is halved by a hash of doc_id, down to one of `parts` parts, whose documents are `failed`.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        named = f"{out}/epoch={epoch}"
        good = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        ledger = Ledger(spark, f"{out}/ids")
        # A batch that runs again begins anew.
        place = spark._jvm.org.apache.hadoop.fs.Path(named)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(place, True)
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        fresh = batch.where(good).withColumn("__n", first).where("__n = 1").drop("__n")
        if (done := ledger.before(epoch)) is not None:
            fresh = fresh.join(done, "doc_id", "left_anti")
        fresh.write.parquet(f"{named}/fresh")
        fresh = spark.read.schema(fresh.schema).parquet(f"{named}/fresh")
        failed: list[tuple[int, int, str]] = []

        def attempt(modulus: int, at: int) -> None:
            part = fresh if modulus == 1 else fresh.where(F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) == at)
            for last in (False, True):
                try:
                    chunk(part).write.mode("overwrite").parquet(f"{named}/chunks/part={modulus}-{at}")
                    return
                except Exception as why:  # the caller's function, of any kind
                    reason = str(why).strip().splitlines()[0][:200] if str(why).strip() else type(why).__name__
                    if not last:
                        continue
            if modulus < parts:
                attempt(modulus * 2, at)
                attempt(modulus * 2, at + modulus)
            else:
                failed.append((modulus, at, reason))

        attempt(1, 0)
        state, reason = F.lit("processed"), F.lit(None).cast("string")
        for modulus, at, why in failed:
            own = F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) == at
            state, reason = F.when(own, "failed").otherwise(state), F.when(own, why).otherwise(reason)
        rejected = batch.where(~good).select("doc_id", F.lit("rejected").alias("state"), F.lit("no id or text").alias("reason"))
        fresh.select("doc_id", state.alias("state"), reason.alias("reason")).unionByName(rejected).write.mode("overwrite").parquet(f"{named}/status")
        ledger.add(fresh.where(state == "processed").select("doc_id"), epoch)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{named}/fresh"), True)

    return documents.writeStream.foreachBatch(each)
