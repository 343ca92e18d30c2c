"""The stream of passes and the intake of documents: equal to the batch jobs, across restarts, files that come twice and failures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import changes, intake, ledger

EVENT = "project string, event_id long, at double, document_id string, priority long, complete boolean"


def arrivals(seed):
    rng, rows, n = random.Random(seed), [], 0
    for project in "abcdef":
        at = 100.0 + rng.random()
        for _ in range(rng.randint(1, 40)):
            at += rng.choice([0.2, 0.7, 1.5, 2.9, 3.0, 3.4, 8.0, 30.0])
            n += 1
            rows.append((project, n, round(at, 3), f"d{rng.randrange(12)}", 60, False))
        if project in "ace":
            n += 1
            rows.append((project, n, round(rng.uniform(110, at + 5), 3), None, 0, True))
    rows = [(p, i, t, d, (80 if d in ("d3", "d7") else r), c) for p, i, t, d, r, c in rows]
    # a last event far ahead moves the watermark past everything
    return sorted(rows, key=lambda r: r[2]) + [("z", n + 1, 10_000.0, "d0", 60, False)]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_of_a_stream_equal_the_batch_across_restarts(spark, rocksdb, tmp_path, seed):
    rows = arrivals(seed)
    source, folder, metrics = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "metrics")
    source.mkdir()
    as_rows = lambda part: spark.createDataFrame(part, EVENT).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    schema = as_rows(rows[:1]).schema
    third = len(rows) // 3
    for k, part in enumerate((rows[:third], rows[third : 2 * third], rows[2 * third :])):
        # each part is a run of its own: state must outlive the query
        as_rows(part).coalesce(1).write.mode("append").parquet(f"file://{source}/part{k}")
        stream = intake.pass_stream(spark.readStream.schema(schema).parquet(f"file://{source}/part*"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"file://{folder}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.project, r.pass_no, r.is_final, r.document_id, r.place, r.n_indexed, round(r.fired_at, 3)) for r in spark.read.schema(intake.PASSES).parquet(f"file://{folder}").collect()}
    events = spark.createDataFrame([(p, i, t, d, r) for p, i, t, d, r, c in rows if not c], "project string, event_id long, seconds double, document_id string, priority long")
    ends = spark.createDataFrame([(p, t) for p, _, t, _, _, c in rows if c], "project string, seconds double")
    batch = intake.coordinated_passes(events, ends)
    want = {(r.project, r.pass_no, r.is_final, r.document_id, r.place, r.n_indexed, round(r.fired_at, 3)) for r in batch.where("project <> 'z'").collect()}
    assert got == want and any(x[2] for x in got) and max(x[1] for x in got if not x[2]) == intake.MAX_INCREMENTAL_PASSES
    done = spark.readStream.schema(intake.PASSES).parquet(f"file://{folder}")
    q = intake.metrics_sink(done, f"file://{metrics}").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    counted = {(r.project, r.pass_no): r.n_documents for r in spark.read.parquet(f"file://{metrics}").collect()}
    assert counted == {k: sum(x[:2] == k for x in want) for k in {x[:2] for x in want}}


def test_state_written_follows_the_new_events(spark, rocksdb, tmp_path):
    schema = "project string, event_id long, at double, document_id string, priority long, complete boolean"
    many = [("a", i, 100.0 + i / 1000, f"d{i:05}", 60, False) for i in range(3_000)]
    parts = [many, [("a", 9_000, 200.0, "new", 60, False)], [("a", 9_001, 300.0, "newer", 60, False), ("b", 9_002, 300.0, "x", 60, False)], [("a", 9_003, 400.0, None, 0, True)], [("z", 9_004, 9_000.0, "x", 60, False)], [("z", 9_005, 100_000.0, "x", 60, False)], [("z", 9_006, 200_000.0, "y", 60, False)]]
    writes, rows = [], []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = intake.pass_stream(spark.readStream.schema(f"{schema}, ts timestamp").parquet(f"file://{tmp_path}/in/*"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        ops = [o for p in q.recentProgress for o in p.stateOperators]
        writes.append(sum(o.customMetrics["rocksdbPutCount"] for o in ops))
        rows.append(ops[-1].numRowsTotal)
    got = {}
    for r in spark.read.schema(intake.PASSES).parquet(f"file://{tmp_path}/out").collect():
        got.setdefault((r.project, r.pass_no, r.is_final), []).append(r.document_id)
    assert {k: len(v) for k, v in got.items() if k[0] == "a"} == {("a", 1, False): 3_000, ("a", 2, False): 1, ("a", 3, False): 1, ("a", 4, True): 3_002}
    # The pass over 3,000 documents writes them; the batches after it bring one or two, and write some rows each.
    assert max(writes[:2]) > 3_000 and max(writes[2:4]) < 100, writes
    # A project that ended leaves one row, then none.
    assert max(rows[:4]) > 3_000 and rows[-1] < 20, rows


def test_lifecycle_is_final_after_the_final_pass(spark):
    merged = spark.createDataFrame([("a", "p"), ("b", "p")], "project string, parameter string")
    read = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "project string, is_final boolean")
    assert {r.project: r.lifecycle_status for r in intake.lifecycle(merged, read).collect()} == {"a": "final", "b": "tentative"}


def test_intake_reads_each_document_once_and_marks_failures(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "doc_id long, text string"
    asked = []

    def chunk(docs):
        asked.append(1)
        # documents whose text is bad fail the whole batch
        return docs.select("doc_id", F.when(F.col("text") == "bad", F.raise_error(F.lit("bad text"))).otherwise(F.length("text")).alias("n"))

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        intake.intake(stream, chunk, out, parts=64).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    run([(i, "bad" if i == 7 else "x" * i) for i in range(20)] + [(None, "no id"), (50, None), (3, "x" * 3)], "one")
    first = len(asked)
    run([(i, "x" * i) for i in range(5)] + [(7, "good"), (90, "new")], "two")
    status = spark.read.schema("doc_id long, state string, reason string").parquet(f"{out}/epoch=*/status").collect()
    chunks = [r.doc_id for r in spark.read.schema("doc_id long, n int").parquet(f"{out}/epoch=*/chunks/part=*").collect()]
    failed = {r.doc_id: r.reason for r in status if r.state == "failed"}
    assert 7 in failed and "bad text" in failed[7] and len(failed) < 5 and first > 2
    processed = [r.doc_id for r in status if r.state == "processed"]
    assert sorted(processed) == sorted(set(processed)) == sorted(chunks) and {7, 90} <= set(processed)
    assert set(range(20)) <= set(processed) | set(failed)
    assert sorted((r.doc_id is None, r.doc_id) for r in status if r.state == "rejected") == [(False, 50), (True, None)]


def test_ledger_opens_as_many_files_after_200_batches(spark, tmp_path):
    ids = ledger.Ledger(spark, f"file://{tmp_path}/ids")
    assert ids.before(0) is None
    opened, known = [], set()
    for batch in range(200):
        before = ids.before(batch)
        opened.append(len(before.inputFiles()) if before is not None else 0)
        if batch in (1, 5, 21, 64, 199):
            assert sorted(r.doc_id for r in before.collect()) == sorted(known)
        own = range(batch * 3, batch * 3 + batch % 3)
        ids.add(spark.range(own.start, own.stop, 1, 1).withColumnRenamed("id", "doc_id"), batch)
        known |= set(own)
    # Three of each size at most, and a level for each power of four.
    assert max(opened) <= 12 and max(opened[150:]) <= max(opened[:64]) + 3


def test_ledger_survives_a_batch_that_runs_again(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1)
    found = lambda batch: sorted(r.doc_id for r in ledger.Ledger(spark, path).before(batch).collect())
    for batch in range(4):
        ledger.Ledger(spark, path).before(batch)
        ledger.Ledger(spark, path).add(rows(batch), batch)
    # Batch 3 ends before its commit and runs again, with other rows: its own segment doesn't count, then it is replaced.
    assert found(3) == [0, 1, 2]
    ledger.Ledger(spark, path).add(rows(3, 30), 3)
    assert found(4) == [0, 1, 2, 3, 30] and [p.name for p in (tmp_path / "ids").iterdir()] == ["0-3"]
    # A merge that stopped halfway: a part remains beside the whole, and a folder without its mark.
    ledger.Ledger(spark, path)._write(rows(0), 0, 0)
    rows(77).write.parquet(f"{path}/4-4")
    (tmp_path / "ids/4-4/_SUCCESS").unlink()
    assert found(5) == [0, 1, 2, 3, 30]


def found_values(seed):
    rng, rows = random.Random(seed), []
    for k in range(400):
        project, parameter = rng.choice("ab"), f"p{rng.randrange(6)}"
        rows.append((project, parameter, rng.randrange(1, 5), float(k), k, rng.choice([None, 1.0, 2.0, 2.0, 3.0]), rng.randrange(40, 100) / 100, rng.choice([10, 60, 80, 100])))
    return rows


FOUND = "project string, parameter string, pass_no long, seconds double, event_id long, value double, confidence double, priority long"


def test_changes_of_batch_and_stream_agree(spark, tmp_path):
    rows = found_values(7)
    want, state = [], {}
    for p in range(1, 5):
        for key in sorted({r[:2] for r in rows}):
            old = state.get(key)
            for *_, v, c, rank in sorted((r for r in rows if r[:2] == key and r[2] == p and r[5] is not None), key=lambda r: r[3:5]):
                now = state.get(key)
                if now is None or c >= now[1] + 0.05 or abs(c - now[1]) < 0.05 and rank > now[2]:
                    state[key] = (v, c, rank, now[3] if now else 0)
            if any(r[:2] == key and r[2] == p and r[5] is not None for r in rows):
                v, c, rank, n = state[key]
                kind = "new" if old is None else "updated" if old[0] != v else "unchanged"
                state[key] = (v, c, rank, n + (kind == "updated"))
                want.append((*key, p, kind, old and old[0], *state[key]))
    df = spark.createDataFrame(rows, FOUND)
    order = lambda out: sorted(map(tuple, out), key=lambda r: r[:3])
    assert order(changes.value_changes(df.repartition(3)).collect()) == order(want)
    assert {r[3] for r in want} == {"new", "updated", "unchanged"}
    merged = {(r.project, r.parameter): (r.value, r.confidence, r.priority) for r in intake.merged_values(df.where("value is not null").withColumn("seconds", F.col("pass_no") * 1000 + F.col("seconds"))).collect()}
    assert merged == {k: v[:3] for k, v in state.items()}
    for p in range(1, 5):
        df.where(F.col("pass_no") == p).coalesce(1).write.parquet(f"file://{tmp_path}/in/{p}")
        stream = changes.value_changes_stream(spark.readStream.schema(FOUND).parquet(f"file://{tmp_path}/in/*"))
        changes.changes_sink(stream, f"file://{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    events = spark.read.schema(changes.CHANGES).parquet(f"file://{tmp_path}/out/events/epoch=*").collect()
    assert order(events) == order(r for r in want if r[3] != "unchanged")
    counts = spark.read.schema("project string, pass_no long, kind string, n long").parquet(f"file://{tmp_path}/out/counts/epoch=*").collect()
    assert {(r.project, r.pass_no, r.kind): r.n for r in counts} == {k: sum((x[0], x[2], x[3]) == k for x in want) for k in {(x[0], x[2], x[3]) for x in want}}


def test_counts_of_passes_that_find_nothing(spark):
    read = spark.createDataFrame([("a", p, p == 3, f"d{k}", k, 2, 1.0 * p) for p in (1, 2, 3) for k in range(2)], intake.PASSES)
    made = spark.createDataFrame([("a", "x", 1, "new", None, 1.0, 0.5, 1, 0), ("a", "x", 3, "unchanged", 1.0, 1.0, 0.5, 1, 0), ("a", "y", 3, "new", None, 1.0, 0.5, 1, 0)], changes.CHANGES)
    got = {r.pass_no: (r.n_documents, r.n_updated, r.n_new, r.n_unchanged, r.n_found) for r in changes.value_counts(made, read).collect()}
    assert got == {1: (2, 0, 1, 0, 1), 2: (2, 0, 0, 0, 1), 3: (2, 0, 1, 1, 2)}
    assert changes.value_changes(spark.createDataFrame([], FOUND)).count() == 0


def test_values_of_a_key_are_folded_as_they_come(spark):
    """Keys go on over batches and no task gathers the rows of one; the order of seconds and event_id counts."""
    rng = random.Random(8)
    rows = [("p" if i % 3 else f"q{i % 7}", "ab"[i % 2], float(rng.randrange(40)), i, rng.choice([1.0, 2.0, 3.0]), rng.randrange(20) / 20, rng.choice([60, 80, 100])) for i in range(300)]
    rng.shuffle(rows)
    values = spark.createDataFrame(rows, "project string, parameter string, seconds double, event_id long, value double, confidence double, priority long")
    want = {}
    for project, parameter, _, _, value, sure, rank in sorted(rows, key=lambda r: r[2:4]):
        old = want.get((project, parameter))
        if old is None:
            want[project, parameter] = (value, sure, rank, 0, [])
        elif sure >= old[1] + 0.05 or abs(sure - old[1]) < 0.05 and rank > old[2]:
            changed = value != old[0]
            want[project, parameter] = (value, sure, rank, old[3] + changed, old[4] + [old[0]] * changed)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = intake.merged_values(values)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.project, r.parameter): tuple(r)[2:] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
