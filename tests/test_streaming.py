"""Incremental AvailableNow runs: re-runs are idempotent, new files are folded in."""

import uuid

from nomina.plans.common import table
from nomina.session import scratch_path
from nomina.streaming import ingest as ING
from nomina.streaming.progress import PUBLIC_COLS, attempts_from_events, progress, progress_summary
from nomina.streaming.state import BucketedState


def _rows(df):
    return sorted(map(tuple, df.select(*PUBLIC_COLS).collect()))


def test_progress_stream_incremental_and_idempotent(spark, sf_small):
    ev = table(spark, sf_small, "events")
    first, second = ev.randomSplit([0.6, 0.4], seed=3)
    landing = scratch_path(spark, f"land-{uuid.uuid4().hex[:8]}")
    state, ckpt = scratch_path(spark, f"state-{uuid.uuid4().hex[:8]}"), scratch_path(spark, f"ck-{uuid.uuid4().hex[:8]}")
    first.coalesce(2).write.parquet(landing)

    run1 = _rows(ING.run_progress_stream(spark, landing, ev.schema, state, ckpt))
    assert run1 == _rows(progress(attempts_from_events(first)))

    again = _rows(ING.run_progress_stream(spark, landing, ev.schema, state, ckpt))     # nothing new
    assert again == run1

    second.coalesce(1).write.mode("append").parquet(landing)                            # new file lands
    run2 = _rows(ING.run_progress_stream(spark, landing, ev.schema, state, ckpt))
    assert run2 == _rows(progress(attempts_from_events(ev)))
    batches = ING.session_log(spark, state).count()
    assert batches == 3                                                                  # 2 + 1 files


def test_latest_content_of_a_key_goes_to_data_and_manifest(spark):
    import hashlib

    landing, out, man, ck = (scratch_path(spark, f"{x}-{uuid.uuid4().hex[:8]}") for x in ("land", "data", "man", "ck"))
    rows = [(1, "OLD", 1), (1, "NEW", 2), (2, "ONE", 1), (2, "ONE", 1)]
    df = spark.createDataFrame(rows, "k long, t string, at long")
    df.coalesce(1).write.parquet(landing)
    run = lambda: sorted((r["k"], r["t"]) for r in ING.run_content_ingest(spark, landing, df.schema, out, man, ck, "k", "t", order="at").collect())
    assert run() == [(1, "NEW"), (2, "ONE")]
    df.coalesce(1).write.mode("append").parquet(landing)
    assert run() == [(1, "NEW"), (2, "ONE")]
    manifest = {r["clave"]: r["sha256"] for r in BucketedState(spark, man, "clave").read().collect()}
    assert manifest == {1: hashlib.sha256(b"NEW").hexdigest(), 2: hashlib.sha256(b"ONE").hexdigest()}
    spark.createDataFrame([(1, "OLD", 9)], "k long, t string, at long").write.mode("append").parquet(landing)
    assert run() == [(1, "NEW"), (1, "OLD"), (2, "ONE")]


def test_a_success_clears_the_error(spark):
    att = spark.createDataFrame([(1, 1, 10, "error", "boom", 0, 1.0), (1, 2, 20, "success", None, 7, 1.0), (2, 3, 5, "success", None, 3, 1.0), (2, 4, 6, "error", "bad", 0, 1.0)],
                                "organismo_id long, intento_id long, ts long, status string, error string, data_count long, processing_time double")
    got = {r["organismo_id"]: (r["last_error"], r["data_total"]) for r in progress(att).collect()}
    assert got == {1: (None, 7), 2: ("bad", 3)}


def _add(current, batch):
    both = batch if current is None else current.select(*batch.columns).unionByName(batch)
    return both.groupBy("k").sum("n").withColumnRenamed("sum(n)", "n")


def test_a_batch_rewrites_only_its_buckets(spark):
    base = scratch_path(spark, f"state-{uuid.uuid4().hex[:8]}")
    state = BucketedState(spark, base, "k", buckets=8)
    assert state.read() is None and state.versions() == {}
    frame = lambda rows: spark.createDataFrame(rows, "k long, n long")
    want = {}

    def fold(batch_id, rows):
        done = state.update(batch_id, frame(rows), _add)
        if done:
            for k, n in rows:
                want[k] = want.get(k, 0) + n
        assert {r.k: r.n for r in state.read().collect()} == want
        return done

    assert fold(0, [(k, 1) for k in range(200)])
    first = state.versions()
    assert set(first.values()) == {0} and len(first) == 8
    assert fold(1, [(3, 10), (3, 5)])
    changed = {b for b, v in state.versions().items() if v == 1}
    assert len(changed) == 1
    written = spark.read.parquet(f"{base}/data/v=1")
    assert written.select("bucket").distinct().count() == 1 and written.count() < 60  # what is written follows the batch
    assert not fold(1, [(3, 10), (3, 5)])  # a replay
    # a batch that died before its commit left files of its own: it is done again over them
    frame([(3, 999)]).withColumn("bucket", state.bucket()).write.partitionBy("bucket").parquet(f"{base}/data/v=2")
    assert fold(2, [(4, 1), (1000, 1)])
    for i in range(3, 9):
        assert fold(i, [(k, 1) for k in range(200)])
    assert state.commits() == [7, 8]
    import os

    left = sorted(os.listdir(f"{base}/data".replace("file:", "")))
    assert [x for x in left if x.startswith("v=")] == ["v=7", "v=8"]  # versions that no commit names are gone
    assert fold(9, [])
    assert BucketedState(spark, base, "k").read().count() == len(want)


def test_summary_with_and_without_sessions(spark):
    att = spark.createDataFrame([(1, 1, 10, "success", None, 4, 1.0)], "organismo_id long, intento_id long, ts long, status string, error string, data_count long, processing_time double")
    ses = spark.createDataFrame([(7, 100, 120, "completada"), (8, 300, None, "abierta"), (9, 200, 220, "completada")], "id long, inicio long, fin long, estado string")
    row = progress_summary(progress(att), ses).first()
    assert (row.total, row.sesion_id, row.sesion_inicio, row.sesion_fin, row.sesion_estado) == (1, 8, 300, None, "abierta")
    assert progress_summary(progress(att), ses.limit(0)).first().sesion_id is None
    assert "sesion_id" not in progress_summary(progress(att)).columns
