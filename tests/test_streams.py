"""Streams over several batches: order, late and repeated rows, restarts, bounded state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from atrium.streaming import frames as S

T0 = dt.datetime(2024, 5, 1)
SCHEMA = "scene_id long, name string, ts timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes one file per call; streams read them one by one in that order."""
    folder = tmp_path / "feed"
    folder.mkdir()

    def put(rows):
        spark.createDataFrame([(s, n, at(m)) for s, n, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    put.stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return put


def progress(spark, feed, tmp_path, gap="30 minutes", delay="60 minutes"):
    log = str(tmp_path / "log")
    S.run_available(S.stream_progress(feed.stream(), gap, delay), spark, "append", S.changelog_sink(log), state=str(tmp_path / "state"))
    rows = spark.read.parquet(log)
    return rows, {(r.scene_id, r.started): r for r in S.latest_progress(rows, gap).collect()}


def test_progress_over_restarts(spark, feed, tmp_path):
    feed([(1, "a", 0), (1, "b", 20), (2, "x", 5)])
    feed([(1, "d", 60), (1, "b", 20), (1, "c", 35)])  # b again; c joins what were two runs
    _, got = progress(spark, feed, tmp_path)
    run = got[1, at(0)]
    assert (run.completed, run.last_frame, run.elapsed_seconds, run.status, run.last_ts) == (4, "d", 3600.0, "running", at(60))
    feed([(1, "e", 300)])
    feed([(1, "f", 301), (2, "y", 310)])
    feed([(3, "z", 600), (1, "late", 10)])
    log, got = progress(spark, feed, tmp_path)  # from the state that the first run left
    assert {k: (r.completed, r.last_frame, r.status) for k, r in got.items()} == {
        (1, at(0)): (4, "d", "complete"), (2, at(5)): (1, "x", "complete"), (1, at(300)): (2, "f", "complete"), (2, at(310)): (1, "y", "complete"), (3, at(600)): (1, "z", "running")}
    assert got[1, at(300)].elapsed_seconds == 60.0
    closed = log.filter("status = 'complete'").groupBy("scene_id", "shard", "started").count()
    assert closed.filter("count > 1").isEmpty()  # a run is closed once
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "runs").load(str(tmp_path / "state"))
    assert state.select("key.scene_id").distinct().count() == 1  # closed runs have left the state


def test_runs_of_one_scene_in_any_order(spark, feed, tmp_path):
    import random

    rng = random.Random(2)
    minutes = sorted(rng.sample(range(0, 3000), 150))
    rows = [(7, f"n{m}", m) for m in minutes]
    parts = [[r for r in rows if r[2] // 1000 == k] for k in range(3)]
    for k in range(3):
        rng.shuffle(parts[k])
    moved = parts[0][:10]
    parts[0], parts[1] = parts[0][10:], parts[1] + moved  # arrive one file later, within the delay
    for part in parts:
        feed(part)
    _, got = progress(spark, feed, tmp_path, "25 minutes", "2000 minutes")
    runs = []
    for m in minutes:
        if runs and m - runs[-1][-1] <= 25:
            runs[-1].append(m)
        else:
            runs.append([m])
    assert {k[1]: (r.completed, r.last_frame) for k, r in got.items()} == {at(r[0]): (len(r), f"n{r[-1]}") for r in runs}


def test_repeated_frames_within_the_delay(spark, feed, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda: S.stream_dedup_frames(feed.stream(), ["scene_id", "name"], delay="60 minutes")
    feed([(1, "a", 0), (1, "a", 0), (2, "a", 1)])
    feed([(1, "a", 30), (1, "b", 40)])
    S.run_available(make(), spark, out=out, state=state)
    feed([(1, "a", 50), (1, "b", 45)])  # still known after the restart
    feed([(1, "c", 500)])
    feed([(1, "d", 501)])
    feed([(1, "b", 44), (1, "a", 520)])  # one late, one new again
    S.run_available(make(), spark, out=out, state=state)
    got = sorted((r.scene_id, r.name, r.ts) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a", at(0)), (1, "a", at(520)), (1, "b", at(40)), (1, "c", at(500)), (1, "d", at(501)), (2, "a", at(1))]
    assert spark.read.format("statestore").load(state).count() <= 3


def test_votes_add_up_over_batches_and_repeats(spark, tmp_path):
    log = S.VoteLog(spark, str(tmp_path / "votes"), every=3)
    assert log.votes().isEmpty()
    rays = spark.range(700).select((F.col("id") % 2).alias("scene_id"), (F.col("id") % 5).alias("vertex_id"), (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 7).alias("part"))
    write = log.sink(lambda batch: batch)
    for k in range(7):
        write(rays.filter(F.col("part") == k), k)
        if k in (2, 4):
            write(rays.filter(F.col("part") == k), k)  # the engine repeats a batch after a failure
    want = {(r.scene_id, r.vertex_id, r.label): r["count"] for r in rays.groupBy("scene_id", "vertex_id", "label").count().collect()}
    assert {(r.scene_id, r.vertex_id, r.label): r.votes for r in log.votes().collect()} == want
    assert log.complete("sum") == [2, 5]
    import shutil

    shutil.rmtree(tmp_path / "votes" / "batch" / "000000000001")  # summed up already, so no longer read
    assert {(r.scene_id, r.vertex_id, r.label): r.votes for r in log.votes().collect()} == want
    assert log.votes(4).agg(F.sum("votes")).first()[0] == rays.filter("part <= 4").count()


def test_session_keeps_its_state_store(spark, feed, tmp_path):
    before = spark.conf.get(S.STATE_STORE)
    feed([(1, "a", 0)])
    S.run_available(S.stream_dedup_frames(feed.stream(), ["name"]), spark)
    assert spark.conf.get(S.STATE_STORE) == before
