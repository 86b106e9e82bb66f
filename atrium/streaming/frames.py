"""Frames that arrive over time: running histograms, progress, votes and duplicate rejection.

Every operator keeps state for a bounded stretch of event time only: rows older than the watermark
are late and dropped, and what the watermark has passed leaves the state.  Results are logs of
batches, which a repeated batch replaces; a query that is started again with the same state folder
goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from atrium.session import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 8  # parts of one scene's state, so that a scene with most of the frames is no single task


def stream_frame_histogram(frames: DataFrame, keys: Sequence[str], label: str, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Label counts per scene and time window; state is dropped once the watermark passes a window."""
    return frames.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys, label).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), *keys, label, "n")


class RunTracker(StatefulProcessor):
    """Runs of frames of one key: frames no more than ``gap`` apart form a run, in whatever order they arrive.

    State is the list of open runs.  A timer behind each run's last frame closes it when the
    watermark has passed, so no frame that is on time can still join it; a closed run goes out once
    as ``complete`` and leaves the state.  Each batch that touches a key also sends its open runs as
    ``running``.
    """

    SCHEMA = "scene_id long, shard int, started long, last long, completed long, last_frame string, status string"

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "started long, last long, completed long, last_frame string")

    def timer(self, last: int) -> int:
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        new = []
        for part in rows:
            part = part.sort_values(["us", "name"], kind="stable")
            us, name = part["us"].to_numpy(), part["name"].to_numpy()
            begin = np.flatnonzero(np.r_[True, np.diff(us) > self.gap])
            end = np.r_[begin[1:], len(us)]
            new += [(int(us[a]), int(us[b - 1]), int(b - a), name[b - 1]) for a, b in zip(begin, end)]
        merged: list[tuple] = []
        for run in sorted(old + new):
            if merged and run[0] - merged[-1][1] <= self.gap:
                one, two = merged[-1], run
                last = max((one[1], one[3]), (two[1], two[3]))
                merged[-1] = (one[0], last[0], one[2] + two[2], last[1])
            else:
                merged.append(run)
        before, after = ({self.timer(r[1]) for r in runs} for runs in (old, merged))
        for at in before - after:
            self.handle.deleteTimer(at)
        for at in after - before:
            self.handle.registerTimer(at)
        self.runs.put(merged)
        yield self.frame(key, merged, "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        closed, rest = ([r for r in runs if (self.timer(r[1]) <= now) == done] for done in (True, False))
        if closed:
            self.runs.put(rest) if rest else self.runs.clear()
        yield self.frame(key, closed, "complete")

    def frame(self, key, runs: list[tuple], status: str) -> pd.DataFrame:
        rows = [(*key, *r, status) for r in runs]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def stream_progress(frames: DataFrame, gap: str = "6 hours", delay: str = "1 day", scene: str = "scene_id", ts: str = "ts", name: str = "name") -> DataFrame:
    """Progress of each scene: runs of distinct frames, open and closed, to be read with `latest_progress`.

    A frame name that comes again within ``delay`` counts once.  State is kept per scene and hash of
    the name, so one scene's frames spread over ``SHARDS`` tasks.
    """
    once = frames.select(F.col(scene).cast("long").alias("scene_id"), F.col(name).alias("name"), F.col(ts).alias("ts")).withWatermark("ts", delay)
    once = once.dropDuplicatesWithinWatermark(["scene_id", "name"])
    keyed = once.select("scene_id", F.pmod(F.xxhash64("name"), F.lit(SHARDS)).cast("int").alias("shard"), "name", F.unix_micros("ts").alias("us"), "ts")
    return keyed.groupBy("scene_id", "shard").transformWithStateInPandas(RunTracker(interval_us(gap)), RunTracker.SCHEMA, "Append", "EventTime")


def interval_us(text: str) -> int:
    """Microseconds of a length such as ``6 hours`` or ``2 days``."""
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def latest_progress(log: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Per scene and run: started, last_ts, completed, last_frame, elapsed_seconds, status, from a log of `stream_progress`.

    Of a key's open runs those of its newest batch hold, unless they closed since.  Parts of a run
    lie within the gap of each other and are put together.
    """
    key = ["scene_id", "shard"]
    done = log.filter("status = 'complete'")
    newest = log.filter("status = 'running'").groupBy(*key).agg(F.max("batch").alias("batch"))
    closed = done.select(*key, "started", F.col("batch").alias("_closed"))
    running = log.filter("status = 'running'").join(newest, [*key, "batch"]).join(closed, [*key, "started"], "left")
    running = running.filter("_closed IS NULL OR _closed < batch").drop("_closed")
    parts = done.unionByName(running.select(done.columns))
    order = W.partitionBy("scene_id").orderBy("started", "shard")  # runs of a scene, not its frames
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_new", (before.isNull() | (F.col("started") - before > interval_us(gap))).cast("int"))
    parts = parts.withColumn("_run", F.sum("_new").over(order))
    runs = parts.groupBy("scene_id", "_run").agg(
        F.min("started").alias("started"), F.max("last").alias("last"), F.sum("completed").alias("completed"),
        F.max_by("last_frame", F.struct("last", "last_frame")).alias("last_frame"), F.max("status").alias("status"))
    return runs.select("scene_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("last").alias("last_ts"), "completed", "last_frame",
                       ((F.col("last") - F.col("started")) / 1_000_000).alias("elapsed_seconds"), "status")


def stream_dedup_frames(frames: DataFrame, identity: Sequence[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First arrival of each frame; copies are rejected while their first arrival is within the delay, late rows are dropped."""
    return frames.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(identity))


def run_available(stream: DataFrame, spark: SparkSession, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
                  out: str | None = None, state: str | None = None) -> str:
    """Process everything that is there; returns the folder the result was written to.

    With the ``state`` folder of an earlier run only what is new since then is processed.
    """
    out, state = out or scratch_path(spark, "result"), state or scratch_path(spark, "state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)  # keyed state with timers needs it; the session's choice comes back below
    try:
        query = (writer.foreachBatch(each) if each is not None else writer.format("parquet").option("path", out)).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()
    return out


def changelog_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_rows(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key in a log of updates."""
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("v"))
    return best.select(*keys, "v.*")


VOTES = "scene_id long, vertex_id long, label int, votes long"


class VoteLog:
    """Votes of a stream of rays on a static mesh: one folder per batch, and sums of all batches so far at intervals.

    A repeated batch replaces its own folder.  Every ``every`` batches the newest sum and what came
    after it are added up under the number of the last batch they hold; readers take the newest
    complete sum and the batches after it, so what they read does not grow with the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 8):
        self.spark, self.path, self.every = spark, path, every

    def sink(self, place: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """``place`` gives each ray its vertex: rows with scene_id, vertex_id and label."""

        def write(batch: DataFrame, number: int) -> None:
            votes = place(batch).groupBy("scene_id", "vertex_id", "label").agg(F.count("*").alias("votes"))
            votes.write.mode("overwrite").parquet(f"{self.path}/batch/{number:012d}")
            if (number + 1) % self.every == 0:
                self.votes(number).write.mode("overwrite").parquet(f"{self.path}/sum/{number:012d}")

        return write

    def complete(self, kind: str) -> list[int]:
        """Numbers of the folders whose write was committed."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{kind}")
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        return sorted(int(f.getPath().getName()) for f in store.listStatus(root) if store.exists(hadoop.Path(f.getPath(), "_SUCCESS")))

    def votes(self, upto: int | None = None) -> DataFrame:
        """Votes per vertex and label of the batches up to a number (default: all)."""
        fits = lambda n: upto is None or n <= upto
        sums = [n for n in self.complete("sum") if fits(n) and n != upto]
        base = sums[-1] if sums else -1
        folders = [f"{self.path}/sum/{base:012d}"] if sums else []
        folders += [f"{self.path}/batch/{n:012d}" for n in self.complete("batch") if fits(n) and n > base]
        if not folders:
            return self.spark.createDataFrame([], VOTES)
        rows = self.spark.read.schema(VOTES).parquet(*folders)
        return rows.groupBy("scene_id", "vertex_id", "label").agg(F.sum("votes").alias("votes"))
