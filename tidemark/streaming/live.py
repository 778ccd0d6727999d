"""Streaming forms of the batch operators: file sources, sessions, sliding maxima, online clustering, upserts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.identity import _Clusters
from tidemark.operators.store import Store, upsert
from tidemark.operators.tracking import IOU, _Correspondence
from tidemark.session import scratch_path, setting
from tidemark.sources.records import FRAMES, video_of


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Frame lines as they arrive in a folder: video_id, frame_idx, t, detections."""
    raw = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.select(video_of(r"_m1\.jsonl"), "frame_idx", "t", "detections")


def keyed_state(spark: SparkSession):
    """While the block runs, streams start with a state store that can hold maps and timers by key."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def joined_state(spark: SparkSession):
    """:func:`keyed_state` for joins of streams: the store doesn't look up each key to count its rows, and commits write what
    changed instead of whole files."""
    store = "spark.sql.streaming.stateStore.rocksdb"
    with keyed_state(spark), setting(spark, f"{store}.trackTotalNumberOfRows", "false"), setting(spark, f"{store}.changelogCheckpointing.enabled", "true"):
        yield


def collected(stream: DataFrame, label: str, state=keyed_state) -> DataFrame:
    """What a stream of append mode gives for the files that are there now, as a table in the shared folder. ``state`` is what
    the stream starts in."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    with state(spark):
        run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key's events, closed once the watermark has passed: start, end (of the last event), n. Events that
    come more than ``late`` behind are dropped."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).select(key, "start", "end", "n")


def stream_sliding_max(events: DataFrame, key: str, ts: str, value: str, late: str, length: str = "10 seconds", hop: str = "5 seconds") -> DataFrame:
    """Largest value of each sliding window of a key."""
    w = F.window(ts, length, hop)
    return events.withWatermark(ts, late).groupBy(key, w).agg(F.max(value).alias("peak")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "peak")


class _Relink(StatefulProcessor):
    """A video's clusters, one map entry each: mean, size and frames."""

    def __init__(self, tau: float):
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("clusters", "cluster long", "mean array<double>, size long, frames array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clusters = _Clusters(self.tau)
        for _, (mean, size, frames) in sorted(((k[0], v) for k, v in self.held.iterator()), key=lambda x: x[0]):
            clusters.mean.append(np.array(mean, float))
            clusters.size.append(size)
            clusters.frames.append(set(frames))
        out, changed = [], set()
        for r in sorted((r for pdf in rows for r in pdf.itertuples()), key=lambda r: r.track_id):
            i, sim, auto = clusters.add(np.array(r.v, float), set() if r.frames is None else set(r.frames))
            out.append((*key, r.track_id, i, sim, auto))
            changed.add(i)
        for i in changed:
            self.held.updateValue((i,), (clusters.mean[i].tolist(), clusters.size[i], sorted(map(int, clusters.frames[i]))))
        yield pd.DataFrame(out, columns=["video_id", "track_id", "cluster", "sim", "auto"])


def stream_relink(tracks: DataFrame, tau: float) -> DataFrame:
    """Online clustering of tracks (video_id, track_id, v, frames) as they come, each video's clusters kept as a map.

    Tracks of one batch are taken by track_id; a track that comes in a later batch is taken after all before
    it, whatever its number. Only clusters that a batch changes are written. Start it inside :func:`keyed_state`.
    """
    kind = tracks.schema["video_id"].dataType.simpleString()
    return tracks.groupBy("video_id").transformWithStateInPandas(_Relink(tau), f"video_id {kind}, track_id long, cluster long, sim double, auto boolean", "Append", "None")


class _ClearMot(StatefulProcessor):
    """A video's open frames, and for each ground-truth track the prediction it last had and whether it was matched when it
    was last there."""

    def __init__(self, thr: float, idle: int | None):
        self.thr, self.idle = thr, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame long", "ms long, side array<int>, ord array<bigint>, track array<bigint>, box array<double>")
        self.last = handle.getMapState("last", "track long", "pred long")
        self.seen = handle.getMapState("seen", "track long", "matched boolean")
        self.at = handle.getValueState("at", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for frame, part in pdf.groupby("frame_idx"):
                ms = int(part["ts"].iloc[0].timestamp() * 1000)
                own = [ms, part["side"].tolist(), part["ord"].tolist(), part["track_id"].tolist(), part[list("xywh")].to_numpy().ravel().tolist()]
                if self.frames.containsKey((frame,)):
                    before = self.frames.getValue((frame,))
                    own = [ms, *(list(a) + b for a, b in zip(before[1:], own[1:], strict=True))]
                self.frames.updateValue((frame,), tuple(own))
                first = ms if first is None else min(first, ms)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def _forget(self) -> None:
        self.last.clear()
        self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted(((k[0], v) for k, v in self.frames.iterator()), key=lambda x: x[0])
        ready = [x for x in every if x[1][0] <= now]
        state = _Correspondence(self.thr)
        state.last = {k[0]: v[0] for k, v in self.last.iterator()}
        state.seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        at = self.at.get()[0] if self.at.exists() else None
        out = []
        for frame, (ms, side, order, track, box) in ready:
            if self.idle is not None and at is not None and ms - at > self.idle:
                self._forget()
                state.last, state.seen = {}, {}
            at = ms
            boxes = sorted(zip(side, order, track, np.reshape(box, (-1, 4)).tolist(), strict=True))
            labelled = any(x[0] == 0 for x in boxes)
            if labelled:
                pick = lambda s: ([x[2] for x in boxes if x[0] == s], np.array([x[3] for x in boxes if x[0] == s]).reshape(-1, 4))  # noqa: E731, B023
                was = state.fp, state.fn, state.switches, state.breaks
                state.frame(*pick(1), *pick(2))
                out.append((*key, frame, *(a - b for a, b in zip((state.fp, state.fn, state.switches, state.breaks), was, strict=True))))
            self.frames.removeKey((frame,))
        if ready:
            self.at.update((at,))
        elif self.idle is not None and at is not None and not every and now >= at + self.idle:
            self._forget()
        for track, pred in state.last.items() if ready else ():
            self.last.updateValue((track,), (pred,))
        for track, matched in state.seen.items() if ready else ():
            self.seen.updateValue((track,), (matched,))
        later = [x[1][0] for x in every[len(ready) :]]
        if later:
            self.handle.registerTimer(min(later))
        elif ready and self.idle is not None:
            self.handle.registerTimer(at + self.idle)
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "fp", "fn", "idsw", "fragmentation"])


def stream_clear_mot(boxes: DataFrame, late: str, thr: float = IOU, idle: int | None = None) -> DataFrame:
    """What each labelled frame adds to a video's fp, fn, idsw and fragmentation, once the watermark has passed it.

    ``boxes`` is a stream of the rows of :func:`tidemark.operators.tracking.written` (side 0 marks a labelled frame, 1 is
    ground truth, 2 a prediction) with ``ts``, the frame's time, which rises with its number. Frames wait in the state until
    the watermark passes them, so rows may come in any order within ``late``; later ones are dropped. Sums over a video are
    those of :func:`tidemark.operators.tracking.clear_mot`. A video's tracks are forgotten before a frame that comes more than
    ``idle`` milliseconds after the last, and when the watermark is that far; without ``idle`` they never are. Start it inside :func:`keyed_state`.
    """
    kind = boxes.schema["video_id"].dataType.simpleString()
    return boxes.withWatermark("ts", late).groupBy("video_id").transformWithStateInPandas(_ClearMot(thr, idle), f"video_id {kind}, frame_idx long, fp long, fn long, idsw long, fragmentation long", "Append", "EventTime")


def stream_overlaps(a: DataFrame, b: DataFrame, keys: list[str], bucket: str, late: str) -> DataFrame:
    """The spans in which intervals of two streams (keys, start, end as timestamps, label) overlap: keys, a_label, b_label,
    start, end.

    Both sides are cut at the bounds of buckets of equal length, and pieces meet by key and bucket, whose start is the event
    time: a bucket's pieces leave the state when both watermarks have passed it by ``late``, and no interval meets one of
    another bucket. Pieces touching a bucket's bound add up to the whole; intervals that come later than ``late`` are dropped.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        size = F.expr(f"cast(interval '{bucket}' as interval day to second)")
        whole = F.window("start", bucket)["start"]
        piece = df.where(F.col("end") > F.col("start")).withColumn("_first", whole)
        piece = piece.withColumn("bucket", F.explode(F.sequence("_first", F.col("end") - F.expr("interval 1 microsecond"), size)))
        own = [F.greatest("start", "bucket").alias(f"{name}_start"), F.least(F.col("end"), F.col("bucket") + size).alias(f"{name}_end")]
        return piece.select(*keys, "bucket", F.col("label").alias(f"{name}_label"), *own).withWatermark("bucket", late)

    both = cut(a, "a").join(cut(b, "b"), [*keys, "bucket"])
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.where(start < end).select(*keys, "a_label", "b_label", start.alias("start"), end.alias("end"))


def upsert_sink(store: Store, table: str, keys: list[str]):
    """A ``foreachBatch`` function that upserts each batch; a repeated batch changes nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        store.write(table, upsert(store.read(table), batch.select(store.read(table).columns), keys))

    return write
