"""Streams with state over several batches, rows out of order and late ones."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import identity, tracking
from tidemark.streaming import live

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """``feed(make, schema, batches)``: the rows that ``make(stream)`` gives when the batches arrive one after another."""
    made = []

    def run(make, schema, *sides):
        made.append(0)
        at = tmp_path / f"s{len(made)}"
        streams = [spark.readStream.schema(schema).parquet(str(at / f"in{i}")) for i in range(len(sides)) if (at / f"in{i}").mkdir(parents=True) is None]
        df = make(*streams)
        for batch in zip(*sides, strict=True):
            for i, rows in enumerate(batch):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at / f"in{i}"))
            # each start goes on from the checkpoint of the one before
            with live.keyed_state(spark):
                q = df.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.schema(df.schema).parquet(str(at / "out"))

    return run


BOXES = "video_id long, side int, frame_idx long, ord long, track_id long, x double, y double, w double, h double, ts timestamp"


def world(frames, seed=5):
    """Rows of one video: crowded boxes, some missed, with changing track numbers."""
    rng = random.Random(seed)
    out = []
    for f in range(frames):
        ts = T0 + dt.timedelta(seconds=f)
        out.append((1, 0, f, 0, 0, 0.0, 0.0, 0.0, 0.0, ts))
        for t in range(4):
            x, y = 12.0 * t + rng.randrange(8), float(rng.randrange(6))
            if rng.random() < 0.9:
                out.append((1, 1, f, t, t, x, y, 30.0, 30.0, ts))
            if rng.random() < 0.8:
                out.append((1, 2, f, t, 100 + t + 10 * rng.randrange(2), x + rng.randrange(9), y, 30.0, 30.0, ts))
    return out


def batch_scores(spark, rows):
    df = spark.createDataFrame(rows, BOXES)
    side = lambda s: df.where(df.side == s).drop("side", "ts")
    return tuple(tracking.clear_mot(side(1), side(2), side(0).select("video_id", "frame_idx")).first())


def end(seconds):
    return (9, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, T0 + dt.timedelta(seconds=seconds))


def test_clear_mot_over_batches(spark, feed):
    rows = world(40)
    rng = random.Random(1)
    # boxes of a frame come up to four seconds apart, over three batches
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 4)
    third = len(order) // 3
    batches = [order[:third], order[third : 2 * third], order[2 * third :], [end(10_000)]]
    got = feed(lambda s: live.stream_clear_mot(s, "5 seconds"), BOXES, batches)
    total = got.where("video_id = 1").groupBy("video_id").sum("fp", "fn", "idsw", "fragmentation").first()
    assert tuple(total) == batch_scores(spark, rows) and got.where("video_id = 1").count() == 40


def test_late_frames_are_dropped(spark, feed):
    rows = world(20)
    late = [r for r in rows if r[2] == 3]
    batches = [[r for r in rows if r[2] != 3], [end(5_000)], late, [end(9_000)]]
    got = feed(lambda s: live.stream_clear_mot(s, "2 seconds"), BOXES, batches)
    assert got.where("frame_idx = 3 and video_id = 1").count() == 0
    total = got.where("video_id = 1").groupBy("video_id").sum("fp", "fn", "idsw", "fragmentation").first()
    assert tuple(total) == batch_scores(spark, [r for r in rows if r[2] != 3])


def test_idle_videos_are_forgotten(spark, feed):
    """The same track with another prediction after a long pause: a switch only where the track is remembered."""
    def seen(f, s, p):
        ts = T0 + dt.timedelta(seconds=s)
        return [(1, 0, f, 0, 0, 0.0, 0.0, 0.0, 0.0, ts), (1, 1, f, 1, 1, 0.0, 0.0, 10.0, 10.0, ts), (1, 2, f, 1, p, 0.0, 0.0, 10.0, 10.0, ts)]

    batches = [seen(0, 0, 7), [end(500)], seen(1, 1000, 8), [end(5_000)]]
    switches = lambda idle: feed(lambda s: live.stream_clear_mot(s, "1 second", idle=idle), BOXES, batches).where("video_id = 1").groupBy().sum("idsw").first()[0]
    assert switches(None) == 1 and switches(60_000) == 0


def test_relink_over_batches(spark, feed):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(24, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"v{i % 2}", i, v[i % 5].tolist() if i % 3 else v[i].tolist(), [i, i + 1] if i % 4 else None) for i in range(24)]
    schema = "video_id string, track_id long, v array<double>, frames array<long>"
    got = feed(lambda s: live.stream_relink(s, 0.6), schema, [rows[:9], rows[9:10], rows[10:]])
    want = identity.relink(spark.createDataFrame(rows, schema), [0.6])
    assert {(r.video_id, r.track_id): (r.cluster, round(r.sim, 3), r.auto) for r in got.collect()} == {(r.video_id, r.track_id): (r.cluster, r.sim, r.auto) for r in want.collect()}


def test_overlaps_of_two_streams(spark, feed):
    rng = random.Random(7)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    side = lambda n: [(rng.choice("pq"), at(s := rng.randrange(900)), at(s + rng.choice((0, 3, 40, 400))), rng.choice("xy")) for _ in range(n)]
    a, b = side(40), side(50)
    schema = "k string, start timestamp, end timestamp, label string"
    got = feed(lambda x, y: live.stream_overlaps(x, y, ["k"], "60 seconds", "1 hour"), schema, [a[:10], a[10:]], [b[:30], b[30:]])
    total = {}
    for r in got.collect():
        total[r.k, r.a_label, r.b_label] = total.get((r.k, r.a_label, r.b_label), 0) + (r.end - r.start).total_seconds()
    want = {}
    for k, s, e, la in a:
        for j, t, u, lb in b:
            if k == j and (n := (min(e, u) - max(s, t)).total_seconds()) > 0:
                want[k, la, lb] = want.get((k, la, lb), 0) + n
    assert total == want
