import json
import struct
import wave

import pytest

from tidemark import cli
from tidemark.operators import tracking as T
from tidemark.sources import records as R
from tidemark.sources import workspace as W

XML = """<annotations><meta><task><original_size><width>1920</width><height>1080</height></original_size></task></meta>
<track id="0" label="dog"><box frame="0" keyframe="1" outside="0" xtl="10" ytl="20" xbr="110" ybr="70"/><box frame="1" keyframe="0" outside="0" xtl="1" ytl="1" xbr="2" ybr="2"/><box frame="5" keyframe="1" outside="1" xtl="1" ytl="1" xbr="2" ybr="2"/></track>
<track id="1" label="cat"><box frame="9" keyframe="1" outside="0" xtl="1" ytl="1" xbr="2" ybr="2"/></track></annotations>"""


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")


def frame(i, *boxes, **more):
    return {"frame_idx": i, "t": i / 30, "detections": [{"track_id": t, "bbox": b, **more} for t, b in boxes]}


def test_frames_round_trip(spark, tmp_path):
    lines(tmp_path / "vid_m1.jsonl", [frame(0, (1, [0, 0, 10, 10])), frame(1), frame(2, (1, [1, 1, 5, 5]), (2, [2, 2, 3, 3]), conf=0.5, cls="cat")])
    f = R.read_frames(spark, str(tmp_path))
    b = R.explode_frames(f)
    assert f.count() == 3 and [(r.video_id, r.frame_idx, r.ord, r.track_id, r.w, r.conf, r.cls) for r in b.orderBy("frame_idx", "ord").collect()] == [("vid", 0, 0, 1, 10.0, 1.0, "dog"), ("vid", 2, 0, 1, 5.0, 0.5, "cat"), ("vid", 2, 1, 2, 3.0, 0.5, "cat")]
    again = R.collect_frames(b, f).orderBy("frame_idx").collect()
    assert [len(r.detections) for r in again] == [1, 0, 2] and again[2].detections[1].bbox == [2.0, 2.0, 3.0, 3.0]
    R.write_json(R.collect_frames(b, f), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    lines(tmp_path / "bad_m1.jsonl", [{"t": 1.0}])
    with pytest.raises(Exception, match="frame_idx"):
        R.read_frames(spark, str(tmp_path / "bad_m1.jsonl")).collect()


def test_documents(spark, tmp_path):
    (tmp_path / "v_m4.json").write_text(json.dumps({"segments": [{"start_t": 0, "end_t": 2, "group": "dynamic"}, {"start_t": 2, "end_t": 3, "group": "static", "action": "앉기", "conf": 0.4, "uncertain": True}]}, indent=1))
    assert [tuple(r) for r in R.read_actions(spark, str(tmp_path)).orderBy("ord").collect()] == [("v", 0, 0.0, 2.0, "dynamic", None, 1.0, False), ("v", 1, 2.0, 3.0, "static", "앉기", 0.4, True)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "v_m2.json").write_text(json.dumps({"mapping": {"1": 0, "2": 0, "3": -1}, "interventions": [{"track_id": 1, "t": 0.0, "reason": "new_anchor"}], "relink_evidence": {"2": {"sim": 0.9, "anchor": 0, "auto": True}}}))
    m, i, e = R.read_reid(spark, str(tmp_path / "x"))
    assert sorted((r.track_id, r.cluster) for r in m.collect()) == [(1, 0), (2, 0)] and i.count() == 1 and e.first().auto
    (tmp_path / "t.yaml").write_text("m1:\n  miss_rate: {max: 0.3}\n  mota: {min: null}\n")
    assert {r.metric: (r.min, r.max) for r in R.read_thresholds(spark, str(tmp_path / "t.yaml")).collect()} == {"miss_rate": (None, 0.3), "mota": (None, None)}


def test_annotations(spark, tmp_path):
    (tmp_path / "v.xml").write_text(XML)
    f, b = R.read_annotations(spark, str(tmp_path / "v.xml"))
    assert sorted(r.frame_idx for r in f.collect()) == [0, 5, 9] and [(r.video_id, r.frame_idx, r.x, r.w, r.h) for r in b.collect()] == [("v", 0, 10.0, 100.0, 50.0)]
    _, b = R.read_annotations(spark, str(tmp_path / "v.xml"), target=(768, 432))
    r = b.first()
    assert (r.x, r.y, r.w, r.h) == pytest.approx((4.0, 8.0, 40.0, 20.0))
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "v.xml").write_text(XML.replace("original_size", "other_size"))
    with pytest.raises(Exception, match="size"):
        R.read_annotations(spark, str(tmp_path / "n" / "v.xml"), target=(768, 432))[1].collect()


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for n in ("b.MOV", "a.mp4", "a.mov", "note.txt"):
        (d / n).write_bytes(b"x")
    files = R.read_videos(spark, [str(d)], ("mov", "mp4"))
    assert sorted((r.stem, r.ext_rank) for r in files.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.stem, r.ext_rank) for r in R.one_per_stem(files).collect()) == [("a", 1), ("b", 1)]
    with pytest.raises(FileNotFoundError):
        R.read_videos(spark, [str(d)], ("avi",))
    with wave.open(str(tmp_path / "s.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(struct.pack("<400h", *range(400)))
    r = R.read_wavs(spark, str(tmp_path / "s.wav")).first()
    assert (r.sample_rate, r.samples) == (8000, 400)


def test_cascade_and_states(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    per = spark.createDataFrame([("a", [1, 2])], "video_id string, tracks array<long>")
    gt = spark.createDataFrame([("a", 9), ("b", 8)], "video_id string, track_id long")
    assert {r.video_id: r.tracks for r in R.cascade_track(v, per, None, gt).collect()} == {"a": [1, 2], "b": [8], "c": None}
    assert {r.video_id: r.tracks for r in R.cascade_track(v, per, 5, gt).collect()} == {"a": [1, 2], "b": [5], "c": [5]}
    assert {r.fps for r in R.with_fps(v, spark.createDataFrame([("a", 60.0)], "video_id string, fps double")).collect()} == {60.0, 30.0}
    jobs = spark.createDataFrame([("x", "uploaded"), ("y", "done"), ("z", "prepared")], "job_id string, state string")
    moves = spark.createDataFrame([("x", "validated"), ("y", "uploaded")], "job_id string, to string")
    assert {r.job_id: (r.state, r.moved) for r in W.advance(jobs, moves).collect()} == {"x": ("validated", True), "y": ("done", False), "z": ("prepared", False)}
    assert W.Workspace("/r/", "j").preds("m1", "v") == "/r/jobs/j/preds/v_m1.jsonl" and W.Workspace("/r").input_dir == "/r/videos"


def test_evaluate_and_cli(spark, tmp_path, capsys):
    for side, x in (("gt", 0), ("pred", 1)):
        (tmp_path / side).mkdir()
        lines(tmp_path / side / "v_m1.jsonl", [frame(i, (1, [x, 0, 10, 10])) for i in range(3)])
    lines(tmp_path / "gt" / "only_m1.jsonl", [frame(0, (1, [0, 0, 1, 1]))])
    m = cli.evaluate(spark, "m1", str(tmp_path / "gt"), str(tmp_path / "pred"))
    assert [(r.video_id, r.mota, r.idf1) for r in m.collect()] == [("v", 1.0, 1.0)]
    (tmp_path / "t.yaml").write_text("m1:\n  miss_rate: {max: 0.3}\n")
    rows = cli.judge(m, "m1", R.read_thresholds(spark, str(tmp_path / "t.yaml"))).collect()
    assert {r.metric: r.status for r in rows}["miss_rate"] == "PASS" and "miss_rate" in cli.render(rows)
    with pytest.raises(ValueError):
        cli.evaluate(spark, "m9", "", "")
    assert T.tracking_report(m).count() == 2


def test_streaming(spark, tmp_path):
    import datetime as dt

    from tidemark.operators.store import Store
    from tidemark.streaming import live

    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", t0 + dt.timedelta(seconds=s), float(s)) for s in (0, 2, 4, 30, 32, 300)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "ev"))
    src = lambda: spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "ev"))

    def drain(df, name, mode="append"):
        with live.keyed_state(spark):
            q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = drain(live.stream_sessions(src(), "k", "ts", "10 seconds", "1 second"), "sess")
    assert sorted((r.start.second, r.n) for r in got) == [(0, 3), (30, 2)]
    assert max(r.peak for r in drain(live.stream_sliding_max(src(), "k", "ts", "v", "1 second"), "slide")) == 32.0
    tr = [("v", 1, [1.0, 0.0], [0]), ("v", 2, [1.0, 0.0], [5]), ("v", 3, [0.0, 1.0], [9])]
    spark.createDataFrame(tr, "video_id string, track_id long, v array<double>, frames array<long>").coalesce(1).write.parquet(str(tmp_path / "tr"))
    st = spark.readStream.schema("video_id string, track_id long, v array<double>, frames array<long>").parquet(str(tmp_path / "tr"))
    assert {r.track_id: r.cluster for r in drain(live.stream_relink(st, 0.8), "rel")} == {1: 0, 2: 0, 3: 1}
    store = Store(spark, str(tmp_path / "store"))
    store.init()
    dogs = spark.createDataFrame([("d", "n", "s", t0)], "dog_id string, name string, status string, created_at timestamp")
    sink = live.upsert_sink(store, "dogs", ["dog_id"])
    sink(dogs, 0)
    sink(dogs, 0)
    assert store.read("dogs").count() == 1


def test_jobs(spark, tmp_path):
    from tidemark.sources import jobs

    (tmp_path / "a.mp4").write_bytes(b"x")
    ws = W.Workspace(str(tmp_path), "j1")
    assert jobs.init_job(spark, ws, [str(tmp_path / "a.mp4")], request="만들어줘")["state"] == "uploaded"
    assert (tmp_path / "jobs/j1/input/a.mp4").read_bytes() == b"x"
    assert jobs.write_meta(spark, ws, state="validated") == {"state": "validated", "request": "만들어줘"}
    with pytest.raises(FileNotFoundError):
        jobs.init_job(spark, ws, [str(tmp_path / "none.mp4")])
