"""Command line, ingest, matching videos to references, and placing texts."""

import json


from tidemark import cli
from tidemark.operators import identity as I
from tidemark.operators import ingest as N
from tidemark.operators import layout as L
from tidemark.operators.store import Store

SEGMENT = "video_id string, ord long, start double, end double, group string, action string, conf double, uncertain boolean"


def test_command_line_from_files_to_answers(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("tidemark.session.get_spark", lambda app: spark)
    for side, dx in (("gt", 0), ("pred", 1)):
        (tmp_path / side).mkdir()
        lines = [{"frame_idx": i, "t": i / 30, "detections": [{"track_id": 1, "bbox": [dx, 0, 10, 10]}]} for i in range(3)]
        if side == "pred":
            lines.insert(0, {"frame_idx": 0, "t": 0, "detections": [{"track_id": 9, "bbox": [500, 0, 10, 10]}]})
        (tmp_path / side / "v_m1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "t.yaml").write_text("m1:\n  miss_rate: {max: 0.3}\n")
    args = ["eval", "--stage", "m1", "--gt", str(tmp_path / "gt"), "--pred", str(tmp_path / "pred"), "--thresholds", str(tmp_path / "t.yaml")]
    assert cli.main([*args, "--json"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["overall"] == "PASS" and {c["metric"]: c["value"] for c in said["checks"]}["fp"] == 0
    cli.main(args)
    assert "overall: PASS" in capsys.readouterr().out
    cli.main(["eval", "--stage", "m1", *args[3:7], "--iou-thr", "0.99"])
    assert "overall: unset" in capsys.readouterr().out
    cli.main(["report", "--gt-dir", str(tmp_path / "gt"), "--pred-dir", str(tmp_path / "pred")])
    assert [x.split()[0] for x in capsys.readouterr().out.splitlines()[1:3]] == ["v", "TOTAL"]

    store = str(tmp_path / "store")
    cli.main(["init", "--store", store])
    (tmp_path / "card.json").write_text(json.dumps({"name": "Bori", "status": "open", "fields": [{"field": "age", "value": "3", "vis": "public"}, {"field": "note", "value": "x", "vis": "staff"}]}))
    cli.main(["card", "--store", store, "d1", "--file", str(tmp_path / "card.json")])
    job = tmp_path / "jobs" / "j1"
    (job / "preds").mkdir(parents=True)
    (job / "meta.json").write_text(json.dumps({"foster_uncertain": [], "scene_profile": {"a": {"behavior": "runs about", "caption": "a park", "dark": False}, "b": {"behavior": "", "caption": "a room"}}, "scene_tags": {"a": ["walk", "park"]}}))
    (job / "preds" / "a_m4.json").write_text(json.dumps({"segments": [{"start_t": 2.0, "end_t": 5.0, "group": "dynamic", "action": "달리기", "conf": 0.9}]}))
    capsys.readouterr()
    cli.main(["ingest", "--store", store, "j1", "--dog", "d1", "--root", str(tmp_path)])
    assert capsys.readouterr().out.split(", ")[:2] == ["videos 2", "l2 3"]
    cli.main(["search", "--store", store, "d1", "runs about", "--card", "-k", "1"])
    out = capsys.readouterr().out
    assert "Bori (open)" in out and "age: 3" in out and "note" not in out and "@a" in out and "runs about" in out


def test_traits_are_made_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    videos = spark.createDataFrame([("a", "runs", "park", None, None, None, False), ("b", None, None, None, None, None, None)], "video_id string, behavior string, caption string, audio array<struct<label:string,p:double>>, indoor boolean, categories array<struct<category:string,p:double>>, dark boolean")
    segments = spark.createDataFrame([("a", 0, 0.0, 30.0, "dynamic", "달리기", 0.9, False), ("c", 0, 0.0, 30.0, "static", "앉기", 0.8, True)], SEGMENT)
    tags = spark.createDataFrame([("a", ["x"])], "video_id string, tags array<string>")
    meta = spark.createDataFrame([([],)], "foster_uncertain array<string>")
    seen = []

    def traits(lines):
        seen.extend(r.line for r in lines.collect())
        return spark.createDataFrame([("활동성", "moves a lot"), ("없는것", "no trait"), ("사교성", " ")], "trait string, text string")

    n = N.ingest_job(store, "d", "j", meta, videos, segments, tags, traits=traits)
    assert n == {"videos": 3, "l2": 2, "l1": 1} and len(seen) == 3 and any("움직임 30초/정지 0초" in x and "확정 장면: x" in x for x in seen)
    l1 = store.read("chunks").where("layer = 'L1'").collect()
    assert [(r.trait, r.text, r.conf) for r in l1] == [("활동성", "moves a lot", 1.0)]
    assert N.reaggregate(store, "d", lambda lines: spark.createDataFrame([], "trait string, text string")) == 0
    assert store.read("chunks").where("layer = 'L2'").count() == 2


def test_match_videos(spark):
    boxes = [("v", f, t, "dog") for t, frames in ((1, range(10)), (2, range(10, 20)), (3, range(5, 15))) for f in frames] + [("v", 3, 4, "cat")]
    b = spark.createDataFrame(boxes, "video_id string, frame_idx long, track_id long, cls string")
    samples = spark.createDataFrame([("v", 1, [1.0, 0.0]), ("v", 1, [0.9, 0.1]), ("v", 2, [0.95, 0.05]), ("v", 3, [0.5, 0.5]), ("v", 5, [1.0, 0.0])], "video_id string, track_id long, v array<double>")
    ids = spark.createDataFrame([("v", t) for t in (1, 2, 3)], "video_id string, track_id long")
    refs = spark.createDataFrame([([0.0, 1.0],), ([1.0, 0.0],)], "v array<double>")
    (r,) = I.match_videos(b, ids, refs, samples).collect()
    assert r.track in (1, 2) and sorted(r.tracks) == [1, 2] and 0.2 < r.margin < 0.4
    assert b.limit(0).join(ids, ["video_id", "track_id"]).count() == 0


def test_texts_are_placed_beside_in_a_region_or_nowhere(spark):
    text = "plan_id long, text_idx int, text string, w0 double, w1 double, span array<double>, peak double, pos string"
    rows = [(1, 0, "wow", 0.0, 10.0, None, None, None), (2, 0, "wow", 0.0, 10.0, None, None, "top-left"), (3, 0, "wow", 0.0, 10.0, None, None, None), (4, 0, "wow", 0.0, 10.0, None, None, None), (5, 0, "wow", 0.0, 0.5, None, None, None)]
    rect = lambda *c: dict(zip(("x1", "y1", "x2", "y2"), map(float, c)))
    r = "r struct<x1:double,y1:double,x2:double,y2:double>"
    boxes = spark.createDataFrame([(1, 0, rect(0, 100, 200, 400)), (3, 0, rect(100, 50, 1180, 700))], f"plan_id long, text_idx int, {r}")
    placed = spark.createDataFrame([(4, "bottom", rect(0, 0, 1280, 720), 0.0, 10.0), (2, "top", rect(500, 0, 700, 60), 20.0, 30.0)], f"plan_id long, pos string, {r}, start double, end double")
    got = {x.plan_id: x for x in L.place_texts(spark.createDataFrame(rows, text), placed, boxes, 1280, 720).collect()}
    assert got[1].pos is None and got[1].r.x1 > 200 and got[2].pos == "top-left" and got[3].pos in L.SHOUT_ORDER and 4 not in got and 5 not in got
    two = spark.createDataFrame([(1, i, "wow", 0.0, 3.0, None, None, None) for i in range(2)], text)
    a, b = L.place_texts(two, placed.limit(0), boxes.limit(0), 1280, 720).orderBy("text_idx").collect()
    assert a.pos != b.pos and (a.r.x2 <= b.r.x1 or b.r.x2 <= a.r.x1 or a.r.y2 <= b.r.y1 or b.r.y2 <= a.r.y1)


def test_samples_of_sound(spark, tmp_path):
    import wave

    from tidemark.sources.records import read_wavs

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"\x00\x00\x00\x40\x00\x80")
    (r,) = read_wavs(spark, str(tmp_path / "a.wav"), with_samples=True).collect()
    assert (r.sample_rate, r.samples, r.pcm) == (8000, 3, [0.0, 0.5, -1.0])
    assert read_wavs(spark, str(tmp_path / "a.wav")).columns == ["path", "sample_rate", "samples"]
