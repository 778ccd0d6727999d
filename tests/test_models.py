"""Questions to models and what is made of the answers, with stand-ins."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import external as E
from tidemark.functions import geometry as G
from tidemark.functions import models as M
from tidemark.functions import text as X


def answering(f):
    return lambda: lambda questions: [f(**json.loads(q)) for q in questions]


def test_detections_and_crops(spark):
    frames = spark.createDataFrame([("v", 0, 0.0), ("v", 5, 0.2), ("w", 0, 0.0)], "video_id string, frame_idx long, t double")
    seen = answering(lambda video_id, frame_idx: [{"track_id": 3, "x": 1.0 * frame_idx, "y": 0.0, "w": 10.0, "h": 20.0, "conf": 0.5, "cls": c} for c in (["dog", "cat"] if video_id == "v" else [])])
    got = M.detect(frames, seen).collect()
    assert [(r.video_id, r.frame_idx, r.ord, r.track_id) for r in sorted(got, key=lambda r: r.frame_idx)] == [("v", 0, 0, 3), ("v", 5, 0, 3)]
    assert sorted((r.track_id, r.x, r.w) for r in M.detect_on(frames, seen, 2.0).collect()) == [(-1, 0.0, 20.0), (-1, 10.0, 20.0)]
    boxes = spark.createDataFrame([("v", 1, i, 0.0, 0.0, 40.0, 40.0) for i in range(30)] + [("v", 2, 0, 0.0, 0.0, 2.0, 2.0)], "video_id string, track_id long, frame_idx long, x double, y double, w double, h double")
    got = M.embed_crops(boxes, 100, 100, answering(lambda video_id, frame_idx, crop: [float(crop["x2"]), 0.0]), dim=2).collect()
    assert [(r.track_id, r.crops, round(r.v[0], 6)) for r in got] == [(1, M.CROPS, 1.0)]
    with pytest.raises(Exception, match="length 3"):
        M.embed_crops(boxes, 100, 100, answering(lambda **q: [1.0, 0.0]), dim=3).collect()


def test_curves_hints_and_judges(spark):
    b = spark.createDataFrame([("v", i, 0.0, 0.0, 1.0, 1.0) for i in range(3)], "video_id string, frame_idx long, x double, y double, w double, h double")
    assert sorted((r.frame_idx, r.motion) for r in M.motion_curve(b, answering(lambda frame_idx, **q: None if frame_idx == 1 else float(frame_idx))).collect()) == [(0, 0.0), (2, 2.0)]
    hints = spark.createDataFrame([(7.96,), (8.0,)], "m double").select(M.motion_hint(F.col("m"))).collect()
    assert [r[0] for r in hints] == ["이 구간 움직임 세기(M3)=8.0 (약함, 기준 8)", "이 구간 움직임 세기(M3)=8.0 (강함, 기준 8)"]
    crops = spark.createDataFrame([("v", 0, 1, "h")], "video_id string, ord long, frame_idx long, hint string")
    judge = lambda: lambda qs: [[{"class": c, "logprob": p} for c, p in x] for x in E.stub_judge(("dynamic", "static"))(qs)]
    assert sorted(r["class"] for r in M.judge_crops(crops, judge).collect()) == ["dynamic", "static"]


def test_descriptions_and_profiles(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    say = answering(lambda video_id: {"a": '{"text": " runs "}', "b": "not json", "c": None}[video_id])
    assert {r.video_id: r.caption for r in M.described(v, "caption", say).collect()} == {"a": "runs", "b": "", "c": ""}
    cache = spark.createDataFrame([("a", "kept", None), ("x", "other", 1.0)], "video_id string, caption string, luma double")
    asked = []

    def measure(name, value):
        def f(videos):
            asked.append((name, sorted(r.video_id for r in videos.collect())))
            return videos.withColumn(name, F.lit(value))

        return f

    got = {r.video_id: (r.caption, r.luma) for r in M.fill_profiles(cache, v, {"caption": measure("caption", "new"), "luma": measure("luma", 2.0)}).collect()}
    assert got == {"a": ("kept", 2.0), "b": ("new", 2.0), "c": ("new", 2.0)} and asked == [("caption", ["b", "c"]), ("luma", ["a", "b", "c"])]


def test_keywords_and_scenes(spark):
    records = spark.createDataFrame([("o", "a", "park run"), ("o", "b", "park still"), ("p", "c", "park")], "owner string, video_id string, line string")
    words = spark.createDataFrame([("o", "park"), ("o", "park"), ("o", " "), ("o", "sea"), ("p", "park")], "owner string, keyword string")
    pick = answering(lambda keyword, records: [r["video_id"] for r in records if keyword in r["line"]] + ["zz"])
    prune = answering(lambda keyword, records: [r["video_id"] for r in records if "still" in r["line"]] + ["a2"])
    found = M.match_keywords(records, words, pick, prune)
    assert sorted(map(tuple, found.collect())) == [("o", "park", "a"), ("p", "park", "c")]
    asked = spark.createDataFrame([("p", "park")], "owner string, keyword string")
    human = spark.createDataFrame([("b",)], "video_id string")
    videos = records.select("owner", "video_id")
    looked = []

    def look(v, k):
        looked.extend(sorted(map(tuple, k.collect())))
        return k.join(v, "owner").select("owner", "keyword", "video_id")

    tags, done = M.infer_scenes(words.where("keyword <> ' '"), asked, videos, human, lambda v, k: found.join(k, ["owner", "keyword"], "left_semi"), lambda f: f.where("false"), look)
    assert sorted(map(tuple, tags.collect())) == [("o", "a", "park"), ("o", "a", "sea")] and set(looked) == {("o", "sea")}
    assert sorted(map(tuple, done.collect())) == [("o", "park"), ("o", "sea"), ("p", "park")]


def test_translations_and_plans(spark):
    table = spark.createDataFrame([("cafe", "카페")], "label string, name string")
    labels = spark.createDataFrame([("cafe",), ("dog",), ("blank",)], "label string")
    got = M.translate_labels(labels, table, lambda: E.stub_lookup({"dog": " 개 ", "cafe": "changed"}))
    assert dict(map(tuple, got.collect())) == {"cafe": "카페", "dog": "개"}
    r = spark.createDataFrame([("a film",), ("broken",)], "request string")
    got = M.plan_from_text(r, "title string", lambda: lambda xs: ['{"title": "T"}' if x == "a film" else "nope" for x in xs]).collect()
    assert {x.request: x.plan and x.plan.title for x in got} == {"a film": "T", "broken": None}


def test_speech_is_tried_again_then_flagged(spark):
    rows = [(1, "하나 둘", "하나 둘", "v", ""), (2, "세 마리", "세 마리", "v", ""), (3, "넷 다섯", "넷 다섯", "v", ""), (4, "kept", "kept", "v", "")]
    p = spark.createDataFrame(rows, "phrase_id long, raw string, read string, voice string, instruct string")
    key = p.where("phrase_id = 4").select(X.cache_key(F.col("read"), F.col("voice"), F.col("instruct"))).first()[0]
    cache = spark.createDataFrame([(key, b"old")], "key string, audio binary")

    def speak(read, voice, instruct, attempt):
        good = read == "하나 둘" or (read == "세 마리" and attempt == 2)
        return {"audio": f"{read}{attempt}".encode(), "heard": read if good else "전혀 다른 말"}

    got = {r.phrase_id: r for r in M.synthesize(p, answering(speak), cache).collect()}
    assert {k: (r.flag, r.cached) for k, r in got.items()} == {1: (False, False), 2: (False, False), 3: (True, False), 4: (False, True)}
    assert bytes(got[2].audio).decode() == "세 마리2" and got[1].cer == 0.0 and bytes(got[4].audio) == b"old"


def test_lengths_and_shapes(spark):
    t = spark.createDataFrame([(None, 2.0, 2.0), (5.0, 2.0, 4.0), (1.0, None, 1.0)], "a double, s double, v double")
    got = [tuple(round(x, 4) if x is not None else None for x in r) for r in t.select(M.narrated_target(F.col("a"), F.col("s")), M.stretch(F.col("v"), F.col("s"))).collect()]
    assert got == [(2.75, 1.275), (5.0, 1.0), (1.0, 1.0)]
    g = spark.createDataFrame([(1920.0, 1080.0)], "w double, h double").select(M.fill_geometry(F.col("w"), F.col("h"), 1080, 1920).alias("g")).first().g
    assert (g.fg_w, g.fg_h, g.x, g.y) == (1080.0, 607.5, 0.0, 656.25) and (round(g.bg_w, 2), g.bg_h, g.bg_y) == (3413.33, 1920.0, 0.0)
    b = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "x double, y double, w double, h double")
    r = b.select(G.box_to_rect(G.box()).alias("r"), G.rect_to_box(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(6.0)).alias("b")).first()
    assert tuple(r.r) == (1.0, 2.0, 4.0, 6.0) and tuple(r.b) == (1.0, 2.0, 3.0, 4.0)
    pins = spark.createDataFrame([("edit", True, "그냥"), ("edit", True, "자막만"), ("narration", True, "x"), ("edit", False, "x")], "m string, a boolean, q string")
    assert [x[0] for x in pins.select(X.voice_allowed(F.col("m"), F.col("a"), F.col("q"))).collect()] == [True, False, False, False]
    assert [x[0] for x in spark.createDataFrame([("so 우리 개 ", "우리 개"), ("x", ""), (None, "x")], "t string, q string").select(X.is_echo(F.col("t"), F.col("q"))).collect()] == [True, False, False]
