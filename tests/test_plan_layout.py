import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import layout as L
from tidemark.operators import plan as P

BLOCKS = "plan_id long, block_idx int, select string, zoom string, pace string, target_dur double, sources array<string>, keywords array<string>"
SEG = "source string, ord long, start double, end double, group string, action string, conf double, uncertain boolean"


def block(i, select="all", zoom="none", pace="fast", dur=None, sources=(), keywords=(), plan=0):
    return (plan, i, select, zoom, pace, dur, list(sources), list(keywords))


def world(spark, blocks, segs, presence=(), tags=(), names=("a", "b")):
    src = spark.createDataFrame([(p, n, i) for p in {b[0] for b in blocks} for i, n in enumerate(names)], "plan_id long, source string, src_ord int")
    return spark.createDataFrame(blocks, BLOCKS), src, spark.createDataFrame(list(tags), "source string, tag string"), spark.createDataFrame(segs, SEG), spark.createDataFrame(list(presence), "source string, start double, end double")


def clips(spark, *a, **k):
    w = world(spark, *a, **k)
    return sorted((r.block_idx, r.source, r.t0, r.t1) for r in P.compile_plans(*w, max_blocks=2).collect())


def seg(source, s, e, group="dynamic", action=None, conf=1.0, unc=False, ord=0):
    return (source, ord, float(s), float(e), group, action, conf, unc)


def test_clips(spark):
    s = [seg("a", 0, 10), seg("b", 0, 4)]
    assert clips(spark, [block(0, dur=6.0), block(1)], s) == [(0, "a", 0.0, 3.0), (0, "b", 0.0, 3.0), (1, "a", 3.0, 5.0)]
    assert clips(spark, [block(0, zoom="gradual", dur=5.0)], s) == [(0, "a", 0.0, 5.0)]
    assert clips(spark, [block(0, dur=1.0)], s + [seg("c", 0, 3)], names=("a", "b", "c")) == [(0, "a", 0.0, 1.0)]
    assert clips(spark, [block(0, dur=4.0)], [seg("a", 0, 10), seg("b", 0, 0.8)]) == [(0, "a", 0.0, 4.0)]
    assert clips(spark, [block(0, "static")], s) == []


def test_clips_presence_uncertain_tricks(spark):
    assert clips(spark, [block(0, pace="calm")], [seg("a", 0, 10)], presence=[("a", 0.0, 2.0), ("a", 5.0, 10.0)]) == [(0, "a", 5.0, 9.0)]
    unsure = [seg("a", 0, 10, unc=True)]
    assert clips(spark, [block(0)], unsure) == []
    assert clips(spark, [block(0, keywords=["카페"])], unsure, tags=[("a", "애견카페")], presence=[("a", 0.0, 1.0)]) == [(0, "a", 0.0, 2.0)]
    assert clips(spark, [block(0, sources=["a"])], unsure) == []
    trick = [seg("a", 0, 5, "static", "정적묘기", 0.7, True), seg("b", 0, 5, "static", "정적묘기", 0.5)]
    assert clips(spark, [block(0, "묘기")], trick) == [(0, "a", 0.0, 2.0)]


def test_sources_and_reservation(spark):
    bl = [block(0, keywords=["cafe"]), block(1), block(2, keywords=["cafe", "zzz"]), block(3, keywords=["zzz"]), block(4, sources=["b", "gone"]), block(5, sources=["gone"])]
    b, s, t, *_ = world(spark, bl, [seg("a", 0, 1)], tags=[("a", "dog cafe")])
    got = {}
    for r in P.block_sources(b, s, t).collect():
        got.setdefault(r.block_idx, set()).add((r.source, r.exempt, r.reserved))
    every = {("a", False, False), ("b", False, False)}
    assert got == {0: {("a", True, True)}, 1: every, 2: {("a", True, True), ("b", False, False)}, 3: every, 4: {("b", False, True)}, 5: every}
    kept = {(r.block_idx, r.source) for r in P.reserve(P.block_sources(b, s, t)).collect()}
    assert kept == {(0, "a"), (2, "a"), (4, "b")}


RAW = f"title string, voice boolean, blocks {P.raw_array()}, texts array<struct<text:string,blocks:array<int>,pos:string,span:array<double>>>"


def authored(spark, raw, request="요청", captions=True, narration=False, voice=False):
    df = spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.from_json("j", RAW).alias("r"))
    out = P.authored_plan(F.col("r"), F.lit(request), F.array(F.lit("a"), F.lit("b")), F.lit(narration), F.lit(captions), F.lit(voice))
    r = df.select(out.alias("p")).first().p
    return r.asDict(True) if r else None


def test_authored_plan(spark):
    p = authored(spark, {"title": "요청 제목", "blocks": [{"caption": "안녕", "target_dur": 99, "speed": 3, "zoom": "gradual", "sources": ["a", "a", "x"], "caption_span": [0.1, 2]}, {}, {"select": "dynamic", "target_dur": 0}], "texts": [{"text": "폴짝!", "blocks": [5, 0]}, {"text": "너무나도 긴 감탄입니다", "blocks": [0]}]})
    b = p["blocks"]
    assert p["title"] == "제목" and len(b) == 2 and b[0]["target_dur"] == 12.0 and b[0]["speed"] == 1.0 and b[0]["subject"] == "foster" and b[0]["sources"] == ["a"] and b[0]["caption_span"] == [0.1, 1.0]
    assert b[1]["target_dur"] is None and p["texts"] == [{"text": "폴짝!", "blocks": [0, 1], "pos": "auto", "span": None}]
    assert authored(spark, {"blocks": []}) is None and authored(spark, {"blocks": [{"sources": ["a"]}]}) is None and authored(spark, {}) is None
    assert authored(spark, {"blocks": [{"sources": ["a"], "caption": "x"}]}, captions=False)["blocks"][0]["caption"] == ""
    v = authored(spark, {"voice": True, "blocks": [{"caption": "하나", "caption_span": [0, 0.5]}, {"sources": ["b"]}], "texts": [{"text": "와", "blocks": [0]}, {"text": "오", "blocks": [0]}]}, voice=True)
    assert v["blocks"][0]["narration"] == "하나" and v["blocks"][0]["caption_span"] is None and v["blocks"][1]["narration"] == "" and len(v["texts"]) == 1


def test_defaults_gaps_fill(spark):
    df = spark.createDataFrame([(json.dumps({"blocks": [{"caption_pos": "nowhere", "target_dur": 0, "caption_span": [0.5, 0.52]}, {"caption": "c", "keywords": ["k"], "target_dur": 3}]}), json.dumps({"blocks": [{"caption": "new", "sources": ["a", "z"], "target_dur": 1}]}))], "u string, a string")
    df = df.select(F.from_json("u", RAW).alias("u"), F.from_json("a", RAW).alias("a")).select(P.default_plan(F.col("u.title"), F.col("u.blocks"), F.col("u.texts")).alias("p"), "a")
    f = F.lit(False)
    r = df.select("p", P.field_gaps(F.col("p"), f, ~f).alias("g"), P.fill_gaps(F.col("p.blocks"), F.col("a.blocks"), F.lit("q"), F.array(F.lit("a")), f, ~f).alias("f"), P.is_unstructured(F.col("p")).alias("n")).first()
    assert r.p.blocks[0].caption_pos == "bottom" and r.p.blocks[0].caption_span is None and r.g == ["블록0:sources+caption+dur"] and not r.n
    assert (r.f[0].caption, r.f[0].sources, r.f[0].target_dur) == ("new", ["a"], 2.0) and r.f[1].caption == "c" and len(r.f) == 2
    empty = spark.createDataFrame([("{}",)], "u string").select(F.from_json("u", RAW).alias("u")).select(P.default_plan(F.col("u.title"), F.col("u.blocks"), F.col("u.texts")).alias("p"))
    assert empty.select(P.is_unstructured(F.col("p"))).first()[0]


def test_rewrites_and_directives(spark):
    b = spark.createDataFrame([(0, 0, "old", "old"), (0, 1, "keep", "")], "plan_id long, block_idx int, caption string, narration string")
    fx = spark.createDataFrame([(0, 0, "new"), (0, 1, ""), (0, 7, "x")], "plan_id long, block_idx int, fix string")
    assert sorted(tuple(r)[1:] for r in P.apply_rewrites(b, fx, F.lit("q")).collect()) == [(0, "new", "new"), (1, "keep", "")]
    rq = spark.createDataFrame([(0, "첫 문장 5초 그리고 아주 긴 사이를 두고 둘째 문장 클로즈 업")], "plan_id long, request string")
    s = spark.createDataFrame([(0, 0, "첫 문장"), (0, 1, "둘째 문장"), (0, 2, "없음")], "plan_id long, block_idx int, sentence string")
    assert sorted((r.block_idx, r.target_dur, r.zoom) for r in P.attribute_directives(s, rq).collect()) == [(0, 5.0, "none"), (1, None, "gradual"), (2, None, "none")]


def test_geometry(spark):
    b = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    r = lambda *v: G.rect(*[F.lit(float(x)) for x in v])
    got = spark.range(1).select(G.iou(b(0, 0, 10, 10), b(0, 0, 10, 10)), G.iou(b(0, 0, 10, 10), b(5, 0, 10, 10)), G.iou(b(0, 0, 1, 1), b(5, 5, 1, 1)), G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)), G.rect_overlap(r(0, 0, 1, 1), r(1, 0, 2, 1)), G.interval_iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)), G.occupancy(r(0, 0, 10, 10), F.array(r(0, 0, 5, 10), r(0, 0, 1, 1))), G.occupancy(r(0, 0, 10, 10), F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))).first()
    assert tuple(got) == (1.0, pytest.approx(1 / 3), 0.0, 0.0, 0.0, pytest.approx(1 / 3), 0.5, 0.0)


def test_adjacency(spark):
    near = {"top": {"top-left", "top-right"}, "bottom": {"bottom-left", "bottom-right"}, "left": {"top-left", "bottom-left"}, "right": {"top-right", "bottom-right"}}
    rows = [(a, b) for a in P.POSITIONS for b in P.POSITIONS]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", L.adjacent(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == (r.a == r.b or r.b in near.get(r.a, ()) or r.a in near.get(r.b, ())), r


def test_windows(spark):
    w = spark.createDataFrame([(1, 0.0, 4.0), (1, 1.0, 3.0)], "k long, start double, end double")
    t = spark.createDataFrame([(1, 0.0, 10.0, None, "폴짝!"), (2, 0.0, 1.0, None, "폴짝!"), (3, 0.0, 10.0, [0.5, 0.9], "폴짝!")], "k long, w0 double, w1 double, span array<double>, text string")
    assert sorted((r.k, r.start, r.end) for r in L.place_copy(t, w, ["k"]).collect()) == [(1, 3.0, 6.0), (3, 5.0, 9.0)]
    s = spark.createDataFrame([(0, 0, "와!", 0.0, 9.0, None, 4.0), (0, 1, "오!", 0.0, 9.0, None, 4.5), (0, 2, "헉!", 0.0, 9.0, None, 4.2), (0, 3, "ㅋ", 0.0, 1.0, None, None)], "plan_id long, text_idx int, text string, w0 double, w1 double, span array<double>, peak double")
    got = {r.text_idx: (r.start, r.end) for r in L.schedule_texts(s).collect()}
    assert got[0] == (4.0, 7.0) and got[1] == (4.5, 7.5) and got[2] == (0.0, 3.0) and 3 not in got
    c = spark.createDataFrame([(1, "x", 1.5, 2.0), (1, "y", 3.5, 5.0)], "k long, ident string, start double, end double")
    assert {r.ident: r.fits for r in L.fits(c, w, ["k"]).collect()} == {"x": False, "y": True}


def test_answers_are_read_field_by_field(spark):
    def read(answer):
        return spark.createDataFrame([(answer,)], "a string").select(P.raw_plan(F.col("a")).alias("p")).first().p

    p = read('{"title": 7, "voice": "true", "extra": [1], "blocks": [{"target_dur": "4.5", "sources": "a", "keywords": ["k", 3], "caption_span": ["0.1", 0.9], "speed": {"x": 1}}, 5, null], "texts": [{"text": "hi", "blocks": 1}, {"blocks": ["2", 3]}]}')
    assert (p.title, p.voice, len(p.blocks)) == ("7", True, 3)
    b = p.blocks[0]
    assert (b.target_dur, b.sources, b.keywords, b.caption_span, b.speed, b.caption) == (4.5, ["a"], ["k", "3"], [0.1, 0.9], None, None)
    assert p.blocks[1].sources is None and [t.blocks for t in p.texts] == [[1], [2, 3]] and p.texts[1].text is None
    for nothing in ("", "{", "[1]", "null", '"text"', None, '{"blocks": 3, "texts": "x"}'):
        p = read(nothing)
        assert p.title is None and p.blocks is None and p.texts is None


def test_sources_of_blocks_are_not_sent_to_the_driver(spark):
    from tidemark.plans import catalog

    for name in ("block_sources", "source_reservation"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") <= 1, name  # the tags; rows of plans go by sorted shuffles
