import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments as S
from tidemark.operators import timeline as T

K = ["k"]


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def segs(spark, rows):
    return df(spark, [("a", i, float(s), float(e), lab) for i, (s, e, lab) in enumerate(rows)], "k string, ord long, start double, end double, label string")


def test_absorb_equals_fold(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(80):
        t, raw = 0.0, []
        for _ in range(rng.randint(1, 12)):
            d = rng.choice([0.1, 0.2, 0.5, 1.0])
            raw.append((t, t + d, rng.choice("ms")))
            t += d
        rows += [(str(k), *r) for r in raw]
        out = []
        for s, e, lab in raw:
            if out and (e - s < 0.3 or out[-1][2] == lab):
                out[-1] = (out[-1][0], e, out[-1][2])
            else:
                out.append((s, e, lab))
        want[str(k)] = out
    got = {}
    for r in T.absorb_short(df(spark, rows, "k string, start double, end double, label string"), K, 0.3).orderBy("k", "start").collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.label))
    assert got == want


def test_subtract_clip_busy_equal_brute_force(spark):
    rng = random.Random(2)
    ivs, used = [], []
    for k in range(40):
        ivs += [(k, i, s := rng.randint(0, 30), s + rng.randint(1, 20)) for i in range(2)]
        used += [(k, s := rng.randint(0, 45), s + rng.randint(0, 6)) for _ in range(rng.randint(0, 6))]
    a = df(spark, ivs, "k long, i long, start long, end long")
    u = df(spark, used, "k long, start long, end long")
    got = {tuple(r) for r in T.subtract(a, u, K, ["i"], 2).collect()}
    want = set()
    for k, i, s, e in ivs:
        free = [x for x in range(s, e) if not any(kk == k and x < ue and x + 1 > us for kk, us, ue in used)]
        for x in free:
            if x - 1 not in free:
                end = x
                while end in free:
                    end += 1
                want.add((k, i, x, end))
    want = {x for x in want if x[3] - x[2] >= 2}
    assert {x for x in got} >= want and all(not any(kk == k and min(ue, hi) > max(us, lo) for kk, us, ue in used) for k, _, lo, hi in got)
    plain = sorted(map(tuple, T.clip(a, u, K).select("k", "i", "lo", "hi").collect()))
    assert plain == sorted(map(tuple, T.clip(a, u, K, bucket=4.0).select("k", "i", "lo", "hi").collect()))
    assert plain == sorted((k, i, max(s, us), min(e, ue)) for k, i, s, e in ivs for kk, us, ue in used if kk == k and min(e, ue) > max(s, us))
    busy = {}
    for r in T.busy(u.where("end > start"), K).collect():
        busy.setdefault(r.k, set()).update(range(r.start, r.end))
    for k in range(40):
        assert busy.get(k, set()) == {x for x in range(60) if sum(kk == k and us <= x < ue for kk, us, ue in used) >= 2}


def test_sessions_and_interpolation(spark):
    d = df(spark, [("a", 0.0), ("a", 0.5), ("a", 1.1), ("b", 3.0), ("b", None)], "k string, t double")
    assert sorted((r.k, r.start, r.end, r.n) for r in T.sessions(d, K, "t", 0.5).collect()) == [("a", 0.0, 0.5, 2), ("a", 1.1, 1.1, 1), ("b", 3.0, 3.0, 1)]
    k = df(spark, [("a", 0, 0, 0.0), ("a", 4, 1, 8.0), ("a", 6, 2, 8.0), ("a", 6, 3, 99.0), ("b", 1, 0, 5.0)], "k string, frame_idx long, ord long, x double")
    got = {r.frame_idx: r.x for r in T.interpolate(k, K, values=("x",)).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 4.0, 3: 6.0, 4: 8.0, 5: 8.0, 6: 8.0}


def test_confusion_first_segment_wins(spark):
    gt = segs(spark, [(0, 10, "moving"), (5, 20, "static")])
    pred = segs(spark, [(0, 8, "moving"), (8, 20, "static")])
    for bucket in (None, 3.0):
        got = {(r.gt_label, r.pred_label): r.secs for r in T.confusion(gt, pred, K, bucket=bucket).collect()}
        assert got == {("moving", "moving"): 8.0, ("moving", "static"): 2.0, ("static", "static"): 10.0}
    (m,) = S.evaluate_motion(gt, pred, K).collect()
    assert m.accuracy == pytest.approx(0.9) and m.missed_motion_rate == pytest.approx(0.2) and m.false_motion_rate == 0


def test_segment_motion_short_curve(spark):
    d = df(spark, [("a", i, 100.0) for i in range(3)], "k string, f long, v double")
    assert [(r.start, r.end, r.label) for r in T.segment_motion(d, K, "f", "v", fps=1.0).collect()] == [(0.0, 3.0, "moving")]


def test_samples(spark):
    d = spark.range(1, 30).withColumnRenamed("id", "n")
    for r in d.select("n", T.uniform_positions(F.col("n"), 8).alias("p"), T.step_positions(F.lit(0), F.col("n"), 30.0, 3).alias("s"), T.fraction_positions(F.col("n")).alias("f")).collect():
        n = r.n
        assert r.p == (list(range(n)) if n <= 8 else [round(i * (n - 1) / 7) for i in range(8)])
        steps = list(range(0, n, 8)) or [0]
        assert r.s == (steps if len(steps) <= 3 else [steps[round(i * (len(steps) - 1) / 2)] for i in range(3)])
        assert r.f == [int(n * x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)]


def test_actions_and_matches(spark):
    schema = "k string, ord long, start double, end double, group string, action string, uncertain boolean"
    gt = df(spark, [("a", 0, 0.0, 6.0, "dynamic", "걷기", False), ("a", 1, 6.0, 10.0, "static", "앉기", False)], schema)
    pred = df(spark, [("a", 0, 0.0, 5.0, "dynamic", None, False), ("a", 1, 5.0, 8.0, "static", None, True), ("a", 2, 8.0, 10.0, "dynamic", None, False)], schema)
    (m,) = S.evaluate_actions(gt, pred, K, ["걷기"]).collect()
    assert (m.total_time, m.committed_time, m.low_motion_recall) == (10.0, 7.0, 1.0) and m.uncertain_rate == pytest.approx(0.3) and m.group_accuracy == pytest.approx(5 / 7)
    ms = "k string, ord long, phrase_id long, source string, start double, end double, uncertain boolean"
    g = df(spark, [("a", i, i, "s", 0.0, 2.0, False) for i in range(4)], ms)
    p = df(spark, [("a", 0, 0, "s", 0.0, 2.0, False), ("a", 1, 1, "x", 0.0, 2.0, False), ("a", 2, 2, "s", 0.0, 2.0, True), ("a", 3, 0, "s", 0.0, 1.9, False)], ms)
    (m,) = S.evaluate_matches(g, p, K).collect()
    assert (m.num_phrases, m.committed, m.uncertain_rate, m.match_accuracy) == (4, 2, 0.25, 0.5)


def test_thresholds(spark):
    m = df(spark, [("s", "a", 1.0), ("s", "b", 2.0), ("s", "c", 3.0), ("s", "d", None)], "stage string, metric string, value double")
    t = df(spark, [("s", "a", 1.0, 0.5), ("s", "b", None, 1.9), ("s", "c", None, None)], "stage string, metric string, min double, max double")
    c = S.check_thresholds(m, t)
    assert {r.metric: (r.rule, r.status) for r in c.collect()} == {"a": ("min", "PASS"), "b": ("max", "FAIL"), "c": ("-", "unset")}
    assert S.overall(c, ["stage"]).first().status == "FAIL" and S.overall(c.where("metric = 'c'"), ["stage"]).first().status == "unset"


def test_summaries(spark):
    schema = "k string, ord long, start double, end double, group string, conf double, uncertain boolean"
    s = df(spark, [("a", 0, 0.0, 30.0, "dynamic", 0.8, False), ("a", 1, 30.0, 60.0, "static", 0.8, True), ("a", 2, 60.0, 120.0, "other", None, False)], schema)
    (r,) = S.activity_rollup(s, K).collect()
    assert (r.total_secs, r.conf) == (120.0, 1.0) and r.dynamic_ratio == pytest.approx(24 / 36) and r.uncertain_pct == pytest.approx(0.25)
    assert [r.ord for r in S.cited_segment(s, K).collect()] == [0]
    assert S.motion_class(s, K).first().motion == "even"
    with pytest.raises(Exception, match="unknown action label"):
        df(spark, [("TODO",)], "action string").select(S.group_of("action")).collect()


def test_profile_lines(spark):
    schema = "video_id string, audio array<struct<label:string,p:double>>, indoor boolean, categories array<struct<category:string,p:double>>, dark boolean, caption string, behavior string, scene_tags array<string>"
    v = df(spark, [("a", [("Speech", 0.7), ("Bark", 0.2)], True, [("park", 0.5)], True, " 글 ", "뛴다", ["x", "y"]), ("b", None, None, None, None, None, None, None)], schema)
    assert [r[0] for r in v.orderBy("video_id").select(S.profile_text(audio_names={"Speech": "말"})).collect()] == ["소리: 말(0.7), Bark(0.2) | 장면분류: 실내 확실 · park(0.5) | 밝기: 어두움(밤/저조도) | 묘사: 글", "소리: (신호 없음)"]
    s = df(spark, [("a", 0.0, 2.5, "dynamic"), ("a", 2.5, 4.0, "static")], "video_id string, start double, end double, group string")
    lines = {r.video_id: r.line for r in S.record_lines(v, s).collect()}
    assert lines["a"].endswith("동작측정: 움직임 2초/정지 2초 | 묘사: 글 | 행동: 뛴다 | 확정 장면: x, y") and lines["b"] == "[b] 소리: (신호 없음) | 동작측정: 움직임 0초/정지 0초"


def test_peaks(spark):
    b = df(spark, [("v", i, float(x), 0.0, 10.0, 10.0) for i, x in [(0, 0), (1, 1), (2, 5), (30, 100), (31, 101)]], "video_id string, frame_idx long, x double, y double, w double, h double")
    assert [(r.frame_idx, r.speed) for r in T.peak(b, ["video_id"]).collect()] == [(2, 0.4)]
    c = df(spark, [(1, 0, "v", 0.0, 0.5, 0.0), (1, 1, "v", 1.0, 2.0, 0.5), (2, 0, "v", 1.0, 2.0, 7.0), (3, 0, "v", 5.0, 6.0, 0.0)], "plan_id long, clip_ord int, video_id string, t0 double, t1 double, out_start double")
    got = {r.plan_id: r["at"] for r in T.peak_in_output(c, b, ["plan_id"]).collect()}
    assert got == {1: pytest.approx(2 / 30), 2: pytest.approx(7 + 31 / 30 - 1.0)}
