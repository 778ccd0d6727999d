import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity as I

TRACK = "video_id long, track_id long, gt_id long, v array<double>, frames array<long>"


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


def test_relink(spark):
    rows = [(0, 1, 0, unit(1, 0, 0), [0, 1]), (0, 2, 0, unit(1, 0.1, 0), [5]), (0, 3, 0, unit(1, 0.05, 0), [5, 6]), (0, 4, 0, unit(0, 0, 1), [9]), (0, 5, 0, unit(1, 0, 0), [20])]
    got = {r.track_id: (r.cluster, r.auto) for r in I.relink(spark.createDataFrame(rows, TRACK), [0.75]).collect()}
    assert got[1] == (0, False) and got[2] == (0, True) and got[3] == (1, False) and got[4] == (2, False)


def test_relink_equals_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(v, t, 0, unit(*rng.normal(size=4)), [int(x) for x in rng.choice(30, 3, replace=False)]) for v in range(3) for t in range(25)]
    got = {(r.video_id, r.track_id): (r.cluster, r.auto, r.sim) for r in I.relink(spark.createDataFrame(rows, TRACK), [0.5]).collect()}
    for v in range(3):
        means, sizes, frames = [], [], []
        for _, t, _, e, f in [r for r in rows if r[0] == v]:
            sims = [float(np.dot(means[i], e)) if not frames[i] & set(f) else -2.0 for i in range(len(means))]
            best = max(range(len(means)), key=lambda i: sims[i], default=None)
            if best is not None and sims[best] >= 0.5:
                m = np.array(means[best]) * sizes[best] + e
                means[best], sizes[best] = m / (np.linalg.norm(m) + 1e-8), sizes[best] + 1
                frames[best] |= set(f)
                want = (best, True)
            else:
                means.append(np.array(e))
                sizes.append(1)
                frames.append(set(f))
                want = (len(means) - 1, False)
            assert got[v, t][:2] == want


def test_anchor_taps(spark):
    rows = [(0, 1, 0, unit(1, 0), [0]), (0, 2, 0, unit(1, 0.1), [3]), (0, 3, 0, unit(0, 1), [6]), (0, 9, 1, unit(1, 0.2), [30])]
    got = {r.gt_id: (r.taps, r.false_attach) for r in I.anchor_taps(spark.createDataFrame(rows, TRACK), 0.9).collect()}
    assert got == {0: (2, 1), 1: (1, 2)}
    many = [(v, t, g, [e, e], f) for v, t, g, e, f in rows]
    got = {r.gt_id: (r.taps, r.false_attach) for r in I.anchor_taps(spark.createDataFrame(many, TRACK.replace("array<double>", "array<array<double>>")), 0.9, many=True).collect()}
    assert got[0][0] == 2 and got[1] == (1, 2)


def test_fragments(spark):
    rows = [(0, 1, 0.60, list(range(10))), (0, 2, 0.55, list(range(20, 30))), (0, 3, 0.52, list(range(5, 15))), (0, 4, 0.30, [90]), (1, 1, 0.5, [1]), (2, 1, 0.60, [1, 2, 3]), (2, 2, 0.58, [3, 4])]
    got = {r.video_id: (r.track, r.tracks, r.margin) for r in I.fragments(spark.createDataFrame(rows, "video_id long, track_id long, sim double, frames array<long>")).collect()}
    assert got == {0: (1, [1, 2], pytest.approx(0.08)), 1: (1, [1], 1.0), 2: (1, [1, 2], 1.0)}


def test_diverse(spark):
    rows = [("a", 0, 1.0, 0.9), ("a", 10, 1.0, 0.8), ("a", 200, 1.0, 0.7), ("b", 5, 0.5, 0.9), ("c", 1, 0.4, 0.1)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, margin double, motion double").withColumn("k", F.lit(1))
    assert [(r.video_id, r.frame_idx) for r in sorted(I.diverse(df, ["k"]).collect(), key=lambda r: r.pick)] == [("a", 0), ("a", 200), ("b", 5)]


def test_propagation(spark):
    p = spark.createDataFrame([("d1", unit(1, 0), unit(1, 0)), ("d2", unit(1, 0), unit(1, 0)), ("t", unit(1, 0.1), unit(1, 0.1)), ("eye", unit(1, 0), unit(0, 1)), ("ear", unit(0, 1), unit(1, 0)), ("none", [], [])], "video_id string, scene_vec array<double>, audio_vec array<double>")
    d = spark.createDataFrame([("cafe", "d2", 0), ("cafe", "d1", 1)], "tag string, video_id string, ord long")
    p, d = p.withColumn("owner", F.lit("o")), d.withColumn("owner", F.lit("o"))
    assert [(r.video_id, r.donor) for r in I.propagate_tags(p, d, ["owner"]).collect()] == [("t", "d2")]
    assert I.propagate_tags(p, d.withColumn("owner", F.lit("x")), ["owner"]).count() == 0
    with pytest.raises(ValueError):
        I.propagate_tags(p, d, [])


def test_two_passes(spark):
    refs = spark.createDataFrame([([1.0, 0.0],)], "v array<double>")
    vids = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [-1.0, 0.0]}

    def match(r):
        held = [x.v for x in r.collect()]
        return spark.createDataFrame([(n, 1, [1], max(float(np.dot(v, h)) for h in held), 0.5) for n, v in vids.items()], "video_id string, track long, tracks array<long>, sim double, margin double")

    sure, left = I.two_pass_anchors(match, refs, lambda ok: spark.createDataFrame([([0.0, 1.0],)] * min(1, ok.count()), "v array<double>"))
    assert sorted(r.video_id for r in sure.collect()) == ["a", "b"] and [r.video_id for r in left.collect()] == ["c"]


def test_reference_similarity(spark):
    random.seed(1)
    t = spark.createDataFrame([(i, [random.random() for _ in range(3)]) for i in range(5)], "track_id long, v array<double>")
    r = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 1.0, 0.0],)], "v array<double>")
    assert all(x.sim == pytest.approx(max(y.v[:2])) for x, y in zip(I.reference_similarity(t, r, ["track_id"]).orderBy("track_id").collect(), t.orderBy("track_id").collect()))


def test_many_references_need_a_key(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0])], "track_id long, v array<double>")
    refs = spark.range(3).selectExpr("array_repeat(1.0D, 400000) v")
    with pytest.raises(ValueError):
        I.reference_similarity(t, refs, ["track_id"])
    assert I.reference_similarity(t, refs.limit(0), ["track_id"]).first().sim is None


def test_relink_report_equals_pairs(spark):
    random.seed(5)
    rows = [(v, t, random.randint(0, 3), random.randint(0, 2), random.random() < 0.5) for v in range(3) for t in range(15)]
    links = spark.createDataFrame([(v, 0.5, t, c, a) for v, t, c, _, a in rows], "video_id long, tau double, track_id long, cluster long, auto boolean")
    truth = spark.createDataFrame([(v, t, g) for v, t, _, g, _ in rows], "video_id long, track_id long, gt_id long")
    (r,) = I.relink_report(links, truth).collect()
    same = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] == b[2]]
    assert r.pair_precision == pytest.approx(sum(a[3] == b[3] for a, b in same) / len(same))
    assert r.taps_per_video == pytest.approx(sum(not x[4] for x in rows) / 3) and r.auto_share == pytest.approx(sum(x[4] for x in rows) / 45)


def test_bitmaps_count_shared_frames(spark):
    import random

    rng = random.Random(3)
    tracks = [(v, t, [rng.randrange(-200, 400) for _ in range(rng.randrange(0, 90))]) for v in range(3) for t in range(8)] + [(0, 90, None), (1, 91, [63, 64, 63]), (1, 92, [64, 65, 127, 128])]
    df = spark.createDataFrame(tracks, "video_id long, track_id long, frames array<long>")
    got = {(r.video_id, r.a, r.b): r.n for r in I.shared_frames(I.frame_bits(df)).collect()}
    want = {(v, s, t): len(set(f or []) & set(g or [])) for v, s, f in tracks for w, t, g in tracks if v == w and s < t}
    assert got == {k: n for k, n in want.items() if n}


def test_folds_take_in_order(spark):
    cuts = [("o", 1, f, m, s) for f, m, s in ((0, 0.5, 1.0), (10, 0.5, 0.9), (400, 0.5, 0.8), (50, None, 2.0), (900, 0.2, None))] + [("o", 2, 5, 0.5, 0.95), ("p", 1, 3, 0.1, 0.1)]
    df = spark.createDataFrame(cuts, "owner string, video_id long, frame_idx long, margin double, motion double")
    got = sorted((r.owner, r.pick, r.video_id, r.frame_idx) for r in I.diverse(df, ["owner"], 4).collect())
    assert got == [("o", 1, 1, 0), ("o", 2, 2, 5), ("o", 3, 1, 400), ("o", 4, 1, 900), ("p", 1, 1, 3)]
    assert I.diverse(df.limit(0), ["owner"]).count() == 0


def plain_relink(tracks, tau):
    """The method, track by track: {track: (cluster, sim, joined)} of (track, vector, frames) in order."""
    held, out = [], {}
    for t, v, frames in tracks:
        best, sim = -1, -1.0
        for i, c in enumerate(held):
            if not c["frames"] & frames and float(np.dot(c["mean"], v)) > sim:
                best, sim = i, float(np.dot(c["mean"], v))
        if best >= 0 and sim >= tau:
            c = held[best]
            total = c["mean"] * c["size"] + v
            held[best] = {"mean": total / (np.linalg.norm(total) + 1e-8), "size": c["size"] + 1, "frames": c["frames"] | frames}
        else:
            held.append({"mean": v, "size": 1, "frames": set(frames)})
        out[t] = (best if best >= 0 and sim >= tau else len(held) - 1, sim, best >= 0 and sim >= tau)
    return out


@pytest.mark.parametrize("listed", [64, 2])
def test_relink_of_crowded_frames(listed, monkeypatch):
    """Frames that many clusters were seen on, as lists and as bits, in videos of several blocks."""
    monkeypatch.setattr(I, "MOST_LISTED", listed)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frames = [set(map(int, rng.choice(9, rng.integers(0, 3)))) | {int(x) for x in rng.choice(5_000, 20)} for _ in v]
    clusters, got = I._Clusters(0.9, 5), []
    for at in range(0, len(v), I.BLOCK):
        got += clusters.block(v[at : at + I.BLOCK], frames[at : at + I.BLOCK])
    want = plain_relink([(i, x, f) for i, (x, f) in enumerate(zip(v, frames, strict=True))], 0.9)
    assert [(c, j) for c, _, j in got] == [(c, j) for c, _, j in want.values()] and any(j for *_, j in got)
    assert np.allclose([s for _, s, _ in got], [s for _, s, _ in want.values()])
    assert {type(x) for x in clusters.at.values()} == {I.array, int}


def test_online_relink_pools_samples_and_keeps_apart_what_is_seen_together(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import catalog

    rng = np.random.default_rng(6)
    dogs = rng.normal(size=(3, 8))
    rows = [(i, (dogs[i % 3] + rng.normal(size=8) * 0.35).astype(np.float32).tolist(), i % 3) for i in range(500)]
    rows[7], rows[30], rows[31] = (7, None, 1), (30, [0.0] * 8, 0), (31, rows[1][1], 1)
    events = [(i, int(rng.integers(0, 150))) for i in map(int, rng.choice(9_000, 400, replace=False)) if i % 5000 < 600]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["online_relink"](spark, str(tmp_path)).collect()

    length = lambda a: a / (np.linalg.norm(a) + 1e-8)
    samples, seen = {}, {}
    for i, v, label in rows:
        if v is not None:
            samples.setdefault((i % 10, label, i // 80), []).append((i, length(np.array(v, float))))
    for e, u in events:
        seen.setdefault(u, set()).add(e % 5000)
    tracks = {}
    for (video, _, _), s in samples.items():
        t = min(s)[0]
        tracks.setdefault(video, []).append((t, length(np.mean([v for _, v in s], axis=0)), seen.get(t % 150, set())))
    want = {(video, tau, t): r for video, rows in tracks.items() for tau in (0.5, 0.6, 0.7, 0.8, 0.9) for t, r in plain_relink(sorted(rows, key=lambda r: r[0]), tau).items()}
    assert {(r.video_id, r.tau, r.track_id): (r.cluster, r.auto) for r in got} == {k: (c, j) for k, (c, _, j) in want.items()} and len(got) == len(want)
    assert all(abs(r.sim - want[r.video_id, r.tau, r.track_id][1]) < 6e-4 for r in got)
    own = {(v, t): f for v, rows in tracks.items() for t, _, f in rows}
    apart = {}
    for r in got:
        apart.setdefault((r.video_id, r.tau, r.cluster), []).append(own[r.video_id, r.track_id])
    assert all(sum(map(len, f)) == len(set().union(*f)) for f in apart.values()) and max(map(len, samples.values())) > 1
    # there are such as would have joined if frames did not count
    assert any(plain_relink([(t, v, set()) for t, v, _ in sorted(rows, key=lambda r: r[0])], 0.5)[t][2] and not want[video, 0.5, t][2] for video, rows in tracks.items() for t, *_ in rows)
    sql = catalog.ORACLE["online_relink"]
    for t in ("embeddings", "events"):
        sql = sql.replace(f"from {t}", f"from '{tmp_path}/{t}.parquet/*.parquet'")
    want = duckdb.connect().execute(f"select video_id, tau, track_id, cluster, sim, auto from ({sql})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
