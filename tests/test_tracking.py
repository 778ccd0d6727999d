import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.assignment import max_assignment, priced_assignment
from tidemark.operators import tracking as T

BOX = "video_id string, frame_idx long, track_id long, x double, y double, w double, h double, conf double, cls string, ord long"


def boxes(spark, rows):
    return spark.createDataFrame([(v, f, t, float(x), float(y), float(w), float(h), 1.0, "dog", i) for i, (v, f, t, x, y, w, h) in enumerate(rows)], BOX)


def frames(spark, rows):
    return spark.createDataFrame(sorted({(v, f) for v, f, *_ in rows}), "video_id string, frame_idx long")


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 2**32 - 1), st.booleans())
def test_assignment_equals_brute_force(n, m, seed, coarse):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, 3, (n, m)).astype(float) if coarse else rng.random((n, m))
    got = max_assignment(w)
    k = min(n, m)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(w[i, j] > 0 for i, j in got)
    best = max(sum(w[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert abs(sum(w[i, j] for i, j in got) - best) < 1e-8


def test_perfect_and_missed(spark):
    gt = [("v", f, 1, 0, 0, 10, 10) for f in range(5)]
    b, f = boxes(spark, gt), frames(spark, gt)
    (r,) = T.evaluate_tracking(b, b, f).collect()
    assert (r.fp, r.fn, r.idsw, r.fragmentation, r.mota, r.idf1, r.miss_rate) == (0, 0, 0, 0, 1.0, 1.0, 0.0)
    gap = boxes(spark, [x for x in gt if x[1] != 2])
    (r,) = T.evaluate_tracking(b, gap, f).collect()
    assert (r.fn, r.fragmentation, r.idsw) == (1, 1, 0) and r.idf1 == pytest.approx(8 / 9)


def test_switch_false_positive_and_sparse_labels(spark):
    gt = [("v", f, 1, 0, 0, 10, 10) for f in range(6)]
    f = frames(spark, gt)
    swap = boxes(spark, [("v", i, 7 if i < 4 else 8, 0, 0, 10, 10) for i in range(6)])
    (r,) = T.evaluate_tracking(boxes(spark, gt), swap, f).collect()
    assert r.idsw == 1 and r.idf1 == pytest.approx(4 / 6)
    extra = boxes(spark, gt + [("v", 0, 9, 500, 500, 5, 5), ("v", 100, 9, 0, 0, 5, 5)])
    (r,) = T.evaluate_tracking(boxes(spark, gt), extra, f).collect()
    assert (r.fp, r.num_pred) == (1, 8)
    empty_frame = f.unionByName(spark.createDataFrame([("v", 100)], "video_id string, frame_idx long"))
    (r,) = T.evaluate_tracking(boxes(spark, gt), extra, empty_frame).collect()
    assert r.fp == 2


def test_correspondence_is_kept_over_a_better_match(spark):
    gt = [("v", 0, 1, 0, 0, 10, 10), ("v", 1, 1, 0, 0, 10, 10)]
    pred = [("v", 0, 5, 0, 0, 10, 10), ("v", 1, 5, 2, 0, 10, 10), ("v", 1, 6, 0, 0, 10, 10)]
    (r,) = T.clear_mot(boxes(spark, gt), boxes(spark, pred), frames(spark, gt)).collect()
    assert (r.fp, r.fn, r.idsw) == (1, 0, 0)


def test_assign_equals_brute_force(spark):
    rng = random.Random(3)
    side = lambda n, base: [("v", f, base + t, rng.randint(0, 40), rng.randint(0, 20), 20, 20) for f in range(40) for t in range(rng.randint(0, n))]
    g, p = side(4, 0), side(4, 100)
    got = {}
    for r in T.assign(boxes(spark, g), boxes(spark, p), 0.3).collect():
        got.setdefault(r.frame_idx, []).append(r.iou)
    for f in range(40):
        a, b = ([x for x in s if x[1] == f] for s in (g, p))
        if not a or not b:
            assert f not in got
            continue
        m = T._pairs_of_frame(*(np.array([x[3:] for x in s], float) for s in (a, b)))
        k = min(m.shape)
        best = max((tuple(sorted((m[i, j] for i, j in zip(rows, cols)), reverse=True)) for rows in itertools.combinations(range(len(a)), k) for cols in itertools.permutations(range(len(b)), k)), key=sum)
        assert sum(got.get(f, [])) == pytest.approx(sum(x for x in best if x >= 0.3))


def test_report_rolls_up(spark):
    gt = [("a", f, 1, 0, 0, 10, 10) for f in range(4)] + [("b", f, 1, 0, 0, 10, 10) for f in range(2)]
    pred = boxes(spark, [x for x in gt if x[:2] != ("a", 0)])
    rows = {r.video_id: r for r in T.tracking_report(T.evaluate_tracking(boxes(spark, gt), pred, frames(spark, gt))).collect()}
    assert rows[None].num_gt == 6 and rows[None].fn == 1 and rows[None].miss_rate == pytest.approx(1 / 6) and rows[None].idf1 == pytest.approx((6 / 7 + 1) / 2)


def test_votes_and_boxes(spark):
    gt = [("v", f, t, 100 * t, 0, 10, 10) for f in range(10) for t in (1, 2)]
    pred = [("v", f, 11, 100 if f < 6 else 200, 0, 10, 10) for f in range(10)] + [("v", f, 12, 900, 0, 10, 10) for f in range(10)]
    got = {r.pred_id: r.gt_id for r in T.track_identities(boxes(spark, gt), boxes(spark, pred), frames(spark, gt)).collect()}
    assert got == {11: 1, 12: -1}
    b = boxes(spark, [("v", 0, 1, 0, 0, 10, 10), ("v", 0, 2, 0, 0, 10, 10), ("v", 0, 3, 0, 0, 5, 5)])
    assert [r.track_id for r in T.largest_box(b).collect()] == [1] and [r.track_id for r in T.surest_box(b).collect()] == [3]
    tracks = spark.createDataFrame([("v", 3)], "video_id string, track_id long")
    assert [r.track_id for r in T.largest_box(b, tracks=tracks).collect()] == [3]


def every_assignment(w):
    """(-total, partners by row, 99 for none) of the best assignment by trying all, the first of equals."""
    def go(i, used):
        if i == len(w):
            yield 0, ()
            return
        for j in [*[j for j in range(w.shape[1]) if w[i, j] > 0 and j not in used], 99]:
            for total, rest in go(i + 1, used | {j} - {99}):
                yield total - (w[i, j] if j != 99 else 0), (j, *rest)

    return min(go(0, set()))


def test_prices_prove_the_first_best_assignment():
    rng = np.random.default_rng(1)
    for t in range(600):
        n, m = rng.integers(0, 6, 2)
        w = rng.integers(0, [2, 4, 10, 1000][t % 4], (n, m)) * (rng.random((n, m)) < 0.8)
        pairs, a, b = priced_assignment(w)
        total, partners = every_assignment(w)
        assert sum(w[i, j] for i, j in pairs) == -total == a.sum() + b.sum()
        assert (a >= 0).all() and (b >= 0).all() and (a[:, None] + b[None] >= w).all()
        assert tuple(dict(pairs).get(i, 99) for i in range(n)) == partners, w


def test_proof_fails_for_a_worse_choice(spark):
    box = lambda t, x, y=0.0: (1, 0, t, x, y, 30.0, 30.0)
    names = "video_id long, frame_idx long, track_id long, x double, y double, w double, h double"
    gt = spark.createDataFrame([box(1, 0.0), box(2, 10.0), box(3, 500.0)], names)
    pred = spark.createDataFrame([box(11, 8.0), box(12, 20.0), box(13, 503.0), box(14, 900.0)], names)
    pairs, chosen = T.priced_pairs(gt, pred)
    good = T.assignment_proof(pairs, chosen).first()
    assert (good.n_pairs, good.broken) == (3, 0) and good.total == good.price > 0
    worse = chosen.withColumn("pred_id", F.expr("case pred_id when 11 then 12 when 12 then 11 else pred_id end"))
    worse = worse.drop("iou").join(pairs, ["video_id", "frame_idx", "gt_id", "pred_id"]).select(*chosen.columns)
    bad = T.assignment_proof(pairs, worse).first()
    assert bad.broken > 0
    less = T.assignment_proof(pairs, chosen.where("gt_id <> 3")).first()
    assert less.broken == 1 and T.assignment_proof(pairs, chosen.limit(0)).first().broken > 0
    assert T.assignment_proof(*T.priced_pairs(gt.limit(0), pred)).count() == 0


@pytest.mark.parametrize("tile", [7.0, T.TILE, None])
def test_pairs_by_tiles_equal_all_pairs(spark, tile):
    rng = np.random.default_rng(4)

    def side(n, first):
        out = [(1, f, first + i, *map(float, rng.uniform(-300, 900, 2)), *map(float, rng.uniform(-3, 60, 2))) for f in (0, 1) for i in range(n)]
        big = [(1, 0, first + n, -30_000.0, -30_000.0, 60_000.0, 60_000.0), (1, 0, first + n + 1, 25_000.0, 3.0, 40.0, 40.0), (1, 1, first + n + 2, 256.0, 256.0, 256.0, 256.0), (1, 1, first + n + 3, None, 1.0, 5.0, 5.0)]
        return out + big

    names = "video_id long, frame_idx long, track_id long, x double, y double, w double, h double"
    gt, pred = side(150, 0), side(140, 1000)
    got = {(r.frame_idx, r.gt_id, r.pred_id): r.iou for r in T.iou_pairs(spark.createDataFrame(gt, names), spark.createDataFrame(pred, names), tile=tile).collect()}
    want = {}
    for _, f, g, gx, gy, gw, gh in gt:
        for _, e, p, px, py, pw, ph in pred:
            if f == e and None not in (gx, px) and min(gw, gh, pw, ph) > 0:
                i = max(0.0, min(gx + gw, px + pw) - max(gx, px)) * max(0.0, min(gy + gh, py + ph) - max(gy, py))
                if i > 0:
                    want[f, g, p] = i / (gw * gh + pw * ph - i)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 100
