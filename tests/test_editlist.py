import random

import pytest

from tidemark.operators import editlist as E

CLIP = "plan_id long, block_idx int, clip_ord int, source string, t0 double, t1 double"
BLOCK = "plan_id long, block_idx int, transition string, speed double"


@pytest.fixture
def edits(spark):
    clips = [(1, 0, 0, "a", 2.0, 4.0), (1, 0, 1, "b", 0.0, 3.0), (1, 1, 0, "a", 10.0, 12.0), (1, 1, 1, "a", 3.0, 5.0), (1, 3, 0, "c", 0.0, 1.0), (1, 3, 1, "c", 5.0, 5.0), (2, 0, 0, "a", 1.0, 2.0)]
    blocks = [(1, 0, "xfade", 1.0), (1, 1, "cut", 2.0), (1, 2, "cut", 1.0), (1, 3, None, None), (2, 0, "xfade", 0.5)]
    return E.edit_list(spark.createDataFrame(clips, CLIP), spark.createDataFrame(blocks, BLOCK))


def test_edit_list(edits):
    got = sorted((r.plan_id, r.block_idx, r.clip_ord, r.fade, r.out_start, r.out_end) for r in edits.collect())
    assert got == [(1, 0, 0, 0.0, 0.0, 2.0), (1, 0, 1, 0.5, 1.5, 4.5), (1, 1, 0, 0.0, 4.5, 5.5), (1, 1, 1, 0.0, 5.5, 6.5), (1, 3, 0, 0.0, 6.5, 7.5), (2, 0, 0, 0.0, 0.0, 2.0)]
    assert sorted(tuple(r) for r in E.block_times(edits).collect()) == [(1, 0, 0.0, 4.5), (1, 1, 4.5, 6.5), (1, 3, 6.5, 7.5), (2, 0, 0.0, 2.0)]


def test_points_both_ways(spark, edits):
    points = spark.createDataFrame([(1, "a", 3.0), (1, "a", 4.0), (1, "a", 11.0), (1, "b", 9.0), (2, "a", 1.5), (3, "a", 1.5), (1, "c", 0.0)], "plan_id long, source string, t double")
    got = sorted((r.plan_id, r.source, r.t, r.at) for r in E.to_output(points, edits).collect())
    assert got == [(1, "a", 3.0, 1.0), (1, "a", 3.0, 5.5), (1, "a", 4.0, 6.0), (1, "a", 11.0, 5.0), (1, "c", 0.0, 6.5), (2, "a", 1.5, 1.0)]
    at = spark.createDataFrame([(1, x) for x in (0.0, 1.5, 1.75, 2.0, 5.0, 7.49, 7.5)], "plan_id long, at double")
    got = sorted((r.at, r.source, round(r.t, 6), round(r.share, 6)) for r in E.to_source(at, edits).collect())
    assert got == [(0.0, "a", 2.0, 1.0), (1.5, "a", 3.5, 1.0), (1.5, "b", 0.0, 0.0), (1.75, "a", 3.75, 0.5), (1.75, "b", 0.25, 0.5), (2.0, "b", 0.5, 1.0), (5.0, "a", 11.0, 1.0), (7.49, "c", 0.99, 1.0)]


def test_the_map_is_its_own_inverse(spark):
    rng = random.Random(3)
    clips = [(p, b, i, rng.choice("xy"), float(s := rng.randrange(60)), s + rng.choice((0.6, 2.0, 31.0))) for p in range(6) for b in range(3) for i in range(rng.randrange(4))]
    blocks = [(p, b, rng.choice(("xfade", "cut", None)), rng.choice((1.0, 0.5, 2.0, None))) for p in range(6) for b in range(3)]
    edits = E.edit_list(spark.createDataFrame(clips, CLIP), spark.createDataFrame(blocks, BLOCK))
    at = spark.createDataFrame([(p, rng.random() * 120) for p in range(6) for _ in range(40)], "plan_id long, at double")
    there = E.to_source(at, edits)
    shares = there.groupBy("plan_id", "at").sum("share").collect()
    assert shares and all(abs(r[2] - 1) < 1e-9 for r in shares)
    back = E.to_output(there.select("plan_id", "source", "t", there.at.alias("was"), there.block_idx.alias("b0"), there.clip_ord.alias("c0")), edits)
    back = back.where("b0 = block_idx and c0 = clip_ord").collect()
    assert len(back) == there.count() and all(abs(r.at - r.was) < 1e-9 for r in back)


def test_boxes_and_overlays(spark, edits):
    boxes = spark.createDataFrame([("a", 90, 7), ("b", 15, 8), ("z", 1, 9)], "source string, frame_idx long, x int")
    assert sorted((r.plan_id, r.x, r.at) for r in E.boxes_in_output(boxes, edits).collect()) == [(1, 7, 1.0), (1, 7, 5.5), (1, 8, 2.0)]
    plans = spark.createDataFrame([(1, "제목", True), (2, None, None), (3, "no clips", True)], "plan_id long, title string, voice boolean")
    captions = spark.createDataFrame([(1, 0, "hello", "auto", [0.5, 1.0]), (1, 1, "x" * 60, "left", None), (1, 2, "no clips", None, None), (1, 3, "", None, None), (2, 0, None, None, None)], "plan_id long, block_idx int, caption string, caption_pos string, caption_span array<double>")
    got = sorted((r.plan_id, r.kind, r.pos, r.start, r.end, r.fade, r.hurried) for r in E.overlays(plans, captions, edits).collect())
    assert got == [(1, "badge", "top-right", 0.0, 7.5, 0.0, False), (1, "caption", "bottom", 2.25, 4.5, 0.25, False), (1, "caption", "left", 4.5, 6.5, 0.25, True), (1, "notice", "top-right", 0.0, 7.5, 0.0, False), (1, "title", "top", 0.0, 4.5, 0.25, False), (2, "badge", "top-right", 0.0, 2.0, 0.0, False)]


def test_a_block_ends_where_the_next_begins(spark):
    clips = [(1, 0, 1, "a", 26.0, 26.0 + 0.6 + 2 / 10), (1, 0, 2, "a", 13.0, 13.0 + 0.6 + 1 / 10), (1, 2, 7, "a", 41.0, 44.9), (2, 0, 1, "a", 13.0, 13.0 + 0.6 + 38 / 10), (2, 0, 2, "b", 45.0, 45.0 + 0.6 + 19 / 10), (2, 0, 3, "b", 43.0, 43.0 + 0.6 + 25 / 10), (2, 1, 4, "b", 1.0, 2.0)]
    blocks = [(1, 0, "xfade", 1.25), (1, 2, "cut", 1.25), (2, 0, "cut", 1.25), (2, 1, "cut", 1.0)]
    edits = E.edit_list(spark.createDataFrame(clips, CLIP), spark.createDataFrame(blocks, BLOCK))
    rows = sorted(tuple(r) for r in E.block_times(edits).collect())
    assert all(a[3] == b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])  # to the last bit
    c = spark.createDataFrame([(1, 0, "x", None, [0.25, 0.5])], "plan_id long, block_idx int, caption string, caption_pos string, caption_span array<double>")
    shown = E.overlays(spark.createDataFrame([(1, None, False)], "plan_id long, title string, voice boolean"), c, edits).where("kind = 'caption'").first()
    assert shown.fade == 0.05
