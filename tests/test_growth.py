"""Steps whose time or memory once grew faster than their input."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.operators import plan as plans
from tidemark.plans import catalog
from tidemark.sources import records as R
from tidemark.streaming import live


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_clusters_by_blocks_equal_one_by_one():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[150:170] = v[:20]  # equal ones, beyond a block's end
    frames = [set(rng.integers(0, 60, 2).tolist()) if i % 3 else set() for i in range(300)]
    c, got = I._Clusters(0.9, 4), []
    for at in range(0, 300, I.BLOCK):
        got += c.block(v[at : at + I.BLOCK], frames[at : at + I.BLOCK])
    means, sizes, held, want = [], [], [], []
    for x, f in zip(v, frames, strict=True):
        sims = [m @ x if not h & f else -2.0 for m, h in zip(means, held, strict=True)]
        i = int(np.argmax(sims)) if sims else -1
        if sims and sims[i] >= 0.9:
            m = means[i] * sizes[i] + x
            means[i], sizes[i], held[i] = m / (np.linalg.norm(m) + I.EPS), sizes[i] + 1, held[i] | f
            want.append((i, True))
        else:
            means, sizes, held = [*means, x], [*sizes, 1], [*held, set(f)]
            want.append((len(means) - 1, False))
    assert [(i, joined) for i, _, joined in got] == want


def test_links_are_clustered_once_for_a_report(spark):
    assert _plan(catalog.QUERIES["relink_report"](spark, "/root/testdata/sf0.001")).count("FlatMapGroupsInPandas") == 1


def test_taps_equal_brute_force_without_pairs_of_tracks(spark):
    rng = random.Random(4)
    rows = [(0, t, rng.randrange(3), [rng.gauss(0, 1), rng.gauss(0, 1)], rng.choice([None, [], [rng.randrange(-70, 400) for _ in range(3)]])) for t in range(60)]
    got = {r.gt_id: (r.taps, r.false_attach) for r in I.anchor_taps(spark.createDataFrame(rows, "video_id long, track_id long, gt_id long, v array<double>, frames array<long>"), 0.6).collect()}
    rows.sort(key=lambda r: (not r[4], min(r[4] or [0]), r[1]))
    for d in range(3):
        total, seen, taps = np.zeros(2), set(), 0
        for r in (r for r in rows if r[2] == d):
            f = set(r[4] or [])
            taps += not (total.any() and np.dot(r[3], total) / (np.linalg.norm(total) + I.EPS) >= 0.6 and not seen & f)
            total, seen = total + r[3], seen | f
        wrong = sum(np.dot(r[3], total) / (np.linalg.norm(total) + I.EPS) >= 0.6 and not seen & set(r[4] or []) for r in rows if r[2] != d)
        assert got[d] == (taps, wrong)
    assert not hasattr(I, "_sharing")


def test_references_are_no_part_of_the_plan(spark):
    v = spark.range(2000).selectExpr("id track_id", "array(cos(id), sin(id)) v")
    out = I.reference_similarity(v, v, ["track_id"])
    assert len(_plan(out, "optimizedPlan")) < 20_000 and out.where("abs(sim - 1) < 1e-9").count() == 2000


def test_later_donors_are_met_by_those_without_an_earlier_one(spark):
    rows = [("t", f"d{i:02}", [0.0, 1.0], [1.0, 0.0], i) for i in range(99)] + [("t", "d99", [1.0, 0.0], [1.0, 0.0], 99)]
    rows += [("", "a", [1.0, 0.1], [1.0, 0.0], 0), ("", "b", [0.1, 1.0], [1.0, 0.0], 0), ("", "none", [0.0, 0.0], [1.0, 0.0], 0), ("", "other", [-1.0, 0.0], [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "tag string, video_id string, scene_vec array<double>, audio_vec array<double>, ord long").selectExpr("*", "1 as k")
    out = I.propagate_tags(df, df.where("tag = 't'").select("tag", "video_id", "ord", "k"), ["k"])
    assert sorted((r.video_id, r.donor) for r in out.collect()) == [("a", "d99"), ("b", "d00")]


def test_small_negative_numbers_keep_their_sign(spark, tmp_path):
    spark.createDataFrame([(1, [-1e-8, 1e-8, -0.25], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert str(catalog.QUERIES["npz_from_files"](spark, str(tmp_path)).first().embedding) == "[-0.0, 0.0, -0.25]"


def test_long_words_are_cut_in_linear_time():
    from tidemark.functions import text as T

    got = T._wrapped("x" * 1_000_000 + " y", 13.2 * 25, 13.2, [])
    assert len(got) == 40_001 and got[-1] == "y" and "".join(got[:-1]) == "x" * 1_000_000 and {len(x) for x in got[:-1]} == {25}
    wide = T._wrapped("ab" * 5, 40.0, 10.0, [(T.re.compile("b"), 5.0)])
    assert wide == ["aba", "bab", "aba", "b"] or all(10 * len(x) + 5 * x.count("b") <= 40 for x in wide)


def test_profiles_are_rounded_as_their_statement_rounds(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # dark means of 0.545 and 0.575, a luma of exactly 0.45, and values whose plain sum depends on their order
    digits = [9] * 9 + [8] + [2] * 10, [9] * 10 + [7] + [2] * 9, [5] * 20, [1] * 20
    digits = [[*d] for d in digits]
    digits[0][-1] += 109 - sum(digits[0])
    digits[1][-1] += 115 - sum(digits[1])
    values = [10.01] * 20, [20.02] * 20, [1.35] * 20, [1e6, 0.1, -1e6] * 6 + [0.35, 0.2]
    rows = [(1000 * u + 10 * i + d, u, v) for u in range(4) for i, (d, v) in enumerate(zip(digits[u], values[u], strict=True))]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.connect().execute(catalog.ORACLE["luma_profile"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["luma_profile"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {0.55, 0.57} <= {r[2] for r in got}


def test_profiles_of_frames_without_a_dark_fraction_and_of_huge_values(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    videos = [
        [(None, 300.0), (9, 300.0)],  # half of its frames are dark, not more
        [(None, 300.0), (9, 300.0), (8, 300.0)],
        [(None, 300.0), (None, 100.0)],
        [(1, None), (9, None)],
        [(9, None), (9, None)],
        [(1, 1e304)],
        [(1, 1e303), (2, -1e303), (3, 900.0)],
        [(1, 1.7e308), (2, 1.7e308)],
        [(1, 1e307), (2, None), (None, None)],
    ]
    rows = [(e, u, v) for u, frames in enumerate(videos) for e, v in frames]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.connect(config={"threads": 1}).execute(catalog.ORACLE["luma_profile"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["luma_profile"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("name", ["segments_from_files", "actions_from_files", "matches_from_files"])
def test_files_of_segments_are_no_more_than_tasks(spark, name):
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").cache()
    assert out.select("video_id").distinct().count() > 8 >= len(out.inputFiles())


def test_documents_a_line_and_a_file_are_read_alike(spark, tmp_path):
    docs = {"7": [{"start_t": 0.0, "end_t": 2.0, "label": "걷기"}, {"start_t": 2.0, "end_t": 3.5, "label": "a\nb"}], "v": []}
    for v, s in docs.items():
        (tmp_path / f"{v}_m3.json").write_text(json.dumps({"segments": s}, indent=1))
    R.write_json(spark.createDataFrame([(v, [tuple(x.values()) for x in s]) for v, s in docs.items()], f"video_id string, {R.SEGMENTS}"), str(tmp_path / "lines"), by=None)
    one, many = (sorted(map(tuple, R.read_segments(spark, p, **k).collect())) for p, k in ((str(tmp_path / "*_m3.json"), {}), (str(tmp_path / "lines"), {"suffix": None})))
    assert one == many == [("7", 0, 0.0, 2.0, "걷기"), ("7", 1, 2.0, 3.5, "a\nb")]
    for bad in ('{"video_id": "x"}', '{"video_id": "x", "segments": ['):
        (tmp_path / "bad.json").write_text(bad + "\n")
        with pytest.raises(Exception):
            R.read_segments(spark, str(tmp_path / "bad.json"), suffix=None).collect()


def test_reservation_sorts_and_shuffles_by_plan_only(spark):
    rows = _plan(catalog.QUERIES["source_reservation"](spark, "/root/testdata/sf0.001")).split("BroadcastExchange")[0].splitlines()
    assert not [r for r in rows if ("Sort [" in r or "hashpartitioning" in r) and "source#" in r]


def test_sources_kept_by_plan_are_those_kept_by_a_window(spark):
    rng = random.Random(7)
    names, words = [*"abcd", None], ["x", "xy", "zz", "q"]
    b = [(p, i, rng.choice([[], [rng.choice(names)], ["a", "b"], None]), rng.choice([[], ["x"], ["xy", "zz"], ["q", ""], None])) for p in range(60) for i in range(4)]
    s = [(p, x, i) for p in range(58) for i, x in enumerate(names)]
    blocks = spark.createDataFrame(b, "plan_id long, block_idx int, sources array<string>, keywords array<string>")
    args = blocks, spark.createDataFrame(s, "plan_id long, source string, src_ord int"), spark.createDataFrame([("a", "x"), ("b", "xyz"), ("c", "z")], "source string, tag string")
    got, want = (sorted(map(str, df.collect())) for df in (plans.allowed_sources(*args), plans.reserve(plans.block_sources(*args))))
    assert got == want and got


def test_joined_streams_neither_count_their_state_nor_copy_it(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.rocksdb"
    spark.range(9).selectExpr("id % 3 k", "timestamp_seconds(id) ts").write.parquet(f"{tmp_path}/in")
    stream = live.stream_sessions(spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/in"), "k", "ts", "10 seconds", "1 hour")
    with live.joined_state(spark):
        assert spark.conf.get(f"{key}.trackTotalNumberOfRows") == "false" and spark.conf.get(f"{key}.changelogCheckpointing.enabled") == "true"
        run = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] == 3
    assert list(tmp_path.glob("state/state/**/*.changelog")) and not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_answers_are_parsed_once(spark):
    rows = _plan(catalog.QUERIES["clean_plans"](spark, "/root/testdata/sf0.001"), "optimizedPlan")
    assert rows.count("parseJson") == 1 and rows.count("regexp_replace") <= 4  # title, captions, narration, texts


@pytest.mark.parametrize("name", ["clean_plans", "default_plans", "plan_checks"])
def test_plans_in_one_row_group_are_dealt_to_all_cores(spark, tmp_path, name):
    parts = spark.range(4000).selectExpr("id p_partkey", "concat('part ', id) p_name", "'LARGE' p_type", "cast(id % 50 + 1 as int) p_size")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = catalog.QUERIES[name](spark, str(tmp_path))
    tasks = {r.t: r["count"] for r in out.groupBy(F.spark_partition_id().alias("t")).count().collect()}
    assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(tasks.values()) == 4000 and max(tasks.values()) < 4000 / 2


def test_odd_answers_are_read_in_one_go_as_field_by_field(spark):
    odd = [{"title": {"a": 1}, "voice": "yes", "blocks": [{"sources": {"x": 1}, "caption": 3, "keywords": [None, [1]], "caption_span": ["x", 1]}, [], "b"]}, {"Title": "t", "blocks": {"caption": "c"}, "texts": [{"blocks": 1.7}, {"blocks": "x", "span": None}]}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(odd)] + [(2, '{"title": "a", "title": "b"}')], "i long, a string")
    a, b, c = (r.p for r in df.select("i", plans.raw_plan(F.col("a")).alias("p")).orderBy("i").collect())
    assert (a.title, a.voice, [x.caption for x in a.blocks]) == ('{"a":1}', True, ["3", None, None])
    assert (a.blocks[0].sources, a.blocks[0].keywords, a.blocks[0].caption_span) == (['{"x":1}'], [None, "[1]"], [None, 1.0])
    assert (b.title, b.blocks, [(t.blocks, t.span) for t in b.texts]) == (None, None, [([1], None), (None, None)])
    assert (c.title, c.voice, c.blocks, c.texts) == (None, None, None, None)
