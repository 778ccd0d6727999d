import random

import numpy as np

from tidemark.llm import quality as Q


def test_pair_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    fm = Q.FactorisationMachine(30, rank=4)
    fm.w, fm.w0[:] = rng.normal(size=30).astype(np.float32), 0.3
    rows = [(np.array([1, 4, 9]), np.array([0.5, -1.0, 2.0])), (np.array([7]), np.array([3.0])), (np.arange(30), rng.normal(size=30))]
    size = np.array([len(r[0]) for r in rows])
    got, _ = fm.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32), np.cumsum(size) - size)
    for (ids, x), y in zip(rows, got):
        want = fm.w0[0] + sum(fm.w[i] * a for i, a in zip(ids, x)) + sum(float(fm.v[ids[i]] @ fm.v[ids[j]]) * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert abs(y - want) < 1e-3


def test_features_of_odd_texts():
    b = Q.Buckets()
    for t in (b"", b" \n ", b"\xff\xfe", b"word", b"w " * 100000):
        ids, value, stats = Q.features(t, None, b)
        assert len(stats) == len(Q.STATS) and np.isfinite(stats).all() and len(ids) == len(value) == len(set(ids))
    assert Q.train([], []).score([Q.features(b"x y", 3, b)])[0] == 0.5


def corpus(n):
    rng = random.Random(4)
    v = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = [rng.choice(v) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        out.append((i, " ".join(w) if good else "!! ".join(x.upper() for x in w), int(good)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, len(t), "s") for i, t, _ in rows] + [(None, "abc", None, "s"), (5000, None, 7, "s"), (5001, "", None, "s"), (7, rows[7][1], len(rows[7][1]), "s")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (8, None), (3, rows[3][2])], "doc_id long, quality long")
    model = Q.fit_quality(docs, labels)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) >= 0.97 * len(held) > 100
    assert Q.score_quality(docs.limit(0), Q.fit_quality(docs, labels.limit(0))).count() == 0
