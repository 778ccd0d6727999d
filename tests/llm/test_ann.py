import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann as A


def brute(ids, v, queries, k):
    out = []
    for q in queries:
        s = A.cosine(v, np.broadcast_to(v[ids.index(q)], v.shape))
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(order)]
    return sorted(out)


def test_beam_search_beats_greedy_and_norms_are_exact():
    rng = np.random.default_rng(0)
    x = A.unit(rng.normal(size=(600, 16)))
    books = A.fit(x, books=4, words=16)
    greedy, _ = A.encode(x, books, beam=1)
    codes, norms = A.encode(x, books, beam=8)
    made = lambda c: sum(books[b][c[:, b]] for b in range(4))
    err = lambda c: ((x - made(c)) ** 2).sum()
    assert err(codes) <= err(greedy) < (x * x).sum()
    assert np.allclose(norms, np.sqrt((made(codes) ** 2).sum(1)), atol=1e-5)


def test_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(2)
    got = {(r.query_id, r.vec_id) for r in A.search(spark, df, F.col("vec_id") % 100 == 0).collect()}
    want = {(a, c) for a, _, c, _ in brute(list(range(6000)), v.astype(float), range(0, 6000, 100), 5)}
    assert len(got & want) >= 0.9 * len(want)


def test_small_tables_are_exact(spark):
    good = [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(0, 40)]
    bad = [(50, None), (100, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (150, [1.0, None, 0.0]), (200, [float("nan"), 1.0, 1.0]), (250, [float("inf"), 1.0, 1.0]), (300, []), (350, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in A.search(spark, df, F.col("vec_id") % 10 == 0, block=3).collect())
    ids, v = [i for i, _ in good], np.array([x for _, x in good])
    assert got == brute(ids, v, [0, 10, 20, 30], 5)
    assert A.search(spark, df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in A.search(spark, two, F.col("vec_id") == 0).collect()] == [1, 1]


def test_copies_and_near_copies_of_a_third_are_exact(spark):
    """A third of the rows are one vector or nearly it, so far more than are reranked have a query's codes."""
    rng = np.random.default_rng(3)
    n = 6000
    v = rng.normal(size=(n, 12))
    same = rng.permutation(n)[: n // 3]
    v[same] = v[same[0]]
    v[same[: n // 6]] += rng.normal(size=(n // 6, 12)) * 1e-5
    ids = [int(i) for i in rng.permutation(n)]
    df = spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id long, embedding array<double>").repartition(2)
    want = brute(ids, v, range(0, n, 100), 5)
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    old = conf.get(key)
    try:
        for rows in (old, "512"):
            conf.set(key, rows)
            assert sorted(tuple(r) for r in A.search(spark, df, F.col("vec_id") % 100 == 0).collect()) == want
    finally:
        conf.set(key, old)


def test_slices_do_not_follow_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 30), (30, 31))]
    got = [p.column("x").to_pylist() for p in A._slices(batches, 8)]
    assert [len(x) for x in got] == [8, 8, 8, 7] and sum(got, []) == list(range(31))
