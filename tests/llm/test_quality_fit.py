"""The rows the quality classifier is fitted on, and the query by plain Python."""

from zlib import crc32

import numpy as np

from tests.llm.test_quality import corpus
from tidemark.llm import quality as Q


def trained(spark, monkeypatch, docs, labels, most):
    seen = {}

    def keep(rows, y):
        seen["rows"], seen["y"] = rows, y
        return train(rows, y)

    train = Q.train
    monkeypatch.setattr(Q, "train", keep)
    model = Q.fit_quality(docs, labels, most)
    monkeypatch.setattr(Q, "train", train)
    return model, seen


def test_repeated_ids_crowd_nobody_out(spark, monkeypatch):
    rows = corpus(60)
    again = [(7, rows[7][1] if i % 2 else f"{rows[7][1]} {i}", 9) for i in range(5000)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows] + again, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, rows[7][2])] * 300, "doc_id long, quality long")
    usable = [r for r in rows if crc32(str(r[0]).encode()) % 5]
    _, seen = trained(spark, monkeypatch, docs, labels, 1000)
    assert sorted(seen["y"]) == sorted(y for _, _, y in usable)
    _, seen = trained(spark, monkeypatch, docs, labels, 20)
    assert len(seen["y"]) == 20 and set(seen["y"]) == {0, 1}


def test_query_equals_scoring_text_by_text(spark, tmp_path):
    """Each row's score is that of its own text and n_chars under the fitted machine, pair by pair."""
    from tidemark.llm import registry

    rows = corpus(80)
    long = "word1 WORD2!! " * 40_000
    every = [(i, t, len(t), "en") for i, t, _ in rows] + [(None, "a b", None, None), (500, None, 3, "fr"), (501, "", 0, None), (502, long, len(long), "en"), (3, rows[3][1], 5, "en")]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in every], "doc_id long, text string, n_chars long, lang string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = Q.fit_quality(docs, labels)
    got = registry.QUERIES["op2_quality"](spark, str(tmp_path)).collect()

    def score(t, n):
        ids, x = model.row(*Q.features((t or "").encode(), n, Q.Buckets()))
        m = model.machine
        v = m.v[ids] * x[:, None]
        pairs = sum(float(v[i] @ v[:i].sum(axis=0)) for i in range(1, len(ids)))
        return 1 / (1 + np.exp(-(float(m.w0[0]) + float(m.w[ids] @ x) + pairs)))

    want = sorted(((str(i), i is not None and crc32(str(i).encode()) % 5 == 0, score(t, n)) for i, t, n, _ in every), key=lambda r: (r[0], r[2]))
    have = sorted(((str(r.doc_id), r.held_out, r.score) for r in got), key=lambda r: (r[0], r[2]))
    assert [r[:2] for r in have] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(have, want))
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
