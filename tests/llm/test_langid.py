import random
from zlib import crc32

import numpy as np

from tidemark.llm import langid as L


def test_gradient_is_the_slope():
    net = L.BiGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq, label = np.array([[97, 98, 99, 97], [120, 97, 98, 195]], np.uint8), np.array([2, 0])
    old = np.float32
    np.float32 = np.float64
    try:
        _, g = net.gradient(seq, label)
        for k in net.p:
            for at in [(97, 5), (3, 7), (0, 1), (1,), (2, 0)]:
                if len(at) != net.p[k].ndim or any(a >= s for a, s in zip(at, net.p[k].shape)):
                    continue
                keep = net.p[k][at]
                net.p[k][at] = keep + 1e-5
                up, _ = net.gradient(seq, label)
                net.p[k][at] = keep - 1e-5
                down, _ = net.gradient(seq, label)
                net.p[k][at] = keep
                assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5, (k, at)
    finally:
        np.float32 = old


def test_windows_label_every_position_once():
    """The sums are those of running each window by itself; texts don't see each other."""
    net = L.BiGRU(2)
    texts = [b"Abc abc, xyz \xc3\xa9t\xc3\xa9 " + b"q" * 80, b"abc", b"", b"12 34 !!", "—…".encode(), "é".encode(), b"x" * 20, b"the end " * 40]
    reader = L.Reader(net, ["a", "b"], window=10, context=4)
    got = reader.read(texts)
    assert [g[0] for g in got[2:5]] == ["und"] * 3 and got[5][0] != "und"
    for text, sums in zip(texts, reader.pooled(texts)):
        want, low = np.zeros(2), text.lower()
        for i in range(0, len(low), 10):
            window = bytes(low[k] if 0 <= k < len(low) else 0 for k in range(i - 4, i + 14))
            p = net.positions(np.frombuffer(window, np.uint8)[None])[4:14, 0]
            want += sum((p[k] for k in range(10) if L._LETTER[window[k + 4]]), np.zeros(2))
        assert np.allclose(sums, want, atol=1e-4)
        assert abs(sums.sum() - sum(97 <= b < 123 or b >= 128 for b in low)) < 1e-3
    assert [g == h for g, h in zip(got, [reader.read([t])[0] for t in texts])].count(False) == 0 or all(abs(g[1] - reader.read([t])[0][1]) < 1e-5 for g, t in zip(got, texts))


PARTS = {"aa": ["the", "ing", "tion", "wh", "th"], "bb": ["sch", "ung", "keit", "ein", "ü"], "cc": ["eau", "oi", "elle", "é", "que"]}


def world(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        rows.append((i, " ".join("".join(rng.choices(PARTS[lang], k=3)) for _ in range(12)), lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = world(400)
    long = " ".join(["einsch keitung"] * 20_000)
    odd = [(None, "thing", "aa"), (900, None, "aa"), (901, "", None), (902, "12 !?", "bb"), (5, rows[5][1], rows[5][2]), (904, long, None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    net, langs = L.fit_langid(docs)
    assert langs == ["aa", "bb", "cc"]
    got = {}
    for r in L.identify(docs, net, langs).collect():
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1)
        got.setdefault(r.doc_id, r)
    assert len(got) == 405 and got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[904].lang_pred == "bb"
    held = [i for i, _, _ in rows if got[i].held_out]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held) > 80
    none, no_langs = L.fit_langid(docs.limit(0))
    assert no_langs == [] and {r.lang_pred for r in L.identify(docs, none, no_langs).collect()} == {"und"}


def test_repeated_ids_crowd_nobody_out(spark):
    """An id repeated thousands of times, with one text or with many, counts once; every language is learned."""
    rows = world(90)
    again = next(r for r in rows if crc32(str(r[0]).encode()) % 3 != 1)
    many = [(again[0], again[1] if i % 2 else f"{again[1]} {i}", again[2]) for i in range(3000)]
    docs = spark.createDataFrame(rows + many, "doc_id long, text string, lang string")
    ids = L.training_ids(docs, 10).collect()
    per = {k: [r.doc_id for r in ids if r.lang == k] for k in PARTS}
    assert all(5 < len(v) <= 10 and len(set(v)) == len(v) for v in per.values())
    assert len(L.training_ids(docs, 300).collect()) == sum(crc32(str(r[0]).encode()) % 3 != 1 for r in rows)
    net, langs = L.fit_langid(docs)
    assert langs == ["aa", "bb", "cc"]
    held = [r for r in rows if crc32(str(r[0]).encode()) % 3 == 1]
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, net, langs).collect()}
    assert sum(got[i] == lang for i, _, lang in held) >= 0.95 * len(held)
