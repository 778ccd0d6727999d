import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def brute(rows, least=10, longest=3, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for p in pieces(text):
            total[lang or "und"] += len(p)
            for n in range(1, longest + 1):
                f.update((lang or "und", tuple(p[i : i + n])) for i in range(len(p) - n + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in often.items():
        if any(x == lang and len(v) > len(w) and 2 * b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in often.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


def rows(seed=3):
    rng = random.Random(seed)
    words = ["new", "York", "CITY", "é", "ß.", "a", "b", "c", "x,", "y\tz", "a:b", "ſ", "\x85", "to", "be"]
    out = [(" ".join(rng.choices(words, weights=range(15, 0, -1), k=rng.randrange(40))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    out += [(None, "en"), ("", None), ("the the the the " * 40, "en"), ("lorem ipsum dolor. " * 12, "fr"), ("q", "zz"), ("one two\nthree \t  four\x0bfive\r\n" * 11, "de")]
    return out + [("in spite of it", "en")] * 30


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(rows())], "doc_id long, text string, lang string, rank int")


@pytest.mark.parametrize("counters", [1 << 16, 64])
def test_equals_brute_force(docs, counters):
    """Also where nearly all counters are shared: they only add candidates."""
    got = C.collocations(docs, counters=counters).collect()
    assert sorted(map(tuple, got)) == brute(rows())


def test_longer_phrases_and_first_rows(docs):
    got = C.collocations(docs, min_count=5, max_words=4, top=3, counters=1 << 16).collect()
    assert sorted(map(tuple, got)) == brute(rows(), 5, 4, 3) and any(len(r.phrase.split(" ")) == 4 for r in got)


def test_statement(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(c.execute(f"select lang, rank, phrase, a, l, r, n, score from ({C.oracle()})").fetchall()) == brute(rows())


def test_empty_and_long(spark, docs):
    assert C.collocations(docs.limit(0), counters=1 << 10).count() == 0
    text = "alpha beta gamma " * 200_000 + "." + "w" * 1_000_000
    (x, y), *_ = [sorted((r.phrase, r.a) for r in C.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), counters=1 << 12).collect())[:2]]
    assert x == ("alpha beta gamma", 200_000) and y == ("beta gamma alpha", 199_999)


def test_bound_and_automaton():
    """No bound is below a count; overlapping matches count, also over shared delimiters."""
    p = C.Phrases([b"A a a a, a a\nb a a", b"", b"c"], "en", 3)
    assert p.words == 10
    every = {n: p.whole(n) for n in p.hashes}
    for n in (2, 3):
        every[n] &= every[n - 1][:-1] & every[n - 1][1:]
    assert {(n, w): c for n, w, c in zip(*p.counts(every), strict=True)} == {(1, b"a"): 8, (1, b"b"): 1, (1, b"c"): 1, (2, b"a a"): 5, (2, b"b a"): 1, (3, b"a a a"): 2, (3, b"b a a"): 1}
    assert C.Phrases([], "en", 3).words == 0 and C.Phrases([b" \n . "], "en", 3).words == 0
