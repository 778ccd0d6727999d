import math
import random
from collections import Counter

from tidemark.llm import lm as L


def brute_corpus(texts, order=3, backoff=0.4):
    docs = [(t or "").encode().lower().split() for t in texts]
    c = Counter(tuple(d[i : i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    n = sum(map(len, docs))

    def after(past, x):
        if not past:
            return math.log(c[x,] / n)
        return math.log(c[*past, x] / c[past]) if c[*past, x] else math.log(backoff) + after(past[1:], x)

    return [(len(d), sum(after(tuple(d[max(0, i - order + 1) : i]), x) for i, x in enumerate(d))) for d in docs]


def query(spark, folder, rows):
    from tidemark.llm import registry

    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted(((r.doc_id, r.n_words, r.log_score, r.mean_score) for r in registry.QUERIES["op6_lm"](spark, str(folder)).collect()), key=str)


def same(got, ids, scores):
    want = sorted(((i, n, s, s / n if n else None) for i, (n, s) in zip(ids, scores)), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want):
        assert abs(a[2] - b[2]) < 2e-6 * max(1, abs(b[2])) and (a[3] is None) == (b[3] is None)


def test_query_scores_words_of_any_rarity(spark, tmp_path):
    """More words than the bounded model's vocabulary, most of them once; none share a symbol."""
    rare = [" ".join(f"w{j}" for j in range(i * 1000, i * 1000 + 1000)) for i in range(70)]
    texts = rare + ["w1", "w1 w2", "the w1 the w2 the", "the " * 5000, "w69999 w5", "w1", "W1 w2", None, "", " \n", "solo", "É É"]
    ids = [*range(len(texts) - 1), None]
    got = query(spark, tmp_path, list(zip(ids, texts)))
    same(got, ids, brute_corpus(texts))
    assert len({x for t in rare for x in t.split()}) > 1 / L.HEAVY_SHARE


def test_query_counts_single_bigrams_and_trigrams(spark, tmp_path):
    """Bigrams seen once are counted, and words after the same word are told apart by the one before it."""
    texts = ["a b c", "x b d", "x b d", "a b", "q r s t u"]
    ids = list(range(len(texts)))
    got = query(spark, tmp_path, list(zip(ids, texts)))
    same(got, ids, brute_corpus(texts))
    assert abs(got[4][2] - math.log(1 / sum(len(t.split()) for t in texts))) < 2e-6


def mixed(n=60):
    rng = random.Random(5)
    v = [f"w{i}" for i in range(40)] + ["É", "Ab", "aB"]
    texts = [" ".join(rng.choices(v, weights=[1 / (i + 1) for i in range(len(v))], k=rng.randint(0, 40))) for _ in range(n)] + [None, "", " \n", "solo", "a " * 20000]
    ids = list(range(len(texts))) + [3, 3, None]
    return ids, texts + [texts[3], "other text", texts[5]]


def test_frequent_ngrams_score_as_the_others(spark):
    """All n-grams of the sample counted ahead, some of them, or none: the same scores."""
    ids, texts = mixed()
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, gram int").repartition(3)
    for share, sample in ((1e-9, 1000), (0.005, 20), (2.0, 5)):
        got = sorted(((r.doc_id, r.n_words, r.log_score, r.mean_score) for r in L.score_corpus(df, share, sample).collect()), key=str)
        same(got, ids, brute_corpus(texts))
    assert L.score_corpus(df.limit(0)).count() == 0


def test_backoff_where_nothing_was_counted(spark):
    """Texts of another corpus: every order is reached, down to words that were never counted."""
    _, corpus = mixed()
    ids, texts = [1, 2, 3, 4, None, 1], ["w1 w2 w3 w0 w0", "new w1 new w39 w38 É ab", None, "", "w0", "w1 w2 w3 w0 w0"]
    docs = [(t or "").encode().lower().split() for t in corpus]
    c = Counter(tuple(d[i : i + k]) for d in docs for k in (1, 2, 3) for i in range(len(d) - k + 1))
    n = sum(map(len, docs))

    def word(past, x):
        if c[*past, x]:
            return math.log(c[*past, x] / (c[past] if past else n))
        return math.log(0.4) + word(past[1:], x) if past else math.log(0.4 / n)

    own = [(t or "").encode().lower().split() for t in texts]
    want = [(len(d), sum(word(tuple(d[max(0, i - 2) : i]), x) for i, x in enumerate(d))) for d in own]
    table = L.ngram_counts(spark.createDataFrame([(t,) for t in corpus], "text string"))
    got = L.score_with(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), table)
    same(sorted(((r.doc_id, r.n_words, r.log_score, r.mean_score) for r in got.collect()), key=str), ids, want)


def test_repeated_texts_stand_out(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 211}" for j in range(50))) for i in range(20)]
    rows.append((20, rows[4][1]))
    got = {r.doc_id: r.repeated for r in L.score_corpus(spark.createDataFrame([*rows, (21, "a b")], "doc_id long, text string")).collect()}
    assert got[4] == got[20] == 1.0 and got[21] is None and all(got[i] < 0.9 for i in range(20) if i != 4)


def test_statement_equals_query(spark, tmp_path):
    import duckdb

    from tidemark.llm import registry

    ids, texts = mixed()
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = registry.QUERIES["op6_lm"](spark, str(tmp_path))
    want = db.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE['op6_lm']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())
