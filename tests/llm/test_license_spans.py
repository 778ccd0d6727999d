"""Long templates, drift and order of the license scan; the query against its statement."""

import random

import duckdb

from tidemark.llm import licenses as L, registry

LONG = " ".join(f"t{i}" for i in range(100))
OWN = (("long", LONG, False), ("pair", "cc by", True), ("mit", next(t for label, t, _ in L.TEMPLATES if label == "mit"), False))


def labels(spark, texts, templates=L.TEMPLATES):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, round(r.score, 3)) for r in L.scan_licenses(df, templates=templates).orderBy("doc_id").collect()]


def test_templates_of_any_length(spark):
    w = LONG.split()
    some_lost = " ".join(x for i, x in enumerate(w) if i % 25)
    some_added = " ".join(y for i, x in enumerate(w) for y in ((x, "extra") if i % 30 == 7 else (x,)))
    got = labels(spark, [f"before {LONG} after", some_lost, some_added, " ".join(w[:70]), " ".join(reversed(w)), f"{' '.join(w[50:])} {' '.join(w[:50])}"], OWN)
    assert got[0] == ("long", 1.0) and got[1][0] == got[2][0] == "long" and got[1][1] < 1 and got[3:] == [("", 0.0)] * 3


def test_drift_is_bounded(spark):
    """A template with a filler word after every pair isn't found, however its diagonals follow one another."""
    mit = OWN[2][1].split()
    filled = " ".join(y for i, x in enumerate(mit) for y in ((x, "filler") if i % 2 else (x,)))
    got = labels(spark, [filled, " ".join(mit)], OWN)
    assert got == [("", 0.0), ("mit", 1.0)]


def test_pairs_count_in_text_order(spark):
    """Pairs near the diagonal that stand in the wrong order don't count."""
    template = " ".join(f"{a} {b}" for a, b in zip("abcdefghij", "klmnopqrst"))
    words = template.split()
    blocks = [words[i : i + 2] for i in range(0, 20, 2)]
    swapped = " ".join(x for i in range(0, 10, 2) for b in (blocks[i + 1], blocks[i]) for x in b)
    got = labels(spark, [template, swapped], (("x", template, False),))
    assert got == [("x", 1.0), ("", 0.0)]


def test_whole_licenses(spark):
    texts = [t.capitalize().replace(" the ", " the\n") for _, t, base in L.TEMPLATES[-4:]]
    got = labels(spark, texts)
    assert [set(g[0].split(",")) >= {label} for g, (label, _, _) in zip(got, L.TEMPLATES[-4:])] == [True] * 4 and all(g[1] == 1.0 for g in got)


def test_statement_equals_query(spark, tmp_path):
    rng = random.Random(7)
    parts = [t.split() for _, t, _ in L.TEMPLATES] + [["the", "of", "software"], ["cc", "by", "x"]]
    rows = []
    for i in range(120):
        w = [x for _ in range(rng.randint(0, 6)) for x in rng.choice(parts)]
        w = [y for x in w for y in ([] if rng.random() < 0.02 else [x, "zz"] if rng.random() < 0.02 else [x])]
        rows.append((i % 100 if i % 17 else None, " ".join(w), "s"))
    rows += [rows[3], rows[3], (7, None, "s"), (8, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, label string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = registry.QUERIES["op5_licenses"](spark, str(tmp_path))
    want = db.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE['op5_licenses']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect()) and len({r[6] for r in want}) > 5
