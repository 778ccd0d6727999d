import re
from collections import Counter

import duckdb
import pytest

from tests.llm.water import water_level
from tidemark.llm import licenses as L
from tidemark.llm import mixing as M

LICENSES = [
    (1, "Licensed under CC BY-NC 4.0."), (2, "CC\nBY cc-by Cc by"), (3, None), (4, ""), (5, "cc"), (6, "GNU General Public License; all rights reserved!"),
    (7, "Permission is hereby granted, free of charge, to any very person obtaining a copy of this software"), (8, "permission is hereby granted free of charge"),
    (9, "éall rights reserved all rights reserved"), (10, "x " * 50000 + "All Rights Reserved"), (2, "CC\nBY cc-by Cc by"), (None, "cc by"), (None, None), (2, "other cc by"),
    (11, "cc by cc cc by"), (12, "this is free and unencumbered software released into the public domain " * 3),
]


def test_licenses_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in LICENSES], "doc_id long, text string, label int")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(df).collect()), key=str)
    want = []
    for i, t in LICENSES:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for label, p, base in L.TEMPLATES if base for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=str)
    by = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    assert by[7].labels == "mit" and 0.8 <= by[7].score < 1 and by[8].labels == "" and by[12].labels == "public-domain" and by[1].labels == "cc-by,cc-by-nc"
    assert L.scan_licenses(df.limit(0)).count() == 0


@pytest.fixture
def mixed(spark):
    rows = [(i, "w " * (i % 17), ["b", "a", "é", None, "B"][min(4, i % 9)], 1) for i in range(600)] + [(1, None, "a", 1), (1, None, "a", 1), (None, "x y", "only", 1), (9000, "z " * 4000, "big", 1), (9001, "", "empty", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mixing(spark, mixed):
    rows, df = mixed
    got = M.mix(df, keep=["source"]).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    target = water_level(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.taken == r.size * r.copies <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= max(40, 4000 * (s == "big")) for s in target)
    again = M.mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert M.mix(df.limit(0)).count() == 0


def test_sql_agrees_on_odd_rows(spark, mixed, tmp_path):
    rows, df = mixed
    lic = spark.createDataFrame([(i, t, "s") for i, t in LICENSES], "doc_id long, text string, source string")
    for table, query, sql in ((df, lambda d: M.mix(d).drop("copies"), M.oracle()), (lic, L.scan_licenses, L.oracle())):
        path = str(tmp_path / sql[:0]) + str(abs(hash(sql)))
        table.write.parquet(path)
        c = duckdb.connect()
        c.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
        out = query(table)
        r = c.execute(f"select {', '.join(out.columns)} from ({sql})").fetchall()
        assert sorted(map(str, r)) == sorted(str(tuple(x)) for x in out.collect())
