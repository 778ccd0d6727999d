"""Groups that hold a large share of the rows, and rows of very different sizes."""

import random
from collections import Counter

import pytest

from tests.llm.test_warc import expected
from tests.llm.water import water_level
from tidemark.llm import mixing as M
from tidemark.llm import simhash as S
from tidemark.llm import warc as W


def test_repeated_rows_are_mixed_one_by_one(spark, monkeypatch):
    """A third of the rows are one row; whether they are written in one go or in several makes no difference."""
    rows = [(i, "w " * (i % 13 + 1), f"s{i % 3}") for i in range(300)] + [(7, "w " * 5, "s1")] * 200 + [(None, "a b", "s2")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    count = lambda: Counter((r.doc_id, r.size, r.copies) for r in M.mix(df).collect())
    whole = count()
    monkeypatch.setattr(M, "SPLIT", 16)
    assert count() == whole and sum(whole.values()) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target, taken = water_level(sizes), Counter()
    for r in M.mix(df, keep=["source"]).collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    out = Counter((r.doc_id, r.text) for r in M.emit(df, ["doc_id", "text", "source"]).collect())
    assert sum(out.values()) == sum(n * c for (_, _, c), n in whole.items())
    assert sum(out[7, t] for t in {t for i, t in out if i == 7}) == sum(n * c for (i, _, c), n in whole.items() if i == 7)


def test_rows_that_differ_in_text_only(spark):
    rows = [(1, f"{x} y z", "s") for x in "abcab"] + [(2, None, "s"), (2, "", "s"), (None, "q", None), (None, "q", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    got = M.emit(df, ["doc_id", "text", "source"]).collect()
    sizes, taken, out, have = Counter(), Counter(), Counter(map(tuple, got)), Counter(rows)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        taken[r.source] += len((r.text or "").split())
    assert {r[:3] for r in out} <= have.keys() and all(n <= have[r[:3]] for r, n in out.items())
    assert all(abs(taken[s] - x) <= 3 for s, x in water_level(sizes).items())


def test_many_sources(spark):
    """Order, weights and levels of sources that no one task holds."""
    rng = random.Random(4)
    sizes = {f"host{rng.randrange(10**6)}": rng.randint(0, 50) for _ in range(3000)} | {None: 7, "": 3}
    got = {r.source: r for r in M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes)
    assert all(got[s].ordinal == i + 1 and got[s].source_size == sizes[s] and got[s].target == pytest.approx(want[s]) for i, s in enumerate(names))


def test_archive_files_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_CLASSES", ((1000, 20), (10_000, 3), (None, 1)))
    rows = [(i, f"u{i}", f"{i}:" + "x" * n) for i, n in enumerate([5] * 70 + [4000] * 10 + [60_000, 90_000, 3_000_000])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    W.write_archives(df, f"{tmp_path}/w")
    files = [f for f in (tmp_path / "w").rglob("*.txt")]
    assert max(f.read_bytes().count(b"WARC-Type: response") for f in files) <= 20
    assert all(f.stat().st_size < 20 * 2000 or f.read_bytes().count(b"WARC-Type: response") <= 3 for f in files) and len(files) >= 70 // 20 + 10 // 3 + 3
    assert sorted((tuple(r) for r in W.capture_digest(W.assemble(W.read_archives(spark, f"{tmp_path}/w"))).collect()), key=str) == expected(rows)


def test_one_fingerprint_of_many_rows(spark):
    rows = [(i, "the same few words in every row") for i in range(1500)] + [(2000 + i, f"text number {i} of {i * i} others {i * 7}") for i in range(1500)]
    got = {r.doc_id: r for r in S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 3000 and {got[i].component_id for i in range(1500)} == {0} and all(got[i].component_id >= 2000 for i in got if i >= 2000)


def test_kept_row_of_equal_ids_and_texts_follows_its_columns(spark):
    rows = [(1, "a b c", lang, k) for lang, k in (("x", 1), ("y", 2), (None, 3), ("y", 2))]
    kept = {tuple(S.keep_one(spark.createDataFrame(rows[i:] + rows[:i], "doc_id long, text string, lang string, h long").repartition(i + 1)).first()) for i in range(4)}
    assert len(kept) == 1 and kept <= set(rows)
