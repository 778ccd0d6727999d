import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from tidemark.llm import sharding as S


def brute(rows, shards):
    """(id, size, crc, shard, slot) by one pass over the sorted rows."""
    made = sorted(((i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest()), i, (t or "").encode()) for i, t in rows)
    total = sum(len(t) + 1 for *_, t in made)
    out, before, slots = [], 0, Counter()
    for _, i, t in made:
        n = len(t) + 1
        shard = min(shards - 1, (2 * before + n) * shards // (2 * total))
        out.append((i, n, zlib.crc32(t), shard, slots[shard]))
        slots[shard] += 1
        before += n
    return out


ROWS = [(i, "é w" * (i * 7 % 23)) for i in range(400)] + [(None, None), (None, ""), (None, "x"), (7, "other"), (900, "z" * 50_000), (901, None)] + [(55, "same")] * 120


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in ROWS], "doc_id long, text string, shard string, slot int")


@pytest.mark.parametrize("shards", [3, 1000])
def test_equals_brute_force(docs, shards):
    got = S.assign_shards(docs, shards, split=50)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect()), key=key) == sorted(brute(ROWS, shards), key=key)


def test_partitioning_does_not_matter(docs):
    rows = lambda d: Counter(map(tuple, S.shard_table(d).collect()))
    assert rows(docs) == rows(docs.repartition(7)) and S.shard_table(docs.limit(0)).count() == 0


def test_balance_and_slots(spark):
    df = spark.range(800).selectExpr("id doc_id", "repeat('ab ', int(id % 90)) text")
    got = S.assign_shards(df, 8).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(8))
    first = sorted((r.doc_id, r.shard) for r in got)
    assert [s for _, s in first] == sorted(s for _, s in first)


def test_statement(spark, docs, tmp_path):
    docs.drop("shard", "slot").write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    out = S.shard_table(docs)
    want = c.execute(f"select {', '.join(out.columns)} from ({S.oracle()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_written_shards(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        S.write_shards(docs, str(tmp_path / "no"))
    df = docs.drop("shard", "slot").withColumn("n", docs.doc_id % 3)
    back = S.write_shards(df, str(tmp_path / "w"), 4, files=2)
    assert Counter((r.doc_id, r.text, r.n) for r in back.collect()) == Counter((r.doc_id, r.text, r.n) for r in df.collect())
    places = Counter((r.shard, r.slot) for r in back.collect())
    assert max(places.values()) == 1 and {s for s, _ in places} == {0, 1, 2, 3}
