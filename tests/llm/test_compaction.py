import hashlib
import random
import zlib

import duckdb
import pytest

from tidemark.llm import compaction as C


def greedy(rows, capacity):
    """{(by, a, b): (first a, first b)} file by file."""
    out, last, held, first = {}, None, 0, None
    for by, a, b, n in sorted(rows):
        if by != last or held + n > capacity:
            last, held, first = by, 0, (a, b)
        held += n
        out[by, a, b] = first
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_next_fit(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", i, rng.randrange(3), rng.choice((0, 0, 1, 7, 20, 60, 99, 100, 101, 350))) for i in range(900)]
    rows += [(f"s{rng.randrange(40)}", i, 0, rng.randrange(60)) for i in range(500)] + [("", -5, 1, 3), ("", -5, 2, 98)] + [("zero", i, 0, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, block long, slot long, n long").repartition(5)
    for ranges in (1, 23):
        got = C.next_fit(df, "source", ("block", "slot"), "n", 100, ranges).collect()
        assert {(r.source, r.block, r.slot): (r.first_block, r.first_slot) for r in got} == greedy(rows, 100) and len(got) == len(rows)
    assert C.next_fit(df.limit(0), "source", ("block", "slot"), "n", 100, 3).count() == 0


def test_entries_equal_every_start():
    """What a range reports is what feeding it to each open group gives."""
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.choice((0, 1, 2, 3, 9, 12)) for _ in range(rng.randrange(1, 12))]
        state = C._Entries(8)
        for i, n in enumerate(sizes):
            state.add(n, (i, 0))
        table = list(state.exits())
        for came in range(10):
            g = C._Greedy(8, came, "came")
            for i, n in enumerate(sizes):
                g.add(n, (i, 0))
            (lo, hi, held, key), *more = [x for x in table if x[0] <= came <= x[1]]
            assert not more and (g.key == "came" if key is None else g.key == key) and g.size == (came + held if key is None else held), (sizes, came)


def test_queue_cut(spark):
    rng = random.Random(5)
    for case in range(3):
        few = case % 2
        rows = [(rng.choice(["a", "ab", "b", "é", ""]), rng.randrange(-9000, 9000), i, 2 if few else rng.choice((1, 2, 3, 5000)), rng.choice((0, 0, 7)) if few else rng.randrange(10_000)) for i in range(60)]
        df = spark.createDataFrame(rows, "source string, block long, slot long, n_files long, bytes long")
        for percent in (0, 70, 100):
            want, so_far, whole = set(), 0, sum(r[4] for r in rows)
            for s, b, k, n, size in sorted(rows, key=lambda r: (-r[3], r[4], r[0].encode(), r[1], r[2])):
                so_far += size
                if 100 * so_far > percent * whole:
                    break
                want.add((s, b, k))
            assert {(r.source, r.block, r.slot) for r in df.where(C.queue_cut(df, percent)).collect()} == want, (case, percent)
    none = df.withColumn("bytes", df.bytes * 0)
    assert none.where(C.queue_cut(none, 70)).count() == 60 and df.limit(0).where(C.queue_cut(df.limit(0), 70)).count() == 0


@pytest.fixture
def docs(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.choice((0, 5, 400, 20_000)), rng.choice(["hot", "hot", "a", "b", None, ""])) for i in rng.sample(range(90_000), 2500)]
    rows += [(None, "no id", "a"), (None, None, None), (7, "same", "hot"), (7, "same", "hot"), (7, "other", "hot"), (40_000, "x" * 200_000, "a"), (40_001, None, "a")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, block int, n_files int")


def test_plan_equals_statement(spark, docs, tmp_path):
    rows, df = docs
    df.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    got = C.compaction_table(df)
    want = c.execute(f"select {', '.join(got.columns)} from ({C.oracle()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert sum(x[6] is not None for x in want) > 70 and {x[7] for x in want} > {0, 1}
    assert C.compaction_table(df.limit(0)).count() == 0


def test_plan_equals_plain_python(docs):
    rows, df = docs
    files = {}
    for i, t, s in rows:
        h = zlib.crc32(b"" if i is None else str(i).encode())
        block, slot = (i or 0) // 2000, min(h % 8, h // 8 % 8)
        gone = h // 64 % 100 < 9 * ((slot + block) % 8)
        files.setdefault((s or "", block, slot), []).append((not gone, i, (t or "").encode()))
    size = lambda f: sum(len(t) for _, _, t in f)
    live = lambda f: [(i is not None, i or 0, t) for k, i, t in f if k]
    dirty = lambda f: 100 * sum(not k for k, *_ in f) >= 35 * len(f)
    cand = [(*k, sum(len(t) for *_, t in live(f))) for k, f in files.items() if dirty(f) or 4 * size(f) < 3 * 65536]
    groups = {}
    for (s, b, k), first in greedy(cand, 65536).items():
        groups.setdefault((s, *first), []).append((s, b, k))
    queue = sorted((k for k, g in groups.items() if len(g) > 1 or dirty(files[g[0]])), key=lambda k: (-len(groups[k]), sum(size(files[f]) for f in groups[k]), k))
    whole, so_far, out, left = sum(size(files[f]) for k in queue for f in groups[k]), 0, [], set(files)
    digest = lambda fs: hashlib.sha256(b"".join((str(i).encode() if some else b"") + b":" + t + b"\n" for some, i, t in sorted(x for f in fs for x in live(files[f])))).hexdigest()
    for at, k in enumerate(queue):
        n = sum(size(files[f]) for f in groups[k])
        so_far += n
        if 100 * so_far > 70 * whole:
            break
        left -= set(groups[k])
        alive = [x for f in groups[k] for x in live(files[f])]
        out.append((*k, len(groups[k]), len(alive), n, n + sum(len(t) for *_, t in alive) + 4096 * len(groups[k]), at // 64, digest(groups[k])))
    out += [(*f, 1, len(live(files[f])), size(files[f]), None, None, digest([f])) for f in left]
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in C.compaction_table(df).collect())


def test_written_files(spark, docs, tmp_path):
    rows, df = docs
    back = C.compact(df, str(tmp_path / "out")).selectExpr("*", "_metadata.file_path f").collect()
    where = {}
    for r in back:
        where.setdefault((r.source, r.unit_block, r.unit_slot), set()).add(r.f)
    assert all(len(x) == 1 for x in where.values())
    assert len(back) == C.with_files(df).where("live").count()
