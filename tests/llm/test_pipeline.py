import random
from collections import Counter

import corpus_pipeline as P
from tests.llm.water import water_level
from tests.llm.test_simhash import brute_components, brute_fp
from tidemark.llm import decontaminate as D
from tidemark.llm import mixing as M
from tidemark.llm import quality as Q
from tidemark.llm import secrets as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    v = [f"word{i}" for i in range(300)]
    item = " ".join(f"bench{i}" for i in range(20)) + ". the answer is here."
    rows = []
    for i in range(400):
        t = " ".join(rng.choice(v) for _ in range(rng.randint(30, 90)))
        if i % 10 == 3:
            t = "!! ".join(x.upper() for x in t.split())
        elif i % 10 == 4 and i > 10:
            t = rows[i - 10][1]
        elif i % 40 == 5:
            t += " " + item + " " + t
        elif i % 40 == 6:
            t += " password=abcdef0123456789abcdef and so on"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    odd = [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, rows[0][1], "en", "s1", 5), (7, *rows[7][1:]), (402, "lone " * 3000, "en", "s0", 15000)]
    return rows + odd, item


def test_stages_equal_brute_force(spark, tmp_path):
    rows, item = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(400)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    step = {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, d), name)
        step[name] = [tuple(r) for r in docs.collect()]
        assert name == "mixing" or docs.columns == P.COLUMNS

    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = Q.fit_quality(spark.createDataFrame(rows, SCHEMA), labels)
    scores = model.score([Q.features((r[1] or "").encode(), r[4], Q.Buckets()) for r in rows])
    want = [r for r, s in zip(rows, scores) if s >= Q.CUT]
    assert Counter(step["quality"]) == Counter(want)
    kept = {r[0] for r in want}
    assert not [i for i in kept if i is not None and i < 400 and i % 10 == 3] and len([i for i in range(400) if i % 10 != 3 and i in kept]) >= 358

    comp = brute_components([r[0] for r in want], [brute_fp(r[1]) for r in want])
    assert sorted(r[0] for r in step["near_copies"]) == sorted(set(comp)) and len(step["near_copies"]) == len(set(comp))
    assert set(step["near_copies"]) <= set(want)

    left = [r for r in step["near_copies"] if "bench3 bench4" not in (r[1] or "")]
    assert Counter(step["decontamination"]) == Counter(left) and len(left) < len(step["near_copies"])

    clean = {r[0]: r for r in step["secrets"]}
    assert len(step["secrets"]) == len(left)
    for r in left:
        spans = S.all_spans(r[1] or "")
        t = S.redact(r[1], spans) if spans else r[1]
        assert clean[r[0]] == (r[0], t, r[2], r[3], len(t) if spans else r[4])
    assert any("[assign]" in (r[1] or "") for r in step["secrets"])

    size = lambda t: len((t or "").split())
    sizes = Counter()
    for r in step["secrets"]:
        sizes[r[3]] += size(r[1])
    target, taken, copies = water_level(sizes), Counter(), Counter()
    for *r, copy in step["mixing"]:
        assert tuple(r) in set(step["secrets"]) and 1 <= copy <= M.MAX_COPIES
        taken[r[3]] += size(r[1])
        copies[r[0], copy] += 1
    assert max(copies.values()) == 1
    assert all(abs(taken[s] - target[s]) < 3100 for s in target)
    assert D.split_item(item)[1] == "the answer is here."


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0
