import math
import random

import pytest

from tidemark.llm import decontaminate as D


def world(seed, n_items=40, n_docs=25):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}é" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    items = [(i, text(rng.randint(3, 50)), text(rng.randint(0, 8))) for i in range(n_items)]
    docs = []
    for _ in range(n_docs):
        parts = [text(rng.randint(0, 200))]
        for i, q, a in rng.sample(items, 2):
            w = f"{q} {a}".split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edited"
            parts += [" ".join(w), text(rng.randint(0, 80))]
        docs.append(" ".join(parts))
    return items, docs


def brute_scores(index_items, w, length):
    """item -> best share over windows of 2 * length words every length words, from the definition."""
    bags = {i: D.tokens(f"{q} {a}".encode()) for i, q, a in index_items}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {}
    for b in bags.values():
        for x in set(b):
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    out = {}
    for k in range(max(1, -(-len(w) // length) - 1)):
        here = set(w[k * length : k * length + 2 * length])
        for i, b in bags.items():
            norm = D.K1 * (1 - D.B + D.B * len(b) / mean)
            part = {x: idf[x] * b.count(x) * (D.K1 + 1) / (b.count(x) + norm) for x in set(b)}
            out[k, i] = sum(v for x, v in part.items() if x in here) / sum(part.values())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_block_max_wand_loses_nothing(seed):
    items, docs = world(seed)
    index = D.BlockMaxIndex(items)
    got, seen = {}, []
    keep = index.retrieve

    def spy(windows, terms):
        out = keep(windows, terms)
        seen.extend(out)
        return out

    index.retrieve = spy
    for k, doc in enumerate(docs):
        seen.clear()
        list(index.scan([doc.encode()]))
        got = {(w, index.ids[i]): s for w, i, s in seen}
        want = {x: s for x, s in brute_scores(items, D.tokens(doc.encode()), index.longest).items() if s >= D.THRESHOLD}
        assert got.keys() == want.keys(), k
        assert all(abs(got[x] - want[x]) < 1e-5 for x in got)


def test_verified_items_equal_brute_force_over_a_batch():
    items, docs = world(9)
    index = D.BlockMaxIndex(items)
    got = {(k, i) for k, i, *_ in index.scan([d.encode() for d in docs] + [b"", b" "])}
    want = set()
    for k, d in enumerate(docs):
        w = D.tokens(d.encode())
        scores = brute_scores(items, w, index.longest)
        for (win, i), s in scores.items():
            _, q, a = items[i]
            run = w[win * index.longest : (win + 2) * index.longest]
            text = b" " + b" ".join(run) + b" "
            g = D.shingles(D.tokens(q.encode())) + D.shingles(D.tokens(a.encode()))
            def pairs(part):
                p = [b" ".join(x) for x in zip(part, part[1:])] or part
                return not part or sum(b" " + x + b" " in text for x in p) >= 0.5 * len(p)

            if s >= D.THRESHOLD and sum(b" " + x + b" " in text for x in g) >= 0.8 * len(g) and pairs(D.tokens(q.encode())) and pairs(D.tokens(a.encode())):
                want.add((k, i))
    assert got == want and want


def test_split_item():
    assert D.split_item("One two. Three four? Five.") == ("One two. Three four?", "Five.")
    assert D.split_item("a b c d e") == ("a b c", "d e") and D.split_item(None) == ("", "")


def test_documents(spark):
    items, docs = world(3)
    bench = spark.createDataFrame([(i, f"{q}. {a}") for i, q, a in items] + [(90, None), (91, "..."), (None, "x y z"), (92, " ".join(f"long{i}" for i in range(300))), (93, "Ünïque!")], "item_id long, text string")
    split = D.split_items(bench)
    long = " ".join(f"w{i}" for i in range(30000)) + " " + " ".join(f"LONG{i}," for i in range(300))
    rows = [(i, d) for i, d in enumerate(docs)] + [(100, None), (101, ""), (102, long), (102, long), (None, docs[0]), (103, "say ünïque now")]
    got = D.contaminated(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int"), split).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert pairs.count((102, 92)) == 2 and (103, 93) in pairs and not {100, 101} & {p[0] for p in pairs}
    assert sorted(p[1] for p in pairs if p[0] is None) == sorted(p[1] for p in pairs if p[0] == 0)
    exact = {(k, i) for k, d in enumerate(docs) for i, q, a in items if f" {q} {a}".rstrip() + " " in f" {d} "}
    assert exact <= set(pairs)
    assert D.contaminated(spark.createDataFrame([], "doc_id long, text string"), split).count() == 0
    assert D.contaminated(spark.createDataFrame([(1, "a")], "doc_id long, text string"), split.limit(0)).count() == 0


def test_scores_do_not_follow_shards_and_null_ids_are_found(spark):
    items = [(i, " ".join(f"q{i}x{j}" if j % 3 else f"common{j}" for j in range(12 + i % 30)), f"the answer {i} is here now") for i in range(40)] + [(None, "an item that nobody has given an id of its own", "but text it has all the same")]
    rows = spark.createDataFrame(items, "item_id long, question string, answer string")
    texts = [f"{q} {a}".encode() for _, q, a in items]

    def groups(index_bytes, pass_bytes):
        return list(D.index_groups(rows, index_bytes=index_bytes, pass_bytes=pass_bytes))

    def found(made):
        return {(k, i): score for g in made for k, i, score, *_ in g.scan(texts)}

    one, many, passes = groups(1 << 30, 1 << 30), groups(3000, 1 << 30), groups(3000, 9000)
    assert len(one) == len(many) == 1 < len(passes) and len(one[0].indexes) == 1 < len(many[0].indexes) == sum(len(g.indexes) for g in passes)
    whole = found(one)
    assert (40, None) in whole and len(whole) == 41
    for cut in (found(many), found(passes)):
        assert whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-6 for k in whole)
    docs = spark.createDataFrame([(1, texts[-1].decode()), (2, "nothing")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, rows).collect()] == [(1, None)]


def test_answer_must_stand_in_the_passage(spark):
    """Most of an item's shingles, but nothing of its answer, isn't a leak; nor is an answer without its question."""
    question = " ".join(f"q{i}" for i in range(60))
    items = spark.createDataFrame([(1, question, "the answer is forty two"), (2, "short question here", "long " + " ".join(f"a{i}" for i in range(60)))], "item_id long, question string, answer string")
    rows = [(1, f"{question} and something else entirely"), (2, f"so {question} the answer is forty two then"), (3, "long " + " ".join(f"a{i}" for i in range(60))), (4, f"{question} the answer was forty two")]
    got = {r.doc_id: (round(r.question_overlap, 2), round(r.answer_overlap, 2)) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {2: (1.0, 1.0), 4: (1.0, 0.5)}


def test_pivots_skip_blocks(monkeypatch):
    """Of many items, postings are read only for the few blocks that can reach the threshold."""
    rng = random.Random(1)
    items = [(i, " ".join([f"c{rng.randrange(20)}" for _ in range(10)] + [f"r{i}x{j}" for j in range(10)]), "") for i in range(2000)]
    index = D.BlockMaxIndex(items)
    read = []
    keep = D._spread

    def spy(start, stop):
        read.append(int((stop - start).sum()))
        return keep(start, stop)

    monkeypatch.setattr(D, "_spread", spy)
    got = list(index.scan([f"{items[7][1]} c1 c2 c3 {items[1500][1]}".encode()]))
    assert sorted(i for _, i, *_ in got) == [7, 1500]
    assert read[-1] < len(index.items.at) / 100


def test_large_benchmark_in_one_pass(spark):
    """Thousands of items of several lengths, in several indexes, against brute force on what was planted."""
    rng = random.Random(6)
    word = lambda: f"w{int(rng.random() ** 3 * 4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((12, 40, 150)))), " ".join(word() for _ in range(6))) for i in range(3000)]
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    groups = list(D.index_groups(frame, index_bytes=1 << 19))
    assert len(groups) == 1 and len(groups[0].indexes) > 3
    planted = {k: rng.randrange(3000) for k in range(60)}
    texts = [" ".join([word() for _ in range(rng.randint(0, 300))] + [items[i][1], items[i][2]] + [word() for _ in range(rng.randint(0, 300))]) for i in planted.values()]
    got = {(k, i) for k, i, *_ in groups[0].scan([t.encode() for t in texts])}
    assert got == set(planted.items())
