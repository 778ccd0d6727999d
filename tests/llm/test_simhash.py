import numpy as np
import xxhash
from pyspark.sql import types as T

from tidemark.llm import simhash as S


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_tree_links_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        fp = {int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(25)}

        def rank(x):
            for k in (1, 2, 4, 8, 16, 32):
                x ^= x >> k
            return x

        fp = np.array(sorted(fp, key=rank), np.uint64)
        i, j = S.tree_links(np.zeros(len(fp), np.int64), fp)
        got = {frozenset((int(fp[a]), int(fp[b]))) for a, b in zip(i, j)}
        want = {frozenset((int(a), int(b))) for a in fp for b in fp if a < b and (int(a) ^ int(b)).bit_count() <= 2}
        assert got == want and len(i) == len(got)


def test_components_equal_brute_force(spark):
    texts = [None, "", "  \n", "one", "ONE", "one two", "a b c", "A b C", "ſ b K", "x " * 50000] + [f"the quick brown fox {i % 4} jumps over the lazy dog again and again and again {'x' * (i % 3)}" for i in range(30)]
    ids = [7, 3, None, *range(20, 20 + len(texts) - 4), 20]
    rows = [(i, t, "clash") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, S.simhash_components(df).collect()), key=str)
    fps = [brute_fp(t) for t in texts]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], brute_components(ids, fps)), key=str)
    assert got == want


def test_big_node_is_split(spark):
    rng = np.random.default_rng(2)
    base = 0x0123456789ABCDEF
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 28) for b in range(28)}
    far = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps = sorted(near | far)
    assert len(near) > S.NODE_MAX
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    from tidemark.llm.components import connected_components

    got = {n % (1 << 64): r % (1 << 64) for n, r in connected_components(S.fingerprint_links(df)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    classes = {}
    for f, c in zip(fps, want):
        classes.setdefault(c, set()).add(f)
    for members in classes.values():
        assert len({got.get(f, f) for f in members}) == 1
    assert len({got.get(f, f) for f in fps}) == len(classes)


def test_components_of_chain_and_star(spark):
    from tidemark.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(101)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and len(got) == 401


def test_empty(spark):
    assert S.simhash_components(spark.createDataFrame([], T._parse_datatype_string("doc_id long, text string"))).count() == 0
