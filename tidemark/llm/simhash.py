"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within two bits agree exactly on at least two of their four 16-bit quarters. Each distinct
fingerprint is therefore filed under the six patterns that keep two quarters and mask the others; these
patterns are the index's top nodes. Below a node the fingerprints stand in Gray-rank order, where equal
leading bits are neighbours, so shared bit patterns factor into inner nodes. A search walks pairs of nodes
downwards, adds up the differing bits of the patterns, and drops both subtrees once the sum passes the limit.

A node that holds more than ``NODE_MAX`` fingerprints is replaced by its 36 finer patterns, which keep 56
bits and hold at most 2**8 distinct fingerprints each, so no task meets an unbounded node and no link is lost:
within two bits, the 32 masked bits agree on two of their four bytes, and the 16 bits then left agree on two
of their four nibbles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._tokens import BATCH_ROWS, as_bytes, sliced, with_column, words
from tidemark.llm.components import connected_components
from tidemark.session import materialize

BITS_APART = 2
SHINGLE = 3
SEED = 42
NODE_MAX = 256
#: Fingerprints with this fraction of all rows are joined by broadcast.
HOT = 1000
_CHUNK = 1 << 16


def _masks(bits: list[int], parts: int = 4) -> list[tuple[int, list[int]]]:
    """For the given bit positions cut into four parts: (mask that keeps two parts, the positions left out)."""
    n = len(bits) // parts
    cut = [bits[i * n : (i + 1) * n] for i in range(parts)]
    return [(sum(1 << b for b in cut[i] + cut[j]), [b for k in range(parts) if k not in (i, j) for b in cut[k]]) for i, j in combinations(range(parts), 2)]


TOP = _masks(list(range(63, -1, -1)))
FINE = [[m | m2 | m3 for m2, left2 in _masks(left) for m3, _ in _masks(left2)] for m, left in TOP]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(data: bytes) -> int:
    """The unsigned 64-bit SimHash of a text's UTF-8: 3-word shingles, repeats included; no words: zero."""
    import xxhash

    w = words(data)
    n = len(w)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(w), seed=SEED)
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, w), np.int64, n) - 1)[: n - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: fp is the fingerprint as a signed long. Null texts count as empty; every row stays."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "t"):
                fps = [_signed(fingerprint(x)) for x in as_bytes(part, "t")]
                yield with_column(part, ["id"], fp=pa.array(fps, pa.int64()))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _gray_rank(fp: str):
    """Inverse of the binary-reflected Gray code, with the top bit flipped so that signed order is unsigned order."""
    r = F.col(fp)
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def tree_links(group: np.ndarray, fp: np.ndarray, limit: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of one group whose fingerprints differ in at most ``limit`` bits.

    Rows must stand by group and, within it, in Gray order. Level 0 is the group, each level below adds 16
    leading bits, and the last level's nodes are the fingerprints themselves.
    """
    code = fp.view(np.uint64) if fp.dtype == np.int64 else fp
    new_group = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    starts = [np.flatnonzero(new_group)]
    for shift in (48, 32, 16, 0):
        p = code >> np.uint64(shift)
        starts.append(np.flatnonzero(new_group | np.r_[True, p[1:] != p[:-1]] if len(p) else new_group))
    left = right = np.arange(len(starts[0]))
    apart = np.zeros(len(left), np.int64)
    for level, shift in enumerate((48, 32, 16, 0)):
        up, down = starts[level], starts[level + 1]
        first = np.searchsorted(down, up)
        count = np.diff(np.r_[first, len(down)])
        n = count[left] * count[right]
        pair = np.repeat(np.arange(len(left)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        width = count[right][pair]
        i, j = first[left][pair] + k // width, first[right][pair] + k % width
        keep = i <= j
        i, j, pair = i[keep], j[keep], pair[keep]
        chunk = (code[down] >> np.uint64(shift)) & np.uint64(0xFFFF)
        total = apart[pair] + np.bitwise_count(chunk[i] ^ chunk[j])
        keep = total <= limit
        left, right, apart = i[keep], j[keep], total[keep]
    keep = left < right
    return starts[-1][left[keep]], starts[-1][right[keep]]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows, the smallest row that the links connect it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        if not np.any(low != root[i]) and not np.any(low != root[j]):
            return root
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while np.any(root[root] != root):
            root = root[root]


def _node_links(batches):
    """Batches sorted by node; a node may run over from one batch to the next (it holds at most NODE_MAX rows)."""
    rest = None
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(node, fp):
        i, j = tree_links(node, fp)
        root = _forest(len(fp), i, j)
        # the least fingerprint stands for a tree, so trees of different nodes meet at once where they can
        least = fp.copy()
        np.minimum.at(least, root, fp)
        least = least[root]
        at = np.flatnonzero(least != fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(least[at])], schema=out)

    for batch in batches:
        m, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "key", "fp"))
        if rest is not None:
            m, key, fp = (np.concatenate(x) for x in zip(rest, (m, key, fp)))
        if not len(fp):
            continue
        node = np.cumsum(np.r_[0, (m[1:] != m[:-1]) | (key[1:] != key[:-1])])
        last = int(np.searchsorted(node, node[-1]))
        rest = m[last:], key[last:], fp[last:]
        if last:
            yield linked(node[:last], fp[:last])
    if rest is not None and len(rest[0]):
        yield linked(np.zeros(len(rest[0]), np.int64), rest[2])


def _filed(fps: DataFrame, patterns) -> DataFrame:
    """Each fingerprint under each (m, pattern): columns m, key, fp."""
    return fps.select("fp", F.explode(patterns).alias("x")).select(F.col("x.m").alias("m"), F.col("x.key").alias("key"), "fp")


def _patterns(masks: list[int], first: int = 0):
    return F.array(*[F.struct(F.lit(first + i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` -> ``(a, b)``: links whose transitive closure is that of all pairs within two
    bits. Within one node only a spanning forest is given, never all pairs."""
    spark = fps.sparkSession
    top = _filed(fps, _patterns([m for m, _ in TOP]))
    size = top.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    top = materialize(top.join(size, ["m", "key"]), "nodes")
    big = top.where(F.col("n") > NODE_MAX)
    fine = F.lit(None)
    for i, masks in enumerate(FINE):
        fine = F.when(F.col("m") == i, _patterns(masks, first=len(FINE) + 36 * i)).otherwise(fine) if i else F.when(F.col("m") == 0, _patterns(masks, first=len(FINE)))
    nodes = top.where(F.col("n") <= NODE_MAX).select("m", "key", "fp").unionByName(_filed(big, fine))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.withColumn("rank", _gray_rank("fp")).repartition(parts, "m", "key").sortWithinPartitions("m", "key", "rank")
    return ordered.select("m", "key", "fp").mapInArrow(_node_links, "a long, b long")


def _members(fps: DataFrame) -> DataFrame:
    """(id, fp) rows -> (fp, root, component_id, rows), one row per distinct fingerprint."""
    least = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "distinct-fingerprints")
    roots = materialize(connected_components(fingerprint_links(least.select("fp"))), "roots").withColumnRenamed("node", "fp")
    joined = least.join(roots, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(joined.join(named, "root").select("fp", "root", "component_id", "rows"), "members")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and more), all columns.

    Kept is the row with the smallest id, of equal ids the one with the smallest hash of the text, of rows equal in
    both the one whose columns, written as JSON, have the smallest hash; null ids come last. Null and wordless texts
    are one component. Texts move once, to meet the ids that stay.
    """
    plain = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    fps = materialize(add_fingerprints(plain.select(F.struct("doc_id", "h").alias("doc_id"), "text")).select("id.*", "fp"), "fingerprints", batch_rows=BATCH_ROWS)
    member = _members(fps.select(F.col("doc_id").alias("id"), "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    # the least row of each fingerprint first, by partial minima, so that no join meets a fingerprint's copies
    best = fps.groupBy("fp").agg(F.min(order).alias("x")).join(member, "fp").groupBy("root").agg(F.min("x").alias("x")).select("x.doc_id", "x.h")
    rows = fps.groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    best = materialize(best.alias("a").join(rows.alias("b"), same("a", "b")).select("a.doc_id", "a.h", "rows").distinct(), "kept")
    # whole rows in one column, so that no other column's name clashes
    full = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    single = full.alias("a").join(best.where("rows = 1").alias("b"), same("a", "b"), "left_semi").select("row.*")
    again = best.where("rows > 1")
    if again.isEmpty():
        return single
    repeated = full.alias("a").join(again.alias("b"), same("a", "b"), "left_semi")
    repeated = repeated.groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return single.unionByName(repeated)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over
    links of at most two differing bits).

    Null or wordless texts have fingerprint zero and are linked like any other. Rows with a null id are
    fingerprinted and share their component's id, but never name it; a component of null ids only has a null
    ``component_id``. Repeated ids give a row each. Other columns of ``docs`` are not read, so their names can't
    clash. An empty table gives an empty table.
    """
    fps = materialize(add_fingerprints(docs, id_col, text_col), "fingerprints", batch_rows=BATCH_ROWS)
    member = _members(fps).select("fp", "component_id", "rows")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # at most HOT fingerprints have a share of 1 / HOT of the rows each; their rows stay where they are
    hot = F.broadcast(member.where(F.col("rows") * HOT >= fps.count()))
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(member, "fp")
    return fps.join(hot, "fp").unionByName(rest).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
