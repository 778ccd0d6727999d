"""Nearest neighbours by cosine through additive quantisation.

A unit vector is written as the sum of one codeword from each of several full-dimensional codebooks. The
books are fitted on a bounded sample (k-means on residuals, then rounds of beam-search encoding and joint
least squares), every row is encoded by beam search, and the norm of its reconstruction is stored beside the
codes, with the angle between the row and its reconstruction. A query is scored against all rows by adding
entries of its lookup table and dividing by the stored norm. The best rows of the first slice are scored again on
their original vectors in double precision, and so is every row of any slice whose angle to the query, which is at
least the angle of the reconstruction less the stored one, can still reach the k-th best score and whose cosine
in single precision does: the result is that of scoring all rows exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize, scratch_path

#: Rows the codebooks are fitted on: those with the smallest hash of the id.
SAMPLE = 4096
BOOKS, WORDS, BEAM = 8, 256, 4
#: Rows of a slice of BATCH that are scored exactly for a query, while its list of k isn't full, before bounds decide.
RERANK, BATCH = 48, 2048
#: Slack of the bounds and cosines for sums in single precision, and pairs of a query and a row that are scored at a time.
SLACK, PAIRS = 1e-4, 1 << 16
#: Queries of one block; a block is what is sent to the executors at a time.
BLOCK = 4096


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v, dim)`` of rows that take part: id and vector not null, no null or non-finite component, not zero."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(ok).withColumn("dim", F.size("v"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 as float32; scaled by the largest component first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c.astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the reconstructions): per row the beam's best sum of one word from each book."""
    n, (m, k, _) = len(x), books.shape
    rest = x[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for b in range(m):
        words = books[b]
        cost = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ words.T) + (words * words).sum(1)
        width = cost.shape[1]
        keep = min(beam if b < m - 1 else 1, width * k)
        best = np.argpartition(cost.reshape(n, -1), keep - 1, axis=1)[:, :keep]
        row, word = best // k, best % k
        rest = np.take_along_axis(rest, row[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    made = x - rest[:, 0]
    return codes[:, 0], np.sqrt((made * made).sum(1))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dim) for unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    made, rest = [], x
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        at = ((c * c).sum(1)[None] - 2 * rest @ c.T).argmin(1)
        rest = rest - c[at]
        made.append(c)
    c = np.stack(made)
    for _ in range(rounds):
        codes, _ = encode(x, c)
        one = np.zeros((len(x), books * words), np.float32)
        one[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
        gram = one.T @ one + np.eye(books * words, dtype=np.float32)
        c = np.linalg.solve(gram, one.T @ x + c.reshape(-1, x.shape[1])).astype(np.float32).reshape(c.shape)
    return c


def _vectors(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _slices(batches, size: int = BATCH):
    """The rows of the batches in batches of ``size``, however many each came with."""
    held, n = [], 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == size:
                yield whole()
                held, n = [], 0
    if held:
        yield whole()


def angle_off(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Angle between each unit vector and its reconstruction; pi, which bounds nothing, where that is next to zero."""
    made = sum(books[b][codes[:, b]].astype(float) for b in range(len(books)))
    norm = np.sqrt((made * made).sum(1))
    made /= np.maximum(norm, 1e-12)[:, None]
    along = (x * made).sum(1)
    across = x - along[:, None] * made
    return np.where(norm < 0.01, np.pi, np.arctan2(np.sqrt((across * across).sum(1)), along))


def could_reach(near: np.ndarray, off: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Whether a row with this cosine (rows, queries) of its reconstruction, ``off`` from it, can score ``kth``."""
    edge = np.where(np.isfinite(kth), np.arccos(np.clip(kth, -1, 1)), np.pi)
    limit = np.outer(np.cos(off), np.cos(edge)) - np.outer(np.sin(off), np.sin(edge)) - SLACK
    return (near >= limit) | (off[:, None] + edge >= np.pi - SLACK)


def merge_best(best: np.ndarray, best_id: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Put scored rows (query position, score, id) among the best of their queries, in place."""
    k, own = best.shape[1], np.unique(at)
    query = np.r_[np.repeat(own, k), at]
    score, ids = np.r_[best[own].ravel(), score], np.r_[best_id[own].ravel(), ids]
    order = np.lexsort((ids, -score, query))
    take = order[np.searchsorted(query[order], own)[:, None] + np.arange(k)]
    best[own], best_id[own] = score[take], ids[take]


def build_index(rows: DataFrame, dim: int, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """Every row of ``rows`` (vec_id, v) with ``codes``, ``norm`` and ``off``, as a written table, and the codebooks."""
    spark = rows.sparkSession
    fitted = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(sample).select("v").collect()
    books = fit(unit(np.array([r.v for r in fitted])))
    sent = spark.sparkContext.broadcast(books)

    def run(batches):
        for part in _slices(batches):
            x = unit(_vectors(part, "v", dim))
            codes, norms = encode(x, sent.value)
            off = angle_off(x, codes, sent.value)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(list(map(bytes, codes)), pa.binary()), pa.array(norms, pa.float32()), pa.array(off)], names=["vec_id", "v", "codes", "norm", "off"])

    return materialize(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, codes binary, norm float, off double"), "codes"), books


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine along the last axis in double precision, summed from the first component to the last."""
    dot = aa = bb = 0.0
    for j in range(a.shape[-1]):
        dot, aa, bb = dot + a[..., j] * b[..., j], aa + a[..., j] * a[..., j], bb + b[..., j] * b[..., j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _search_block(index: DataFrame, books: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, rerank: int) -> DataFrame:
    """The k nearest of each partition for each query of the block: (query_id, vec_id, score)."""
    spark = index.sparkSession
    m, words, dim = books.shape
    table = np.ascontiguousarray(np.einsum("qd,mkd->mkq", unit(q), books, optimize=True))
    sent = spark.sparkContext.broadcast((ids, q, table))

    def run(batches):
        ids, q, table = sent.value
        unit_q = unit(q)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        best = np.full((len(ids), k), -np.inf)
        for part in _slices(batches):
            vec_id = part.column("vec_id").to_numpy()
            v = _vectors(part, "v", dim)
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, m)
            near = table[0][codes[:, 0]]
            for b in range(1, m):
                near += table[b][codes[:, b]]
            near /= np.maximum(part.column("norm").to_numpy(), 1e-12)[:, None]
            near[vec_id[:, None] == ids] = -np.inf
            # the best of the first slices fill the lists; from then on bounds decide what is scored
            r = min(rerank, len(vec_id)) if not np.isfinite(best[:, -1]).all() else 0
            rows = np.argpartition(-near, r - 1, axis=0)[:r].T if r else np.zeros((len(ids), 0), np.int64)
            for lo in range(0, len(ids) if r else 0, 256):
                own = slice(lo, lo + 256)
                exact = cosine(v[rows[own]], q[own, None, :])
                exact[vec_id[rows[own]] == ids[own, None]] = -np.inf
                score = np.concatenate([best[own], exact], axis=1)
                other = np.concatenate([best_id[own], vec_id[rows[own]]], axis=1)
                order = np.lexsort((other, -score), axis=1)[:, :k]
                best[own], best_id[own] = np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)
            rest = could_reach(near, part.column("off").to_numpy(), best[:, -1])
            rest[vec_id[:, None] == ids] = False
            rest[rows, np.arange(len(ids))[:, None]] = False
            some = np.flatnonzero(rest.any(axis=1))
            rest[some] &= unit(v[some]) @ unit_q.T >= best[:, -1] - SLACK
            at, row = np.nonzero(rest.T)
            for lo in range(0, len(at), PAIRS):
                q_at, v_at = at[lo : lo + PAIRS], row[lo : lo + PAIRS]
                merge_best(best, best_id, q_at, cosine(v[v_at], q[q_at]), vec_id[v_at])
        there = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(best_id[there]), pa.array(best[there])], names=["query_id", "vec_id", "score"])

    found = index.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(rows, size: int):
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.vec_id, r.v)
        if len(held) == size:
            yield held
            held = {}
    if held:
        yield held


def search(spark: SparkSession, table: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine in double).

    Queries are the rows that ``query_filter`` (a Column over ``vec_id``) selects; candidates are all rows with
    another id. Null ids, null or zero vectors and vectors with null or non-finite components take no part.
    Vectors of another length than the query's aren't compared. Equal scores go by the smaller id. A repeated
    id is searched once, with its first vector in sort order, and each of its rows is a candidate for others.
    An empty table, or one without queries, gives no rows. Blocks of queries are sent to the executors one at
    a time, so neither the driver nor a task ever holds all of them.
    """
    rows = usable(table, id_col, vec_col)
    out = scratch_path(spark, "nearest")
    schema = "query_id long, rank int, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(out)
    for dim in sorted(r.dim for r in rows.where(query_filter).select("dim").distinct().collect()):
        index, books = build_index(rows.where(F.col("dim") == dim), dim)
        queries = index.where(query_filter).select("vec_id", "v").orderBy("vec_id", "v")
        for held in _blocks(queries.toLocalIterator(), block):
            ids = np.fromiter(held, np.int64, len(held))
            _search_block(index, books, ids, np.array(list(held.values())), k, rerank).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def oracle(k: int = 5, every: int = 50) -> str:
    add = "lambda a, b: a + b"
    dot = lambda x, y: f"list_reduce(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]), {add}, 0.0::double)"
    return f"""
with e as (select vec_id, embedding::double[] v from embeddings where vec_id is not null and embedding is not null),
f as (select vec_id, v, {dot('v', 'v')} n from e where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
s as (select q.vec_id query_id, c.vec_id, {dot('c.v', 'q.v')} / (sqrt(c.n) * sqrt(q.n)) score from f q join f c on c.vec_id <> q.vec_id where q.vec_id % {every} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s)
select * from r where rank <= {k}"""
