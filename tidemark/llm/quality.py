"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

A text has one sparse feature vector x: its words hashed to buckets (log counts, scaled to length 1), and
statistics of its structure and of the ``n_chars`` column, standardised on the training rows. The score is the
logistic of w0 + <w, x> + the sum over pairs i < j of <v_i, v_j> x_i x_j, and the pair sum is taken in time
linear in the features, as half of (sum v_i x_i)^2 - sum v_i^2 x_i^2.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._tokens import as_bytes, map_slices, sliced

BUCKETS, RANK = 1 << 13, 8
#: Labelled rows the model is fitted on: those with the smallest hash of the id, so the same on every run.
TRAIN_ROWS = 4000
CUT = 0.3
STATS = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "stop", "newline", "not_ascii", "distinct", "top_word", "repeat", "log_line", "line_repeat", "log_n_chars", "n_chars_gap", "n_chars_null")

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 digit, 3 symbol, 4 stop or comma, 5 newline, 6 not ASCII
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 6
for _i in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _KIND[_i] = 3
_KIND[46] = _KIND[44] = 4
_KIND[10] = 5


class Buckets(dict):
    """Bucket of a word, remembered; forgotten as a whole once it holds a million words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        x = self[w] = zlib.crc32(w) % BUCKETS
        return x


def features(data: bytes, n_chars: int | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket indices, their values, statistics) of a text; the empty text has no buckets."""
    w = data.split()
    n = len(w)
    ids = np.sort(np.fromiter(map(buckets.__getitem__, w), np.int64, n))
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if n else ids
    count = np.diff(np.r_[start, n])
    value = np.log1p(count)
    value = value / max(1e-12, float(np.sqrt((value * value).sum())))
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=7) / max(1, len(data))
    lines = data.split(b"\n")
    chars = len(data) if n_chars is None else max(0, n_chars)
    stats = np.array([
        np.log1p(len(data)), np.log1p(n), (len(data) - n) / max(1, n), *kinds[[1, 2, 3, 4, 5, 6]],
        len(start) / max(1, n), count.max(initial=0) / max(1, n), sum(map(bytes.__eq__, w, w[1:])) / max(1, n - 1),
        np.log1p(len(data) / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(chars), abs(np.log1p(chars) - np.log1p(len(data))), float(n_chars is None),
    ])
    return ids[start], value, stats


class FactorisationMachine:
    def __init__(self, size: int, rank: int = RANK, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w0 = np.zeros(1, np.float32)
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.05, (size, rank)).astype(np.float32)

    def raw(self, ids: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the logistic, sum v_i x_i) for rows whose features begin at ``start``; none is empty."""
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
        return self.w0[0] + np.add.reduceat(self.w[ids] * x, start) + pairs, s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 5):
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        g0, gw, gv = np.full_like(self.w0, 1e-6), np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                own = order[at : at + batch]
                size = np.array([len(rows[i][0]) for i in own])
                ids, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]).astype(np.float32)
                raw, s = self.raw(ids, x, np.cumsum(size) - size)
                e = (1 / (1 + np.exp(-raw)) - y[own]).astype(np.float32) / len(own)
                ex = np.repeat(e, size) * x
                used, inv = np.unique(ids, return_inverse=True)
                dw = np.bincount(inv, ex, len(used)) + decay * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]), np.float32)
                np.add.at(dv, inv, ex[:, None] * np.repeat(s, size, axis=0) - (ex * x)[:, None] * self.v[ids])
                dv += decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                d0 = e.sum()
                g0 += d0 * d0
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self


class QualityModel:
    """The machine with the scale of the statistics; statistics are the last features."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, machine: FactorisationMachine):
        self.mean, self.std, self.machine = mean, std, machine

    def row(self, ids, value, stats) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.std, -4, 4) / np.sqrt(len(stats))
        return np.r_[ids, BUCKETS + np.arange(len(stats))], np.r_[value, z]

    def score(self, rows) -> np.ndarray:
        rows = [self.row(*r) for r in rows]
        if not rows:
            return np.zeros(0)
        size = np.array([len(r[0]) for r in rows])
        raw, _ = self.machine.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32), np.cumsum(size) - size)
        return 1 / (1 + np.exp(-raw.astype(np.float64)))


def train(rows: list[tuple], labels: list[int]) -> QualityModel:
    """From feature triples and 0/1 labels; without rows every text scores one half."""
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, len(STATS)))
    model = QualityModel(stats.mean(0), np.maximum(stats.std(0), 1e-3), FactorisationMachine(BUCKETS + len(STATS)))
    if rows:
        model.machine.fit([model.row(*r) for r in rows], np.array(labels, np.float32))
    else:
        model.machine.v[:] = 0
    return model


def crc_of(column):
    return F.crc32(column.cast("string").cast("binary"))


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``train_rows`` documents whose crc32(doc_id) mod 5 is not 0 and whose quality is 0 or 1. The ids
    are chosen before any text is read; contradicting labels of an id are all used. An id counts once for each of
    its labels, however often its rows or its labels repeat: of several texts, that with the smallest hash."""
    h = F.xxhash64("doc_id")
    chosen = labels.where((F.pmod(crc_of(F.col("doc_id")), F.lit(5)) != 0) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(h, "doc_id", "quality").limit(train_rows)

    def run(batches):
        buckets = Buckets()
        for batch in batches:
            for part in sliced(batch, "t"):
                made = [features(t, n, buckets) for t, n in zip(as_bytes(part, "t"), part.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *[pa.array([m[i] for m in made], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())))]], names=["doc_id", "quality", "ids", "value", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most train_rows ids are broadcast
    x = F.struct(F.xxhash64("text").alias("h"), F.col("n_chars").cast("long").alias("n"), F.col("text").alias("t"))
    texts = docs.select("doc_id", x.alias("x")).join(F.broadcast(chosen), "doc_id")
    # a repeated id's rows are reduced to one within each task before they are shuffled
    texts = texts.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("doc_id", "quality", "x.t", "x.n")
    rows = texts.select("doc_id", "quality", "t", "n").mapInArrow(run, f"doc_id {kind}, quality int, ids array<long>, value array<double>, stats array<double>")
    rows = rows.orderBy(h, "doc_id", "quality", "stats").limit(train_rows).toArrow()
    return train(list(zip(*[_lists(rows.column(c), t) for c, t in (("ids", np.int64), ("value", float), ("stats", float))])), rows.column("quality").to_pylist())


def _lists(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The lists of a column as views of its values, without a Python object for each value."""
    out = []
    for chunk in column.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
        out += [values[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
    return out


def score_quality(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """Per input row: doc_id, ``held_out``, ``score``, ``predicted``.

    The whole text is read. Null text counts as empty and has a score like any other; a null n_chars is a
    feature; a null doc_id is not held out and never trained on; repeated rows score alike. Labels, language,
    source and id are not inputs, and columns other than doc_id, text and n_chars aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        buckets = Buckets()
        for batch in batches:
            for part in sliced(batch, "t"):
                rows = [features(t, n, buckets) for t, n in zip(as_bytes(part, "t"), part.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(rows), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").alias("t"), F.col("n_chars").cast("long").alias("n")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``cut``; scored as in :func:`score_quality`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def change(part):
        buckets = Buckets()
        chars = part.column("n_chars").cast(pa.int64()).to_pylist()
        score = sent.value.score([features(t, n, buckets) for t, n in zip(as_bytes(part, "text"), chars)])
        return part.filter(pa.array(score >= cut))

    return map_slices(docs, change)
