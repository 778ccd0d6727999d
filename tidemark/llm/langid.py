"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

A document is its UTF-8 bytes, A-Z lower-cased. The network reads them in both directions and gives every position
a probability for each language; the document's probabilities are the mean over its positions that belong to
letters (a-z and bytes from 128). Long sequences are read in windows of ``WINDOW`` positions, each with up to
``CONTEXT`` bytes of the text before and after it, over which the states settle; every position is labelled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._tokens import as_bytes, sliced
from tidemark.llm.quality import crc_of

#: Documents of a language the network is fitted on, by smallest hash of the id, and sequences of each language
#: drawn, by smallest hash, from anywhere in their whole texts.
DOCS_PER_LANG, ROWS_PER_LANG = 300, 3000
#: Bytes of a sequence it is fitted on.
LENGTH = 64
HIDDEN, WINDOW, CONTEXT = 8, 256, 16
#: Windows that are run at a time.
BLOCK = 512
UNKNOWN = "und"

_LETTER = np.array([97 <= i < 123 or i >= 128 for i in range(256)])


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGRU:
    """Per direction: table (256, 3h) of input projections with biases, u (h, 3h) recurrent weights; gates are
    update z, reset r, candidate n, and h' = z * h + (1 - z) * n. Output weights o (2h, classes) and bias."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = f(256, 3 * hidden, scale=0.3)
            self.p["u" + d] = f(hidden, 3 * hidden, scale=hidden**-0.5)
            # byte 0 stands before and after a text: both gates shut and the candidate is 0, so the state is 0 there
            self.p["x" + d][0] = [-30.0] * (2 * hidden) + [0.0] * hidden
        self.p["o"], self.p["c"] = f(2 * hidden, classes, scale=hidden**-0.5), np.zeros(classes, np.float32)

    def _pass(self, seq: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (length, rows, h) of one direction; ``keep`` collects what the way back needs."""
        h, (rows, length) = self.h, seq.shape
        table, u = self.p["x" + d], self.p["u" + d]
        uzr, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        by_step = np.ascontiguousarray(seq.T)
        out = np.empty((length, rows, h), np.float32)
        s = np.zeros((rows, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = table.take(by_step[t], axis=0)
            zr = s @ uzr
            zr += a[:, : 2 * h]
            zr = _sigmoid(zr)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * s
            n = rs @ un
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, s, z, r, rs, n))
            s = np.add(n, z * (s - n), out=out[t])
        return out

    def positions(self, seq: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Probabilities (length, rows, classes) of equally long byte sequences (rows, length), or of their positions
        from ``start`` to ``stop``."""
        o = self.p["o"]
        y = self._pass(seq, "f")[start:stop] @ o[: self.h]
        y += self._pass(seq, "b")[start:stop] @ o[self.h :]
        y += self.p["c"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y

    def gradient(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions but those of byte 0, and its gradient, by backpropagation through time."""
        h, (rows, length) = self.h, seq.shape
        kept, states = {"f": [], "b": []}, {}
        for d in "fb":
            states[d] = self._pass(seq, d, kept[d])
        both = np.concatenate([states["f"], states["b"]], axis=2)
        y = both @ self.p["o"] + self.p["c"]
        y -= y.max(axis=2, keepdims=True)
        y = np.exp(y)
        y /= y.sum(axis=2, keepdims=True)
        there = (seq.T != 0) / max(1, np.count_nonzero(seq))
        loss = float(-(np.log(np.maximum(y[:, np.arange(rows), label], 1e-12)) * there).sum())
        y[:, np.arange(rows), label] -= 1
        y = (y * there[:, :, None]).astype(np.float32)
        g = {"o": np.tensordot(both, y, axes=([0, 1], [0, 1])), "c": y.sum(axis=(0, 1))}
        dstate = y @ self.p["o"].T
        bytes_of = np.ascontiguousarray(seq.T).ravel()
        for i, d in enumerate("fb"):
            u = self.p["u" + d]
            g["u" + d] = np.zeros_like(u)
            into = np.empty((length, rows, 3 * h), np.float32)
            back = np.zeros((rows, h), np.float32)
            for t, s, z, r, rs, n in reversed(kept[d]):
                ds = back + dstate[t, :, i * h : (i + 1) * h]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                drs = dn @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1, out=into[t])
                back = ds * z + drs * r + da[:, : 2 * h] @ u[:, : 2 * h].T
                g["u" + d][:, : 2 * h] += s.T @ da[:, : 2 * h]
                g["u" + d][:, 2 * h :] += rs.T @ dn
            flat = into.reshape(-1, 3 * h)
            g["x" + d] = np.stack([np.bincount(bytes_of, flat[:, j], 256) for j in range(3 * h)], axis=1).astype(np.float32)
            g["x" + d][0] = 0
        return loss, g

    def fit(self, sequences: list[bytes], labels: np.ndarray, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 13) -> BiGRU:
        """Adam over batches of equally long sequences, each language drawn as often."""
        rng = np.random.default_rng(seed)
        length = np.array([len(s) for s in sequences])
        by = {n: np.flatnonzero(length == n) for n in np.unique(length)}
        share = 1 / np.bincount(labels)[labels]
        sizes = np.array([share[by[n]].sum() for n in by], float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            some = by[rng.choice(list(by), p=sizes / sizes.sum())]
            own = rng.choice(some, batch, p=share[some] / share[some].sum())
            seq = np.frombuffer(b"".join(sequences[i] for i in own), np.uint8).reshape(batch, -1)
            _, g = self.gradient(seq, labels[own])
            now = rate * min(1, 3 * (1 - step / (steps + 1)))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


class Reader:
    """Scores documents."""

    def __init__(self, net: BiGRU, langs: list[str], window: int = WINDOW, context: int = CONTEXT):
        self.net, self.langs, self.window, self.context = net, langs, window, context

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): sums of probabilities over each text's letter positions."""
        w, c = self.window, self.context
        count = np.array([-(-len(t) // w) for t in texts], np.int64)
        # before, between and after texts stand zeros
        held = np.frombuffer(b"".join(part for t, n in zip(texts, count) for part in (bytes(c), t.lower(), bytes(int(n) * w - len(t) + c))), np.uint8)
        origin = np.cumsum(count * w + 2 * c) - (count * w + 2 * c)
        text = np.repeat(np.arange(len(texts)), count)
        start = origin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * w
        sums = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(text), BLOCK):
            seq = held[start[lo : lo + BLOCK, None] + np.arange(w + 2 * c)]
            p = self.net.positions(seq, c, c + w)
            np.add.at(sums, text[lo : lo + BLOCK], np.einsum("trk,rt->rk", p, _LETTER[seq[:, c : c + w]].astype(np.float32)))
        return sums

    def read(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for text, sums in zip(texts, self.pooled(texts)):
            if not self._lettered(text):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(sums.argmax())
            out.append((self.langs[best], float(min(1.0, sums[best] / sums.sum()))))
        return out

    @staticmethod
    def _lettered(text: bytes) -> bool:
        plain = text.translate(None, bytes(i for i in range(256) if not (65 <= i < 91 or 97 <= i < 123)))
        return bool(plain) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def training_ids(docs: DataFrame, per_lang: int) -> DataFrame:
    """(doc_id, lang): at most ``per_lang`` ids of each language, however often their rows repeat.

    A language's ids are first thinned by their hash to about four times that many, told by a sketch of their number,
    so that the window over a language ranks few rows.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of(F.col("doc_id")), F.lit(3)) != 1))
    usable = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    # one row a language
    near = usable.join(F.broadcast(ids), "lang").where(F.pmod("h", F.lit(1 << 20)) * F.col("ids") <= F.lit(4 * per_lang * (1 << 20)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.select("doc_id", "lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang).select("doc_id", "lang")


def fit_langid(docs: DataFrame, per_lang: int = DOCS_PER_LANG, rows: int = ROWS_PER_LANG) -> tuple[BiGRU, list[str]]:
    """Fit on at most ``per_lang`` documents of each language whose crc32(doc_id) mod 3 is not 1, one text each (of
    several, that with the smallest hash). Their whole texts are cut into sequences of ``LENGTH`` bytes, of which the
    ``rows`` of each language with the smallest hash are drawn; sequences without a letter are left out."""
    import zlib

    chosen = training_ids(docs, per_lang)
    # at most per_lang ids of each language are broadcast; a repeated id's rows are reduced to one before they are shuffled
    texts = docs.select("doc_id", "lang", F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t")).alias("x")).join(F.broadcast(chosen), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).select("lang", F.col("x.t").alias("t"))

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "t"):
                for t, lang in zip(as_bytes(part, "t"), part.column("lang").to_pylist()):
                    low = t.lower()
                    cut = [low[i : i + LENGTH].ljust(LENGTH, b"\0") for i in range(0, len(low), LENGTH)]
                    cut = [s for s in cut if _LETTER[np.frombuffer(s, np.uint8)].any()]
                    if cut:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut)), pa.array([zlib.crc32(s) for s in cut], pa.int64()), pa.array(cut, pa.binary())], names=["lang", "c", "s"])

    cut = texts.mapInArrow(run, "lang string, c long, s binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("c", "s"))
    # at most ``rows`` sequences of LENGTH bytes a language reach the driver
    drawn = cut.distinct().withColumn("rank", rank).where(F.col("rank") <= rows).orderBy("lang", "rank").collect()
    langs = sorted({r.lang for r in drawn})
    net = BiGRU(max(1, len(langs)))
    if drawn:
        net.fit([bytes(r.s) for r in drawn], np.array([langs.index(r.lang) for r in drawn]))
    return net, langs


def identify(docs: DataFrame, net: BiGRU, langs: list[str]) -> DataFrame:
    """Per input row: doc_id, ``held_out``, ``lang_pred``, ``score``.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is everything if no
    language was learned. A null doc_id is not held out; repeated rows score alike; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net, langs))

    def run(batches):
        reader = Reader(*sent.value)
        for batch in batches:
            for part in sliced(batch, "t"):
                rows = reader.read(as_bytes(part, "t"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    held = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
