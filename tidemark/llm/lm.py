"""Stupid-backoff language-model scores, computed relationally.

N-grams of one to three words are counted over all words of a corpus, however rare, in a table partitioned by the
n-gram's hash (:func:`ngram_counts`). :func:`score_with` explodes other texts into words, left-joins each to the
counts of its n-grams and their contexts, backs off by 0.4 wherever an n-gram was never counted, and sums per
document.

:func:`score_corpus` scores the corpus by its own counts. Every n-gram of it is counted, so nothing backs off, and
the denominators of a text cancel the numerators one order below: its log score is the sum of ln c over its
trigrams, less that of its inner pairs, less ln N. The two sums are two passes of one plan: n-grams of all texts
go to the partition of their hash, meet their count there, and are summed per text. N-grams that a sample finds
to be very frequent don't travel: their exact counts, at most ``1 / HEAVY_SHARE`` of each order, are gathered by
partial sums and broadcast, so no task collects a hot n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._tokens import BATCH_ROWS, sliced
from tidemark.session import materialize

BACKOFF = 0.4
#: An n-gram that makes up so much of the sample's n-grams of its order is counted ahead; at most 1 / share can.
HEAVY_SHARE = 1 / 65_536
#: Documents of that sample: those with the smallest hash of the id. It decides which rows travel, not what is counted.
SAMPLE_DOCS = 4096
#: Bytes whose words are hashed at a time, and bytes of texts whose n-grams are held at a time: each takes tens of bytes.
CHUNK, SLICE = 1 << 18, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Each byte's term of a word's hash: A-Z as a-z, and none zero.
_TERM = np.array([i + 33 if 65 <= i <= 90 else i + 1 for i in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base modulo 2**64 and of its inverse, for positions of a run of bytes."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64)
            self.up, self.down = made(_BASE), made(pow(_BASE, -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, number of words of each text). Words are as in
    :func:`tidemark.llm._tokens.words`; null is empty.

    A word's hash is its bytes' polynomial at a fixed odd base modulo 2**64, mixed with its length. It is taken
    from running sums over the texts' bytes, so no word becomes a Python object.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space = _SPACE[data]
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    cut = at[(at > 0) & (at < len(data))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    out = np.zeros(len(first), np.uint64)
    lo = 0
    while lo < len(first):
        # whole words of about CHUNK bytes
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + CHUNK)))
        start, stop = first[lo], last[hi - 1] + 1
        up, down = _POWERS.of(max(CHUNK, int(stop - start)))
        total = np.zeros(stop - start + 1, np.uint64)
        np.cumsum(_TERM[data[start:stop]] * up[: stop - start], out=total[1:])
        a, b = first[lo:hi] - start, last[lo:hi] - start + 1
        out[lo:hi] = _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out, np.diff(np.searchsorted(first, at))


class Grams:
    """Hashes of the n-grams of a slice of texts; the lowest bit of each is 0."""

    def __init__(self, column: pa.Array):
        one, self.size = hashed_words(column)
        n = len(one)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.pos = np.arange(n) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        pair = _mix(_mix(one[:-1]) + one[1:]) if n > 1 else one[:0]
        three = _mix(pair[:-1] + _mix(one[2:])) if n > 2 else one[:0]
        even = np.uint64(0xFFFFFFFFFFFFFFFE)
        self.gram = {1: one & even, 2: pair & even, 3: three & even}

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, start) of each n-gram that stands in one text."""
        gram = self.gram[order]
        text, pos = self.text[: len(gram)], self.pos[: len(gram)]
        keep = pos + order <= self.size[text]
        return gram[keep], text[keep], pos[keep]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _each_slice(batches, column: str = "t"):
    for batch in batches:
        for part in sliced(batch, column, SLICE):
            yield part, Grams(part.column(column))


def ngram_counts(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The count table (order, gram, n) of all texts, partitioned by hash; null texts have no words."""

    def run(batches):
        for _, grams in _each_slice(batches):
            for order in orders:
                gram, n = np.unique(grams.of(order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), order, np.int32)), _signed(gram), pa.array(n)], names=["order", "gram", "n"])

    rows = docs.select(F.col("text").alias("t")).mapInArrow(run, "order int, gram long, n long")
    return rows.groupBy("order", "gram").agg(F.sum("n").alias("n"))


def score_with(docs: DataFrame, counts: DataFrame, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, ``n_words``, ``log_score``, ``mean_score`` by the counts of a corpus that need not hold the texts.

    A word scores ln(c(a b c) / c(a b)); where the trigram has no count, ln backoff more than ln(c(b c) / c(b)); where
    that has none either, ln backoff more than ln(c(c) / N); a word without a count counts ``backoff`` times. Null
    and empty texts have 0 words, log_score 0 and a null mean_score; repeated rows are scored alike.
    """
    spark = docs.sparkSession
    counts = materialize(counts, "counts", batch_rows=BATCH_ROWS)
    total = float(counts.where("order = 1").agg(F.sum("n")).first()[0] or 1)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialize(base.withColumn("row", F.monotonically_increasing_id()), "rows")

    def run(batches):
        for part, grams in _each_slice(batches):
            n = len(grams.text)
            gram = lambda order, back: pa.array(np.concatenate([np.zeros(min(n, back), np.int64), grams.gram[order][: max(0, n - back)].view(np.int64)]), mask=grams.pos < back)
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(grams.text)), gram(1, 0), gram(1, 1), gram(2, 1), gram(2, 2), gram(3, 2)], names=["row", "w", "b", "bw", "ab", "abw"])

    # w is the word, b and ab stand before it
    at = rows.select("row", "t").mapInArrow(run, "row long, w long, b long, bw long, ab long, abw long")
    of = lambda column: (1 if len(column) == 1 else len(column))
    for column in ("w", "b", "bw", "ab", "abw"):
        at = at.join(counts.where(F.col("order") == of(column)).select(F.col("gram").alias(column), F.col("n").alias(f"c_{column}")), column, "left")
    low = F.ln(F.coalesce(F.col("c_w").cast("double"), F.lit(backoff)) / total)
    pair = F.when(F.col("c_bw").isNotNull(), F.ln(F.col("c_bw") / F.col("c_b"))).when(F.col("bw").isNull(), low).otherwise(np.log(backoff) + low)
    score = F.when(F.col("c_abw").isNotNull(), F.ln(F.col("c_abw") / F.col("c_ab"))).when(F.col("abw").isNull(), pair).otherwise(np.log(backoff) + pair)
    found = at.groupBy("row").agg(F.count("*").alias("n_words"), F.sum(score).alias("log"))
    out = rows.select("row", "doc_id").join(found, "row", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), "n_words", F.round(F.coalesce("log", F.lit(0.0)), 6).alias("log_score"), F.round(F.col("log") / F.col("n_words"), 6).alias("mean_score"))


def frequent(src: DataFrame, share: float = HEAVY_SHARE, sample: int = SAMPLE_DOCS) -> dict[int, np.ndarray]:
    """Pairs and trigrams (sorted hashes by order) that make up ``share`` of a sample's, which at most 1 / share do."""
    h = F.xxhash64("doc_id", "key")
    ids = src.select("doc_id", "key").distinct().orderBy(h, "doc_id", "key").limit(sample)
    # the sample is bounded, so its ids are broadcast
    own = src.alias("s").join(F.broadcast(ids).alias("i"), F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.key") == F.col("i.key")), "left_semi")
    counts = materialize(ngram_counts(own.select(F.col("t").alias("text")), (2, 3)), "sample-counts", batch_rows=BATCH_ROWS)
    least = {r[0]: r[1] * share for r in counts.groupBy("order").agg(F.sum("n")).collect()}
    heavy = counts.where(F.col("n") > 1).where(" or ".join(f"(order = {o} and n >= {x})" for o, x in least.items()) or "false").select("order", "gram").collect()
    return {o: np.sort(np.array([r.gram for r in heavy if r.order == o], np.int64).view(np.uint64)) for o in (2, 3)}


class Lookup:
    """Where n-grams stand among some sorted ones; a table of their highest 20 bits answers most that don't."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(grams >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the n-grams that stand there, their places)."""
        at = np.flatnonzero(self.seen[(gram >> np.uint64(44)).view(np.int64)])
        if not len(self.grams):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.grams, gram[at]), len(self.grams) - 1)
        found = self.grams[place] == gram[at]
        return at[found], place[found]


def _sizes(src: DataFrame, heavy: dict[int, np.ndarray]) -> DataFrame:
    """Rows (doc_id, key, n_words, word: the hash of the only word) of each text, and rows (order, gram, n) with
    each task's counts of the frequent n-grams."""
    sent = src.sparkSession.sparkContext.broadcast(heavy)
    names = ["doc_id", "key", "n_words", "word", "order", "gram", "n"]

    def run(batches):
        heavy = sent.value
        find = {o: Lookup(g) for o, g in heavy.items()}
        held = {o: np.zeros(len(g), np.int64) for o, g in heavy.items()}
        kind = None
        for part, grams in _each_slice(batches):
            for o in heavy:
                held[o] += np.bincount(find[o](grams.of(o)[0])[1], minlength=len(heavy[o]))
            word = np.zeros(len(grams.size), np.uint64)
            single = grams.size == 1
            word[single] = grams.gram[1][single[grams.text]]
            kind = part.column("doc_id").type
            none = pa.nulls(len(word), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(grams.size), pa.array(word.view(np.int64), mask=~single), none.cast(pa.int32()), none, none], names=names)
        for o, n in held.items() if kind is not None else ():
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none.cast(kind), none, none, none, pa.array(np.full(len(n), o, np.int32)), _signed(heavy[o]), pa.array(n)], names=names)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, key long, n_words long, word long, order int, gram long, n long")


def _sums(src: DataFrame, order: int, heavy: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(key, copies, log, again) of texts of two words or more: how many rows have the text, the sum over them of the
    weights of their n-grams times ln c, and how many n-grams occur more than once.

    Trigrams weigh 1. Inner pairs weigh -1, the pair of a text of two words 1, other first and last pairs 0. Each
    text also has a row of its own, with an odd number in place of a hash, that holds what the frequent n-grams
    add up to.
    """
    sent = src.sparkSession.sparkContext.broadcast((heavy, np.log(np.maximum(counts, 1))))

    def run(batches):
        heavy, log = sent.value
        find = Lookup(heavy)
        for part, grams in _each_slice(batches):
            gram, text, pos = grams.of(order)
            size = grams.size[text]
            weight = np.ones(len(gram), np.int32) if order == 3 else np.where(size == 2, 1, np.where((pos > 0) & (pos < size - 2), -1, 0)).astype(np.int32)
            known, at = find(gram)
            gain = np.bincount(text[known], log[at] * weight[known], len(grams.size))
            often = np.bincount(text[known], minlength=len(grams.size))
            own = np.flatnonzero(grams.size > 1)
            key = part.column("key").to_numpy()
            light = np.ones(len(gram), bool)
            light[known] = False
            gram = np.concatenate([gram[light], _mix(key.view(np.uint64)[own]) | np.uint64(1)])
            yield pa.RecordBatch.from_arrays(
                [_signed(gram), pa.array(np.concatenate([key[text[light]], key[own]])), pa.array(np.concatenate([weight[light], often[own].astype(np.int32)])), pa.array(np.concatenate([np.zeros(light.sum()), gain[own]]))],
                names=["gram", "key", "w", "gain"],
            )

    rows = src.select("key", "t").mapInArrow(run, "gram long, key long, w int, gain double")
    c = F.count("*").over(Window.partitionBy("gram"))
    own = F.col("gram").bitwiseAND(F.lit(1)) == 1
    rows = rows.select("key", "w", "gain", own.alias("own"), c.alias("c"))
    log = F.when(F.col("own"), F.col("gain")).otherwise(F.col("w") * F.ln("c"))
    again = F.when(F.col("own"), F.col("w")).otherwise((F.col("c") > 1).cast("int"))
    return rows.groupBy("key").agg(F.sum(F.col("own").cast("int")).alias("copies"), F.sum(log).alias("log"), F.sum(again).alias("again"))


def score_corpus(docs: DataFrame, share: float = HEAVY_SHARE, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Per input row: doc_id, ``n_words``, ``log_score`` (sum over words), ``mean_score`` (per word) and ``repeated``, the
    share of its trigrams that the corpus holds more than once; rounded to six places, as sums of doubles depend on
    their order.

    Words are as in :func:`tidemark.llm._tokens.words`. A text of one word scores ln(c(a) / N), one of two ln(c(a b) / N). Null and empty
    texts have 0 words, log_score 0 and a null mean_score; ``repeated`` is null below three words. Null and repeated
    ids are kept apart by a hash of the text; a repeated row is counted every time it occurs, and each of its rows
    gets the same score. Other columns aren't read; an empty table gives an empty table.
    """
    src = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("text").alias("t"))
    heavy = frequent(src, share, sample)
    sizes = materialize(_sizes(src, heavy), "documents", batch_rows=BATCH_ROWS)
    base = sizes.where("order is null")
    total = float(base.agg(F.sum("n_words")).first()[0] or 1)
    # at most 1 / share counts of each order
    known = {(r.order, r.gram): r.n for r in sizes.where("order is not null").groupBy("order", "gram").agg(F.sum("n").alias("n")).collect()}
    counts = {o: np.array([known.get((o, g), 0) for g in grams.view(np.int64).tolist()], float) for o, grams in heavy.items()}

    three = materialize(_sums(src, 3, heavy[3], counts[3]), "trigrams", batch_rows=BATCH_ROWS)
    two = materialize(_sums(src, 2, heavy[2], counts[2]), "pairs", batch_rows=BATCH_ROWS).select("key", F.col("log").alias("log2"))
    single = materialize(base.where("n_words = 1").select(F.col("word").alias("gram")).distinct(), "singles")
    one = single.limit(0).select(F.col("gram").alias("word"), F.lit(0.0).alias("one"))
    if not single.isEmpty():
        one = materialize(ngram_counts(docs, (1,)).join(single, "gram", "left_semi").select(F.col("gram").alias("word"), F.ln("n").alias("one")), "single-counts", batch_rows=BATCH_ROWS)

    per_row = (F.coalesce("log", F.lit(0.0)) + F.coalesce("log2", F.lit(0.0))) / F.col("copies")
    log = F.when(F.col("n_words") == 0, 0.0).otherwise(F.coalesce("one", per_row) - F.lit(float(np.log(total))))
    out = base.select("doc_id", "key", "n_words", "word").join(one, "word", "left").join(three.join(two, "key"), "key", "left").withColumn("score", log)
    repeated = F.when(F.col("n_words") > 2, F.round(F.col("again") / F.col("copies") / (F.col("n_words") - 2), 6))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 6)).alias("mean_score"), repeated.alias("repeated"))


def oracle() -> str:
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with d as (select row_number() over () r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{up}', '{up.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
t as (select r, p, w[p] x, case when p > 1 then w[p - 1] end b, case when p > 2 then w[p - 2] end a from (select r, w, unnest(range(1, len(w) + 1)) p from d)),
n as (select count(*) n from t),
c1 as (select x, count(*) c from t group by x),
c2 as (select b, x, count(*) c from t where p > 1 group by b, x),
c3 as (select a, b, x, count(*) c from t where p > 2 group by a, b, x),
s as (select r, p, case when p = 1 then ln(c1.c / n.n) when p = 2 then ln(c2.c / cb.c) else ln(c3.c / cab.c) end s, c3.c > 1 again
  from t join c1 using (x) left join c2 on c2.b = t.b and c2.x = t.x left join c1 cb on cb.x = t.b left join c2 cab on cab.b = t.a and cab.x = t.b left join c3 on c3.a = t.a and c3.b = t.b and c3.x = t.x, n),
z as (select r, sum(s) s, avg(again::int) filter (p > 2) again from s group by r)
select doc_id, len(w)::bigint n_words, coalesce(round(s, 6), 0.0) log_score, case when len(w) > 0 then round(s / len(w), 6) end mean_score, round(again, 6) repeated from d left join z using (r)"""
