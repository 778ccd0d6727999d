"""Phrase collocations: sketch, candidates, automata, exact counts, thresholds.

1. **Sketch.** Each task hashes its words and phrases (salted by language) into saturating counters and writes them in
   compressed chunks; the chunks are summed. No counter is less than what was hashed into it, so it bounds a phrase's
   count from above. What goes on is one bit a counter: does it reach ``min_count``.
2. **Candidates.** A phrase is one where its own bound and those of all its parts reach ``min_count``. Every phrase that
   often is among them; collisions only add some.
3. **Automata.** Texts are scanned in slices. The candidates that stand in a slice and language become one Aho-Corasick
   automaton over delimited phrases, and overlapping matches in the slice's candidate runs, with guards between runs and
   pieces, are counted. So an automaton is bounded by its slice, nothing is broadcast but the bits,
   and the work follows the text.
4. Counts are summed over slices; from here on everything is exact: scores, containment, ranks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._tokens import as_bytes, sliced
from tidemark.llm.lm import _mix, hashed_words
from tidemark.session import materialize

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
CONTAINED_PERCENT = 50
SCALE = 1_000_000
#: Counters of the sketch and of a chunk of it. A task holds one byte a counter; one bit a counter is broadcast.
COUNTERS, CHUNK = 1 << 26, 1 << 18
#: Bytes of texts that are scanned at a time.
SLICE = 16 << 20
#: Parts of a language whose first rows are found before those of the language.
PARTS = 32

_GUARD = b"\n"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def _packed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(x, asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, n, asbytes=True), np.uint8)


class Phrases:
    """The words of some texts of one language, one space on either side of each, with ``\\n`` between pieces."""

    def __init__(self, texts: list[bytes], lang: str, max_words: int):
        data = b" " + _GUARD.join(texts).translate(_FOLD).replace(_GUARD, b" \n ") + b" "
        while b"  " in data:
            data = data.replace(b"  ", b" ")
        self.data = data
        read = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(read == 32)
        start, end = space[:-1] + 1, space[1:]
        guard = (end - start == 1) & (read[start] == 10)
        # places within a slice fit into 32 bits unless one text alone is larger
        small = np.int32 if len(data) < 1 << 31 else np.int64
        self.start, self.end, self.piece = (x[~guard].astype(small) for x in (start, end, np.cumsum(guard)))
        self.words = len(self.start)
        one = hashed_words(pa.array([data], pa.large_binary()))[0] ^ np.uint64(xxhash.xxh64_intdigest(lang))
        self.hashes = {1: _mix(one)}
        for n in range(2, max_words + 1):
            before = self.hashes[n - 1]
            self.hashes[n] = _mix(before[:-1] * np.uint64(3) + self.hashes[1][n - 1 :]) if len(before) > 1 else before[:0]

    def whole(self, n: int) -> np.ndarray:
        """For each run of n words: does it stand in one piece."""
        return self.piece[: len(self.hashes[n])] == self.piece[n - 1 :][: len(self.hashes[n])]

    def buckets(self, n: int, counters: int) -> np.ndarray:
        return (self.hashes[n] >> np.uint64(64 - (counters.bit_length() - 1))).astype(np.int64)

    def often(self, bits: np.ndarray, counters: int) -> dict[int, np.ndarray]:
        """For each order, the runs whose bound and parts' bounds reach the count; ``bits`` are packed."""
        out: dict[int, np.ndarray] = {}
        for n in self.hashes:
            at = self.buckets(n, counters)
            out[n] = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & self.whole(n)
            if n > 1:
                out[n] &= out[n - 1][:-1] & out[n - 1][1:]
        return out

    def texts(self, at: np.ndarray, n: int) -> list[bytes]:
        data = self.data
        return [data[s:e] for s, e in zip(self.start[at].tolist(), self.end[at + n - 1].tolist(), strict=True)]

    def counts(self, often: dict[int, np.ndarray]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(order, phrase, how often it stands here) of the candidates: words by name, phrases by an automaton.

        The automaton reads words as numbers of a fixed width: a leading character and following ones, which are kept
        apart, so that a match starts and ends with a word; a guard stands between runs of words that aren't candidates
        together. Words are numbered by name, so no two are mixed up.
        """
        at = np.flatnonzero(often[1])
        names = self.texts(at, 1)
        words = Counter(names)
        number = dict(zip(words, range(len(words)), strict=True))
        held = np.zeros(self.words, np.int64)
        held[at] = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        order, phrases, hits = [np.ones(len(words), np.int32)], list(words), [np.fromiter(words.values(), np.int64, len(words))]
        del names
        code = _digits(held, len(words))
        automaton, rank, size = ahocorasick.Automaton(ahocorasick.STORE_INTS), held, len(words)
        found = 0
        for n in list(often)[1:]:
            at = np.flatnonzero(often[n])
            # the same prefix and the same last word: the same phrase
            _, first, same = np.unique(rank[at] * size + held[at + n - 1], return_index=True, return_inverse=True)
            rank = np.zeros(self.words, np.int64)
            rank[at] = same
            first = at[first]
            wide, text = n * code.shape[1], code[first[:, None] + np.arange(n)].tobytes().decode("latin-1")
            for i in range(len(first)):
                automaton.add_word(text[i * wide : (i + 1) * wide], found + i)
            found += len(first)
            order.append(np.full(len(first), n, np.int32))
            phrases += self.texts(first, n)
        if found:
            automaton.make_automaton()
            hits.append(np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(self.runs(often[2], code))), np.int64), minlength=found))
        return np.concatenate(order), phrases, np.concatenate(hits)

    def runs(self, pairs: np.ndarray, code: np.ndarray) -> str:
        """The words that stand in a candidate pair, and so all that stand in a longer candidate, with a guard before each
        run of them."""
        covered, joined = np.zeros(self.words, bool), np.zeros(self.words, bool)
        covered[:-1] |= pairs
        covered[1:] |= pairs
        joined[1:] = pairs
        at = np.flatnonzero(covered)
        wide = code.shape[1]
        place = np.arange(len(at)) * wide + np.cumsum(~joined[at])
        out = np.full(len(at) * wide + int((~joined[at]).sum()), _GUARD[0], np.uint8)
        for d in range(wide):
            out[place + d] = code[at, d]
        return out.tobytes().decode("latin-1")


def _digits(numbers: np.ndarray, size: int) -> np.ndarray:
    """Numbers below ``size`` in base 64, a row each: the first digit from 64 on, the others from 128 on."""
    wide = max(1, -(-(max(1, size) - 1).bit_length() // 6))
    digits = [(numbers >> (6 * d)) & 63 for d in range(wide - 1, -1, -1)]
    return np.stack([(x + (128 if i else 64)).astype(np.uint8) for i, x in enumerate(digits)], axis=1)


def _by_lang(batches, max_words: int):
    """(language, its phrases) for slices of the rows (lang, t)."""
    for batch in batches:
        for part in sliced(batch, "t", SLICE):
            held = defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part, "t"), strict=True):
                held[lang].append(text)
            for lang, texts in held.items():
                yield lang, Phrases(texts, lang, max_words)


def sketch_bits(rows: DataFrame, min_count: int, max_words: int, counters: int) -> np.ndarray:
    """One bit a counter, packed (low bits first): is the number of words and phrases hashed into it at least ``min_count``."""
    if not 0 < min_count < 255:
        raise ValueError("counters hold up to 254")
    chunk = min(CHUNK, counters)

    def count(batches):
        sketch = np.zeros(counters, np.uint8)
        for _, p in _by_lang(batches, max_words):
            for n in p.hashes:
                at, c = np.unique(p.buckets(n, counters)[p.whole(n)], return_counts=True)
                sketch[at] = np.minimum(sketch[at] + c, min_count)
        for i in range(counters // chunk):
            part = sketch[i * chunk : (i + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["chunk", "data"])

    def add(batches):
        at, held = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held >= min_count, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])
        for batch in batches:
            for i, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        yield told()
                    at, held = i, np.zeros(chunk, np.uint8)
                more = _unpacked(data, chunk)
                held = np.minimum(held.astype(np.uint16) + more, min_count).astype(np.uint8)
        if at is not None:
            yield told()

    parts = rows.mapInArrow(count, "chunk int, data binary")
    summed = materialize(parts.repartition(max(1, min(64, counters // chunk)), "chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, bits binary"), "sketch")
    out = np.zeros(counters // 8, np.uint8)
    for r in summed.toLocalIterator():
        out[r.chunk * chunk // 8 : (r.chunk + 1) * chunk // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, counters: int = COUNTERS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, order, phrase, f): exact counts of the words and phrases of up to ``max_words`` words that occur ``min_count``
    times in their language, and with order 0 and an empty phrase the number of all its words.

    Null texts are empty and null languages ``und``; repeated rows each count; an empty table gives an empty table.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(sketch_bits(rows, min_count, max_words, counters))

    def scan(batches):
        for lang, p in _by_lang(batches, max_words):
            often = p.often(bits.value, counters)
            p.hashes.clear()
            order, phrases, hits = p.counts(often)
            columns = [pa.repeat(lang, len(order) + 1), pa.array(np.r_[order, np.int32(0)]), pa.array([*phrases, b""], pa.binary()), pa.array(np.r_[hits, p.words])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "phrase", "f"])

    found = rows.mapInArrow(scan, "lang string, n int, phrase binary, f long").groupBy("lang", F.col("n").alias("order"), F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    out = materialize(found.where((F.col("f") >= min_count) | (F.col("order") == 0)), "phrases")
    bits.destroy()
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) in exact arithmetic: counts below 10**15."""
    whole = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(SCALE).cast("decimal(7,0)"), whole(left) * whole(right))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, contained_percent: int = CONTAINED_PERCENT, counters: int = COUNTERS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of 2 to ``max_words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its worst cut into two parts, a * a / (l * r) in millionths, equal scores by the shorter first
    part. Phrases within a longer one that is at least ``contained_percent`` as frequent are left out. Ties are decided
    by a, then by the phrase's bytes. Nulls, repeated rows and empty tables are as in :func:`phrase_counts`.
    """
    counts = phrase_counts(docs, min_count, max_words, counters, text_col, lang_col)
    phrases = counts.where("order > 1").select("lang", "order", "phrase", F.col("f").alias("a"))
    part = lambda n, k: F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.substring_index("phrase", " ", k - n).alias("right"))
    cuts = F.lit(None)
    for n in range(2, max_words + 1):
        cuts = F.when(F.col("order") == n, F.array(*[part(n, k) for k in range(1, n)])).otherwise(cuts)
    cut = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    of = counts.where("order > 0")
    for side in ("left", "right"):
        cut = cut.join(of.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])), ["lang", side])
    scored = cut.select("lang", "phrase", "a", "k", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    best = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    words = F.split("phrase", " ")
    inner = [F.array_join(F.slice(words, i, m), " ") for m in range(2, max_words) for i in range(1, max_words - m + 2)]
    if inner:
        each = phrases.where("order > 2").select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(F.array(*inner))).alias("phrase"), F.size(words).alias("size"))
        each = each.where(F.size(F.split("phrase", " ")) < F.col("size"))
        longer = each.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        best = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a"))).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    # at most PARTS * top rows of a language meet in a task
    parts = first(best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part").drop("rank", "part")
    total = counts.where("order = 0").select("lang", F.col("f").alias("n"))
    return first(parts, "lang").join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with p as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') w from (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) piece from documents)),
g as (
  select lang, 1 o, unnest(w) p from p
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from p
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from p),
f as materialized (select lang, o, p, count(*)::hugeint f from g group by all),
n as (select lang, sum(f)::bigint n from f where o = 1 group by lang),
c as (select lang, o, p, f a, string_split(p, ' ') w from f where o > 1 and f >= {MIN_COUNT}),
k as (
  select lang, o, p, a, 1 k, w[1] x, array_to_string(w[2:], ' ') y from c
  union all select lang, o, p, a, 2, w[1] || ' ' || w[2], w[3] from c where o = 3),
s as (select k.*, l.f l, r.f r, ({SCALE} * k.a * k.a) // (l.f * r.f) score from k join f l on l.lang = k.lang and l.p = k.x join f r on r.lang = k.lang and r.p = k.y),
b as (select * from s qualify row_number() over (partition by lang, p order by score, k) = 1),
i as (select lang, p, max(a) a from (select lang, w[1] || ' ' || w[2] p, a from c where o = 3 union all select lang, w[2] || ' ' || w[3], a from c where o = 3) group by all),
z as (select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, b.p) rank from b left join i on i.lang = b.lang and i.p = b.p where i.a is null or 100 * i.a < {CONTAINED_PERCENT} * b.a)
select lang, rank, p phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score from z join n using (lang) where rank <= {TOP}"""
