"""Benchmark decontamination: a BM25 inverted index of test items, asked with every passage of every document.

The index holds the items (question and answer) as documents. A passage asks with its distinct words, and the
score of an item is its BM25 sum divided by what the item scores with all of its own words, so 1 means all of
an item's weight is there and one threshold suits items of every length. Postings stand in order of item, items
in order of length, and each word's list is cut at blocks of items, whose largest impact is kept.

All items at or above the threshold are retrieved by block-max WAND, for the passages of a slice of texts at
once. A passage is dropped if its words' largest impacts together can't reach the threshold. Of the others, the
words are put in order of their lists' largest impact; as long as these add up to less than the threshold, no item
can do with such words alone, so only blocks in the other words' lists are pivots. A pivot block is skipped if the
words' largest impacts inside it can't reach the threshold; only then are postings read, those of the block. No item that reaches
the threshold is lost.

What is retrieved is verified on the passage itself: 0.8 of the item's five-word shingles, and half of the word pairs
of the question and of the answer, each by itself, must stand in it.

Passages are windows of 2L words every L words, where L bounds the length of the items asked for, so every run
of L words lies whole in one window. Items are dealt into indexes by length class, of at most ``INDEX_BYTES`` each,
and indexes are asked together, as many as ``PASS_BYTES`` hold, so a pass over the documents asks all of a usual
benchmark; what is broadcast is never larger.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._tokens import as_bytes, map_slices, sliced
from tidemark.session import materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE, MIN_OVERLAP = 5, 0.8
PART, MIN_PART = 2, 0.5
ITEM_BLOCK = 8
SHORTEST_CLASS = 64
#: Most bytes of items that make one index, and of indexes that one pass over the documents asks.
INDEX_BYTES, PASS_BYTES = 8 << 20, 64 << 20
#: Entries of postings or blocks that are added up at a time.
ENTRIES = 1 << 21

_SPACES = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))


def tokens(data: bytes) -> list[bytes]:
    """Words of a text's UTF-8 in lower case, ASCII punctuation and white space taken as breaks."""
    return data.decode("utf-8", "replace").lower().encode().translate(_SPACES).split()


def shingles(w: list[bytes], n: int = SHINGLE) -> list[bytes]:
    """Runs of n words; of fewer words, the whole run; of none, nothing."""
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text: the last sentence is the answer; of a single sentence,
    the last quarter of its words."""
    text = (text or "").strip()
    parts = re.split(r"(?<=[.!?])\s+", text)
    if len(parts) > 1:
        return text[: len(text) - len(parts[-1])].strip(), parts[-1]
    w = text.split()
    cut = len(w) - math.ceil(len(w) / 4)
    return " ".join(w[:cut]), " ".join(w[cut:])


class Postings(NamedTuple):
    """Lists one after the other: that of word t is start[t] to start[t + 1]."""

    start: np.ndarray
    at: np.ndarray
    impact: np.ndarray


class Texts:
    """Words of a slice of texts, as numbers of a vocabulary (-1 if they aren't in it)."""

    def __init__(self, texts: list[bytes], vocab: dict[bytes, int]):
        self.words = [tokens(t) for t in texts]
        self.size = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.origin = np.cumsum(self.size) - self.size
        term = np.fromiter(map(vocab.get, chain.from_iterable(self.words), repeat(-1)), np.int64, int(self.size.sum()))
        #: places of known words, counted over all texts
        self.at = np.flatnonzero(term >= 0)
        self.term = term[self.at]
        self.text = np.repeat(np.arange(len(texts)), self.size)[self.at]


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) for all positions of the ranges start to stop."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]


def _runs(size: np.ndarray, most: int):
    """(from, to) of neighbours whose sizes add up to about ``most``."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class BlockMaxIndex:
    """Items ``(item_id, question, answer)`` of one length class. ``whole`` has the number of all items, their mean
    length and the document frequency of each word here, where there are items beyond these; ``vocab`` numbers words
    for several indexes and grows."""

    def __init__(self, items: list[tuple[int | None, str, str]], threshold: float = THRESHOLD, whole: tuple[int, float, dict[bytes, int]] | None = None, vocab: dict[bytes, int] | None = None):
        qa = [(i, tokens((q or "").encode()), tokens((a or "").encode())) for i, q, a in items]
        qa.sort(key=lambda x: (len(x[1]) + len(x[2]), x[0] is None, x[0] or 0))
        self.threshold = threshold
        self.ids = [i for i, _, _ in qa]
        self.parts = [(shingles(q) + shingles(a), shingles(q, PART), shingles(a, PART)) for _, q, a in qa]
        bags = [Counter(q + a) for _, q, a in qa]
        self.longest = max(sum(b.values()) for b in bags)
        df = Counter(w for b in bags for w in b)
        self.vocab = vocab if vocab is not None else {}
        for w in sorted(df):
            self.vocab.setdefault(w, len(self.vocab))
        n, mean, df = whole or (len(bags), sum(sum(b.values()) for b in bags) / len(bags), df)
        rows = []
        for i, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in bag.items()}
            total = sum(own.values())
            rows += [(self.vocab[w], i, x / total) for w, x in own.items()]
        rows.sort()
        term, item = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        impact = np.array([r[2] for r in rows], np.float32)
        #: numbers of the words that some item here has, and their lists of items, and of blocks with largest impacts
        self.terms, first = np.unique(term, return_index=True)
        self.items = Postings(np.r_[first, len(rows)], item, impact)
        cut = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // ITEM_BLOCK != item[:-1] // ITEM_BLOCK)])
        self.blocks = Postings(np.searchsorted(cut, self.items.start), item[cut] // ITEM_BLOCK, np.maximum.reduceat(impact, cut))
        #: postings of each block entry: from here to the next
        self.block_items = np.r_[cut, len(rows)]
        self.list_max = np.maximum.reduceat(impact, first)

    def local(self, size: int) -> np.ndarray:
        """From a word's number in the vocabulary to its list here, -1 without one."""
        out = np.full(size, -1)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def retrieve(self, windows: np.ndarray, terms: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, item position, score) at or above the threshold, for pairs of window and distinct list, sorted."""
        if not len(windows):
            return []
        least = self.threshold - 1e-6
        starts = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]])
        count = np.diff(np.r_[starts, len(terms)])
        live = np.add.reduceat(self.list_max[terms], starts) >= least
        terms, ids, count = terms[np.repeat(live, count)], windows[starts[live]], count[live]
        out = []
        for lo, hi in _runs(np.bincount(np.repeat(np.arange(len(ids)), count), np.diff(self.blocks.start)[terms], len(ids)), ENTRIES):
            base = count[:lo].sum()
            out += self._walk(ids[lo:hi], count[lo:hi], terms[base : base + count[lo:hi].sum()], least)
        return out

    def _walk(self, ids: np.ndarray, count: np.ndarray, terms: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        own = np.repeat(np.arange(len(ids)), count)
        order = np.lexsort((self.list_max[terms], own))
        terms = terms[order]
        sums = np.cumsum(self.list_max[terms], dtype=float)
        before = np.r_[0.0, sums][np.cumsum(count) - count]
        needed = sums - before[own] >= least
        # pivots: blocks in the lists that an item can't do without
        which, at = _spread(self.blocks.start[terms[needed]], self.blocks.start[terms[needed] + 1])
        n_blocks = -(-len(self.ids) // ITEM_BLOCK)
        pivot = np.unique(own[needed][which] * n_blocks + self.blocks.at[at])
        # the largest impacts of all words inside the pivots
        which, at = _spread(self.blocks.start[terms], self.blocks.start[terms + 1])
        cell = own[which] * n_blocks + self.blocks.at[at]
        place = np.searchsorted(pivot, cell)
        on = place < len(pivot)
        on[on] = pivot[place[on]] == cell[on]
        place, at = place[on], at[on]
        enough = np.bincount(place, self.blocks.impact[at], len(pivot)) >= least
        place, at = place[enough[place]], at[enough[place]]
        # postings of the blocks that are left
        which, post = _spread(self.block_items[at], self.block_items[at + 1])
        cell, inverse = np.unique((pivot[place] // n_blocks)[which] * len(self.ids) + self.items.at[post], return_inverse=True)
        score = np.bincount(inverse, self.items.impact[post], len(cell))
        good = np.flatnonzero(score >= least)
        return [(int(ids[c // len(self.ids)]), int(c % len(self.ids)), float(x)) for c, x in zip(cell[good], score[good])]

    def overlaps(self, item: int, present: set[bytes]) -> tuple[float | None, float | None, float | None]:
        """Shares of the question's and the answer's word pairs, and of all of the item's shingles, that are present."""
        share = lambda x: sum(s in present for s in x) / len(x) if x else None
        every, question, answer = self.parts[item]
        return share(question), share(answer), share(every)

    def scan(self, texts: list[bytes]):
        """As :meth:`find`, of texts."""
        yield from self.find(Texts(texts, self.vocab), self.local(len(self.vocab)))

    def find(self, texts: Texts, local: np.ndarray):
        """Yield (text's position, item_id, score, question share, answer share) of verified items, each once a text."""
        length, size = self.longest, len(self.terms)
        term = local[texts.term]
        known = term >= 0
        if not known.any():
            return
        term, at, text = term[known], texts.at[known], texts.text[known]
        count = np.maximum(1, -(-texts.size // length) - 1)
        origin = np.cumsum(count) - count
        cell = (at - texts.origin[text]) // length
        # the word at cell c stands in the windows that begin at cells c - 1 and c
        keys = [((origin[text] + cell - shift) * size + term)[(cell >= shift) & (cell - shift < count[text])] for shift in (0, 1)]
        pairs = np.sort(np.concatenate(keys))
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        found: dict[tuple[int, int], tuple] = {}
        shown: dict[int, set] = {}
        for window, item, score in self.retrieve(pairs // size, pairs % size):
            k = int(np.searchsorted(origin, window, "right")) - 1
            if window not in shown:
                lo = (window - origin[k]) * length
                run = texts.words[k][lo : lo + 2 * length]
                shown = {window: {x for n in range(1, SHINGLE + 1) for x in shingles(run, n)}}
            q, a, both = self.overlaps(item, shown[window])
            if both is not None and both >= MIN_OVERLAP and min(x for x in (q, a) if x is not None) >= MIN_PART and score > found.get((k, item), (0,))[0]:
                found[k, item] = (score, q, a)
        for (k, item), (score, q, a) in sorted(found.items()):
            yield k, self.ids[item], score, q, a


class IndexGroup:
    """Indexes that are asked together: texts are read once for all of them."""

    def __init__(self, vocab: dict[bytes, int], indexes: list[BlockMaxIndex]):
        self.vocab, self.indexes = vocab, indexes
        self.locals = [x.local(len(vocab)) for x in indexes]

    def scan(self, texts: list[bytes]):
        read = Texts(texts, self.vocab)
        for index, local in zip(self.indexes, self.locals):
            yield from index.find(read, local)


def length_class(n):
    """1 for up to SHORTEST_CLASS words, then doubling; of an integer column."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(SHORTEST_CLASS)))).cast("int")


def index_groups(items: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES, pass_bytes: int = PASS_BYTES):
    """Yield an :class:`IndexGroup` for each pass over the documents; the driver holds the items of one pass at a time,
    and weights follow all items. Items without words are left out: no passage holds them."""
    bag = F.udf(lambda q, a: (lambda w: (len(w), sorted(set(w))))(tokens((q or "").encode()) + tokens((a or "").encode())), "n int, words array<binary>")
    some = items.select("item_id", "question", "answer").distinct().withColumn("x", bag("question", "answer")).where("x.n > 0")
    some = some.withColumn("bytes", F.lit(64) + 40 * F.size("x.words") + 4 * F.octet_length(F.concat_ws(" ", "question", "answer")))
    held = materialize(some.withColumn("c", length_class(F.col("x.n"))), "items")
    n_items, mean = held.agg(F.count("*"), F.avg("x.n")).first()
    df = materialize(held.select(F.explode("x.words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "item-words")
    # one row a length class, of which there are as many as doublings
    parts = {r.c: -(-r.b // index_bytes) for r in held.groupBy("c").agg(F.sum("bytes").alias("b")).collect()}
    dealt = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else F.create_map(F.lit(0), F.lit(1))
    held = held.withColumn("part", F.pmod(F.xxhash64("item_id", "question", "answer"), dealt[F.col("c")]).cast("int"))
    sizes = held.groupBy("c", "part").agg(F.sum("bytes").alias("b")).orderBy("c", "part").collect()
    for lo, hi in _runs(np.array([r.b for r in sizes], np.int64), pass_bytes):
        now = held.join(F.broadcast(items.sparkSession.createDataFrame([(r.c, r.part) for r in sizes[lo:hi]], "c int, part int")), ["c", "part"])
        known = {bytes(r.word): r.df for r in df.join(now.select(F.explode("x.words").alias("word")).distinct(), "word", "left_semi").collect()}
        rows: dict[tuple, list] = {}
        for r in now.select("c", "part", "item_id", "question", "answer").collect():
            rows.setdefault((r.c, r.part), []).append((r.item_id, r.question, r.answer))
        vocab: dict[bytes, int] = {}
        yield IndexGroup(vocab, [BlockMaxIndex(rows[k], threshold, (n_items, mean, known), vocab) for k in sorted(rows)])


def split_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, question, answer) of items that are one text each; see :func:`split_item`. The benchmark is a
    small table, so this runs row by row."""
    cut = F.udf(split_item, "question string, answer string")
    return benchmark.select(F.col(id_col).alias("item_id"), cut(F.col(text_col)).alias("x")).select("item_id", "x.question", "x.answer")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Rows ``(id, item_id, score, question_overlap, answer_overlap)``, one per document row and item found in it.

    ``items`` has item_id, question, answer. Null or empty texts hold nothing; null ids are carried; a repeated
    document or item gives repeated rows; columns other than the named ones (and ``keep``) aren't read. An
    overlap is null where the item lacks that part. No shuffle is made: the indexes go to the documents.
    """
    spark = docs.sparkSession
    keep = keep or []
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)

    def asked(index):
        sent = spark.sparkContext.broadcast(index)

        def run(batches):
            index = sent.value
            for batch in batches:
                for part in sliced(batch, "t"):
                    rows = list(index.scan(as_bytes(part, "t")))
                    at = pa.array([r[0] for r in rows], pa.int64())
                    columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), *columns], names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)

    for group in index_groups(items, threshold):
        out = out.unionByName(asked(group))
    return out.withColumnRenamed("id", id_col)


def filter_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no verified item; found as in :func:`contaminated`. Null and empty
    texts stay; repeated rows share their fate."""

    def without(index):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def change(part):
            bad = {r[0] for r in sent.value.scan(as_bytes(part, "text"))}
            return part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        return change

    for group in index_groups(items, threshold):
        docs = map_slices(docs, without(group))
    return docs
