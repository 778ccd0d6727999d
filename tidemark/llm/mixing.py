"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, e = target / source words. Documents stand in
order of size within their source; with the expected copies summed up to and including a document, S, one
random offset u per source, and the sum before it, S - e, the document is emitted floor(S + u) - floor(S - e + u)
times: once for each integer boundary crossed. Because neighbours in the order have like sizes, the words
taken stay near the target.

The prefix sum is built in levels (size bin, sub-bin by a hash of the id, size and finer hash, rank within all), so
that no task ever holds a whole source. Rows alike in everything that is asked for are one row with a count until
the result is written, so that a repeated row makes no group either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

SPACE = " \t\n\x0b\x0c\r"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
#: Copies of one row that one task writes.
SPLIT = 1 << 16


def size_of(text):
    """Number of whitespace-separated words (0x20, 0x09-0x0D) of a text column; null: 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def running(rows: DataFrame, order: list, sums: dict, label: str) -> DataFrame:
    """``rows`` with, for each (name, column) of ``sums``, the column's sum over all rows before this one in an order
    without ties. Rows are dealt out by ranges of the order; only one row a range meets in a task."""
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(before().orderBy("_range")), zero).alias(f"_{name}") for name in sums])
    out = ranged.join(F.broadcast(starts), "_range")
    own = [(F.coalesce(F.sum(c).over(before("_range").orderBy(*order)), zero) + F.col(f"_{name}")).alias(name) for name, c in sums.items()]
    return out.select(*rows.columns, *own)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, ordinal, source_size, target) for each source of ``(source, size)``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. All words are shared by weight, no source
    above 3 times its own; the excess goes to the others by weight. That is one level l with target =
    least(l * weight, 3 * size): the sources with the least 3 * size / weight are the capped ones. Sources may be
    many: order and sums are taken range by range. A source without words has target 0.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    s = running(s, [F.col("source").asc_nulls_last()], {"earlier": "one"}, "mix-sources").withColumn("ordinal", (F.col("earlier") + 1).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("ordinal") - 1) % len(WEIGHTS) + 1)).withColumn("cap", MAX_COPIES * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    s = running(s.select("source", "ordinal", "source_size", "weight", "cap"), [ratio, F.col("ordinal")], {"capped": "cap", "passed": "weight"}, "mix-levels")
    s = materialize(s, "mix-targets")
    total, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    # The level if this source and all after it are open; it holds from the first source that isn't capped at it.
    s = s.withColumn("level", (F.lit(total) - F.col("capped")) / (F.lit(weights) - F.col("passed")))
    first = s.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct(ratio.alias("ratio"), "ordinal", "level")).alias("x")).first().x
    level = F.lit(first.level if first else None).cast("double")
    target = F.when(level.isNull() | (level * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return s.select("source", "ordinal", "source_size", target.alias("target"))


def _offset(seed: str):
    """Uniform in [0, 1), fixed by seed and source."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.col("ordinal").cast("string")))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _alike(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """(row: id and the columns in ``keep``, source, size, h, m): rows alike in all of these, and how many they are."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), *keep).alias("row"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), digest.alias("h"))
    # size is computed once; the counts and sums below read a small table, not the texts
    return materialize(rows.groupBy("row", "source", "size", "h").agg(F.count("*").alias("m")), "mix-rows")


def _drawn(alike: DataFrame, seed: str) -> DataFrame:
    """(row, size, source_size, target, copies), one for each of the m rows."""
    rows = alike.withColumn("bin", F.floor(F.sqrt(F.col("size").cast("double"))).cast("int")).withColumn("sub", F.substring("h", 1, 2)).withColumn("fine", F.substring("h", 3, 2))
    goal = source_targets(rows.select("source", (F.col("size") * F.col("m")).alias("size")))
    fine = ["source", "bin", "sub", "size", "fine"]
    n = rows.groupBy(*fine).agg(F.sum("m").alias("n"))
    subs = n.groupBy("source", "bin", "sub").agg(F.sum("n").alias("n"))
    bins = subs.groupBy("source", "bin").agg(F.sum("n").alias("n"))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("source", "bin", before(["source"], ["bin"]).alias("bin_start"))
    subs = subs.select("source", "bin", "sub", before(["source", "bin"], ["sub"]).alias("sub_start"))
    n = n.select(*fine, before(["source", "bin", "sub"], ["size", "fine"]).alias("fine_start"))
    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    start = subs.alias("a").join(bins.alias("b"), same("a", "b", "source", "bin")).join(goal.alias("g"), same("a", "g", "source"))
    start = start.select("a.source", "a.bin", "a.sub", (F.col("bin_start") + F.col("sub_start")).alias("start"), "ordinal", "source_size", "target")
    start = n.alias("n").join(start.alias("s"), same("n", "s", "source", "bin", "sub")).select(*[f"n.{c}" for c in fine], (F.col("start") + F.col("fine_start")).alias("start"), "ordinal", "source_size", "target")
    # the window's groups are those of the join, so the rows move once
    own = F.coalesce(F.sum("m").over(Window.partitionBy(*[f"r.{c}" for c in fine]).orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.alias("r").withColumn("rank", own).alias("r").join(start.alias("s"), same("r", "s", *fine))
    e = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(F.lit(0.0))
    out = out.select("r.row", "r.size", "m", (F.col("start") + F.col("rank")).alias("start"), "source_size", "target", e.alias("e"), _offset(seed).alias("u"))
    one = F.lit(1).cast("long")
    each = out.where(F.col("m") <= SPLIT).withColumn("k", F.explode(F.sequence(one, F.col("m"))))
    if not alike.where(F.col("m") > SPLIT).isEmpty():
        many = out.where(F.col("m") > SPLIT).withColumn("k0", F.explode(F.sequence(one, F.col("m"), F.lit(SPLIT).cast("long")))).repartition("row", "k0")
        each = each.unionByName(many.withColumn("k", F.explode(F.sequence(F.col("k0"), F.least(F.col("k0") + SPLIT - 1, "m")))).drop("k0"))
    at = F.col("start") + F.col("k")
    copies = F.least(F.floor(at * F.col("e") + F.col("u")) - F.floor((at - 1) * F.col("e") + F.col("u")), F.lit(MAX_COPIES)).cast("int")
    return each.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Per input row: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (size * copies), and the
    columns in ``keep``, by which rows are told apart as well.

    Null texts and texts without words have size 0 and take 0 words. Null sources are one source, the last.
    Null ids and repeated rows each count as a document. The same table gives the same result whatever its
    partitioning: order within a source is by (size, md5 of the id, id, kept columns), and rows alike in all of them
    are alike in the result. An empty table gives an empty table.
    """
    keep = keep or []
    out = _drawn(_alike(docs, id_col, text_col, source_col, keep), seed)
    return out.select(F.col("row.id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[F.col(f"row.{c}").alias(c) for c in keep])


def oracle() -> str:
    return rf"""
with d as (select row_number() over () r, doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint size, md5(coalesce(doc_id::varchar, '')) h from documents),
s0 as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) ordinal from s0),
s2 as (select *, (ordinal - 1) % 3 + 1 weight, 3 * source_size cap from s1),
s3 as (select *, coalesce(sum(cap) over (order by cap::double / weight, ordinal rows between unbounded preceding and 1 preceding), 0)::bigint capped, sum(weight) over (order by cap::double / weight, ordinal rows between current row and unbounded following)::bigint open, sum(source_size) over ()::bigint total from s2),
s4 as (select *, (total - capped)::double / open as lvl from s3),
l as (select arg_min(lvl, (cap::double / weight, ordinal)) lvl from s4 where lvl * weight <= cap),
g as (select source, ordinal, source_size, case when l.lvl is null or l.lvl * weight > cap then cap::double else l.lvl * weight end target, ('0x' || substr(md5('{SEED}:' || ordinal::varchar), 1, 8))::bigint / 4294967296.0::double u from s4, l),
k as (select d.*, g.source_size, g.target, g.u, case when g.source_size > 0 then least(g.target / g.source_size, 3.0::double) else 0.0::double end e,
  row_number() over (partition by d.source order by floor(sqrt(size::double)), substr(h, 1, 2), size, h, doc_id) pos from d join g on d.source is not distinct from g.source),
c as (select *, least(floor(pos * e + u) - floor((pos - 1) * e + u), 3)::bigint copies from k)
select doc_id, size, source_size, target, size * copies taken from c"""


def emit(docs: DataFrame, columns: list[str], seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and source among ``columns``) as often as the mix takes them, with ``copy``
    numbered from 1. A document that the mix takes no time is left out; nulls and repeated rows are as in :func:`mix`.

    The mix is drawn on rows without their texts, which have a hash in their place; texts are joined once.
    """
    narrow = [c for c in columns if c not in ("doc_id", "text")]
    docs = docs.select(*columns, F.xxhash64("text").alias("_text"))
    alike = _alike(docs, "doc_id", "text", "source", [*narrow, "_text"])
    rows = _drawn(alike, seed).where("copies > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    same = lambda a, b, x: F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._text") == F.col(f"{b}._text"))
    texts = docs.select("doc_id", "_text", "text")
    again = materialize(alike.groupBy("row.id", "row._text").agg(F.sum("m").alias("m")).where("m > 1").select(F.col("id").alias("doc_id"), "_text"), "mix-repeated")
    if not again.isEmpty():
        once = texts.alias("t").join(again.alias("a"), same("t", "a", "doc_id"), "left_semi").groupBy("doc_id", "_text").agg(F.min("text").alias("text"))
        texts = texts.alias("t").join(again.alias("a"), same("t", "a", "doc_id"), "left_anti").unionByName(once)
    out = rows.alias("r").join(texts.alias("t"), same("r", "t", "id"))
    return out.select(*[F.col("r.id" if c == "doc_id" else "t.text" if c == "text" else f"r.{c}").alias(c) for c in columns], "copy")
