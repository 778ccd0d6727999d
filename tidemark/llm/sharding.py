"""Contiguous shards of nearly equal bytes from one global prefix sum, in DataFrame operations only.

Documents stand in order of (id, digest of the text). They are dealt out by ranges of that order; totals per range
give each range its start, and a running sum inside the range gives each document the bytes before it. The axis of
all bytes is cut at equal targets; a document belongs to the shard that holds its middle byte, so a shard misses
its target by half a document at either end. Whole texts move only when shards are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._sql import crc32
from tidemark.llm.mixing import SPLIT, running
from tidemark.session import materialize

SHARDS = 8
LAW = "bytes"


def one_by_one(rows: DataFrame, m: str, name: str, split: int = SPLIT) -> DataFrame:
    """Each row ``rows[m]`` times, with ``name`` numbered from 0. A row of more than ``split`` copies is cut into runs
    that are dealt out first, so that no task writes them all."""
    k = lambda start, stop: F.explode(F.sequence(start, stop))
    zero = F.lit(0).cast("long")
    few = rows.where(F.col(m) <= split).withColumn(name, k(zero, F.col(m) - 1))
    many = rows.where(F.col(m) > split).withColumn("_run", F.explode(F.sequence(zero, F.col(m) - 1, F.lit(split).cast("long"))))
    many = many.repartition(*rows.columns, "_run").withColumn(name, k(F.col("_run"), F.least(F.col("_run") + split, F.col(m)) - 1))
    return few.unionByName(many.drop("_run"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Per input row: id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``text_md5``, ``shard`` from 0, ``slot`` (place in
    the shard, gapless from 0) and the columns in ``keep``, by which rows are told apart as well.

    Null texts count as empty. Null ids come first. Rows alike in all of these are one row with a count until the end,
    so a repeated row makes no hot group; each of them gets a slot. A document larger than a shard's target can leave
    shards empty. The same table gives the same result whatever its partitioning. An empty table gives an empty table.
    """
    keep = keep or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).alias("id"), *keep)
    rows = docs.select(row.alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("text_md5"))
    # sizes and digests are computed once: what follows reads a narrow table
    alike = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "shard-rows")
    total = alike.agg(F.sum(F.col("size") * F.col("m"))).first()[0] or 1
    placed = running(alike, [F.col("row.id").asc_nulls_first(), F.col("text_md5"), F.col("row")], {"before": F.col("size") * F.col("m"), "at": F.col("m")}, "shard-ranges")
    placed = one_by_one(placed, "m", "copy", split)
    twice = (2 * (F.col("before") + F.col("copy") * F.col("size")) + F.col("size")).cast("decimal(20,0)")
    cut = F.least(F.lit(shards - 1).cast("long"), F.call_function("div", twice * F.lit(shards), F.lit(2 * total).cast("decimal(20,0)"))).cast("int")
    placed = materialize(placed.select("row", "size", "text_crc32", "text_md5", (F.col("at") + F.col("copy")).alias("at"), cut.alias("shard")), "shard-places")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # as many rows as there are shards
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("row.id").alias(id_col), "size", "text_crc32", "text_md5", "shard", (F.col("at") - F.col("first")).alias("slot"), *[F.col(f"row.{c}").alias(c) for c in keep])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows and columns of ``docs`` below ``path``, a folder a shard, each in ``files`` runs of slots, and return
    what was written. Nulls, ties and repeated rows are as in :func:`assign_shards`; columns named ``shard``, ``slot``,
    ``size``, ``text_crc32`` or ``text_md5`` in ``docs`` are an error.
    """
    clash = {"shard", "slot", "size", "text_crc32", "text_md5"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns that the shards add: {', '.join(sorted(clash))}")
    narrow = [c for c in docs.columns if c not in (id_col, text_col)]
    empty = "_was_null"
    base = docs.withColumn(empty, F.col(text_col).isNull())
    placed = assign_shards(base, shards, id_col, text_col, [*narrow, empty])
    # alike texts of one id travel once
    texts = docs.where(F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("_id"), F.md5(text_col).alias("_md5")).agg(F.min(text_col).alias(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")) & ~F.col(empty)
    out = placed.join(texts, same, "left").select(*docs.columns, "shard", "slot")
    per = placed.groupBy("shard").agg(F.ceil(F.count("*") / files).alias("_per"))
    out = out.join(F.broadcast(per), "shard").withColumn("_file", F.floor(F.col("slot") / F.col("_per")))
    out.repartition(shards * files, "shard", "_file").sortWithinPartitions("shard", "slot").drop("_per", "_file").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of :func:`assign_shards` under the law ``bytes``."""
    return assign_shards(docs, shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = SHARDS) -> str:
    return f"""
with d as (select doc_id, (strlen(coalesce(text, '')) + 1)::bigint size, {crc32("encode(coalesce(text, ''))")} text_crc32, md5(coalesce(text, '')) m from documents),
s as (select *, coalesce(sum(size) over (order by doc_id nulls first, m rows between unbounded preceding and 1 preceding), 0)::hugeint before, sum(size) over ()::hugeint total, row_number() over (order by doc_id nulls first, m) pos from d),
c as (select *, least({shards - 1}, (2 * before + size) * {shards} // (2 * total))::int shard from s)
select doc_id, size, text_crc32, '{LAW}' law, shard, (row_number() over (partition by shard order by pos) - 1)::bigint slot, null::int grown_shard from c"""
