"""The queries of this subpackage and, where SQL can express them, the DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_decontaminate")
def op1(spark, sf_dir):
    from tidemark.llm.decontaminate import contaminated, split_items

    return contaminated(table(spark, sf_dir, "documents"), split_items(table(spark, sf_dir, "benchmark")))


@query("op2_quality")
def op2(spark, sf_dir):
    from tidemark.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_simhash")
def op3(spark, sf_dir):
    from tidemark.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


@query("op9_secrets")
def op9(spark, sf_dir):
    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")


@query("op4_langid")
def op4(spark, sf_dir):
    from tidemark.llm.langid import fit_langid, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, *fit_langid(docs))


@query("op5_licenses")
def op5(spark, sf_dir):
    from tidemark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_lm")
def op6(spark, sf_dir):
    from tidemark.llm.lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


@query("op7_warc")
def op7(spark, sf_dir):
    from tidemark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


@query("op8_mixing")
def op8(spark, sf_dir):
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("copies")


@query("op10_nearest")
def op10(spark, sf_dir):
    from pyspark.sql import functions as F

    from tidemark.llm.ann import search

    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_compaction")
def op11(spark, sf_dir):
    from tidemark.llm.compaction import compaction_table

    return compaction_table(table(spark, sf_dir, "documents"))


@query("op12_shards")
def op12(spark, sf_dir):
    from tidemark.llm.sharding import shard_table

    return shard_table(table(spark, sf_dir, "documents"))


@query("op13_collocations")
def op13(spark, sf_dir):
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def _oracles() -> None:
    from tidemark.llm import ann, collocations, compaction, licenses, lm, mixing, sharding, warc

    ORACLE["op5_licenses"] = licenses.oracle()
    ORACLE["op6_lm"] = lm.oracle()
    ORACLE["op7_warc"] = warc.oracle()
    ORACLE["op10_nearest"] = ann.oracle()
    ORACLE["op8_mixing"] = mixing.oracle()
    ORACLE["op11_compaction"] = compaction.oracle()
    ORACLE["op12_shards"] = sharding.oracle()
    ORACLE["op13_collocations"] = collocations.oracle()


_oracles()
