"""Bringing a job's analyses into the store: what was observed becomes rows, chunks with vectors, and traits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import external
from tidemark.operators import segments as S
from tidemark.operators.store import DIMENSION, TRAITS, Store, ingest_gate, l2_rows

PROFILE = "behavior string, caption string, scene_tags array<string>, audio array<struct<label:string,p:double>>, indoor boolean, categories array<struct<category:string,p:double>>, dark boolean"
#: The same of a job's file, where tags stand apart.
SEEN = "behavior:string,caption:string,audio:array<struct<label:string,p:double>>,indoor:boolean,categories:array<struct<category:string,p:double>>,dark:boolean"
#: Columns of a chunk but its id.
CHUNK = ["dog_id", "layer", "trait", "conf", "vis", "video_id", "t_start", "t_end", "text", "embedding"]


def _chunks(rows: DataFrame, layer: str, embed, **known) -> DataFrame:
    """Rows with a text as chunks, embedded; columns that ``rows`` lacks are null."""
    rows = external.embed_texts(rows, "text", DIMENSION, embed).withColumn("layer", F.lit(layer)).withColumn("vis", F.lit("public"))
    for name, value in known.items():
        rows = rows.withColumn(name, value)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in CHUNK])


def ingest_job(store: Store, dog_id: str, job_id: str, meta: DataFrame, videos: DataFrame, segments: DataFrame, tags: DataFrame, embed: Callable | None = None, traits: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Take a job's videos into the store: their analyses, their L2 chunks, and with ``traits`` the subject's L1 chunks anew.

    ``meta`` has foster_uncertain (:func:`store.ingest_gate` refuses a job with open subjects), ``videos`` video_id and
    the columns of ``PROFILE`` but scene_tags, ``segments`` video_id, ord, start, end, group, action, conf, uncertain, and
    ``tags`` video_id, tags. Videos without profile and segments are left out. A video that was there before is
    replaced, whatever job it came with. Returns how many videos and chunks were written.
    """
    ingest_gate(meta)
    store.init()
    item = F.struct("ord", "start", "end", "group", "action", "conf", "uncertain")
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    seen = videos.withColumn("profile", F.struct(*[c for c in videos.columns if c != "video_id"])).select("video_id", "profile")
    both = seen.join(rows, "video_id", "full").join(tags.select("video_id", F.array_sort("tags").alias("scene_tags")), "video_id", "left").withColumn("dog_id", F.lit(dog_id))
    plain = F.transform(F.coalesce("s", F.array().cast(rows.schema["s"].dataType)), lambda s: s.dropFields("ord"))
    profile = F.to_json(F.struct("profile.*", "scene_tags"))
    analyses = both.select("dog_id", "video_id", F.lit(job_id).alias("job_id"), plain.alias("segments"), profile.alias("profile"))
    cited = S.cited_segment(segments.withColumn("dog_id", F.lit(dog_id)), ["dog_id", "video_id"])
    told = l2_rows(both.select("dog_id", "video_id", "profile.behavior", "profile.caption", "scene_tags"), cited.select("dog_id", "video_id", "start", "end", "conf"))
    l2 = _chunks(told, "L2", embed)
    store.ingest(dog_id, analyses, l2)
    l1 = reaggregate(store, dog_id, traits, embed) if traits else 0
    return {"videos": analyses.count(), "l2": told.count(), "l1": l1}


def observed(store: Store, dog_id: str) -> tuple[DataFrame, float]:
    """(lines: video_id, line; conf): a record line of each of the subject's videos, and how sure the whole is."""
    own = store.read("video_analysis").where(F.col("dog_id") == dog_id)
    videos = own.select("video_id", F.from_json("profile", PROFILE).alias("p")).select("video_id", "p.*")
    each = own.select("dog_id", "video_id", F.inline("segments"))
    roll = S.activity_rollup(each, ["dog_id"]).first()
    return S.record_lines(videos, each), roll.conf if roll else 0.0


def reaggregate(store: Store, dog_id: str, traits: Callable[[DataFrame], DataFrame], embed: Callable | None = None) -> int:
    """The subject's L1 chunks from all of its videos. ``traits`` turns record lines into (trait, text), checked and
    rewritten as it sees fit (:func:`external.verify_and_rewrite`); traits of another name or without a text are left out.
    What it doesn't give any more is deleted."""
    lines, conf = observed(store, dog_id)
    said = traits(lines).where(F.col("trait").isin(*TRAITS) & (F.length(F.trim("text")) > 0)).dropDuplicates(["trait"])
    l1 = _chunks(said.withColumn("dog_id", F.lit(dog_id)), "L1", embed, conf=F.lit(float(conf)))
    store.replace_traits(dog_id, l1)
    return store.read("chunks").where((F.col("dog_id") == dog_id) & (F.col("layer") == "L1")).count()


def read_card(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(subject: name, status; fields: field, value, soft_value, vis, ord) of a card file."""
    raw = spark.read.schema("name string, status string, fields array<struct<field:string,value:string,soft_value:string,vis:string>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select("name", "status"), raw.select(F.posexplode("fields").alias("ord", "f")).select("f.*", "ord")


def job_tables(spark, workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(meta, videos, segments, tags) of a job's files, as :func:`ingest_job` takes them."""
    from tidemark.sources.records import read_actions

    raw = spark.read.schema(f"foster_uncertain array<string>, scene_profile map<string,struct<{SEEN}>>, scene_tags map<string,array<string>>").option("multiLine", True).json(workspace.meta)
    meta = raw.select(F.coalesce("foster_uncertain", F.array().cast("array<string>")).alias("foster_uncertain"))
    videos = raw.select(F.explode("scene_profile").alias("video_id", "p")).select("video_id", "p.*")
    tags = raw.select(F.explode("scene_tags").alias("video_id", "tags"))
    return meta, videos, read_actions(spark, workspace.preds("m4")), tags
