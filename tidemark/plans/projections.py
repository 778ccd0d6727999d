"""The model's tables as projections of star-schema, event, vector and document tables, in DataFrame form and as the
common table expressions of the SQL statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF_DAY = 43_200_000_000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores by their keys, for work that costs far more than reading them: a file is read by one task
    for each of its row groups, and one row group may hold millions of short rows."""
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


GT_SQL = """gt as (select l_suppkey % 10 video_id, l_orderkey % 1000 frame_idx, l_linenumber::bigint track_id, min(l_partkey) pk,
  40.0::double * any_value(l_linenumber) + min(l_quantity) x, (min(l_partkey) % 50)::double y, 30.0::double w, 30.0::double h from lineitem group by 1, 2, 3)"""
PRED_SQL = """pr as (select video_id, frame_idx, track_id + 100 track_id, pk, x + pk % 9 x, y + pk % 5 y, w, h, (pk % 100) / 100.0::double conf, track_id as ord from gt where pk % 11 <> 0)"""


def _sides():
    return [F.lit(30.0).alias("w"), F.lit(30.0).alias("h")]


def gt_boxes(spark, d) -> DataFrame:
    g = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("video_id"), (F.col("l_orderkey") % 1000).alias("frame_idx"), F.col("l_linenumber").cast("long").alias("track_id"))
    g = g.agg(F.min("l_partkey").alias("pk"), F.min("l_quantity").alias("q"))
    return g.select("video_id", "frame_idx", "track_id", "pk", (40.0 * F.col("track_id") + F.col("q")).alias("x"), (F.col("pk") % 50).cast("double").alias("y"), *_sides())


def pred_boxes(spark, d) -> DataFrame:
    g = gt_boxes(spark, d).where(F.col("pk") % 11 != 0)
    return g.select("video_id", "frame_idx", (F.col("track_id") + 100).alias("track_id"), "pk", (F.col("x") + F.col("pk") % 9).alias("x"), (F.col("y") + F.col("pk") % 5).alias("y"), *_sides(), ((F.col("pk") % 100) / 100.0).alias("conf"), F.col("track_id").alias("ord"))


def switched_boxes(spark, d) -> DataFrame:
    """Predictions whose track numbers change half way, with a phantom box every 97th frame."""
    p = pred_boxes(spark, d).withColumn("track_id", F.col("track_id") + F.when(F.col("frame_idx") >= 500, 50).otherwise(0))
    ghost = p.where(F.col("frame_idx") % 97 == 0).groupBy("video_id", "frame_idx").agg(F.max("pk").alias("pk"))
    ghost = ghost.select("video_id", "frame_idx", F.lit(999).cast("long").alias("track_id"), "pk", F.lit(5000.0).alias("x"), F.lit(0.0).alias("y"), *_sides(), F.lit(0.1).alias("conf"), F.lit(99).cast("long").alias("ord"))
    return p.unionByName(ghost)


def labelled_frames(spark, d) -> DataFrame:
    return gt_boxes(spark, d).select("video_id", "frame_idx").distinct()


ACTIONS = {"click": "걷기", "purchase": "점프", "view": "앉기", "signup": "엎드림"}
_CASE = "case event_type when 'click' then '걷기' when 'purchase' then '점프' when 'view' then '앉기' when 'signup' then '엎드림' end"


def _segment_sql(name: str, moving: str, where: str = "true") -> str:
    return f"""{name} as (select * from (select user_id video_id, event_id, event_type, value, row_number() over w as ord, epoch_us(ts) as start, lead(epoch_us(ts)) over w as "end",
  case when event_type in ({moving}) then 'moving' else 'static' end label, case when event_type in ({moving}) then 'dynamic' else 'static' end "group", {_CASE} as action,
  least(1.0::double, value / 100) conf, event_type = 'error' uncertain from events where {where} window w as (partition by user_id order by epoch_us(ts), event_id)) where "end" is not null)"""


GT_SEG_SQL = _segment_sql("gs", "'click', 'purchase'")
PRED_SEG_SQL = _segment_sql("ps", "'click', 'error'", "event_id % 3 <> 0")


def event_times(spark, d) -> DataFrame:
    """Events with ``us``, the wall-clock microseconds since the epoch, whatever the session's time zone."""
    us = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return read(spark, d, "events").withColumn("us", us)


def _segments(e: DataFrame, moving: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    action = None
    for k, v in ACTIONS.items():
        action = F.when(F.col("event_type") == k, v) if action is None else action.when(F.col("event_type") == k, v)
    is_moving = F.col("event_type").isin(*moving)
    s = e.select(
        F.col("user_id").alias("video_id"), "event_id", "event_type", "value", F.row_number().over(w).cast("long").alias("ord"), F.col("us").alias("start"), F.lead("us").over(w).alias("end"),
        F.when(is_moving, "moving").otherwise("static").alias("label"), F.when(is_moving, "dynamic").otherwise("static").alias("group"), action.alias("action"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("conf"), (F.col("event_type") == "error").alias("uncertain"),
    )
    return s.where("end is not null")


def gt_segments(spark, d) -> DataFrame:
    return _segments(event_times(spark, d), ("click", "purchase"))


def pred_segments(spark, d) -> DataFrame:
    return _segments(event_times(spark, d).where("event_id % 3 <> 0"), ("click", "error"))


def chunks(spark, d) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, d, "embeddings").select(v.alias("id"), F.col("label").alias("dog_id"), F.when(v % 3 == 0, "L1").otherwise("L2").alias("layer"), F.when(v % 17 == 0, "staff").otherwise("public").alias("vis"), "embedding")


CHUNK_SQL = "ch as (select vec_id id, label dog_id, case when vec_id % 3 = 0 then 'L1' else 'L2' end layer, case when vec_id % 17 = 0 then 'staff' else 'public' end vis, embedding::double[] embedding from embeddings)"


def card_fields(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    vis = F.when(k % 3 == 0, "public").when(k % 3 == 1, "public_soft").otherwise("staff")
    return read(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").cast("long").alias("dog_id"), F.col("c_mktsegment").alias("field"), F.col("c_name").alias("value"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("about "), F.col("c_mktsegment"))).alias("soft_value"), vis.alias("vis"))


CARD_SQL = "cf as (select c_custkey id, c_nationkey::bigint dog_id, c_mktsegment field, c_name as value, case when c_custkey % 5 = 0 then '' else 'about ' || c_mktsegment end soft_value, case c_custkey % 3 when 0 then 'public' when 1 then 'public_soft' else 'staff' end vis from customer)"


def track_vectors(spark, d) -> DataFrame:
    """Tracks of ten videos with a unit vector, their true identity and the frames of an event stream."""
    from tidemark.functions.vectors import doubles, normalized

    e = read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("video_id"), F.col("vec_id").alias("track_id"), F.col("label").cast("long").alias("gt_id"), normalized(doubles("embedding"), 0.0).alias("v"), (F.col("vec_id") % 150).alias("user_id"))
    f = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set((F.col("event_id") % 5000).cast("long"))).alias("frames"))
    return e.join(f, "user_id", "left").drop("user_id").withColumn("frames", F.coalesce("frames", F.array().cast("array<bigint>")))


def sampled_tracks(spark, d) -> DataFrame:
    """Tracks of ten videos as an embedder gives them: a video's rows of one identity among eight of its rows are the samples
    of a track, numbered by the first of them. Each sample is scaled to length 1, they are averaged in order, and the mean is
    scaled again; with the frames of an event stream. Samples without a vector are left out."""
    from tidemark.functions.vectors import EPS, doubles, norm

    # lengths are bound by arrays of one, or a lambda would take them anew for each component
    bound = lambda c, f: F.transform(F.array(c), f)[0]
    scaled = lambda a: bound(a, lambda v: bound(norm(v) + F.lit(EPS), lambda n: F.transform(v, lambda x: x / n)))
    v = F.col("vec_id")
    e = read(spark, d, "embeddings").where("embedding is not null").groupBy((v % 10).alias("video_id"), "label", F.expr("vec_id div 80").alias("part"))
    e = e.agg(F.min("vec_id").alias("track_id"), F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    total = lambda s: F.aggregate(s, F.transform(s[0], lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    mean = bound(F.transform("s", lambda r: scaled(doubles(r["embedding"]))), lambda s: F.transform(total(s), lambda x: x / F.size(s)))
    e = e.select("video_id", "track_id", scaled(mean).alias("v"), (F.col("track_id") % 150).alias("user_id"))
    f = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set((F.col("event_id") % 5000).cast("long"))).alias("frames"))
    return e.join(f, "user_id", "left").select("video_id", "track_id", "v", F.coalesce("frames", F.array().cast("array<bigint>")).alias("frames"))
