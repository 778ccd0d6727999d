"""The places where a model is asked, each with the shape of its question and answer. Every one takes a backend as
:func:`external.call` does, asks distinct inputs once, and leaves nothing of an answer unchecked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import external, text
from tidemark.functions.geometry import box, crop_box, scaled
from tidemark.functions.vectors import mean_pool
from tidemark.operators.timeline import uniform_positions

DETECTIONS = "array<struct<track_id:bigint,x:double,y:double,w:double,h:double,conf:double,cls:string>>"
LOGPROBS = "array<struct<class:string,logprob:double>>"
CROPS, CROP_MARGIN = 8, 0.05
#: Speech in a block: silence before it, after it, and the least that must follow before the block is stretched.
LEAD, TAIL, LEAST_TAIL = 0.4, 0.35, 0.15


def _ask(df: DataFrame, keys: list[str], out: str, kind: str, backend: Callable[[], Callable], **options) -> DataFrame:
    """``df`` with the answer to the JSON of its key columns; a backend gets and gives lists."""
    asked = df.withColumn("_q", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return external.call(asked, "_q", out, kind, backend, **options).drop("_q")


def detect(frames: DataFrame, backend: Callable[[], Callable], cls: tuple[str, ...] = ("dog",)) -> DataFrame:
    """Boxes of frames (video_id, frame_idx, t): as :func:`records.explode_frames`, only of the wanted classes."""
    d = _ask(frames, ["video_id", "frame_idx"], "d", DETECTIONS, backend).select("video_id", "frame_idx", "t", F.posexplode("d").alias("ord", "d"))
    return d.select("video_id", "frame_idx", "t", "ord", "d.*").where(F.col("cls").isin(*cls))


def detect_on(frames: DataFrame, backend: Callable[[], Callable], scale: float = 1.0) -> DataFrame:
    """Detections on labelled frames, without tracking: track -1, scaled to the labels' size."""
    d = detect(frames, backend).withColumn("b", scaled(box(), F.lit(scale)))
    return d.select("video_id", "frame_idx", "t", "ord", F.lit(-1).cast("long").alias("track_id"), "b.*", "conf", "cls")


def embed_crops(boxes: DataFrame, width: int, height: int, backend: Callable[[], Callable], dim: int = 384, k: int = CROPS) -> DataFrame:
    """One vector a track: (video_id, track_id, v, crops) from up to k of its boxes, spread evenly over it, each grown by a
    margin and cut to the picture; boxes too small to cut give none, and answers of another length raise."""
    key = ["video_id", "track_id"]
    rows = boxes.select(*key, "frame_idx", box().alias("b")).withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("frame_idx")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    rows = rows.where(F.array_contains(uniform_positions(F.col("n"), k), F.col("i"))).withColumn("crop", crop_box(F.col("b"), width, height, CROP_MARGIN)).where("crop is not null")
    asked = _ask(rows, ["video_id", "frame_idx", "crop"], "v", "array<double>", backend)
    bad = F.raise_error(F.lit(f"a crop's vector must have length {dim}")).cast("array<double>")
    asked = asked.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(bad))
    return mean_pool(asked, key, "v").withColumnRenamed("pooled", "v").join(asked.groupBy(*key).agg(F.count("*").alias("crops")), key)


def motion_curve(frames: DataFrame, backend: Callable[[], Callable]) -> DataFrame:
    """(video_id, frame_idx, motion): the residual motion of the subject on each frame with a box; null answers are left out."""
    return _ask(frames, ["video_id", "frame_idx", "x", "y", "w", "h"], "motion", "double", backend).where("motion is not null").select("video_id", "frame_idx", "motion")


def motion_hint(value: Column, thr: float = 8.0) -> Column:
    """What a judge of a crop is told of the segment's measured motion."""
    strong = F.when(value >= thr, "강함").otherwise("약함")
    return F.format_string(f"이 구간 움직임 세기(M3)=%.1f (%s, 기준 {thr:.0f})", F.bround(value, 1), strong)


def judge_crops(crops: DataFrame, backend: Callable[[], Callable]) -> DataFrame:
    """Tokens' log probabilities (class, logprob) of crops (video_id, ord, frame_idx, hint), a row for each."""
    return _ask(crops, ["video_id", "frame_idx", "hint"], "a", LOGPROBS, backend).select("video_id", "ord", "frame_idx", F.inline("a"))


def described(videos: DataFrame, out: str, backend: Callable[[], Callable], field: str = "text") -> DataFrame:
    """``videos`` with a description: ``field`` of the answer's JSON, trimmed; empty where that can't be read."""
    asked = _ask(videos, ["video_id"], "_a", "string", backend)
    return asked.withColumn(out, F.trim(F.coalesce(F.get_json_object("_a", f"$.{field}"), F.lit("")))).drop("_a")


def fill_profiles(cache: DataFrame, videos: DataFrame, sensors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Profiles of ``videos`` (video_id): those in ``cache`` with only their null columns measured, all others anew.
    ``sensors`` maps a column to what measures it, given the videos that need it: (video_id, column)."""
    out = videos.select("video_id").distinct().join(cache, "video_id", "left")
    for name, measure in sensors.items():
        fresh = measure(out.where(F.col(name).isNull()).select("video_id")).select("video_id", F.col(name).alias("_new"))
        out = out.join(fresh, "video_id", "left").withColumn(name, F.coalesce(F.col(name), F.col("_new").cast(cache.schema[name].dataType))).drop("_new")
    return out.select(cache.columns)


def match_keywords(records: DataFrame, keywords: DataFrame, pick: Callable[[], Callable], prune: Callable[[], Callable]) -> DataFrame:
    """(owner, keyword, video_id): videos whose record lines answer a keyword. ``records`` has owner, video_id, line, ``keywords``
    owner, keyword. ``pick`` may name any videos, of which an owner's own count; ``prune`` may only take some away."""
    told = records.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("video_id", "line"))).alias("records"))
    ask = keywords.where(F.length(F.trim("keyword")) > 0).distinct().join(told, "owner")
    names = F.transform("records", lambda r: r["video_id"])
    none = F.array().cast("array<string>")
    picked = _ask(ask, ["keyword", "records"], "p", "array<string>", pick).withColumn("records", F.filter("records", lambda r: F.array_contains(F.coalesce("p", none), r["video_id"]))).where(F.size("records") > 0).drop("p")
    left = _ask(picked, ["keyword", "records"], "gone", "array<string>", prune)
    return left.select("owner", "keyword", F.explode(F.array_except(names, F.coalesce("gone", none))).alias("video_id"))


def infer_scenes(keywords: DataFrame, asked: DataFrame, videos: DataFrame, human: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame], look: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Tags for the keywords of a request: (owner, video_id, tag) that are new, and (owner, keyword) asked by now.

    Keywords asked before, and videos that a person tagged, are left alone. ``match(videos, keywords)`` reads profiles;
    ``spread(found)`` lends what it found to other videos of the same place; only keywords still without a video go to
    ``look(videos, keywords)``, which looks at pictures. All give (owner, keyword, video_id).
    """
    new = keywords.where(F.length("keyword") > 0).distinct().join(asked, ["owner", "keyword"], "left_anti")
    free = videos.join(human.select("video_id").distinct(), "video_id", "left_anti")
    found = match(free, new)
    found = found.unionByName(spread(found)).distinct()
    open_ = new.join(found, ["owner", "keyword"], "left_anti")
    every = found.unionByName(look(free, open_)).join(free.select("owner", "video_id"), ["owner", "video_id"], "left_semi")
    return every.select("owner", "video_id", F.col("keyword").alias("tag")).distinct(), asked.unionByName(new).distinct()


def translate_labels(labels: DataFrame, table: DataFrame, backend: Callable[[], Callable]) -> DataFrame:
    """(label, name): ``table`` with the labels it lacks, asked 20 at a time; what is there stays, blank answers stay out."""
    new = external.call(labels.select("label").distinct().join(table, "label", "left_anti"), "label", "name", "string", backend)
    return table.select("label", "name").unionByName(new.select("label", F.trim("name").alias("name")).where(F.length("name") > 0))


def plan_from_text(requests: DataFrame, schema: str, backend: Callable[[], Callable], tries: int = 3) -> DataFrame:
    """``requests`` (request) with ``plan``, the model's JSON in the given schema; null where it isn't JSON."""
    asked = external.call(requests, "request", "_a", "string", backend, tries=tries)
    return asked.withColumn("plan", F.from_json("_a", schema)).drop("_a")


def synthesize(phrases: DataFrame, speak: Callable[[], Callable], cache: DataFrame | None = None) -> DataFrame:
    """Phrases (phrase_id, raw, read, voice, instruct) with key, audio, heard, cer, flag, cached.

    ``speak`` turns JSON questions (read, voice, instruct, attempt) into (audio, heard). What is heard must be like the
    phrase as written or as read out; if not, it is spoken once more, and flagged if that fails too. Phrases whose key is
    in ``cache`` (key, audio) aren't spoken.
    """
    p = phrases.withColumn("key", text.cache_key(F.col("read"), F.col("voice"), F.coalesce("instruct", F.lit(""))))
    known = None
    if cache is not None:
        known = p.join(cache.select("key", "audio"), "key").select(*p.columns, "audio", F.lit(None).cast("string").alias("heard"), F.lit(None).cast("double").alias("cer"), F.lit(False).alias("flag"), F.lit(True).alias("cached"))
        p = p.join(cache.select("key"), "key", "left_anti")

    def once(rows: DataFrame, attempt: int) -> DataFrame:
        said = _ask(rows.withColumn("attempt", F.lit(attempt)), ["read", "voice", "instruct", "attempt"], "s", "struct<audio:binary,heard:string>", speak)
        fails = text.speech_fails(F.col("raw"), F.col("read"), F.col("heard"))
        near = F.least(text.cer(F.col("raw"), F.col("heard")), text.cer(F.col("read"), F.col("heard")))
        return said.select(*p.columns, "s.audio", "s.heard").select("*", F.round(near, 4).alias("cer"), fails.alias("flag"), F.lit(False).alias("cached"))

    first = once(p, 1)
    out = first.where(~F.col("flag")).unionByName(once(first.where("flag").select(p.columns), 2))
    return out if known is None else known.unionByName(out)


def narrated_target(asked: Column, speech: Column) -> Column:
    """Seconds a block must last for its speech: as asked for, or longer if the speech needs it; without speech as asked."""
    return F.when(speech.isNull(), asked).otherwise(F.greatest(F.coalesce(asked, F.lit(0.0)), LEAD + speech + TAIL))


def stretch(video: Column, speech: Column) -> Column:
    """Factor by which a block that came out shorter than its speech is slowed down; 1 if it is long enough."""
    need = LEAD + speech + LEAST_TAIL
    return F.when((video > 0) & (video < need), need / video).otherwise(F.lit(1.0))


def fill_geometry(src_w: Column, src_h: Column, width: int, height: int) -> Column:
    """How a clip fills a canvas of another shape: (fg_w, fg_h, x, y) of the whole picture fitted and centred, and (bg_w,
    bg_h, bg_x, bg_y) of the same picture behind it, as large as covers the canvas, and what is cut off it."""
    w, h = F.lit(float(width)), F.lit(float(height))
    fit, cover = F.least(w / src_w, h / src_h), F.greatest(w / src_w, h / src_h)
    at = lambda v, name: v.cast("double").alias(name)
    return F.struct(
        at(src_w * fit, "fg_w"), at(src_h * fit, "fg_h"), at((w - src_w * fit) / 2, "x"), at((h - src_h * fit) / 2, "y"),
        at(src_w * cover, "bg_w"), at(src_h * cover, "bg_h"), at((src_w * cover - w) / 2, "bg_x"), at((src_h * cover - h) / 2, "bg_y"),
    )
