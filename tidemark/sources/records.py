"""Readers and writers of frame, segment, match, annotation and media files. Schemas are given, never inferred; the
video a row belongs to is its file's name before the first underscore suffix."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

DETECTION = "track_id:bigint,bbox:array<double>,conf:double,cls:string"
FRAMES = f"frame_idx long, t double, detections array<struct<{DETECTION}>>"
SEGMENTS = "segments array<struct<start_t:double,end_t:double,label:string>>"
ACTIONS = "segments array<struct<start_t:double,end_t:double,group:string,action:string,conf:double,uncertain:boolean>>"
MATCHES = "matches array<struct<phrase_id:bigint,source:string,start_t:double,end_t:double,uncertain:boolean>>"
REID = "mapping map<string,bigint>, interventions array<struct<track_id:bigint,t:double,reason:string>>, relink_evidence map<string,struct<sim:double,anchor:bigint,auto:boolean>>"


def video_of(suffix: str):
    """The video a row belongs to: of a folder ``video_id=...``, as :func:`write_json` makes them, else of the file's name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/video_id=([^/]*)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$", "")).alias("video_id")


def _columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def _required(df: DataFrame, *columns: str) -> DataFrame:
    """Null in a required column raises when the row is read."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"missing required key: {c}")).cast(df.schema[c].dataType)))
    return df


def read_frames(spark: SparkSession, path: str, suffix: str = "_m1.jsonl") -> DataFrame:
    """One row a line: video_id, frame_idx, t, detections; blank lines are skipped, a broken line fails the read."""
    raw = spark.read.schema(FRAMES).option("mode", "FAILFAST").json(path).select(video_of(suffix), *_columns(FRAMES))
    return _required(raw, "frame_idx").withColumn("detections", F.coalesce("detections", F.array().cast(f"array<struct<{DETECTION}>>")))


def explode_frames(frames: DataFrame) -> DataFrame:
    """One row a detection: video_id, frame_idx, t, ord, track_id, x, y, w, h, conf (1 by default), cls (dog by default).
    Frames without detections give no row; keep ``frames`` to know that they were looked at."""
    d = frames.select("video_id", "frame_idx", "t", F.posexplode("detections").alias("ord", "d"))
    side = [F.get("d.bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")]
    return d.select("video_id", "frame_idx", "t", "ord", "d.track_id", *side, F.coalesce("d.conf", F.lit(1.0)).alias("conf"), F.coalesce("d.cls", F.lit("dog")).alias("cls"))


def collect_frames(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """The nested form again: every frame of ``frames``, its detections in order of ``ord``."""
    item = F.struct("ord", F.col("track_id").cast("bigint").alias("track_id"), F.array("x", "y", "w", "h").cast("array<double>").alias("bbox"), F.col("conf").cast("double").alias("conf"), "cls")
    nested = boxes.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(item)).alias("_d"))
    plain = F.transform("_d", lambda d: F.struct(d["track_id"].alias("track_id"), d["bbox"].alias("bbox"), d["conf"].alias("conf"), d["cls"].alias("cls")))
    empty = F.array().cast(f"array<struct<{DETECTION}>>")
    return frames.select("video_id", "frame_idx", "t").join(nested, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", "t", F.coalesce(plain, empty).alias("detections"))


def write_json(df: DataFrame, path: str, by: str | None = "video_id") -> None:
    """JSON lines, non-ASCII as it is; a folder for each video, or with ``by=None`` all columns in each line."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).json(path)


def _documents(spark, path, schema, suffix):
    """A document a file, named by its video; or, with no suffix, a document a line that holds its ``video_id``, as
    :func:`write_json` makes them with ``by=None``: the number of files then doesn't grow with that of videos."""
    if suffix is None:
        rows = spark.read.schema(f"video_id string, {schema}").option("mode", "FAILFAST").json(path)
        return rows.select("video_id", *_columns(schema))
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(video_of(suffix), *_columns(schema))


def read_segments(spark: SparkSession, path: str, suffix: str | None = "_m3.json") -> DataFrame:
    """video_id, ord, start, end, label, in file order."""
    d = _required(_documents(spark, path, SEGMENTS, suffix), "segments").select("video_id", F.posexplode("segments").alias("ord", "s"))
    return d.select("video_id", "ord", F.col("s.start_t").alias("start"), F.col("s.end_t").alias("end"), "s.label")


def read_actions(spark: SparkSession, path: str, suffix: str | None = "_m4.json") -> DataFrame:
    """video_id, ord, start, end, group, action, conf (1 by default), uncertain (false by default)."""
    d = _required(_documents(spark, path, ACTIONS, suffix), "segments").select("video_id", F.posexplode("segments").alias("ord", "s"))
    return d.select("video_id", "ord", F.col("s.start_t").alias("start"), F.col("s.end_t").alias("end"), "s.group", "s.action", F.coalesce("s.conf", F.lit(1.0)).alias("conf"), F.coalesce("s.uncertain", F.lit(False)).alias("uncertain"))


def read_matches(spark: SparkSession, path: str, suffix: str | None = "_m5.json") -> DataFrame:
    d = _required(_documents(spark, path, MATCHES, suffix), "matches").select("video_id", F.posexplode("matches").alias("ord", "s"))
    return d.select("video_id", "ord", "s.phrase_id", "s.source", F.col("s.start_t").alias("start"), F.col("s.end_t").alias("end"), F.coalesce("s.uncertain", F.lit(False)).alias("uncertain"))


def read_reid(spark: SparkSession, path: str, suffix: str | None = "_m2.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping: video_id, track_id, cluster; interventions: video_id, track_id, t, reason; evidence: video_id, track_id,
    sim, anchor, auto). Tracks mapped to -1 belong to nobody and are dropped."""
    d = _documents(spark, path, REID, suffix)
    mapping = d.select("video_id", F.explode("mapping").alias("k", "cluster")).select("video_id", F.col("k").cast("long").alias("track_id"), "cluster").where("cluster <> -1")
    asked = d.select("video_id", F.inline("interventions"))
    evidence = d.select("video_id", F.explode("relink_evidence").alias("k", "e")).select("video_id", F.col("k").cast("long").alias("track_id"), "e.*")
    return mapping, asked, evidence


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """stage, metric, min, max of a YAML file; an empty file has no row. A configuration file, read on the driver through
    Spark so that any store will do."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    rows = [(stage, metric, *[None if (b or {}).get(k) is None else float(b[k]) for k in ("min", "max")]) for stage, metrics in (yaml.safe_load(text) or {}).items() for metric, b in (metrics or {}).items()]
    return spark.createDataFrame(rows, "stage string, metric string, min double, max double")


TRACK_XML = "_id long, _label string, box array<struct<_frame:bigint,_keyframe:int,_outside:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>"


def read_annotations(spark: SparkSession, path: str, fps: float = 30.0, labels: tuple[str, ...] = ("dog",), target: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames: video_id, frame_idx, t; boxes: as :func:`explode_frames`) of annotation XML.

    A keyframe of any track and label marks its frame as labelled; boxes are keyframes with a wanted label that
    aren't outside. With ``target`` boxes are scaled from the annotated size, which must then be given.
    """
    tracks = spark.read.format("xml").option("rowTag", "track").schema(TRACK_XML).load(path).select(video_of(".xml"), *_columns(TRACK_XML))
    keys = tracks.select("video_id", F.col("_id").alias("track_id"), F.col("_label").alias("cls"), F.explode("box").alias("b")).where("b._keyframe = 1")
    frames = keys.select("video_id", F.col("b._frame").alias("frame_idx")).distinct().withColumn("t", F.col("frame_idx") / fps)
    boxes = keys.where((F.coalesce("b._outside", F.lit(0)) != 1) & F.col("cls").isin(*labels))
    if target:
        size = spark.read.format("xml").option("rowTag", "original_size").schema("width int, height int").load(path).select(video_of(".xml"), "width", "height")
        boxes = boxes.join(size, "video_id", "left")
        known = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("the annotated size is not given")).cast("boolean"))
        boxes = boxes.where(known).withColumn("sx", F.lit(float(target[0])) / F.col("width")).withColumn("sy", F.lit(float(target[1])) / F.col("height"))
    else:
        boxes = boxes.withColumn("sx", F.lit(1.0)).withColumn("sy", F.lit(1.0))
    x, y = F.col("b._xtl") * F.col("sx"), F.col("b._ytl") * F.col("sy")
    order = F.row_number().over(Window.partitionBy("video_id", "b._frame").orderBy("track_id")) - 1
    boxes = boxes.select("video_id", F.col("b._frame").alias("frame_idx"), (F.col("b._frame") / fps).alias("t"), order.alias("ord"), "track_id", x.alias("x"), y.alias("y"), (F.col("b._xbr") * F.col("sx") - x).alias("w"), (F.col("b._ybr") * F.col("sy") - y).alias("h"), F.lit(1.0).alias("conf"), "cls")
    return frames, boxes


def read_videos(spark: SparkSession, folders: list[str], extensions: tuple[str, ...]) -> DataFrame:
    """The files of the folders, one level deep, with one of the extensions in either case: path, stem, folder, ext_rank.
    A folder without any raises."""
    out = None
    for i, folder in enumerate(folders):
        files = spark.read.format("binaryFile").load(folder).select("path")
        name = F.element_at(F.split("path", "/"), -1)
        files = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lit(i).alias("folder"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("_e"))
        files = files.withColumn("ext_rank", F.array_position(F.array(*map(F.lit, extensions)), F.col("_e"))).where("ext_rank > 0").drop("_e")
        if files.isEmpty():
            raise FileNotFoundError(f"{folder}: no file with an extension of {sorted(extensions)}")
        out = files if out is None else out.unionByName(files)
    return out


def one_per_stem(files: DataFrame) -> DataFrame:
    """Of files that share a stem, the one in the first folder and of the first extension."""
    w = Window.partitionBy("stem").orderBy("folder", "ext_rank", "path")
    return files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_wavs(spark: SparkSession, path: str, with_samples: bool = False) -> DataFrame:
    """path, sample_rate, samples (their number) of 16-bit PCM files; other widths raise. ``with_samples`` adds ``pcm``, the
    samples themselves as shares of full scale, channels in turn."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf.path, pdf.content):
                with wave.open(io.BytesIO(data)) as f:
                    if f.getsampwidth() != 2:
                        raise ValueError(f"{p}: not 16-bit PCM")
                    pcm = np.frombuffer(f.readframes(f.getnframes()), "<i2") / 32768 if with_samples else None
                    rows.append((p, f.getframerate(), f.getnframes(), *([pcm] if with_samples else [])))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples", *(["pcm"] if with_samples else [])])

    schema = "path string, sample_rate int, samples long" + ", pcm array<double>" * with_samples
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def with_fps(videos: DataFrame, maps: DataFrame, default: float = 30.0) -> DataFrame:
    """Videos with ``fps`` from their map, or the default."""
    return videos.join(maps.select("video_id", "fps"), "video_id", "left").withColumn("fps", F.coalesce("fps", F.lit(default)))


def cascade_track(videos: DataFrame, per_video: DataFrame, job: int | None, gt: DataFrame) -> DataFrame:
    """The subject's tracks of each video as an array: its own choice, else the job's, else the ground truth's, else null."""
    j = videos.select("video_id").join(per_video.select("video_id", F.col("tracks").alias("_a")), "video_id", "left")
    j = j.join(gt.select("video_id", F.array("track_id").alias("_c")), "video_id", "left")
    one = F.lit(None).cast("array<bigint>") if job is None else F.array(F.lit(job).cast("bigint"))
    return j.select("video_id", F.coalesce(F.col("_a").cast("array<bigint>"), one, F.col("_c").cast("array<bigint>")).alias("tracks"))
