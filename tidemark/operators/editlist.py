"""Edit lists: where each chosen clip stands on the output's clock, what shows over it, and the way between the two clocks.

The map from source to output is piecewise linear, a piece a clip. Clips stand one after another in their block, each
crossfade pulling the next one forward; a block's speed divides its length; blocks follow each other by cuts. All of it is
running sums over clips and blocks, and points go through the map by joins that cut time into buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import required_secs
from tidemark.operators.layout import title_end

PLAN, BLOCK = ["plan_id"], ["plan_id", "block_idx"]
#: Seconds of a crossfade, and of the fade at either end of a text.
CROSSFADE, TEXT_FADE, LEAST_FADE = 0.5, 0.25, 0.05
#: What the badge and the notice of a synthetic voice say.
BADGE, NOTICE = "AI 편집", "내레이션: AI 음성"
#: Seconds of a bucket by which points and clips meet.
BUCKET = 10.0


def edit_list(clips: DataFrame, blocks: DataFrame) -> DataFrame:
    """Clips (plan_id, block_idx, clip_ord, source, t0, t1) of blocks (plan_id, block_idx, transition, speed) with ``fade``
    (seconds of source shown together with the clip before), ``speed``, ``out_start`` and ``out_end``.

    Only ``xfade`` blocks fade, and only between their clips; null transitions cut, null speeds are 1. Clips without a
    length, and blocks without clips, take no time. Clips of a block stand in order of clip_ord, blocks of block_idx.
    """
    own = clips.where("t1 > t0").join(blocks.select(*BLOCK, F.col("transition") == "xfade", F.coalesce("speed", F.lit(1.0)).alias("speed")).toDF(*BLOCK, "_x", "speed"), BLOCK)
    in_block = Window.partitionBy(*BLOCK).orderBy("clip_ord")
    fade = F.when(F.col("_x") & (F.row_number().over(in_block) > 1), F.lit(CROSSFADE)).otherwise(F.lit(0.0))
    own = own.withColumn("fade", fade).withColumn("_len", F.col("t1") - F.col("t0"))
    # a clip starts where those before it end, less its own fade and theirs
    own = own.withColumn("_end", F.sum(F.col("_len") - F.col("fade")).over(in_block)).withColumn("_at", F.col("_end") - F.col("_len"))
    # a block's length stands at its last clip, so that no row before that counts it
    total = F.when(F.lead("clip_ord").over(in_block).isNull(), F.col("_end") / F.col("speed"))
    before = F.sum("_total").over(Window.partitionBy(*PLAN).orderBy("block_idx", "clip_ord").rowsBetween(Window.unboundedPreceding, -1))
    out = own.withColumn("_total", total).withColumn("_start", F.coalesce(before, F.lit(0.0)))
    at = lambda c: F.col("_start") + F.col(c) / F.col("speed")
    # both from the block's start, so the end of a block is the start of the next to the last bit
    return out.select(*BLOCK, "clip_ord", "source", "t0", "t1", "fade", "speed", at("_at").alias("out_start"), at("_end").alias("out_end"))


def block_times(edits: DataFrame) -> DataFrame:
    """(plan_id, block_idx, start, end) of each block on the output's clock."""
    return edits.groupBy(*BLOCK).agg(F.min("out_start").alias("start"), F.max("out_end").alias("end"))


def _meet(points: DataFrame, edits: DataFrame, at: str, lo: str, hi: str, keys: list[str]) -> DataFrame:
    """Points joined to the clips whose span lo..hi holds them."""
    bucket = lambda c: F.floor(c / BUCKET)
    spans = edits.withColumn("_b", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    both = points.withColumn("_b", bucket(F.col(at))).join(spans, [*keys, "_b"])
    return both.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_b")


def to_output(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Points of sources (plan_id, source, t and any more) on the output's clock: ``at``, and the clip that shows each. A point
    that no clip holds isn't listed, one that several hold is listed for each; a clip holds its start, not its end."""
    met = _meet(points, edits, "t", "t0", "t1", [*PLAN, "source"])
    at = F.col("out_start") + (F.col("t") - F.col("t0")) / F.col("speed")
    return met.select(*points.columns, "block_idx", "clip_ord", at.alias("at"))


def to_source(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Moments of the output (plan_id, at and any more) in the sources: source, t and ``share``, how much of the picture that
    clip makes up. In a crossfade two clips are listed, whose shares add up to 1. Moments beyond the end aren't listed."""
    following = Window.partitionBy(*BLOCK).orderBy("clip_ord")
    faded = edits.withColumn("_out", F.coalesce(F.lead("fade").over(following), F.lit(0.0)))
    met = _meet(points, faded, "at", "out_start", "out_end", PLAN)
    rising = F.when(F.col("fade") > 0, F.least((F.col("at") - F.col("out_start")) * F.col("speed") / F.col("fade"), F.lit(1.0))).otherwise(1.0)
    falling = F.when(F.col("_out") > 0, F.least((F.col("out_end") - F.col("at")) * F.col("speed") / F.col("_out"), F.lit(1.0))).otherwise(1.0)
    t = F.col("t0") + (F.col("at") - F.col("out_start")) * F.col("speed")
    return met.select(*points.columns, "block_idx", "clip_ord", "source", t.alias("t"), F.least(rising, falling).alias("share"))


def boxes_in_output(boxes: DataFrame, edits: DataFrame, fps: float = 30.0) -> DataFrame:
    """Boxes of sources (source, frame_idx and any more) in every plan that shows them: plan_id and ``at``."""
    mine = boxes.withColumn("t", F.col("frame_idx") / fps)
    every = mine.join(edits.select(*PLAN, "source").distinct(), "source")
    return to_output(every, edits).drop("t")


def _faded(start: Column, end: Column) -> Column:
    fade = F.least(F.lit(TEXT_FADE), F.greatest(F.lit(0.0), (end - start) / 4))
    return F.when(fade >= LEAST_FADE, fade).otherwise(0.0)


def overlays(plans: DataFrame, blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """What shows over the picture: plan_id, kind, block_idx, text, pos, start, end, fade, ``hurried``.

    ``plans`` has plan_id, title, voice; ``blocks`` caption, caption_pos, caption_span (shares of the block, or null for all
    of it). A caption whose place is ``auto`` stands at the bottom; it is ``hurried`` if it shows too short to be read. A title
    goes after three reading times. The badge shows throughout, and below it the notice where a synthetic voice speaks. Plans
    without clips show nothing, nor do empty texts.
    """
    times = block_times(edits)
    whole = times.groupBy(*PLAN).agg(F.max("end").alias("_total"))
    c = blocks.select(*BLOCK, "caption", "caption_pos", "caption_span").join(times, BLOCK).where(F.length("caption") > 0)
    long = F.col("end") - F.col("start")
    at = lambda i, default: F.col("start") + F.coalesce(F.col("caption_span")[i], F.lit(default)) * long
    pos = F.when(F.col("caption_pos").isNull() | (F.col("caption_pos") == "auto"), "bottom").otherwise(F.col("caption_pos"))
    c = c.select("plan_id", F.lit("caption").alias("kind"), F.col("block_idx").cast("int").alias("block_idx"), F.col("caption").alias("text"), pos.alias("pos"), at(0, 0.0).alias("start"), at(1, 1.0).alias("end"))
    p = plans.join(whole, PLAN)
    none = F.lit(None).cast("int").alias("block_idx")
    all_of = lambda kind, text, pos, end: [F.lit(kind).alias("kind"), none, text.alias("text"), F.lit(pos).alias("pos"), F.lit(0.0).alias("start"), end.alias("end")]
    title = p.where(F.length("title") > 0).select("plan_id", *all_of("title", F.col("title"), "top", title_end(F.col("title"), F.col("_total"))))
    badge = p.select("plan_id", *all_of("badge", F.lit(BADGE), "top-right", F.col("_total")))
    notice = p.where("voice").select("plan_id", *all_of("notice", F.lit(NOTICE), "top-right", F.col("_total")))
    fixed = F.col("kind").isin("badge", "notice")
    out = title.unionByName(c).unionByName(badge).unionByName(notice)
    out = out.withColumn("fade", F.when(fixed, 0.0).otherwise(_faded(F.col("start"), F.col("end"))))
    shown = F.col("end") - F.col("start")
    return out.withColumn("hurried", (F.col("kind") == "caption") & (shown > 0) & (shown < required_secs(F.col("text"))))
