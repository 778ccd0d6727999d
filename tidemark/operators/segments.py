"""Scores and summaries of labelled time segments, phrase matches, clusterings and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import interval_iou
from tidemark.operators.timeline import confusion, label_at

# Action labels and their groups.
DYNAMIC = ("점프", "달리기", "걷기", "동적묘기")
STATIC = ("앉기", "엎드림", "정적묘기")
TRICK = ("동적묘기", "정적묘기")
LOW_MOTION = ("걷기",)
SELECT_TRICK = "묘기"

UNCERTAIN_WEIGHT, CITE_CONF, FULL_SECS = 0.5, 0.7, 60.0


def ratio(top, bottom, empty: float):
    """top / bottom, or ``empty`` where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(float(empty)))


def group_of(action):
    """dynamic or static of an action label; any other label raises."""
    a = F.col(action) if isinstance(action, str) else action
    bad = F.raise_error(F.concat(F.lit("unknown action label: "), F.coalesce(a, F.lit("null"))))
    return F.when(a.isin(*DYNAMIC), F.lit("dynamic")).when(a.isin(*STATIC), F.lit("static")).otherwise(bad)


def is_trick(action):
    return F.coalesce((F.col(action) if isinstance(action, str) else action).isin(*TRICK), F.lit(False))


def evaluate_motion(gt: DataFrame, pred: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """Per key: total_time, accuracy, false_motion_rate (static called moving), missed_motion_rate. Only time that both
    label counts; keys without any aren't listed."""
    c = confusion(gt, pred, keys, "label", bucket)
    secs = lambda cond: F.sum(F.when(cond, F.col("secs")).otherwise(0))
    g, p = F.col("gt_label"), F.col("pred_label")
    out = c.groupBy(*keys).agg(F.sum("secs").alias("total_time"), secs(g == p).alias("_ok"), secs(g == "static").alias("_s"), secs(g == "moving").alias("_m"), secs((g == "static") & (p == "moving")).alias("_sm"), secs((g == "moving") & (p == "static")).alias("_ms"))
    return out.select(*keys, "total_time", ratio(F.col("_ok"), F.col("total_time"), 1).alias("accuracy"), ratio(F.col("_sm"), F.col("_s"), 0).alias("false_motion_rate"), ratio(F.col("_ms"), F.col("_m"), 0).alias("missed_motion_rate"))


def evaluate_actions(gt: DataFrame, pred: DataFrame, keys: list[str], low_motion: list[str] | None = None, bucket: float | None = None) -> DataFrame:
    """Per key: total_time, committed_time, uncertain_rate, group_accuracy (of committed time), low_motion_recall.

    Segments have start, end, ord, group, action, uncertain. The recall is the share of the time of ground-truth
    segments with a ``low_motion`` action at whose middle the prediction is committed and right; null without
    such segments.
    """
    c = confusion(gt, pred, keys, "group", bucket, ["uncertain"])
    secs = lambda cond: F.sum(F.when(cond, F.col("secs")).otherwise(0))
    sure = ~F.coalesce("uncertain", F.lit(False))
    out = c.groupBy(*keys).agg(F.sum("secs").alias("total_time"), secs(sure).alias("committed_time"), secs(sure & (F.col("gt_group") == F.col("pred_group"))).alias("_ok"))
    out = out.select(*keys, "total_time", "committed_time", ratio(F.col("total_time") - F.col("committed_time"), F.col("total_time"), 0).alias("uncertain_rate"), ratio(F.col("_ok"), F.col("committed_time"), 1).alias("group_accuracy"))
    if not low_motion:
        return out.withColumn("low_motion_recall", F.lit(None).cast("double"))
    want = gt.where(F.col("action").isin(*low_motion)).select(*keys, F.col("group").alias("_g"), (F.col("end") - F.col("start")).alias("_d"), ((F.col("start") + F.col("end")) / 2).alias("t"))
    got = label_at(want, pred, keys, ["group", "uncertain"], bucket)
    hit = F.when((F.col("group") == F.col("_g")) & ~F.coalesce("uncertain", F.lit(False)), F.col("_d")).otherwise(0)
    recall = got.groupBy(*keys).agg(F.sum("_d").alias("_t"), F.sum(hit).alias("_h")).select(*keys, F.when(F.col("_t") > 0, F.col("_h") / F.col("_t")).alias("low_motion_recall"))
    return out.join(recall, keys, "left")


def evaluate_matches(gt: DataFrame, pred: DataFrame, keys: list[str], thr: float = 0.5) -> DataFrame:
    """Per key: num_phrases, committed, uncertain_rate (of all phrases), match_accuracy (of committed).

    Entries have phrase_id, source, start, end, uncertain, ord; of a repeated phrase the last counts. A match is
    right if it names the same source and overlaps by ``thr``.
    """
    cols = ["source", "start", "end", "uncertain"]
    last = lambda df, s: df.groupBy(*keys, "phrase_id").agg(F.max_by(F.struct(*cols), "ord").alias(s))
    j = last(gt, "g").join(last(pred, "p"), [*keys, "phrase_id"], "left")
    unsure = F.coalesce(F.col("p.uncertain"), F.lit(False))
    sure = F.col("p").isNotNull() & ~unsure
    right = sure & (F.col("p.source") == F.col("g.source")) & (interval_iou(F.col("g.start"), F.col("g.end"), F.col("p.start"), F.col("p.end")) >= thr)
    out = j.groupBy(*keys).agg(F.count("*").alias("num_phrases"), F.count_if(sure).alias("committed"), F.count_if(unsure).alias("_u"), F.count_if(right).alias("_ok"))
    return out.select(*keys, "num_phrases", "committed", ratio(F.col("_u"), F.col("num_phrases"), 0).alias("uncertain_rate"), ratio(F.col("_ok"), F.col("committed"), 1).alias("match_accuracy"))


def evaluate_clusters(gt: DataFrame, pred: DataFrame, keys: list[str], interventions: DataFrame | None = None) -> DataFrame:
    """Pair precision and recall of a clustering of tracks: gt (keys, track_id, gt_id), pred (keys, track_id, pred_id).

    Pairs are counted in closed form from the sizes of the cells, so nothing grows with the square of a
    cluster. ``interventions`` (keys, track_id) lists the tracks a person was asked about, possibly repeatedly.
    """
    both = gt.join(pred, [*keys, "track_id"])
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2

    def same(*by):
        n = both.groupBy(*keys, *by).agg(F.count("*").alias("_n"))
        return n.groupBy(*keys).agg(F.sum(pairs("_n")).alias("_".join(["_same", *by])), F.count("*").alias("_".join(["_groups", *by])))

    out = both.groupBy(*keys).agg(F.count("*").alias("num_tracks"))
    for by in (("gt_id",), ("pred_id",), ("gt_id", "pred_id")):
        out = out.join(same(*by), keys)
    if interventions is None:
        out = out.withColumn("interventions", F.lit(0).cast("long")).withColumn("_asked", F.lit(0).cast("long"))
    else:
        out = out.join(interventions.groupBy(*keys).agg(F.count("*").alias("interventions")), keys, "left")
        asked = both.join(interventions.select(*keys, "track_id").distinct(), [*keys, "track_id"], "left_semi").groupBy(*keys).agg(F.count("*").alias("_asked"))
        out = out.join(asked, keys, "left").fillna(0, ["interventions", "_asked"])
    tp = F.col("_same_gt_id_pred_id")
    return out.select(
        *keys, "num_tracks", F.col("_groups_gt_id").alias("num_global_gt"), F.col("_groups_pred_id").alias("num_global_pred"), "interventions",
        ratio(F.col("num_tracks") - F.col("_asked"), F.col("num_tracks"), 1).alias("auto_relink_rate"), ratio(tp, F.col("_same_pred_id"), 1).alias("pair_precision"), ratio(tp, F.col("_same_gt_id"), 1).alias("pair_recall"),
    )


def check_thresholds(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics (stage, metric, value) against bounds (stage, metric, min, max): rule, bound, status PASS, FAIL or unset.

    A non-null min goes before max; bounds are inclusive; null values aren't checked. The thresholds are a
    dimension table of one row per metric name; Spark broadcasts it if it is small.
    """
    j = metrics.where("value is not null").join(thresholds, ["stage", "metric"], "left")
    rule = F.when(F.col("min").isNotNull(), "min").when(F.col("max").isNotNull(), "max").otherwise("-")
    ok = F.when(F.col("min").isNotNull(), F.col("value") >= F.col("min")).otherwise(F.col("value") <= F.col("max"))
    status = F.when(ok.isNull(), "unset").when(ok, "PASS").otherwise("FAIL")
    return j.select(*metrics.columns, rule.alias("rule"), F.coalesce("min", "max").alias("bound"), status.alias("status"))


def overall(checks: DataFrame, keys: list[str]) -> DataFrame:
    """FAIL if any check fails, else PASS if any passes, else unset."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    return checks.groupBy(*keys).agg(F.when(has("FAIL"), "FAIL").when(has("PASS"), "PASS").otherwise("unset").alias("status"))


def long_metrics(df: DataFrame, keys: list[str], stage: str, metrics: list[str]) -> DataFrame:
    """One row per metric: keys, stage, metric, value."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value").withColumn("stage", F.lit(stage))


def activity_rollup(segments: DataFrame, keys: list[str]) -> DataFrame:
    """total_secs, dynamic_ratio (time weighted by conf, uncertain time by half), uncertain_pct, conf. Everything that
    isn't dynamic counts as static; a null conf weighs nothing."""
    d = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    unsure = F.coalesce("uncertain", F.lit(False))
    w = d * F.coalesce("conf", F.lit(0.0)) * F.when(unsure, UNCERTAIN_WEIGHT).otherwise(1.0)
    dyn = F.coalesce(F.col("group") == "dynamic", F.lit(False))
    s = segments.groupBy(*keys).agg(F.sum(d).alias("total_secs"), F.sum(F.when(dyn, w).otherwise(0.0)).alias("_d"), F.sum(w).alias("_w"), F.sum(F.when(unsure, d).otherwise(0.0)).alias("_u"))
    return s.select(*keys, "total_secs", ratio(F.col("_d"), F.col("_w"), 0).alias("dynamic_ratio"), ratio(F.col("_u"), F.col("total_secs"), 0).alias("uncertain_pct"), F.least(F.lit(1.0), F.col("total_secs") / FULL_SECS).alias("conf"))


def cited_segment(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The surest segment that isn't uncertain and has conf of 0.7 or more, the first by ``ord`` on ties."""
    good = segments.where(~F.coalesce("uncertain", F.lit(False)) & (F.coalesce("conf", F.lit(0.0)) >= CITE_CONF))
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"), "ord")
    return good.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def motion_class(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds moving and still, and lively, still or even by which is more than twice the other."""
    d = F.col("end") - F.col("start")
    secs = lambda g: F.coalesce(F.sum(F.when(F.col("group") == g, d)), F.lit(0.0))
    s = segments.groupBy(*keys).agg(secs("dynamic").alias("dynamic_secs"), secs("static").alias("static_secs"))
    return s.withColumn("motion", F.when(F.col("dynamic_secs") > 2 * F.col("static_secs"), "lively").when(F.col("static_secs") > 2 * F.col("dynamic_secs"), "still").otherwise("even"))


def consensus(tags: DataFrame, keys: list[str], frame: str, tag: str, min_agree: int = 2) -> DataFrame:
    """Tags (keys, frame, tag; null tag for a frame without any) that at least ``min_agree`` frames carry, or all frames
    if there are fewer."""
    n = tags.groupBy(*keys).agg(F.count_distinct(frame).alias("_n"))
    votes = tags.where(F.col(tag).isNotNull()).groupBy(*keys, tag).agg(F.count_distinct(frame).alias("votes"))
    return votes.join(n, keys).where(F.col("votes") >= F.least(F.lit(min_agree), F.greatest(F.lit(1), F.col("_n")))).drop("_n")


def logprob_vote(tokens: DataFrame, keys: list[str], cls: str, logprob: str, tau: float = 0.7) -> DataFrame:
    """Probability mass by class, as a share of all classes' mass, from top-k token log probabilities (null class for
    tokens of no class): the winning ``cls``, its ``p``, and ``verdict`` (the class if p reaches ``tau``, else uncertain;
    uncertain too if no token has a class)."""
    w = tokens.select(*keys).distinct()
    m = tokens.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.sum(F.exp(logprob)).alias("_m"))
    share = m.withColumn("p", F.col("_m") / F.sum("_m").over(Window.partitionBy(*keys))).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_m"), cls))).where("_r = 1")
    out = w.join(share.select(*keys, cls, "p"), keys, "left")
    return out.withColumn("verdict", F.when(F.col("p") >= tau, F.col(cls)).otherwise("uncertain"))


def segment_vote(crops: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment of judged crops (dyn, sta masses, action, ord): group by the mean dynamic share, conf the share of that
    group, and the most frequent action of the group (of all, if none is of the group; first seen on ties)."""
    ok = crops.where(F.col("dyn") + F.col("sta") > 0)
    g = ok.groupBy(*keys).agg(F.avg(F.col("dyn") / (F.col("dyn") + F.col("sta"))).alias("_m"))
    g = g.withColumn("group", F.when(F.col("_m") >= 0.5, "dynamic").otherwise("static")).withColumn("conf", F.when(F.col("_m") >= 0.5, F.col("_m")).otherwise(1 - F.col("_m")))
    inside = F.when(F.col("group") == "dynamic", F.col("action").isin(*DYNAMIC)).otherwise(F.col("action").isin(*STATIC))
    n = ok.join(g.select(*keys, "group"), keys).groupBy(*keys, "action", F.coalesce(inside, F.lit(False)).alias("_in")).agg(F.count("*").alias("_n"), F.min("ord").alias("_o"))
    top = n.groupBy(*keys).agg(F.min_by("action", F.struct(~F.col("_in"), -F.col("_n"), "_o")).alias("action"))
    return g.join(top, keys).select(*keys, "group", "conf", "action")


def top_tags(tags, n: int = 8, least: float = 0.15):
    """Of an array of (label, p): the n surest, then those of ``least`` or more, rounded to three places."""
    best = F.slice(F.sort_array(F.transform(tags, lambda t: F.struct(t["p"].alias("p"), t["label"].alias("label"))), asc=False), 1, n)
    return F.transform(F.filter(best, lambda t: t["p"] >= least), lambda t: F.struct(t["label"].alias("label"), F.bround(t["p"], 3).alias("p")))


def is_dark(luma, dark_frac):
    """Mean luma below 60, or more than half of the picture dark."""
    return (luma < 60) | (dark_frac > 0.5)


def steady_mean(v):
    """Mean of doubles, the same in whatever order they are summed: parts down to 2^-20 add up exactly below 2^33, and what
    is left of each is too small to count. Larger numbers are added as they are."""
    high = F.when(F.abs(v) < 2.0**33, F.rint(v * 2.0**20) / 2.0**20).otherwise(v)
    return (F.sum(high) + F.sum(F.nanvl(v - high, F.lit(0.0)))) / F.count(v)


def luma_profile(frames: DataFrame, keys: list[str], channels: int = 1) -> DataFrame:
    """Mean luma (one place) and dark fraction (two) over frames, and whether the video is dark. ``luma`` of a frame may be
    a sum over ``channels``. Means are rounded as doubles: 0.545 lies above its half and 0.575 below. A frame without a dark
    fraction takes no part in the mean, and isn't dark when it is asked whether more than half is."""
    m = frames.groupBy(*keys).agg((steady_mean(F.col("luma")) / channels).alias("_l"), F.avg("dark_frac").alias("_d"), (F.sum("dark_frac") / F.count("*")).alias("_a"))
    places = lambda c, unit: F.when(F.abs(c) < 1e300, F.rint(c * unit) / unit).otherwise(c)
    return m.select(*keys, places(F.col("_l"), 10.0).alias("luma"), places(F.round("_d", 9).cast("double"), 100.0).alias("dark_frac"), is_dark(F.col("_l"), F.col("_a")).alias("dark"))


def place_profile(probs: DataFrame, indoor: DataFrame, keys: list[str], tau: float = 0.9, least: float = 0.2, n: int = 5) -> DataFrame:
    """Mean probability by category over frames (keys, frame, category, p): ``indoor`` true if the indoor categories' mass
    reaches ``tau``, else null (never false), and the up to n surest ``categories`` of at least ``least``."""
    frames = probs.groupBy(*keys).agg(F.count_distinct("frame").alias("_n"))
    mean = probs.groupBy(*keys, "category").agg(F.sum("p").alias("_s")).join(frames, keys).withColumn("p", F.col("_s") / F.col("_n"))
    mean = mean.join(indoor.select("category").distinct().withColumn("_in", F.lit(True)), "category", "left")
    w = Window.partitionBy(*keys).orderBy(F.desc("p"), "category")
    ranked = mean.withColumn("_r", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when((F.col("_r") <= n) & (F.col("p") >= least), F.struct("_r", "category", "p"))))
    out = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("_in"), F.col("p")).otherwise(0.0)).alias("_m"), top.alias("_t"))
    return out.select(*keys, F.when(F.col("_m") >= tau, F.lit(True)).alias("indoor"), F.transform("_t", lambda t: F.struct(t["category"].alias("category"), F.bround(t["p"], 3).alias("p"))).alias("categories"))


def finalize_labels(segments: DataFrame) -> DataFrame:
    """Checked ground truth: unknown or open labels raise; group comes from the action, conf is 1, nothing is uncertain."""
    return segments.withColumn("group", group_of("action")).withColumn("conf", F.lit(1.0)).withColumn("uncertain", F.lit(False))


def gloss(label, table: dict[str, str]):
    """A label's translation, or the label itself. The table is a bounded dictionary (at most 10,000 labels)."""
    if len(table) > 10_000:
        raise ValueError("more than 10,000 labels: join them as a table")
    if not table:
        return label
    words = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(words, label), label)


def _listed(tags, name: str, table: dict[str, str]):
    return F.array_join(F.transform(tags, lambda t: F.concat(gloss(t[name], table), F.lit("("), t["p"].cast("string"), F.lit(")"))), ", ")


def profile_text(extra=None, audio_names: dict[str, str] | None = None, place_names: dict[str, str] | None = None):
    """One line on what was observed of a video: sounds, kind of place, darkness, ``extra``, caption. Reads columns audio
    (label, p), indoor, categories (category, p), dark and caption, any of which may be null."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    sound = F.when(has("audio"), F.concat(F.lit("소리: "), _listed(F.col("audio"), "label", audio_names or {}))).otherwise("소리: (신호 없음)")
    place = F.concat_ws(" · ", F.when(F.col("indoor"), "실내 확실"), F.when(has("categories"), _listed(F.col("categories"), "category", place_names or {})))
    said = F.trim(F.coalesce("caption", F.lit("")))
    parts = [sound, F.when(place != "", F.concat(F.lit("장면분류: "), place)), F.when(F.col("dark"), "밝기: 어두움(밤/저조도)"), extra if extra is not None else F.lit(None).cast("string"), F.when(said != "", F.concat(F.lit("묘사: "), said))]
    return F.concat_ws(" | ", *parts)


def record_lines(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, line): the profile of each video with seconds moving and still (all that isn't dynamic), behaviour and
    confirmed tags. ``videos`` has the columns of :func:`profile_text`, behavior and scene_tags."""
    d = F.col("end") - F.col("start")
    dyn = F.coalesce(F.col("group") == "dynamic", F.lit(False))
    s = segments.groupBy("video_id").agg(F.sum(F.when(dyn, d).otherwise(0.0)).alias("_d"), F.sum(F.when(dyn, 0.0).otherwise(d)).alias("_s"))
    v = videos.join(s, "video_id", "left").fillna(0.0, ["_d", "_s"])
    whole = lambda c: F.rint(c).cast("long").cast("string")
    motion = F.concat(F.lit("동작측정: 움직임 "), whole("_d"), F.lit("초/정지 "), whole("_s"), F.lit("초"))
    did = F.trim(F.coalesce("behavior", F.lit("")))
    tags = F.when(F.coalesce(F.size("scene_tags") > 0, F.lit(False)), F.concat(F.lit("확정 장면: "), F.array_join("scene_tags", ", ")))
    line = F.concat_ws(" | ", F.concat(F.lit("["), F.col("video_id").cast("string"), F.lit("] "), profile_text(motion)), F.when(did != "", F.concat(F.lit("행동: "), did)), tags)
    return v.select("video_id", line.alias("line"))
