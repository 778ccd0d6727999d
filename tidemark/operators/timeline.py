"""Interval and ordered-sequence operators. Every operator works on all keys at once; times are numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def _bucketed(df: DataFrame, lo: str, hi: str, width) -> DataFrame:
    """A row for each time bucket that the half-open interval meets."""
    return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def label_at(points: DataFrame, segments: DataFrame, keys: list[str], columns: list[str], bucket: float | None = None) -> DataFrame:
    """The points (keys, ``t``) with ``columns`` of the first segment by ``ord`` with start <= t < end, or nulls.

    With ``bucket``, both sides also meet on time buckets of that width, so a long timeline isn't compared
    point by segment. Repeated points give one row.
    """
    on, p, s = list(keys), points.select(*keys, "t").distinct(), segments.where(F.col("start") < F.col("end"))
    if bucket:
        p, s, on = p.withColumn("_b", F.floor(F.col("t") / bucket)), _bucketed(s, "start", "end", bucket), [*keys, "_b"]
    hit = p.join(s.select(*on, "start", "end", F.struct(F.col("ord").alias("_ord"), *columns).alias("_s")), on).where("start <= t and t < end")
    first = hit.groupBy(*keys, "t").agg(F.min_by("_s", "_s._ord").alias("_s"))
    return points.join(first, [*keys, "t"], "left").select(*points.columns, *[F.col(f"_s.{c}").alias(c) for c in columns])


def elementary(segments: list[DataFrame], keys: list[str]) -> DataFrame:
    """Intervals (keys, t0, t1, ``t`` the middle) between neighbouring bounds of all the tables' segments."""
    ends = None
    for s in segments:
        for c in ("start", "end"):
            part = s.select(*keys, F.col(c).alias("t0"))
            ends = part if ends is None else ends.unionByName(part)
    ends = ends.distinct().withColumn("t1", F.lead("t0").over(_w(keys, "t0")))
    return ends.where("t1 > t0").withColumn("t", (F.col("t0") + F.col("t1")) / 2)


def confusion(gt: DataFrame, pred: DataFrame, keys: list[str], label: str = "label", bucket: float | None = None, extra: list[str] | None = None) -> DataFrame:
    """Time by pair of labels where both tables have one: keys, ``gt_<label>``, ``pred_<label>``, ``secs``.

    ``extra`` names further columns of ``pred`` to group by.
    """
    extra = extra or []
    cells = elementary([gt, pred], keys)
    cells = label_at(cells, gt, keys, [label], bucket).withColumnRenamed(label, f"gt_{label}")
    cells = label_at(cells, pred, keys, [label, *extra], bucket).withColumnRenamed(label, f"pred_{label}")
    both = cells.where(F.col(f"gt_{label}").isNotNull() & F.col(f"pred_{label}").isNotNull())
    return both.groupBy(*keys, f"gt_{label}", f"pred_{label}", *extra).agg(F.sum(F.col("t1") - F.col("t0")).alias("secs"))


def sessions(df: DataFrame, keys: list[str], t: str, gap) -> DataFrame:
    """Runs of ``t`` in which no step is longer than ``gap``: keys, session, start, end, n. A lone value is a session
    of length 0. Null times are left out."""
    w = _w(keys, t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    marked = df.where(F.col(t).isNotNull()).withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "session").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def smooth(df: DataFrame, keys: list[str], order: str, value: str, k: int = 7, out: str = "smoothed") -> DataFrame:
    """Box filter over positions, zero beyond both ends and always divided by ``k``."""
    if k % 2 == 0:
        raise ValueError("the window must hold an odd number of positions")
    near = _w(keys, order).rowsBetween(-(k // 2), k // 2)
    return df.withColumn(out, F.sum(value).over(near) / F.lit(float(k)))


def runs(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Maximal runs of equal labels: keys, ord, first, last, label."""
    w = _w(keys, order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("_new", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(new)).withColumn("ord", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "ord", label).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def absorb_short(segments: DataFrame, keys: list[str], min_dur, label: str = "label") -> DataFrame:
    """Segments below ``min_dur`` join their predecessor, and neighbours of one label become one.

    The first segment is never absorbed. Whoever stands takes the label of the last segment that wasn't
    absorbed, so the fold over the list is one running last-non-null and one run-length pass.
    """
    w = _w(keys, "start", "end")
    stands = (F.row_number().over(w) == 1) | (F.col("end") - F.col("start") >= min_dur)
    kept = segments.withColumn("_l", F.when(stands, F.col(label))).withColumn("_l", F.last("_l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    new = F.coalesce((F.col("_l") != F.lag("_l").over(w)).cast("int"), F.lit(0))
    kept = kept.withColumn("_new", new).withColumn("ord", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy(*keys, "ord", F.col("_l").alias(label)).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def segment_motion(curve: DataFrame, keys: list[str], frame: str, value: str, fps: float = 30.0, thr: float = 8.0, k: int = 7, min_dur: float = 0.3) -> DataFrame:
    """Moving and static segments of a motion curve: smooth, threshold, run lengths, absorb.

    A run lasts from its first frame to the one after its last. Fewer samples than the window are smoothed like
    any others.
    """
    s = smooth(curve, keys, frame, value, k).withColumn("label", F.when(F.col("smoothed") >= thr, "moving").otherwise("static"))
    r = runs(s, keys, frame, "label").select(*keys, "label", (F.col("first") / fps).alias("start"), ((F.col("last") + 1) / fps).alias("end"))
    return absorb_short(r, keys, min_dur)


def clip(intervals: DataFrame, spans: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """Parts of ``intervals`` inside ``spans`` (both with start, end) that aren't empty: lo, hi beside the columns of
    ``intervals``. With ``bucket``, a pair is met once, in the bucket where the part begins."""
    on, a, b = list(keys), intervals, spans.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    if bucket:
        a, b, on = _bucketed(a, "start", "end", bucket), _bucketed(b, "_s", "_e", bucket), [*keys, "_b"]
    lo, hi = F.greatest("start", "_s"), F.least("end", "_e")
    out = a.join(b, on).withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    if bucket:
        out = out.where(F.floor(F.col("lo") / bucket) == F.col("_b"))
    return out.select(*intervals.columns, "lo", "hi")


def gaps(ranges: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """What ``used`` leaves of each key's range (start, end), as one sweep over a key's used spans: start, end."""
    u = used.where(F.col("start") < F.col("end")).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    j = u.join(ranges.select(*keys, F.col("start").alias("_lo"), F.col("end").alias("_hi")), keys, "right")
    done = F.max("_e").over(_w(keys, "_s", "_e").rowsBetween(Window.unboundedPreceding, -1))
    before = j.withColumn("start", F.greatest("_lo", done)).select(*keys, "start", F.least("_s", "_hi").alias("end"), "_s").where("_s is not null").drop("_s")
    after = j.groupBy(*keys, "_lo", "_hi").agg(F.max("_e").alias("_e")).select(*keys, F.greatest("_lo", "_e").alias("start"), F.col("_hi").alias("end"))
    return before.unionByName(after).where("end > start")


def subtract(intervals: DataFrame, used: DataFrame, keys: list[str], ident: list[str], min_len=0.0, bucket: float | None = None) -> DataFrame:
    """What ``used`` leaves of each interval: keys, ident, lo, hi, for pieces of ``min_len`` or more that aren't empty.

    ``ident`` names columns that, with the keys, tell intervals apart. Used spans are swept once a key; where keys have
    many intervals, ``bucket`` (a time, such as a few lengths of them) keeps each from meeting every gap.
    """
    ranges = intervals.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = clip(intervals.select(*keys, *ident, "start", "end"), gaps(ranges, used, keys), keys, bucket)
    return out.where(F.col("hi") - F.col("lo") >= min_len).select(*keys, *ident, "lo", "hi")


def busy(windows: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """Spans in which ``k`` or more windows (start, end) are open; at one instant ends come before starts."""
    ev = windows.select(*keys, F.col("start").alias("x"), F.lit(1).alias("d")).unionByName(windows.select(*keys, F.col("end").alias("x"), F.lit(-1).alias("d")))
    w = _w(keys, "x", "d")
    ev = ev.withColumn("_i", F.row_number().over(w))
    w = _w(keys, "_i")
    ev = ev.withColumn("_n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turn = ev.withColumn("_was", F.coalesce(F.lag("_n").over(w), F.lit(0))).where((F.col("_n") >= k) != (F.col("_was") >= k))
    turn = turn.withColumn("end", F.lead("x").over(w))
    return turn.where(F.col("_n") >= k).select(*keys, F.col("x").alias("start"), "end")


def free(ranges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of each key's range (start, end) outside ``spans``: keys, lo, hi."""
    return subtract(ranges, spans, keys, [])


def running_layout(df: DataFrame, keys: list[str], order: str, dur: str, pause=0.0, lead_in=0.0) -> DataFrame:
    """Start and end of pieces laid one after another, each followed by its pause; adds ``start`` and ``end``."""
    pause = F.col(pause) if isinstance(pause, str) else F.lit(pause)
    done = F.sum(F.col(dur) + pause).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.lit(lead_in) + F.coalesce(done, F.lit(0.0))
    return df.withColumn("start", start).withColumn("end", F.col("start") + F.col(dur))


def crossfade_offsets(df: DataFrame, keys: list[str], order: str, dur: str, fade: float = 0.5) -> DataFrame:
    """Where each piece but the first begins to fade in: the lengths so far less one fade for each seam."""
    total = F.sum(F.col(dur) - fade).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("offset", total)


def spoken_layout(df: DataFrame, keys: list[str], order: str, video: str, speech: str, lead: float = 0.4) -> DataFrame:
    """Blocks of measured length ``video`` in a row, and in each the time its speech takes: it starts after ``lead``,
    or sooner if the block has less room. Null speech gives null times."""
    done = F.coalesce(F.sum(video).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = done + F.least(F.lit(lead), F.greatest(F.lit(0.0), F.col(video) - F.col(speech)))
    at = F.when(F.col(speech).isNotNull(), start)
    return df.withColumn("block_start", done).withColumn("block_end", done + F.col(video)).withColumn("start", at).withColumn("end", at + F.col(speech))


def uniform_positions(n: Column, k: int) -> Column:
    """Positions 0..n-1 if n <= k, else k of them spread evenly, halves rounded to even."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(spread)


def step_positions(f0: Column, f1: Column, fps: float, max_n: int, secs: float = 0.25) -> Column:
    """Frames f0, f0 + step, ... below f1, one every ``secs``; f0 alone if there is none; if more than ``max_n``, that
    many of them spread evenly from first to last."""
    step = max(1, round(fps * secs))
    count = F.greatest(F.ceil((f1 - f0) / F.lit(float(step))), F.lit(1)).cast("int")
    at = F.when(count <= max_n, F.sequence(F.lit(0), count - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max_n - 1)), lambda i: F.rint(i * (count - 1) / F.lit(float(max(1, max_n - 1)))).cast("int")))
    return F.transform(at, lambda i: f0 + i * step)


def fraction_positions(n: Column, fractions: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> Column:
    """Frames at the given shares of n, cut to whole frames."""
    return F.array(*[(n * F.lit(f)).cast("int") for f in fractions])


def interpolate(keyframes: DataFrame, keys: list[str], frame: str = "frame_idx", values: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    """Boxes of every frame between neighbouring keyframes, linearly; a lone keyframe gives nothing. Of several boxes on
    one frame the first by ``ord`` counts."""
    first = keyframes.groupBy(*keys, frame).agg(F.min_by(F.struct(*values), "ord").alias("_v")) if "ord" in keyframes.columns else keyframes.select(*keys, frame, F.struct(*values).alias("_v"))
    w = _w(keys, frame)
    pairs = first.withColumn("_f1", F.lead(frame).over(w)).withColumn("_v1", F.lead("_v").over(w)).withColumn("_last", F.lead(frame, 2).over(w).isNull()).where("_f1 is not null")
    until = F.col("_f1") - F.when(F.col("_last"), 0).otherwise(1)
    each = pairs.withColumn("_f", F.explode(F.sequence(F.col(frame), until))).withColumn("_a", (F.col("_f") - F.col(frame)) / (F.col("_f1") - F.col(frame)))
    return each.select(*keys, F.col("_f").alias(frame), *[(F.col(f"_v.{v}") + F.col("_a") * (F.col(f"_v1.{v}") - F.col(f"_v.{v}"))).alias(v) for v in values])


def sliding_max(df: DataFrame, keys: list[str], t: str, value: str, length, hop) -> DataFrame:
    """Maximum of ``value`` by window of ``length`` every ``hop`` from 0; a window that would pass the last value is moved
    back to end with it."""
    last = df.groupBy(*keys).agg(F.greatest(F.max(t) + 1 - length, F.lit(0)).cast("long").alias("_tail"))
    j = df.join(last, keys)
    # the windows a value is in, from the value's side: those of the hop's multiples that begin late enough, and the last
    first, until = F.greatest(F.floor((F.col(t) - length) / hop) + 1, F.lit(0)), F.floor(F.least(F.col(t), F.col("_tail")) / hop)
    hops = F.when(until >= first, F.transform(F.sequence(first.cast("long"), until.cast("long")), lambda k: (k * hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(F.col(t) >= F.col("_tail"), F.array("_tail")).otherwise(F.array().cast("array<bigint>"))
    each = j.select(*keys, value, F.explode(F.array_distinct(F.concat(hops, tail))).alias("win"))
    return each.groupBy(*keys, "win").agg(F.max(value).alias("peak"))


def peak(boxes: DataFrame, keys: list[str], min_speed: float = 0.02, max_gap: int = 3) -> DataFrame:
    """Per key the frame of highest box speed (centre shift over width and frames passed), the first on ties.

    ``boxes`` has frame_idx, x, y, w, h; steps over more than ``max_gap`` frames don't count; keys whose highest
    speed is below ``min_speed`` are left out.
    """
    w = _w(keys, "frame_idx")
    c = boxes.select(*keys, "frame_idx", "w", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    gap = F.col("frame_idx") - F.lag("frame_idx").over(w)
    shift = F.abs(F.col("cx") - F.lag("cx").over(w)) + F.abs(F.col("cy") - F.lag("cy").over(w))
    v = F.when(F.col("w") > 0, shift / (F.col("w") * gap))
    c = c.withColumn("_gap", gap).withColumn("speed", v).where((F.col("_gap") <= max_gap) & (F.col("speed") >= min_speed))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("speed"), "frame_idx"))
    return c.withColumn("_r", best).where("_r = 1").select(*keys, "frame_idx", "speed")


def peak_in_output(clips: DataFrame, boxes: DataFrame, keys: list[str], fps: float = 30.0, min_speed: float = 0.02, max_gap: int = 3, bucket: int = 300) -> DataFrame:
    """Per key the moment, on the output's clock, at which the subject moves fastest in its clips.

    ``clips`` has keys, clip_ord, video_id, t0, t1, out_start; ``boxes`` video_id, frame_idx, x, y, w, h. Speed is
    measured inside a clip only; the first moment wins ties; keys without a speed of ``min_speed`` aren't listed.
    Clips meet boxes by runs of ``bucket`` frames.
    """
    c = clips.withColumn("_f0", (F.col("t0") * fps).cast("int")).withColumn("_f1", (F.col("t1") * fps).cast("int")).where("_f0 <= _f1")
    c = _bucketed(c, "_f0", "_f1", bucket)
    b = boxes.withColumn("_b", F.floor(F.col("frame_idx") / bucket))
    j = c.join(b, ["video_id", "_b"]).where("frame_idx >= _f0 and frame_idx <= _f1")
    best = peak(j, [*keys, "clip_ord"], min_speed, max_gap)
    at = best.join(clips, [*keys, "clip_ord"]).withColumn("at", F.col("out_start") + F.col("frame_idx") / fps - F.col("t0"))
    w = Window.partitionBy(*keys).orderBy(F.desc("speed"), "clip_ord", "frame_idx")
    return at.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "at", "speed")
