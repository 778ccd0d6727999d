"""Where and when texts may stand: regions, reading windows, and their placement against the subject and each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import occupancy, rect, rect_overlap
from tidemark.functions.text import DWELL, MIN_SHOW, READ_CPS, TITLE_DWELL, fixed_width, required_secs, wrap
from tidemark.operators.timeline import busy, free

# Region orders, neighbours, limits and type sizes.
AUTO_ORDER = ("bottom", "top", "bottom-left", "bottom-right", "left", "right", "top-left")
SHOUT_ORDER = ("left", "right", "top-left", "bottom-left", "bottom-right")
OCCUPIED, CONCURRENT = 0.10, 2
STYLE_DIVISOR = {"caption": 18, "copy": 13, "title": 11}
SMALLEST_TYPE = 28


def adjacent(a: Column, b: Column) -> Column:
    """Whether two regions crowd each other: the same, or a side and one of its corners."""
    corner = lambda side, c: F.array_contains(F.split(c, "-"), side) & F.contains(c, F.lit("-")) & ~F.contains(side, F.lit("-"))
    return (a == b) | corner(a, b) | corner(b, a)


def pick_region(regions: DataFrame, keys: list[str], thr: float = OCCUPIED) -> DataFrame:
    """Per key the region to use: of ``regions`` (keys, pos, ord, r, boxes, taken, blocked) those that crowd no ``taken``
    region and meet no ``blocked`` rectangle, the first that the subject's ``boxes`` cover by at most ``thr``; if all are
    covered more, the least covered. Keys without any aren't listed."""
    ok = regions.where(~F.exists("taken", lambda t: adjacent(F.col("pos"), t)) & ~F.exists("blocked", lambda b: rect_overlap(F.col("r"), b) > 0))
    ok = ok.withColumn("occ", occupancy(F.col("r"), F.col("boxes")))
    clear = F.col("occ") <= thr
    w = Window.partitionBy(*keys).orderBy(F.when(clear, 0).otherwise(1), F.when(clear, 0.0).otherwise(F.col("occ")), "ord")
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "pos", "occ")


def title_end(title: Column, total: Column) -> Column:
    """When an opening title goes: three reading times, or with the video."""
    return F.least(total, required_secs(title) * TITLE_DWELL)


def resolve_window(w0: Column, w1: Column, span: Column, need: Column) -> Column:
    """The part of a window that a span names, or all of it if that is too short to read, or null if that is too."""
    a = F.when(span.isNotNull(), w0 + (w1 - w0) * span[0]).otherwise(w0)
    b = F.when(span.isNotNull(), w0 + (w1 - w0) * span[1]).otherwise(w1)
    window = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    return F.when(b - a + 1e-6 >= need, window(a, b)).when(w1 - w0 + 1e-6 >= need, window(w0, w1))


def fits(candidates: DataFrame, windows: DataFrame, keys: list[str], k: int = CONCURRENT) -> DataFrame:
    """Candidates (keys, ident, start, end) during which no k windows of the key are open at once: adds ``fits``."""
    b = busy(windows, keys, k).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = candidates.join(b, keys).where(F.least("end", "_e") > F.greatest("start", "_s")).select(*keys, "ident").distinct().withColumn("_no", F.lit(True))
    return candidates.join(hit, [*keys, "ident"], "left").withColumn("fits", F.col("_no").isNull()).drop("_no")


def place_copy(texts: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """A window for one text of each key (keys, w0, w1, span, text) where fewer than two of ``windows`` are open: in its
    span if a free piece of that is long enough to read, else twice the reading time from the first free piece
    that is; keys without such a piece aren't listed."""
    ranges = texts.select(*keys, F.col("w0").alias("start"), F.col("w1").alias("end"))
    gaps = free(ranges, busy(windows, keys), keys)
    need = required_secs(F.col("text"))
    j = gaps.join(texts, keys).withColumn("need", need)
    at = lambda i: F.col("w0") + (F.col("w1") - F.col("w0")) * F.col("span")[i]
    j = j.withColumn("a", F.greatest(at(0), "lo")).withColumn("b", F.least(at(1), "hi"))
    spanned = F.col("span").isNotNull() & (F.col("b") - F.col("a") + 1e-6 >= F.col("need"))
    plain = F.col("hi") - F.col("lo") + 1e-6 >= F.col("need")
    j = j.withColumn("rank", F.when(spanned, 0).when(plain, 1)).where("rank is not null")
    start = F.when(F.col("rank") == 0, F.col("a")).otherwise(F.col("lo"))
    end = F.when(F.col("rank") == 0, F.col("b")).otherwise(F.col("lo") + F.least(F.col("hi") - F.col("lo"), F.col("need") * DWELL))
    w = Window.partitionBy(*keys).orderBy("rank", "lo")
    return j.withColumn("start", start).withColumn("end", end).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "start", "end")


def type_size(width: int, style: str) -> int:
    return max(SMALLEST_TYPE, width // STYLE_DIVISOR[style])


def line_limit(pos: str, width: int) -> int:
    """Widest line of a region: wide for the middle bands, narrow at sides and corners."""
    return int(width * (0.40 if "-" in pos or pos in ("left", "right") else 0.86))


def block_origin(pos: Column, width, height, block_w: Column, block_h: Column, line_h: Column) -> Column:
    """Upper left corner (x, y) of a text block: bands and sides grow about a fixed centre, corners from their edges; the
    upper right corner stays below the badge."""
    W, H = F.lit(float(width)), F.lit(float(height))
    foot = F.lit(float(max(30, height // 12)))
    corner = F.contains(pos, F.lit("-"))
    cx = F.when(pos == "left", W * 0.28).when(pos == "right", W * 0.72).otherwise(W / 2)
    cy = F.when(pos == "top", H * 0.20 + line_h / 2).when(pos == "bottom", H - foot - line_h / 2).otherwise(H / 2)
    mid_x = F.least(F.greatest(cx - block_w / 2, F.lit(24.0)), W - block_w - 24)
    x = F.when(~corner, mid_x).when(F.endswith(pos, F.lit("left")), W * 0.05).otherwise(W - W * 0.05 - block_w)
    y = F.when(~corner, cy - block_h / 2).when(pos == "top-right", H * 0.18).when(pos == "top-left", H * 0.10).otherwise(H - foot - block_h)
    return F.struct(x.alias("x"), y.alias("y"))


def text_rect(pos: Column, width: int, height: int, lines: Column, advance: float, line_h: float) -> Column:
    """The padded rectangle that wrapped lines take at a region, with a fixed advance in place of font metrics."""
    n = F.size(lines)
    block_w = F.array_max(F.transform(lines, lambda s: F.length(s))) * F.lit(float(advance))
    block_h = n * F.lit(float(line_h)) + (n - 1) * F.lit(float(line_h // 4))
    o = block_origin(pos, width, height, block_w, block_h, F.lit(float(line_h)))
    return rect(o["x"] - 18, o["y"] - 14, o["x"] + block_w + 18, o["y"] + block_h + 18)


def project_boxes(boxes: DataFrame, maps: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes (video_id, frame_idx, x, y, w, h) as rectangles of the output canvas: scaled to the source, fitted and
    centred. ``maps`` has video_id, scale, src_w, src_h."""
    j = boxes.join(maps, "video_id").withColumn("s", F.least(F.lit(float(width)) / F.col("src_w"), F.lit(float(height)) / F.col("src_h")))
    ox, oy = (F.lit(float(width)) - F.col("src_w") * F.col("s")) / 2, (F.lit(float(height)) - F.col("src_h") * F.col("s")) / 2
    x = lambda v: v * F.col("scale") * F.col("s") + ox
    y = lambda v: v * F.col("scale") * F.col("s") + oy
    return j.select("video_id", "frame_idx", rect(x(F.col("x")), y(F.col("y")), x(F.col("x") + F.col("w")), y(F.col("y") + F.col("h"))).alias("r"))


def source_map(videos: DataFrame, maps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(video_id, scale, src_w, src_h): of the original where it is mapped, else of the analysis copy at scale 1."""
    j = videos.select("video_id").join(maps.select("video_id", F.col("scale").alias("_s"), F.col("src_w").alias("_w"), F.col("src_h").alias("_h")), "video_id", "left").join(sizes, "video_id", "left")
    return j.select("video_id", F.coalesce("_s", F.lit(1.0)).alias("scale"), F.coalesce("_w", "w").alias("src_w"), F.coalesce("_h", "h").alias("src_h"))


def beside_subject(boxes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per key the roomier side of the subject's median rectangle, if it has a fifth of the width: side, room, face_y, x1, x2."""
    m = boxes.groupBy(*keys).agg(*[F.percentile(f"r.{c}", 0.5).alias(c) for c in ("x1", "y1", "x2", "y2")])
    edge = width * 0.03 + 24
    m = m.withColumn("_r", F.lit(float(width)) - F.col("x2") - edge).withColumn("_l", F.col("x1") - edge)
    side = F.when(F.col("_r") >= F.col("_l"), "right").otherwise("left")
    out = m.select(*keys, side.alias("side"), F.greatest("_r", "_l").alias("room"), (F.col("y1") + 0.35 * (F.col("y2") - F.col("y1"))).alias("face_y"), "x1", "x2")
    return out.where(F.col("room") >= width * 0.20)


def zoom_frames(clips: DataFrame) -> DataFrame:
    """Frames of a slow zoom of n frames from the whole picture (w, h) onto (cx, cy, end_w, end_h): zw, zh, zx, zy by i,
    eased at both ends."""
    e = clips.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    e = e.withColumn("a", a * a * (3 - 2 * a))
    mix = lambda p, q: p + (q - p) * F.col("a")
    return e.withColumn("zw", mix(F.col("w"), F.col("end_w"))).withColumn("zh", mix(F.col("h"), F.col("end_h"))).withColumn("zx", mix(F.col("w") / 2, F.col("cx"))).withColumn("zy", mix(F.col("h") / 2, F.col("cy")))


def zoom_target(b: Column, scale: Column, w: Column, h: Column) -> Column:
    """(cx, cy, end_w, end_h) of a zoom onto a box: its face line, 1.4 times its height, inside the picture."""
    tall = F.least(h, b["h"] * scale * 1.4)
    wide = tall * w / h
    over = wide > w
    end_w, end_h = F.when(over, w).otherwise(wide), F.when(over, w * h / w).otherwise(tall)
    cx, cy = (b["x"] + b["w"] / 2) * scale, (b["y"] + 0.35 * b["h"]) * scale
    inside = lambda c, side, whole: F.least(F.greatest(c, side / 2), whole - side / 2)
    return F.struct(inside(cx, end_w, w).alias("cx"), inside(cy, end_h, h).alias("cy"), end_w.alias("end_w"), end_h.alias("end_h"))


class _Stage:
    """Windows already given to a plan's short texts."""

    def __init__(self, k: int):
        self.k, self.taken = k, []

    def crowded(self) -> list[tuple[float, float]]:
        at = sorted({x for w in self.taken for x in w})
        return [(a, b) for a, b in zip(at, at[1:]) if sum(s <= a and b <= e for s, e in self.taken) >= self.k]

    def gaps(self, w0: float, w1: float) -> list[tuple[float, float]]:
        out, at = [], w0
        for a, b in self.crowded():
            if b > at and a < w1:
                out.append((at, min(a, w1)))
                at = b
        return [(a, b) for a, b in [*out, (at, w1)] if b > a]

    def place(self, w0, w1, span, need, peak):
        if span is None and peak is not None:
            s = max(w0, min(peak, w1 - need))
            e = min(w1, s + need * DWELL)
            if e - s + 1e-6 >= need and peak <= e + 1e-6 and not any(min(b, e) > max(a, s) for a, b in self.crowded()):
                return s, e
        if span is not None:
            lo, hi = w0 + (w1 - w0) * span[0], w0 + (w1 - w0) * span[1]
            for a, b in self.gaps(w0, w1):
                if min(hi, b) - max(lo, a) + 1e-6 >= need:
                    return max(lo, a), min(hi, b)
        for a, b in self.gaps(w0, w1):
            if b - a + 1e-6 >= need:
                return a, a + min(b - a, need * DWELL)
        return None


def schedule_texts(texts: DataFrame, k: int = CONCURRENT) -> DataFrame:
    """Windows for all short texts of each plan (plan_id, text_idx, text, w0, w1, span, peak), one after another, so that
    no more than k are open at once: snapped to a motion peak if that can be, else in its span or the first
    gap. Texts that fit nowhere aren't listed. A plan holds a few texts, so it is a group."""
    kind = texts.schema["plan_id"].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        stage, out = _Stage(k), []
        for r in pdf.sort_values("text_idx").itertuples():
            need = max(MIN_SHOW, len((r.text or "").strip()) / READ_CPS)
            span = None if r.span is None or not len(r.span) else [float(x) for x in np.asarray(r.span)]
            w = stage.place(r.w0, r.w1, span, need, None if pd.isna(r.peak) else r.peak)
            if w is not None:
                stage.taken.append(w)
                out.append((*key, r.text_idx, *map(float, w)))
        return pd.DataFrame(out, columns=["plan_id", "text_idx", "start", "end"])

    return texts.groupBy("plan_id").applyInPandas(run, f"plan_id {kind}, text_idx int, start double, end double")


def _text_rects(text: str, width: int, height: int, advance: float) -> dict[str, tuple]:
    """Where a short text would stand, by region: its padded rectangle."""
    size = type_size(width, "copy")
    line_h, step = float(size), advance * size
    foot = float(max(30, height // 12))
    out = {}
    for pos in SHOUT_ORDER:
        lines = wrap(text, fixed_width(step), line_limit(pos, width))
        w, h = max((len(x) for x in lines), default=0) * step, len(lines) * line_h + max(0, len(lines) - 1) * (line_h // 4)
        if "-" in pos:
            x = width * 0.05 if pos.endswith("left") else width * 0.95 - w
            y = height * (0.18 if pos == "top-right" else 0.10) if pos.startswith("top") else height - foot - h
        else:
            middle = width * (0.28 if pos == "left" else 0.72)
            x, y = min(max(middle - w / 2, 24.0), width - w - 24), height / 2 - h / 2
        out[pos] = (x - 18, y - 14, x + w + 18, y + h + 18)
    return out


def _crowds(a: str, b: str) -> bool:
    """:func:`adjacent` of two region names."""
    side, corner = (a, b) if "-" in b else (b, a)
    return a == b or ("-" in corner and "-" not in side and side in corner.split("-"))


def _shared(a: tuple, b: tuple) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _cover(r: tuple, boxes: list[tuple]) -> float:
    area = (r[2] - r[0]) * (r[3] - r[1])
    return max((_shared(r, b) / area for b in boxes), default=0.0) if area > 0 else 0.0


def _beside(text: str, boxes: list[tuple], width: int, height: int, advance: float) -> tuple | None:
    """The text's rectangle on the roomier side of the subject's median box, at its face; None without the room."""
    if not boxes:
        return None
    x1, y1, x2, y2 = np.median(np.array(boxes, float), axis=0)
    edge = width * 0.03 + 24
    right, left = width - x2 - edge, x1 - edge
    room = max(right, left)
    if room < width * 0.20:
        return None
    size = type_size(width, "copy")
    lines = wrap(text, fixed_width(advance * size), room)
    w, h = max((len(x) for x in lines), default=0) * advance * size, len(lines) * size + max(0, len(lines) - 1) * (size // 4)
    face = y1 + 0.35 * (y2 - y1)
    x = x2 + width * 0.03 if right >= left else x1 - width * 0.03 - w
    y = min(max(face - h / 2, 24.0), height - h - 24)
    return x - 18, y - 14, x + w + 18, y + h + 18


def place_texts(texts: DataFrame, placed: DataFrame, boxes: DataFrame, width: int, height: int, advance: float = 0.55, k: int = CONCURRENT) -> DataFrame:
    """Windows and places of all short texts of each plan: plan_id, text_idx, start, end, pos (null beside the subject), r.

    ``texts`` is as for :func:`schedule_texts` with ``pos`` (a region that was asked for, or null); ``placed`` (plan_id,
    pos, r, start, end) are titles and captions that stand already; ``boxes`` (plan_id, text_idx, r) are the subject's
    rectangles while a text may show. Texts come one after another: each takes its window, then the region asked for
    if that is free, else a place beside the subject, else the first free region that the subject covers least, and
    is dropped if there is none. What stands at the same time in the same or a neighbouring region, or would be
    overlapped, isn't free. Types are as wide as ``advance`` of their size. A plan holds a few texts, so it is a group.
    """
    kind = texts.schema["plan_id"].dataType.simpleString()
    windows = schedule_texts(texts, k)
    mine = texts.select("plan_id", "text_idx", "text", "pos").join(windows, ["plan_id", "text_idx"])
    around = boxes.groupBy("plan_id", "text_idx").agg(F.collect_list("r").alias("boxes"))
    held = placed.groupBy("plan_id").agg(F.collect_list(F.struct("pos", "r", "start", "end")).alias("held"))
    rows = mine.join(around, ["plan_id", "text_idx"], "left").join(held, "plan_id", "left")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        corners = lambda r: tuple(r[c] for c in ("x1", "y1", "x2", "y2"))
        some = lambda x: [] if x is None else list(x)
        standing, out = [], []
        for row in pdf.sort_values("text_idx").itertuples():
            standing = standing or [(h["pos"], corners(h["r"]), h["start"], h["end"]) for h in some(row.held)]
            now = [(pos, r) for pos, r, s, e in standing if min(e, row.end) > max(s, row.start)]
            subject = [corners(r) for r in some(row.boxes)]
            rects = _text_rects(row.text, width, height, advance)
            free = [p for p in SHOUT_ORDER if not any(q and _crowds(p, q) for q, _ in now) and not any(_shared(rects[p], r) > 0 for _, r in now)]
            side = _beside(row.text, subject, width, height, advance)
            if row.pos in free:
                pos, r = row.pos, rects[row.pos]
            elif side and _cover(side, subject) <= OCCUPIED and not any(_shared(side, r) > 0 for _, r in now):
                pos, r = None, side
            elif free:
                cover = {p: _cover(rects[p], subject) for p in free}
                pos = next((p for p in free if cover[p] <= OCCUPIED), min(free, key=lambda p: cover[p]))
                r = rects[pos]
            else:
                continue
            standing.append((pos, r, row.start, row.end))
            out.append((*key, row.text_idx, row.start, row.end, pos, dict(zip(("x1", "y1", "x2", "y2"), r))))
        return pd.DataFrame(out, columns=["plan_id", "text_idx", "start", "end", "pos", "r"])

    return rows.groupBy("plan_id").applyInPandas(run, f"plan_id {kind}, text_idx int, start double, end double, pos string, r struct<x1:double,y1:double,x2:double,y2:double>")
