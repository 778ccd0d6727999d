"""Per-frame box matching, tracking scores and per-track votes.

Boxes are rows (video_id, frame_idx, track_id, x, y, w, h); ground truth lists its labelled frames in a table
(video_id, frame_idx), because a labelled frame may hold no box.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.assignment import UNIT, max_assignment, priced_assignment, units
from tidemark.functions.geometry import box, box_area, iou
from tidemark.session import materialize

FRAME = ["video_id", "frame_idx"]
IOU = 0.5
#: Frames that are handed to Python together.
FRAMES_PER_GROUP = 64
#: Side of the tiles by which boxes of crowded frames meet, in pixels, and the outermost tile in either direction.
TILE, EDGE = 256.0, 64
#: Boxes that can overlap anything.
SOLID = "w > 0 and h > 0 and x is not null and y is not null"


def last_per_frame(frames: DataFrame) -> DataFrame:
    """Of frames listed more than once (video_id, frame_idx, ord, ...), the last."""
    w = Window.partitionBy(*FRAME).orderBy(F.desc("ord"))
    return frames.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def labelled(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """The boxes on labelled frames."""
    return boxes.join(frames.select(*FRAME).distinct(), FRAME, "left_semi")


def _tiled(boxes: DataFrame, ident: str, name: str, tile: float) -> DataFrame:
    """Boxes with an area, a row for each tile of the grid that they touch."""
    at = lambda c: F.least(F.greatest(F.floor(c / tile), F.lit(-EDGE)), F.lit(EDGE)).cast("int")
    span = lambda c, size: F.explode(F.sequence(at(F.col(c)), at(F.col(c) + F.col(size))))
    rows = boxes.where(SOLID).select(*FRAME, F.col("track_id").alias(ident), "x", "y", "w", "h")
    rows = rows.withColumn("_tx", span("x", "w")).withColumn("_ty", span("y", "h"))
    return rows.select(*FRAME, "_tx", "_ty", ident, box().alias(name))


def iou_pairs(gt: DataFrame, pred: DataFrame, least: float = 0.0, tile: float | None = None) -> DataFrame:
    """Overlapping pairs of one frame: video_id, frame_idx, gt_id, pred_id, iou (above 0 and at least ``least``).

    Boxes of a frame meet each other, which is cheapest where frames hold a few. Where they hold hundreds, give ``tile``
    (such as ``TILE``, some box sizes): boxes then meet by tiles of a grid. Both boxes of a pair touch the tile that holds the
    upper left corner of what they share, and the pair counts there only. Beyond ``EDGE`` tiles from the origin one edge tile
    holds the rest. The result is the same. Boxes without an area, or with a null, overlap nothing.
    """
    if tile is None:
        g = gt.where(SOLID).select(*FRAME, F.col("track_id").alias("gt_id"), box().alias("_g"))
        both = g.join(pred.where(SOLID).select(*FRAME, F.col("track_id").alias("pred_id"), box().alias("_p")), FRAME).withColumn("iou", iou(F.col("_g"), F.col("_p")))
        return both.where((F.col("iou") > 0) & (F.col("iou") >= least)).select(*FRAME, "gt_id", "pred_id", "iou")
    both = _tiled(gt, "gt_id", "_g", tile).join(_tiled(pred, "pred_id", "_p", tile), [*FRAME, "_tx", "_ty"])
    at = lambda a, b: F.least(F.greatest(F.floor(F.greatest(a, b) / tile), F.lit(-EDGE)), F.lit(EDGE)).cast("int")
    both = both.where((at(F.col("_g.x"), F.col("_p.x")) == F.col("_tx")) & (at(F.col("_g.y"), F.col("_p.y")) == F.col("_ty")))
    both = both.withColumn("iou", iou(F.col("_g"), F.col("_p")))
    return both.where((F.col("iou") > 0) & (F.col("iou") >= least)).select(*FRAME, "gt_id", "pred_id", "iou")


def priced_pairs(gt: DataFrame, pred: DataFrame, tile: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, chosen): the overlapping pairs as :func:`iou_pairs`, written once, and those of each frame's assignment of
    largest total IoU, with gt_price and pred_price in billionths of IoU.

    The prices prove the choice (:func:`assignment_proof`): a pair's prices add up to its IoU, boxes without a pair cost
    nothing, and no pair's IoU exceeds its boxes' prices, so no assignment has a larger total. Totals are compared in
    billionths; of equal ones, the first box (by gt_id) has the first partner (by pred_id) it can have. A pair whose
    boxes overlap no other is taken as it is; only frames with contested boxes go to the solver. ``tile`` is for crowded
    frames, as in :func:`iou_pairs`.
    """
    columns = [*FRAME, "gt_id", "pred_id", "iou"]
    n = lambda c: F.count("*").over(Window.partitionBy(*FRAME, c))
    pairs = iou_pairs(gt, pred, tile=tile).withColumn("_plain", (n("gt_id") == 1) & (n("pred_id") == 1))
    pairs = materialize(pairs, "pairs")

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_idx", "gt_id", "pred_id"])
        frame, gid, pid, value = (pdf[c].to_numpy() for c in ("frame_idx", "gt_id", "pred_id", "iou"))
        cut = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        out = []
        for lo, hi in zip(cut, [*cut[1:], len(frame)]):
            g, gi = np.unique(gid[lo:hi], return_inverse=True)
            p, pi = np.unique(pid[lo:hi], return_inverse=True)
            m = np.zeros((len(g), len(p)))
            m[gi, pi] = value[lo:hi]
            chosen, a, b = priced_assignment(units(m))
            out += [(key[0], frame[lo], g[i], p[j], m[i, j], int(a[i]), int(b[j])) for i, j in chosen]
        return pd.DataFrame(out, columns=[*columns, "gt_price", "pred_price"])

    few_frames = F.floor(F.col("frame_idx") / FRAMES_PER_GROUP)
    own = pairs.where("_plain").select(*columns, F.round(F.col("iou") * UNIT).cast("long").alias("gt_price"), F.lit(0).cast("long").alias("pred_price"))
    hard = pairs.where("not _plain").select(columns).groupBy("video_id", few_frames).applyInPandas(solve, own.schema)
    return pairs.select(columns), own.where("gt_price > 0").unionByName(hard)


def assign(gt: DataFrame, pred: DataFrame, thr: float = IOU, tile: float | None = None) -> DataFrame:
    """Pairs of :func:`priced_pairs` that reach ``thr``; columns as :func:`iou_pairs`. The threshold is applied after the
    assignment. Pairs without overlap add nothing to the total, so only overlapping pairs are looked at."""
    return priced_pairs(gt, pred, tile)[1].where(F.col("iou") >= thr).drop("gt_price", "pred_price")


def assignment_proof(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per frame with overlapping pairs: ``n_pairs`` chosen, ``total`` (billionths of IoU), ``price`` (of all boxes) and
    ``broken``, the rules broken: chosen pairs that share a box or whose prices aren't their IoU, and pairs that are worth
    more than their boxes cost. With none broken and price = total, the total is the largest there is."""
    unit = F.round(F.col("iou") * UNIT).cast("long")
    box = lambda c: chosen.select(*FRAME, c, F.col(f"{c[:-3]}_price"))
    priced = pairs.join(box("gt_id"), [*FRAME, "gt_id"], "left").join(box("pred_id"), [*FRAME, "pred_id"], "left").fillna(0, ["gt_price", "pred_price"])
    open_ = priced.groupBy(*FRAME).agg(F.count_if(unit > F.col("gt_price") + F.col("pred_price")).alias("_worth"))
    shared = lambda c: F.count("*") - F.count_distinct(c)
    own = chosen.groupBy(*FRAME).agg(
        F.count("*").alias("n_pairs"), F.sum(unit).alias("total"), F.sum(F.col("gt_price") + F.col("pred_price")).alias("price"),
        (F.count_if((unit != F.col("gt_price") + F.col("pred_price")) | (F.least("gt_price", "pred_price") < 0)) + shared("gt_id") + shared("pred_id")).alias("_own"),
    )
    out = open_.join(own, FRAME, "left").fillna(0, ["n_pairs", "total", "price", "_own"])
    return out.select(*FRAME, "n_pairs", "total", "price", (F.col("_worth") + F.col("_own")).alias("broken"))


def written(gt: DataFrame, pred: DataFrame, frames: DataFrame) -> DataFrame:
    """Both sides' boxes and the labelled frames as one written table, so that each source is read once: video_id, side (0
    a frame, 1 ground truth, 2 prediction), frame_idx, ord (the track number where a side has none), track_id, x, y, w, h."""

    def side(df, s):
        order = "ord" if "ord" in df.columns else "track_id"
        return df.select("video_id", F.lit(s).alias("side"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col(order).cast("long").alias("ord"), F.col("track_id").cast("long").alias("track_id"), *[F.col(c).cast("double").alias(c) for c in "xywh"])

    zero = F.lit(0.0)
    marks = frames.select("video_id", "frame_idx", F.lit(0).alias("track_id"), *[zero.alias(c) for c in "xywh"]).distinct()
    return materialize(side(marks, 0).unionByName(side(gt, 1)).unionByName(side(pred, 2)), "boxes")


def _side(rows: DataFrame, side: int, on_labelled: bool = False) -> DataFrame:
    own = rows.where(F.col("side") == side)
    return labelled(own, rows.where("side = 0")) if on_labelled else own


def miss_counts(gt: DataFrame, pred: DataFrame, frames: DataFrame, thr: float = IOU) -> DataFrame:
    """Per video: num_gt, num_pred (on labelled frames), fn, fp, from each frame's assignment."""
    p = labelled(pred, frames)
    count = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    out = frames.select("video_id").distinct()
    for part in (count(gt, "num_gt"), count(p, "num_pred"), count(assign(gt, p, thr), "hits")):
        out = out.join(part, "video_id", "left")
    out = out.fillna(0, ["num_gt", "num_pred", "hits"])
    return out.select("video_id", "num_gt", "num_pred", (F.col("num_gt") - F.col("hits")).alias("fn"), (F.col("num_pred") - F.col("hits")).alias("fp"))


def _pairs_of_frame(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """IoU matrix of boxes (rows x, y, w, h)."""
    lo = np.maximum(g[:, None, :2], p[None, :, :2])
    hi = np.minimum(g[:, None, :2] + g[:, None, 2:], p[None, :, :2] + p[None, :, 2:])
    both = np.maximum(hi - lo, 0).prod(2)
    area = lambda b: np.maximum(b[:, 2:], 0).prod(1)
    union = area(g)[:, None] + area(p)[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


class _Correspondence:
    """What a video's frames so far say about its ground-truth tracks."""

    def __init__(self, thr: float):
        self.thr, self.last, self.seen = thr, {}, {}
        self.fp = self.fn = self.switches = self.breaks = 0

    def frame(self, gid, g, pid, p) -> None:
        m = _pairs_of_frame(g, p)
        pair = self._kept(gid, pid, m)
        free_g = [i for i in range(len(gid)) if i not in pair]
        free_p = [j for j in range(len(pid)) if j not in pair.values()]
        rest = m[np.ix_(free_g, free_p)]
        pair |= {free_g[i]: free_p[j] for i, j in max_assignment(rest) if rest[i, j] >= self.thr}
        self.fn += len(gid) - len(pair)
        self.fp += len(pid) - len(pair)
        now = {gid[i]: pid[j] for i, j in pair.items()}
        for track, other in now.items():
            self.switches += self.last.get(track, other) != other
            self.breaks += self.seen.get(track, True) is False
        self.last |= now
        self.seen |= {track: track in now for track in gid}

    def _kept(self, gid, pid, m) -> dict[int, int]:
        """Pairs that go on from the last frame they were matched in."""
        pair: dict[int, int] = {}
        for i, track in enumerate(gid):
            if track in self.last:
                fit = (j for j, other in enumerate(pid) if other == self.last[track] and j not in pair.values() and m[i, j] >= self.thr)
                if (j := next(fit, None)) is not None:
                    pair[i] = j
        return pair


def clear_mot(gt: DataFrame, pred: DataFrame, frames: DataFrame, thr: float = IOU) -> DataFrame:
    """Per video: fp, fn, idsw, fragmentation, over labelled frames in order.

    A ground-truth track, in order of ``ord`` where there is one, first keeps the prediction it last had, if that still
    overlaps enough; the rest are assigned. The state of a video is sequential: its frames go through one task in
    order, one frame at a time, however many there are.
    """
    return _clear_mot(written(gt, pred, frames), thr)


def _clear_mot(rows: DataFrame, thr: float) -> DataFrame:
    every = rows.where("side = 0").unionByName(labelled(rows.where("side > 0"), rows.where("side = 0")))
    ordered = every.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "side", "ord", "track_id")
    names = ["video_id", "fp", "fn", "idsw", "fragmentation"]
    kind = rows.schema["video_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        state = video = None
        done: list[tuple] = []
        rest = None

        def frame(part) -> None:
            nonlocal state, video
            if state is None or part[0][0] != video:
                close()
                state, video = _Correspondence(thr), part[0][0]
            side, track, box = part[1], part[2], part[3]
            g, p = side == 1, side == 2
            state.frame(track[g].tolist(), box[g], track[p].tolist(), box[p])

        def close() -> None:
            if state is not None:
                done.append((video, state.fp, state.fn, state.switches, state.breaks))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], video_type), *[pa.array([r[i] for r in done], pa.int64()) for i in range(1, 5)]], names=names)
            done.clear()
            return made

        video_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            video_type = batch.column("video_id").type
            own = [np.array(batch.column("video_id").to_pylist(), object), *[batch.column(c).to_numpy() for c in ("side", "track_id")], np.stack([batch.column(c).to_numpy() for c in "xywh"], axis=1)]
            at = batch.column("frame_idx").to_numpy()
            if rest is not None:
                own, at = [np.concatenate(x) for x in zip(rest[0], own)], np.concatenate([rest[1], at])
            cut = np.flatnonzero(np.r_[True, (own[0][1:] != own[0][:-1]) | (at[1:] != at[:-1])])
            # the last frame may go on in the next batch
            for lo, hi in zip(cut[:-1], cut[1:]):
                frame([x[lo:hi] for x in own])
            rest = [x[cut[-1] :] for x in own], at[cut[-1] :]
            if done:
                yield out()
        if rest is not None:
            frame(rest[0])
            close()
            yield out()

    return ordered.mapInArrow(run, f"video_id {kind}, fp long, fn long, idsw long, fragmentation long")


def identity_counts(gt: DataFrame, pred: DataFrame, frames: DataFrame, thr: float = IOU) -> DataFrame:
    """Per video: idtp, idfp, idfn, idf1. Tracks are paired once for the whole video so that the frames in which the
    pairs match are most; pairing, not frames, goes to the solver. Nothing on either side scores 1."""
    return _identity_counts(written(gt, pred, frames), thr)


def _identity_counts(rows: DataFrame, thr: float) -> DataFrame:
    hits = assign(_side(rows, 1), _side(rows, 2, True), thr).groupBy("video_id", "gt_id", "pred_id").agg(F.count("*").alias("n"))

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        gi, g = pd.factorize(pdf.gt_id)
        pi, q = pd.factorize(pdf.pred_id)
        m = np.zeros((len(g), len(q)))
        m[gi, pi] = pdf.n
        _, a, b = priced_assignment(m)
        return pd.DataFrame([(*key, int(a.sum() + b.sum()))], columns=["video_id", "idtp"])

    kind = rows.schema["video_id"].dataType.simpleString()
    best = hits.groupBy("video_id").applyInPandas(solve, f"video_id {kind}, idtp long")
    # one pass counts both sides; a prediction counts on labelled frames
    marks = rows.where("side = 0").select(*FRAME, F.lit(True).alias("_l"))
    n = rows.join(marks, FRAME, "left").groupBy("video_id").agg(F.count_if(F.col("side") == 1).alias("g"), F.count_if((F.col("side") == 2) & F.col("_l")).alias("p"), F.max((F.col("side") == 0).cast("int")).alias("_any")).where("_any = 1")
    out = n.join(best, "video_id", "left").fillna(0, ["idtp"])
    f1 = F.when(F.col("g") + F.col("p") > 0, 2 * F.col("idtp") / (F.col("g") + F.col("p"))).otherwise(F.lit(1.0))
    return out.select("video_id", "idtp", (F.col("p") - F.col("idtp")).alias("idfp"), (F.col("g") - F.col("idtp")).alias("idfn"), f1.alias("idf1"))


def _ratio(top, bottom, empty):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(float(empty)))


def evaluate_tracking(gt: DataFrame, pred: DataFrame, frames: DataFrame, thr: float = IOU) -> DataFrame:
    """Per video: num_gt, num_pred (all frames), fp, fn, idsw, fragmentation, mota, miss_rate, idf1."""
    rows = written(gt, pred, frames)
    out = _clear_mot(rows, thr).join(_identity_counts(rows, thr).select("video_id", "idf1"), "video_id")
    n = rows.groupBy("video_id").agg(F.count_if(F.col("side") == 1).alias("num_gt"), F.count_if(F.col("side") == 2).alias("num_pred"))
    out = out.join(n, "video_id")
    bad = F.col("fn") + F.col("fp") + F.col("idsw")
    return out.withColumn("mota", F.lit(1.0) - _ratio(bad, F.col("num_gt"), 0)).withColumn("miss_rate", _ratio(F.col("fn"), F.col("num_gt"), 0))


def tracking_report(per_video: DataFrame) -> DataFrame:
    """The per-video rows and a total row (video_id null): counts summed, mota and miss_rate from the sums, idf1 the
    mean over videos; one ROLLUP."""
    r = per_video.rollup("video_id").agg(*[F.sum(c).alias(c) for c in ("num_gt", "num_pred", "fp", "fn", "idsw", "fragmentation")], F.avg("idf1").alias("idf1"))
    bad = F.col("fn") + F.col("fp") + F.col("idsw")
    return r.withColumn("mota", F.lit(1.0) - _ratio(bad, F.col("num_gt"), 0)).withColumn("miss_rate", _ratio(F.col("fn"), F.col("num_gt"), 0)).withColumn("idf1", F.coalesce("idf1", F.lit(1.0)))


def track_identities(gt: DataFrame, pred: DataFrame, frames: DataFrame, thr: float = IOU, ratio: float = 0.3) -> DataFrame:
    """Per predicted track: ``gt_id`` that most of its boxes overlap best, or -1.

    A box votes for the ground-truth box of highest overlap (first by gt ``ord``, else id) if that reaches
    ``thr``; the track takes the id with most votes (the one voted for first, on ties) if those are at least
    ``ratio`` of the track's boxes on labelled frames, and one.
    """
    p = labelled(pred, frames)
    order = F.col("ord") if "ord" in gt.columns else F.col("track_id")
    rank = gt.select(*FRAME, F.col("track_id").alias("gt_id"), order.alias("_o"))
    pairs = iou_pairs(gt, p).join(rank, [*FRAME, "gt_id"])
    best = pairs.groupBy(*FRAME, "pred_id").agg(F.min_by(F.struct("gt_id", "iou"), F.struct(-F.col("iou"), "_o")).alias("b")).where(F.col("b.iou") >= thr)
    votes = best.groupBy("video_id", "pred_id", F.col("b.gt_id").alias("gt_id")).agg(F.count("*").alias("n"), F.min("frame_idx").alias("_f"))
    top = votes.groupBy("video_id", "pred_id").agg(F.min_by(F.struct("gt_id", "n"), F.struct(-F.col("n"), "_f", "gt_id")).alias("t"))
    total = p.groupBy("video_id", F.col("track_id").alias("pred_id")).agg(F.count("*").alias("total"))
    enough = F.col("t.n") >= F.greatest(F.lit(1.0), F.col("total") * ratio)
    return total.join(top, ["video_id", "pred_id"], "left").select("video_id", "pred_id", F.when(enough, F.col("t.gt_id")).otherwise(F.lit(-1)).alias("gt_id"))


def _first(df: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy(*FRAME).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def largest_box(boxes: DataFrame, cls: str | None = "dog", tracks: DataFrame | None = None) -> DataFrame:
    """Per frame the box of largest area, the first by ``ord`` on ties; only of ``tracks`` (video_id, track_id) if given."""
    b = boxes if cls is None or "cls" not in boxes.columns else boxes.where(F.col("cls") == cls)
    b = b if tracks is None else b.join(tracks, ["video_id", "track_id"], "left_semi")
    return _first(b, F.desc(box_area(box())), "ord")


def surest_box(boxes: DataFrame) -> DataFrame:
    """Per frame the box of highest ``conf``, the last by ``ord`` on ties."""
    return _first(boxes, F.desc("conf"), F.desc("ord"))


def subject_tracks(boxes: DataFrame, frames: DataFrame, min_share: float = 0.1, cls: str = "dog") -> DataFrame:
    """Tracks whose boxes number at least ``min_share`` of the video's frames: video_id, track_id, n, most boxes first by
    ``rank``. Boxes are counted, not frames."""
    total = frames.groupBy("video_id").agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    n = boxes.where(F.col("cls") == cls).groupBy("video_id", "track_id").agg(F.count("*").alias("n"))
    kept = n.join(total, "video_id").where(F.col("n") / F.col("_n") >= min_share)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), "track_id"))).drop("_n")


def span_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest box around all boxes of a key: cx, cy, w, h."""
    e = boxes.groupBy(*keys).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return e.select(*keys, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def segment_evidence(segments: DataFrame, boxes: DataFrame, motion: DataFrame, fps: float = 30.0, min_coverage: float = 0.25, bucket: int | None = None) -> DataFrame:
    """Segments (video_id, ord, start, end, action) with ``coverage`` (share of their frames that have a box),
    ``mean_motion`` (0 without samples) and ``uncertain`` (no action, or too little coverage).

    Frames meet segments by runs of ``bucket`` frames, by default the segments' mean length."""
    s = segments.withColumn("_f0", (F.col("start") * fps).cast("int")).withColumn("_f1", (F.col("end") * fps).cast("int"))
    bucket = bucket or max(1, int(s.agg(F.avg(F.col("_f1") - F.col("_f0"))).first()[0] or 1))
    run = lambda c: F.floor(F.col(c) / bucket)
    ident = s.where("_f0 < _f1").select("video_id", "ord", "_f0", "_f1", F.explode(F.sequence(run("_f0"), F.floor((F.col("_f1") - 1) / bucket))).alias("_b"))
    inside = (F.col("frame_idx") >= F.col("_f0")) & (F.col("frame_idx") < F.col("_f1"))
    met = lambda df: ident.join(df.withColumn("_b", run("frame_idx")), ["video_id", "_b"]).where(inside).groupBy("video_id", "ord")
    n = met(boxes.select(*FRAME).distinct()).agg(F.count("*").alias("_n"))
    m = met(motion).agg(F.avg("motion").alias("mean_motion"))
    out = s.join(n, ["video_id", "ord"], "left").join(m, ["video_id", "ord"], "left").fillna(0, ["_n", "mean_motion"])
    cover = F.col("_n") / F.greatest(F.lit(1), F.col("_f1") - F.col("_f0"))
    return out.withColumn("coverage", cover).withColumn("uncertain", F.col("action").isNull() | (F.col("coverage") < min_coverage)).drop("_f0", "_f1", "_n")


def quiet_frames(boxes: DataFrame, frame_area, bins: int = 5) -> DataFrame:
    """Per video and bin of neighbouring frames (bins as equal as they come), the frame the boxes cover least."""
    cover = boxes.groupBy(*FRAME).agg(F.least(F.sum(box_area(box())) / F.lit(float(frame_area)), F.lit(1.0)).alias("cover"))
    cut = cover.withColumn("bin", F.ntile(bins).over(Window.partitionBy("video_id").orderBy("frame_idx")))
    w = Window.partitionBy("video_id", "bin").orderBy("cover", "frame_idx")
    return cut.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
