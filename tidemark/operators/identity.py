"""Linking tracks by appearance: online clustering, anchors, fragments, diverse donors, tag propagation."""

from __future__ import annotations

from array import array
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from tidemark.functions.vectors import cosine_or_zero, dot, doubles, norm
from tidemark.session import materialize

EPS = 1e-8
TAU_SIM, TAU_MARGIN, OVERLAP, FRAGMENT = 0.40, 0.05, 2, 0.15
DONORS, DONOR_MARGIN, DUP_VIDEO, DUP_NEAR, DUP_FRAMES, DUP_MAX = 3, 0.2, 0.5, 0.5, 90, 0.75
TAU_VISUAL, TAU_AUDIO = 0.65, 0.70
#: Numbers in all references that go into a plan: 8 MB.
MOST_NUMBERS = 1_000_000
#: Tracks compared with the clusters at a time, and what rounding may take from a product.
BLOCK, SLACK = 128, 1e-9
#: Clusters that a frame lists before they may become bits.
MOST_LISTED = 64
#: Donors tried for each video at first; each round tries four times as many as the one before.
FIRST_DONORS = 16


def frame_sets(boxes: DataFrame) -> DataFrame:
    """(video_id, track_id, frames): the distinct frames of each track."""
    return boxes.groupBy("video_id", "track_id").agg(F.array_sort(F.collect_set("frame_idx")).alias("frames"))


def frame_bits(tracks: DataFrame) -> DataFrame:
    """(video_id, track_id, word, bits): the frames of each track (an array ``frames``, repeats allowed) as a bitmap in words
    of 64, of which only those with a frame are rows. A track without frames has none."""
    f = tracks.select("video_id", "track_id", F.explode(F.col("frames").cast("array<bigint>")).alias("f"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("f").bitwiseAND(F.lit(63)).cast("int"))
    return f.groupBy("video_id", "track_id", F.shiftright("f", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def shared_frames(bits: DataFrame) -> DataFrame:
    """(video_id, a, b, n): how many frames each two tracks of a video share, a < b, for those that share any. Tracks meet
    by words of 64 frames, and a word's frames are counted at once."""
    side = lambda t: bits.select("video_id", "word", F.col("track_id").alias(t), F.col("bits").alias(f"_{t}"))
    both = side("a").join(side("b"), ["video_id", "word"]).where(F.col("a") < F.col("b"))
    n = F.bit_count(F.col("_a").bitwiseAND(F.col("_b")))
    return both.groupBy("video_id", "a", "b").agg(F.sum(n).cast("long").alias("n")).where("n > 0")


class _Clusters:
    """Clusters in the order they were opened; a track joins the most similar one that it never shares a frame with.

    Means stand in one matrix that doubles when it is full. Tracks are compared by blocks: a product of matrices with the
    clusters at the block's start, and single products with those that changed since. Of clusters within rounding of the
    best the products are taken anew, all in one order of summing, and the first of equals counts.
    """

    def __init__(self, tau: float, dims: int):
        self.tau, self.n, self.mean, self.size = tau, 0, np.empty((64, dims)), np.zeros(64)
        self.at: dict[int, array | int] = {}

    def _set(self, i: int, v: np.ndarray) -> None:
        if i == len(self.size):
            self.mean, self.size = np.concatenate([self.mean, np.empty_like(self.mean)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.mean[i] = v
        self.size[i] += 1

    def _barred(self, own) -> np.ndarray:
        """Numbers of the clusters seen on any of the frames, some of them more than once."""
        lists, bits = [np.empty(0, np.int64)], 0
        for seen in map(self.at.get, own):
            if isinstance(seen, int):
                bits |= seen
            elif seen is not None:
                lists.append(np.frombuffer(seen, np.int64))
        if bits:
            lists.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(self.n // 8 + 1, "little"), np.uint8), bitorder="little")))
        return np.concatenate(lists)

    def _seen(self, i: int, own) -> None:
        """Cluster ``i`` is on the frames. A frame's clusters are a list, or the bits of a number where those take less."""
        for f in own:
            seen = self.at.get(f)
            if isinstance(seen, int):
                self.at[f] = seen | 1 << i
                continue
            if seen is None:
                seen = self.at[f] = array("q")
            seen.append(i)
            if len(seen) > MOST_LISTED and 64 * len(seen) > self.n:
                held = np.zeros(self.n, np.uint8)
                held[seen] = 1
                self.at[f] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")

    def block(self, vectors: np.ndarray, frames: list):
        """(cluster, sim, joined) of each of the vectors, in order."""
        start, changed = self.n, {}
        known = vectors @ self.mean[:start].T
        for k, (v, own) in enumerate(zip(vectors, frames, strict=True)):
            new = list(changed)
            sims = np.concatenate([known[k], np.full(self.n - start, -np.inf)])
            sims[new] = self.mean[new] @ v
            if own:
                sims[self._barred(own)] = -np.inf
            best = sims.max(initial=-1.0)
            i = -1
            if best > -1 - SLACK and self.n:
                close = np.flatnonzero(sims >= best - SLACK)
                exact = (self.mean[close] * v).sum(axis=1)
                i, best = (int(close[exact.argmax()]), float(exact.max())) if len(close) else (-1, -1.0)
            joined = i >= 0 and best > -1 and best >= self.tau
            sim = best if i >= 0 and best > -1 else -1.0
            if joined:
                total = self.mean[i] * self.size[i] + v
                self._set(i, total / (np.linalg.norm(total) + EPS))
            else:
                i, self.n = self.n, self.n + 1
                self._set(i, v)
            changed[i] = True
            self._seen(i, own)
            yield i, sim, joined


def relink(tracks: DataFrame, taus: list[float]) -> DataFrame:
    """Online clustering of each video's tracks (video_id, track_id, v of length 1, frames) in order of track_id, for each
    tau: cluster, sim (best eligible, -1 without any), auto (joined; else a person is asked).

    The clusters of a video are sequential state, so a video and tau are one group; it holds tracks, not frames'
    images. Where little is joined, every track meets every earlier one: the time is quadratic in a video's tracks, by
    products of matrices. Null frames never exclude.
    """
    kind = tracks.schema["video_id"].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id", kind="stable")
        vectors, out = np.stack(pdf["v"].to_numpy()).astype(float), []
        frames = [() if f is None else set(np.asarray(f).tolist()) for f in pdf["frames"]]
        clusters = _Clusters(key[1], vectors.shape[1])
        for at in range(0, len(vectors), BLOCK):
            out += clusters.block(vectors[at : at + BLOCK], frames[at : at + BLOCK])
        cluster, sim, auto = zip(*out, strict=True)
        return pd.DataFrame({"video_id": key[0], "tau": key[1], "track_id": pdf["track_id"].to_numpy(), "cluster": cluster, "sim": [round(x, 3) for x in sim], "auto": auto})

    each = tracks.select("video_id", "track_id", doubles("v").alias("v"), "frames").withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    return each.groupBy("video_id", "tau").applyInPandas(run, f"video_id {kind}, tau double, track_id long, cluster long, sim double, auto boolean")


@F.pandas_udf(BinaryType())
def _packed(frames: pd.Series) -> pd.Series:
    """Frames of a track as words of 64: the words' numbers, then their bits. A null list has none."""

    def one(f) -> bytes:
        f = np.asarray(f if f is not None else [], np.int64)
        words, at = np.unique(f >> 6, return_inverse=True)
        bits = np.zeros(len(words), np.int64)
        np.bitwise_or.at(bits, at, np.left_shift(np.int64(1), f & 63))
        return words.tobytes() + bits.tobytes()

    return frames.map(one)


def _two_best(v: np.ndarray, samples: np.ndarray) -> float:
    """Mean of the two highest products of any of ``v`` with any of ``samples``."""
    p = (v @ samples.T).ravel()
    return float(np.partition(p, -2)[-2:].mean()) if len(p) > 1 else float(p[0]) if len(p) else -1.0


def _near_before(own: np.ndarray, vectors: list[np.ndarray], many: bool) -> np.ndarray:
    """How near each but the first of ``own`` is to what those before it make up together.

    With one vector a track that is the cosine with the sum of their vectors; with many, :func:`_two_best`.
    """
    if many:
        ends = np.cumsum([len(vectors[i]) for i in own])
        samples = np.concatenate([vectors[i] for i in own])
        return np.array([_two_best(vectors[i], samples[:n]) for i, n in zip(own[1:], ends)])
    total = np.cumsum([vectors[i] for i in own], axis=0)[:-1]
    return (np.array([vectors[i] for i in own[1:]]).reshape(total.shape) * total).sum(axis=1) / (np.linalg.norm(total, axis=1) + EPS)


def _near_all(own: np.ndarray, others: np.ndarray, vectors: list[np.ndarray], many: bool) -> np.ndarray:
    """How near each of ``others`` is to what all of ``own`` make up together."""
    if many:
        samples = np.concatenate([vectors[i] for i in own])
        return np.array([_two_best(vectors[i], samples) for i in others])
    total = np.cumsum([vectors[i] for i in own], axis=0)[-1]
    total = total / (np.linalg.norm(total) + EPS)
    return np.array([vectors[i] @ total for i in others])


def anchor_taps(tracks: DataFrame, tau: float, many: bool = False) -> DataFrame:
    """For each true identity of a video taken as the wanted one: taps needed and foreign tracks wrongly taken.

    ``tracks`` has video_id, track_id, gt_id, frames and ``v``, a vector, or with ``many`` an array of vectors.
    The identity's tracks come by first frame, those without frames last; the first costs a tap, each later one too
    unless it is similar enough and shares no frame with those before, and all are taken in either way. What a track
    is compared with is in :func:`_near_before`. A video is a group: its tracks' vectors and their frames as bitmaps,
    and nothing for pairs of tracks.
    """
    kind = tracks.schema["video_id"].dataType.simpleString()
    order = F.row_number().over(Window.partitionBy("video_id").orderBy(F.array_min("frames").asc_nulls_last(), "track_id"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        vectors = [np.stack(v).astype(float) if many else np.array(v, float) for v in pdf["v"]]
        gt, halves = pdf["gt_id"].to_numpy(), [np.frombuffer(f, np.int64).reshape(2, -1) for f in pdf["frames"]]
        words, at = np.unique(np.concatenate([h[0] for h in halves]), return_inverse=True)
        at = np.split(at, np.cumsum([h.shape[1] for h in halves])[:-1])
        out = []
        for d in np.unique(gt):
            own, others = np.flatnonzero(gt == d), np.flatnonzero(gt != d)
            seen, joined = np.zeros(len(words), np.int64), 0
            meets = lambda i: (seen[at[i]] & halves[i][1]).any()  # noqa: E731, B023
            for i, near in zip(own, [False, *(_near_before(own, vectors, many) >= tau)], strict=True):
                joined += bool(near) and not meets(i)
                seen[at[i]] |= halves[i][1]
            near = others[_near_all(own, others, vectors, many) >= tau] if len(others) else others
            out.append((*key, d, len(own) - joined, sum(not meets(i) for i in near)))
        return pd.DataFrame(out, columns=["video_id", "gt_id", "taps", "false_attach"])

    each = tracks.select("video_id", "gt_id", "v", _packed(F.col("frames").cast("array<bigint>")).alias("frames"), order.alias("ord"))
    return each.groupBy("video_id").applyInPandas(run, f"video_id {kind}, gt_id long, taps long, false_attach long")


def tap_summary(taps: DataFrame, by: list[str]) -> DataFrame:
    """Mean taps, share of scenarios below two taps, and false attachments."""
    return taps.groupBy(*by).agg(F.avg("taps").alias("avg_taps"), F.avg((F.col("taps") < 2).cast("double")).alias("share_below_two"), F.sum("false_attach").alias("false_attach"))


def reference_similarity(tracks: DataFrame, refs: DataFrame, keys: list[str], refs_of: list[str] | None = None) -> DataFrame:
    """Highest product of a track's vector with any reference vector: keys, ``sim``.

    References are joined on ``refs_of`` if given; without, every track meets all of them, which are the few
    pictures a person gave: at most ``MOST_NUMBERS`` numbers together, which is checked before they are fetched.
    """
    if refs_of:
        pairs = tracks.join(refs.select(*refs_of, F.col("v").alias("_r")), refs_of)
    else:
        size = refs.agg(F.sum(F.size("v"))).first()[0] or 0
        if size > MOST_NUMBERS:
            raise ValueError(f"references of more than {MOST_NUMBERS:,} numbers: join them on a key")
        held: dict[int, list] = {}
        for r in refs.select(doubles("v").alias("v")).collect():
            if r.v is not None and None not in r.v:
                held.setdefault(len(r.v), []).append(r.v)
        by_length = {n: np.array(v, float).reshape(len(v), n) for n, v in held.items()}

        @F.pandas_udf("double")
        def nearest(vectors: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(vectors), dtype=object)
            sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
            for n, own in by_length.items():
                rows = np.flatnonzero(sizes == n)
                for at in range(0, len(rows), 1024):  # a product of 1024 x references at a time
                    part = rows[at : at + 1024]
                    out.iloc[part] = (np.array(list(vectors.iloc[part]), float).reshape(len(part), n) @ own.T).max(axis=1)
            return out

        whole = F.when(~F.exists("v", lambda x: x.isNull()), doubles("v"))
        return tracks.select(*keys, nearest(whole).alias("sim"))
    return pairs.groupBy(*keys).agg(F.max(dot(doubles("v"), doubles("_r"))).alias("sim"))


def fragments(tracks: DataFrame, overlap: int = OVERLAP, delta: float = FRAGMENT) -> DataFrame:
    """Per video of (video_id, track_id, sim, frames): the tracks that are pieces of the best one, most similar first, and
    the margin to the best track that isn't (1 without any).

    Tracks are taken by falling sim (then by track_id) while within ``delta`` of the best, if they share at most
    ``overlap`` frames with each taken so far. Shared frames are counted on bitmaps; the greedy choice is a fold over
    a video's tracks near the best. Tracks without sim are left out.
    """
    tracks = tracks.where("sim is not null")
    best = tracks.groupBy("video_id").agg(F.max("sim").alias("_b"))
    near = tracks.join(best, "video_id").where(F.col("sim") >= F.col("_b") - delta)
    clash = shared_frames(frame_bits(near)).where(F.col("n") > overlap)
    clash = clash.select("video_id", F.col("a").alias("track_id"), F.col("b").alias("other")).unionByName(clash.select("video_id", F.col("b").alias("track_id"), F.col("a").alias("other")))
    clash = clash.groupBy("video_id", "track_id").agg(F.collect_list(F.col("other").cast("long")).alias("clash"))
    row = F.struct((-F.col("sim")).alias("s"), F.col("track_id").cast("long").alias("t"), F.coalesce("clash", F.array().cast("array<bigint>")).alias("c"))
    ordered = near.select("video_id", "track_id", "sim").join(clash, ["video_id", "track_id"], "left").groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("_o"))
    take = F.aggregate("_o", F.array().cast("array<bigint>"), lambda taken, x: F.when(F.arrays_overlap(taken, x["c"]), taken).otherwise(F.concat(taken, F.array(x["t"]))))
    chosen = ordered.select("video_id", take.alias("tracks"))
    rival = tracks.join(chosen, "video_id").where(~F.array_contains("tracks", F.col("track_id").cast("long"))).groupBy("video_id").agg(F.max("sim").alias("_v"))
    out = chosen.join(best, "video_id").join(rival, "video_id", "left")
    return out.select("video_id", F.col("tracks")[0].alias("track"), "tracks", F.col("_b").alias("sim"), F.coalesce(F.bround(F.col("_b") - F.col("_v"), 4), F.lit(1.0)).alias("margin"))


def confident(track, sim, margin):
    """Whether a match needs no person: there is a track, and both its similarity and its margin suffice."""
    return track.isNotNull() & (sim >= TAU_SIM) & (margin >= TAU_MARGIN)


def match_videos(boxes: DataFrame, candidates: DataFrame, refs: DataFrame, samples: DataFrame) -> DataFrame:
    """For each video the track that is most like the references: video_id, track, tracks (its pieces), sim, margin.

    ``boxes`` has video_id, frame_idx, track_id, cls; ``candidates`` (video_id, track_id) are the tracks in question;
    ``samples`` (video_id, track_id, v) are vectors of their crops, pooled here; ``refs`` (v) are the few references. Only
    dogs' boxes count. Videos none of whose candidates has a vector aren't listed.
    """
    from tidemark.functions.vectors import mean_pool

    key = ["video_id", "track_id"]
    own = boxes.where(F.col("cls") == "dog").join(candidates.select(key).distinct(), key, "left_semi")
    mean = mean_pool(samples.join(candidates.select(key).distinct(), key, "left_semi"), key, "v").withColumnRenamed("pooled", "v")
    sim = reference_similarity(mean, refs, key)
    return fragments(sim.join(frame_sets(own), key, "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<bigint>"))))


def donor_cuts(boxes: DataFrame, margins: DataFrame, step: int = 15, per_video: int = 6) -> DataFrame:
    """Candidate cuts (video_id, frame_idx, margin, motion) of subject boxes: every ``step``-th frame of a video in order,
    motion the centre's shift since the one before over that box's larger side, the livelier ``per_video`` of each."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    s = boxes.withColumn("_i", F.row_number().over(w)).where((F.col("_i") - 1) % step == 0)
    s = s.select("video_id", "frame_idx", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), F.greatest("w", "h").alias("size"))
    shift = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2)) / F.greatest(F.lag("size").over(w), F.lit(1.0))
    s = s.withColumn("motion", F.bround(F.coalesce(shift, F.lit(0.0)), 4))
    top = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("motion"), "frame_idx"))
    return s.withColumn("_r", top).where(F.col("_r") <= per_video).join(margins, "video_id").select("video_id", "frame_idx", "margin", "motion")


def repeats(a: Column, b: Column) -> Column:
    """How much a cut repeats another (structs with video_id and frame_idx): 0.5 and up to 0.5 more by nearness for the same
    video, 0 for others."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(a["frame_idx"] - b["frame_idx"]) / DUP_FRAMES)
    return F.when(a["video_id"] == b["video_id"], DUP_VIDEO + DUP_NEAR * near).otherwise(0.0)


def diverse(cuts: DataFrame, keys: list[str], k: int = DONORS, dup_max: float = DUP_MAX) -> DataFrame:
    """Greedily the first k cuts (by margin, then motion, both falling, then by video and frame) that repeat none of those
    taken by ``dup_max`` or more: adds ``pick`` from 1. Cuts without a margin or motion come last.

    The choice depends on what was taken before: a fold over a key's candidate cuts, which are a few for each video.
    """
    last = lambda c: F.coalesce(-F.col(c), F.lit(float("inf")))
    row = F.struct(last("margin").alias("_m"), last("motion").alias("_s"), "video_id", "frame_idx", F.struct(*cuts.columns).alias("_row"))
    ordered = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_o"))
    none = F.filter("_o", lambda _: F.lit(False))
    fresh = lambda taken, x: (F.size(taken) < k) & ~F.exists(taken, lambda y: repeats(x, y) >= dup_max)
    taken = F.aggregate("_o", none, lambda taken, x: F.when(fresh(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    out = ordered.select(F.posexplode(taken).alias("_i", "_x"))
    return out.select("_x._row.*", (F.col("_i") + 1).cast("long").alias("pick"))


def two_pass_anchors(match, refs: DataFrame, donors_of) -> tuple[DataFrame, DataFrame]:
    """Anchor videos in two passes. ``match(refs)`` gives (video_id, track, tracks, sim, margin); videos confirmed by the
    pictures, with a margin of 0.2 or more, lend a reference through ``donors_of(confirmed)``; what that confirms too
    is added, the rest is left for a person. Returns (confirmed, open)."""
    ok = confident(F.col("track"), F.col("sim"), F.col("margin"))
    first = match(refs)
    sure = first.where(ok)
    lent = donors_of(sure.where(F.col("margin") >= DONOR_MARGIN))
    again = match(refs.unionByName(lent)).join(sure.select("video_id"), "video_id", "left_anti")
    return sure.unionByName(again.where(ok)), again.where(~ok)


def same_place(a: str, b: str, tau_visual: float = TAU_VISUAL, tau_audio: float = TAU_AUDIO):
    """Whether two profiles are of one place: pictures and sounds both alike."""
    alike = lambda v: cosine_or_zero(F.col(f"{a}.{v}"), F.col(f"{b}.{v}"))
    return (alike("scene_vec") >= tau_visual) & (alike("audio_vec") >= tau_audio)


def propagate_tags(profiles: DataFrame, donors: DataFrame, keys: list[str], tau_visual: float = TAU_VISUAL, tau_audio: float = TAU_AUDIO) -> DataFrame:
    """Tags lent to videos of the same place: (tag, video_id, donor, vis, aud), the first donor by ``ord`` that fits.

    ``profiles`` has video_id, scene_vec, audio_vec and ``keys`` (such as an owner) within which places are
    compared; ``donors`` has tag, video_id, ord and the same keys. Donors of a tag get nothing for it, and what
    is lent isn't lent on. Keys are required, as without them every video would meet every donor.
    """
    if not keys:
        raise ValueError("videos and donors need a key, such as an owner, by which they meet")
    p = profiles.select(*keys, "video_id", doubles("scene_vec").alias("scene_vec"), doubles("audio_vec").alias("audio_vec"))
    order = F.row_number().over(Window.partitionBy(*keys, "tag").orderBy("ord", "donor"))
    d = donors.where("ord is not null").join(p, [*keys, "video_id"]).select(*keys, "tag", F.col("video_id").alias("donor"), "ord", F.struct("scene_vec", "audio_vec").alias("d"))
    d = materialize(d.withColumn("_k", order), "donors")
    own = donors.select(*keys, "tag", "video_id")
    tags = d.groupBy(*keys, "tag").agg(F.max("_k").alias("_n"))
    left = p.select(*keys, "video_id", F.struct("scene_vec", "audio_vec").alias("t")).join(tags, keys).join(own, [*keys, "tag", "video_id"], "left_anti")
    if tau_visual > 0:
        left = left.where(norm(F.col("t.scene_vec")) > 0)  # without a direction nothing is alike
    if tau_audio > 0:
        left = left.where(norm(F.col("t.audio_vec")) > 0)
    vis, aud = cosine_or_zero(F.col("t.scene_vec"), F.col("d.scene_vec")), cosine_or_zero(F.col("t.audio_vec"), F.col("d.audio_vec"))
    last, lo, hi, found = d.agg(F.max("_k")).first()[0] or 0, 0, FIRST_DONORS, []
    while True:
        # donors come in order, so a video that has met one that fits needs no later one
        part = d.where((F.col("_k") > lo) & (F.col("_k") <= hi))
        fit = left.join(part, [*keys, "tag"]).where((F.col("video_id") != F.col("donor")) & same_place("t", "d", tau_visual, tau_audio))
        lent = F.min_by(F.struct("donor", F.bround(vis, 3).alias("vis"), F.bround(aud, 3).alias("aud")), "_k").alias("x")
        found.append(materialize(fit.groupBy(*keys, "tag", "video_id").agg(lent), f"lent-{hi}"))
        if hi >= last:
            break
        left = materialize(left.where(F.col("_n") > hi).join(found[-1], [*keys, "tag", "video_id"], "left_anti"), f"left-{hi}")
        lo, hi = hi, hi * 4
    first = reduce(DataFrame.unionByName, found)
    return first.select(*keys, "tag", "video_id", "x.donor", "x.vis", "x.aud")


def relink_report(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Per tau of :func:`relink`'s rows against (video_id, track_id, gt_id): pair_precision from counts summed over videos
    (1 without a merged pair), taps_per_video, auto_share. Pairs are counted from cell sizes."""
    both = links.join(truth, ["video_id", "track_id"])
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    # each level is summed from the one below, so the links are read, and the clustering run, once
    cells = both.groupBy("tau", "video_id", "cluster", "gt_id").agg(F.count("*").alias("n"), F.count_if("auto").alias("_a"), F.count_if(~F.col("auto")).alias("_asked"))
    merged = cells.groupBy("tau", "video_id", "cluster").agg(F.sum("n").alias("n"), pairs("n").alias("_g"), F.sum("_a").alias("_a"), F.sum("_asked").alias("_asked"))
    videos = merged.groupBy("tau", "video_id").agg(F.sum("n").alias("n"), pairs("n").alias("_c"), F.sum("_g").alias("_g"), F.sum("_a").alias("_a"), F.sum("_asked").alias("_asked"))
    out = videos.groupBy("tau").agg(F.sum("n").alias("n"), F.count("video_id").alias("_v"), *[F.sum(c).alias(c) for c in ("_c", "_g", "_a", "_asked")])
    precision = F.when(F.col("_c") > 0, F.col("_g") / F.col("_c")).otherwise(F.lit(1.0))
    known = F.col("_a") + F.col("_asked")
    return out.select("tau", precision.alias("pair_precision"), (F.col("_asked") / F.col("_v")).alias("taps_per_video"), (F.col("_a") / F.when(known > 0, known)).alias("auto_share"))


def donor_vectors(cuts: DataFrame, embedded: DataFrame, keys: list[str]) -> DataFrame:
    """One reference per key from the chosen cuts' vectors (video_id, frame_idx, v): scaled, averaged and scaled again."""
    from tidemark.functions.vectors import mean_pool

    return mean_pool(cuts.join(embedded, ["video_id", "frame_idx"]), keys, "v").withColumnRenamed("pooled", "v")
