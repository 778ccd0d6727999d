"""Queries on worlds in which no two boxes contend, where SQL can say what the solvers find; taps and spoken numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import identity, tracking
from tidemark.plans import projections as P
from tidemark.plans.registry import query


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


# ---- boxes far apart: every ground-truth box meets its own prediction or none ----

_WORLD = f"""with {P.GT_SQL}, g as (select video_id, frame_idx, track_id from gt),
p as (select video_id, frame_idx, track_id gt_id, track_id + case when frame_idx >= 500 then 150 else 100 end pred_id, (30 - pk % 9) * (30 - pk % 5) both_ from gt where pk % 11 <> 0),
h as (select video_id, frame_idx, gt_id, pred_id from p where both_ / (1800.0::double - both_) >= 0.5),
np as (select video_id, count(*) n from (select video_id from p union all select video_id from (select distinct video_id, frame_idx from p where frame_idx % 97 = 0)) group by 1),
n as (select video_id, count(*) num_gt, coalesce(any_value(np.n), 0) num_pred from g left join np using (video_id) group by 1),
x as (select n.video_id, num_gt, num_pred, count(h.gt_id) hits from n left join h using (video_id) group by all),
c as (select video_id, num_gt, num_pred, num_gt - hits fn, num_pred - hits fp from x),
sw as (select video_id, count(*) filter (pred_id <> was) n from (select *, lag(pred_id) over (partition by video_id, gt_id order by frame_idx) was from h) group by 1),
br as (select video_id, count(*) filter (hit and not was) n from (select *, lag(hit) over (partition by video_id, track_id order by frame_idx) was from (select g.*, h.gt_id is not null hit from g left join h on h.video_id = g.video_id and h.frame_idx = g.frame_idx and h.gt_id = g.track_id)) group by 1),
m as (select c.*, coalesce(sw.n, 0) idsw, coalesce(br.n, 0) fragmentation from c left join sw using (video_id) left join br using (video_id)),
i as (select video_id, sum(n)::bigint idtp from (select video_id, gt_id, max(n) n from (select video_id, gt_id, pred_id, count(*) n from h group by all) group by all) group by 1),
f as (select n.video_id, coalesce(idtp, 0) idtp, num_pred - coalesce(idtp, 0) idfp, num_gt - coalesce(idtp, 0) idfn, 2 * coalesce(idtp, 0) / (num_gt + num_pred)::double idf1 from n left join i using (video_id))"""


def _apart(spark, d):
    """Ground truth and predictions of :data:`_WORLD`: predictions change their number half way, and a phantom box stands
    far off on every 97th frame that has predictions."""
    g = P.gt_boxes(spark, d).withColumn("x", 200.0 * F.col("track_id"))
    p = g.where("pk % 11 <> 0").withColumn("x", F.col("x") + F.col("pk") % 9).withColumn("y", F.col("y") + F.col("pk") % 5)
    p = p.withColumn("track_id", F.col("track_id") + F.when(F.col("frame_idx") >= 500, 150).otherwise(100))
    ghost = p.where("frame_idx % 97 = 0").select("video_id", "frame_idx").distinct().select("video_id", "frame_idx", F.lit(999).cast("long").alias("track_id"), F.lit(9000.0).alias("x"), *[F.lit(30.0).alias(c) for c in "ywh"])
    box = ["video_id", "frame_idx", "track_id", "x", "y", "w", "h"]
    return g.select(box), p.select(box).unionByName(ghost), P.labelled_frames(spark, d)


@query("miss_counts_apart", f"{_WORLD} select video_id, num_gt, num_pred, fn, fp from c")
def miss_counts_apart(spark, d):
    return tracking.miss_counts(*_apart(spark, d))


@query("clear_mot_apart", f"{_WORLD} select video_id, fp, fn, idsw, fragmentation from m")
def clear_mot_apart(spark, d):
    return tracking.clear_mot(*_apart(spark, d))


@query("identity_f1_apart", f"{_WORLD} select video_id, idtp, idfp, idfn, round(idf1, 6) idf1 from f")
def identity_f1_apart(spark, d):
    return tracking.identity_counts(*_apart(spark, d)).withColumn("idf1", F.round("idf1", 6))


@query("tracking_report_apart", f"""{_WORLD}, v as (select m.*, idf1 from m join f using (video_id)), r as (select video_id, sum(num_gt)::bigint num_gt, sum(num_pred)::bigint num_pred, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(idsw)::bigint idsw, sum(fragmentation)::bigint fragmentation, avg(idf1) idf1 from v group by rollup (video_id))
select video_id, num_gt, num_pred, fp, fn, idsw, fragmentation, round(idf1, 6) idf1, round(1 - (fn + fp + idsw) / num_gt::double, 6) mota, round(fn / num_gt::double, 6) miss_rate from r""")
def tracking_report_apart(spark, d):
    r = tracking.tracking_report(tracking.evaluate_tracking(*_apart(spark, d)))
    return r.select("video_id", "num_gt", "num_pred", "fp", "fn", "idsw", "fragmentation", _r("idf1"), _r("mota"), _r("miss_rate"))


@query("last_listed_frame", "select event_type video_id, event_id % 50 frame_idx, max(event_id) as ord, arg_max(user_id, event_id) as track_id from events group by 1, 2")
def last_listed_frame(spark, d):
    e = P.read(spark, d, "events").select(F.col("event_type").alias("video_id"), (F.col("event_id") % 50).alias("frame_idx"), F.col("event_id").alias("ord"), F.col("user_id").alias("track_id"))
    return tracking.last_per_frame(e)


# ---- taps: what a person is asked, by cumulative sums of vectors ----

_TAPS = """with e as (select vec_id % 10 video_id, vec_id track_id, label::bigint gt_id, embedding::double[] v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) n, vec_id % 150 user_id from embeddings),
ev as (select user_id, list_sort(list(distinct event_id % 5000)) frames from events group by 1),
t as (select video_id, track_id, gt_id, list_transform(v, lambda x: case when n > 0 then x / n else x end) v, coalesce(frames, []) frames, row_number() over (partition by video_id order by coalesce(frames, [])[1] nulls last, track_id) as pos from e left join ev using (user_id)),
k as (select *, row_number() over (partition by video_id, gt_id order by pos) k, count(*) over (partition by video_id, gt_id) own from t),
u as (select video_id, gt_id, k, i, sum(v[i]) over (partition by video_id, gt_id, i order by k) s from (select *, unnest(range(1, len(v) + 1)) i from k)),
a as (select video_id, gt_id, k, list(s order by i) s, sqrt(sum(s * s)) + 1e-8 n from u group by all),
w as (select x.video_id, x.gt_id, x.k, list_dot_product(a.s, x.v) / a.n as sim, exists (select 1 from k y where y.video_id = x.video_id and y.gt_id = x.gt_id and y.k < x.k and list_has_any(y.frames, x.frames)) met from k x join a on a.video_id = x.video_id and a.gt_id = x.gt_id and a.k = x.k - 1),
tp as (select video_id, gt_id, 1 + (select count(*) from w where w.video_id = k.video_id and w.gt_id = k.gt_id and (met or sim < 0.75)) taps from k where k.k = 1),
fa as (select z.video_id, z.gt_id, count(*) n from k z join a on a.video_id = z.video_id and a.gt_id = z.gt_id and a.k = z.own join k x on x.video_id = z.video_id and x.gt_id <> z.gt_id where z.k = 1 and list_dot_product(a.s, x.v) / a.n >= 0.75 and not exists (select 1 from k y where y.video_id = z.video_id and y.gt_id = z.gt_id and list_has_any(y.frames, x.frames)) group by all),
taps as (select tp.video_id, tp.gt_id, taps, coalesce(fa.n, 0) false_attach from tp left join fa on fa.video_id = tp.video_id and fa.gt_id = tp.gt_id)"""


@query("anchor_taps", f"{_TAPS} select * from taps")
def anchor_taps(spark, d):
    return identity.anchor_taps(P.track_vectors(spark, d), 0.75)


@query("tap_summary", f"{_TAPS} select video_id, round(avg(taps), 9) avg_taps, round(avg((taps < 2)::int), 9) share_below_two, sum(false_attach)::bigint false_attach from taps group by 1")
def tap_summary(spark, d):
    out = identity.tap_summary(identity.anchor_taps(P.track_vectors(spark, d), 0.75), ["video_id"])
    return out.select("video_id", _r("avg_taps", 9), _r("share_below_two", 9), "false_attach")


# ---- numbers as they are spoken ----


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sino_sql(n: str) -> str:
    """A SQL expression for :func:`text.read_sino` of a non-negative integer expression of up to 16 digits."""
    s = f"(({n})::varchar)"
    left = f"(length({s}) - i)"
    digit = f"{s}[i]::int"
    place = f"{_listed(text.PLACES)}[{left} % 4 + 1]"
    said = f"case when {digit} = 0 then '' when {digit} = 1 and {left} % 4 > 0 then {place} else {_listed(text.DIGITS)}[{digit} + 1] || {place} end"
    group = f"case when {left} % 4 = 0 and (({n})::bigint // pow(10, {left})::bigint) % 10000 > 0 then {_listed(text.GROUPS)}[{left} // 4 + 1] else '' end"
    return f"case when ({n}) = 0 then '{text.ZERO}' else array_to_string(list_transform(range(1, length({s}) + 1), lambda i: {said} || {group}), '') end"


_SPELLED = f"array_to_string(list_transform(range(1, length(part) + 1), lambda i: case when part[i] = '0' then '{text.ZERO}' else {_listed(text.DIGITS)}[part[i]::int + 1] end), ' ')"


@query("numbers_to_words", f"""with p as (select p_partkey, p_size::bigint z, split_part(p_retailprice::varchar, '.', 1)::bigint whole, split_part(p_retailprice::varchar, '.', 2) part from part)
select p_partkey, case when z between 1 and 99 then {_listed(text.NATIVE_TENS)}[z // 10 + 1] || {_listed(text.NATIVE_ONES)}[z % 10 + 1] else {sino_sql('z')} end || ' 마리 ' || {sino_sql('whole')} || case when part <> '' then ' {text.POINT} ' || {_SPELLED} else '' end || ' {text.UNITS['kg']} ' || {sino_sql('p_partkey')} as read from p""")
def numbers_to_words(spark, d):
    p = P.read(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("마리 "), F.col("p_retailprice").cast("string"), F.lit("kg "), F.col("p_partkey").cast("string")).alias("t"))
    return p.select("p_partkey", text.read_numbers_udf("t").alias("read"))
