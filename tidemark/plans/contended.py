"""Statements for boxes that contend. A frame's best assignment is a table of the best total for each set of predictions
used so far, one ground-truth track after another; what is carried along a video is a recursion over its frames."""

from __future__ import annotations

from tidemark.plans import projections as P

TRACKS = 7
NONE = 1_000_000

_SWITCHED = """sb as (select video_id, frame_idx, track_id + case when frame_idx >= 500 then 50 else 0 end track_id, pk, x, y from pr),
sw as (select video_id, frame_idx, track_id, x, y from sb union all select distinct video_id, frame_idx, 999, 5000.0::double, 0.0::double from sb where frame_idx % 97 = 0)"""


def _pairs(pred: str) -> str:
    """pairs: overlapping boxes with their IoU in billionths (u) and a bit for the prediction."""
    return f"""ov as (select g.video_id, g.frame_idx, g.track_id g, p.track_id p, greatest(0, least(g.x, p.x) + 30 - greatest(g.x, p.x)) * greatest(0, least(g.y, p.y) + 30 - greatest(g.y, p.y)) i from gt g join {pred} p using (video_id, frame_idx)),
pairs as materialized (select video_id, frame_idx, g, p, i / (1800 - i) iou, round(i / (1800 - i) * 1000000000)::bigint u, 1 << (p % 50)::int bit from ov where i > 0)"""


def _best(source: str, key: str, out: str) -> str:
    """``out``: by ``key`` the total (of u) and the partners (a list by track, NONE for none) of the best assignment of
    ``source`` (key, g, p, u, bit): of equal totals, the first list."""
    steps = [f"{out}0 as (select distinct {key}, 0::bigint mask, [0::bigint] t from {source})"]
    for k in range(1, TRACKS + 1):
        s = f"{out}{k - 1}"
        grown = f"select {', '.join(f'{s}.{c}' for c in key.split(', '))}, mask | bit mask, list_concat([t[1] - u], t[2:], [p]) t from {s} join {source} q on {' and '.join(f'q.{c} = {s}.{c}' for c in key.split(', '))} and q.g = {k} and mask & bit = 0"
        steps.append(f"{out}{k} as (select {key}, mask, min(t) t from (select {key}, mask, list_append(t, {NONE}::bigint) t from {s} union all {grown}) group by all)")
    return ",\n".join(steps) + f",\n{out} as materialized (select {key}, -min(t)[1] total, min(t)[2:] partner from {out}{TRACKS} group by all)"


_FRAMES = _best("pairs", "video_id, frame_idx", "best")
_CHOSEN = "chosen as (select b.video_id, b.frame_idx, g, p, iou from (select *, unnest(range(1, 8)) g, unnest(partner) p from best) b join pairs using (video_id, frame_idx, g, p))"

#: Both worlds up to each frame's chosen pairs: the predictions as they are, and with changed track numbers.
PLAIN = f"with {P.GT_SQL}, {P.PRED_SQL}, {_pairs('pr')},\n{_FRAMES},\n{_CHOSEN}"
CHANGED = f"with recursive {P.GT_SQL}, {P.PRED_SQL}, {_SWITCHED}, {_pairs('sw')},\n{_FRAMES},\n{_CHOSEN}"

ASSIGNED = f"{PLAIN} select video_id, frame_idx, g gt_id, p pred_id, round(iou, 6) iou from chosen where iou >= 0.5"
PROVED = f"{PLAIN} select video_id, frame_idx, count(c.g) n_pairs, any_value(b.total) total, any_value(b.total) price, 0::bigint broken from best b left join chosen c using (video_id, frame_idx) group by all"
MISSES = f"""{PLAIN}, n as (select video_id, count(*) num_gt from gt group by 1), m as (select video_id, count(*) num_pred from pr group by 1), h as (select video_id, count(*) hits from chosen where iou >= 0.5 group by 1)
select video_id, num_gt, coalesce(num_pred, 0) num_pred, num_gt - coalesce(hits, 0) fn, coalesce(num_pred, 0) - coalesce(hits, 0) fp from n left join m using (video_id) left join h using (video_id)"""

#: Whole-video pairing of tracks by the frames they match in.
_IDENTITY = f"""hits as (select video_id, g, p, count(*)::bigint u, 1 << (case when p = 999 then 20 else p % 50 + (p - 100) // 50 * 10 end)::int bit from chosen where iou >= 0.5 group by all),
{_best('hits', 'video_id', 'ids')},
num as (select video_id, count(*) num_gt from gt group by 1), nump as (select video_id, count(*) num_pred from sw group by 1),
f1 as (select video_id, num_gt, coalesce(num_pred, 0) num_pred, coalesce(total, 0) idtp from num left join nump using (video_id) left join ids using (video_id))"""
IDENTITY = f"{CHANGED},\n{_IDENTITY} select video_id, idtp, num_pred - idtp idfp, num_gt - idtp idfn, round(2 * idtp / (num_gt + num_pred)::double, 6) idf1 from f1"

_EACH = "list_transform(range(1, 8), lambda i: {})"
#: Frame by frame: what a track last had is kept if it still overlaps enough, the first of two that want the same; of all
#: assignments with the kept pairs the best is taken; hits are what reaches the threshold.
_MOT = f"""m0 as (select distinct video_id, frame_idx, 0::bigint mask, [0::bigint] t, []::bigint[] hit from gt),
{", ".join(f'''m{k} as (select video_id, frame_idx, mask, list_append(t, {NONE}::bigint) t, list_append(hit, 0::bigint) hit from m{k - 1} union all
select m.video_id, m.frame_idx, mask | bit, list_concat([t[1] - u], t[2:], [p]), list_append(hit, case when iou >= 0.5 then p else 0 end) from m{k - 1} m join pairs q on q.video_id = m.video_id and q.frame_idx = m.frame_idx and q.g = {k} and mask & bit = 0)''' for k in range(1, TRACKS + 1))},
ms as (select video_id, frame_idx, list({{'t': t, 'hit': hit}}) ms from m{TRACKS} group by all),
here as (select video_id, frame_idx, list(track_id) here from gt group by all),
np as (select video_id, frame_idx, count(*) np from sw group by all),
ok as (select video_id, frame_idx, list(g * {NONE} + p) ok from pairs where iou >= 0.5 group by all),
fr as materialized (select video_id, row_number() over (partition by video_id order by frame_idx) k, ms, here, coalesce(np, 0) np, coalesce(ok, []::bigint[]) ok from ms join here using (video_id, frame_idx) left join np using (video_id, frame_idx) left join ok using (video_id, frame_idx)),
st as (
  select distinct video_id, 0::bigint k, [0::bigint, 0, 0, 0, 0, 0, 0] was, [null::bool, null, null, null, null, null, null] seen, 0::bigint fp, 0::bigint fn, 0::bigint idsw, 0::bigint fragmentation from gt
  union all
  select video_id, k, {_EACH.format('case when hit[i] > 0 then hit[i] else was[i] end')}, {_EACH.format('case when list_contains(here, i) then hit[i] > 0 else seen[i] end')},
    fp + np - n, fn + len(here) - n, idsw + len(list_filter(range(1, 8), lambda i: hit[i] > 0 and was[i] > 0 and was[i] <> hit[i])), fragmentation + len(list_filter(range(1, 8), lambda i: hit[i] > 0 and seen[i] = false))
  from (select *, len(list_filter(hit, lambda h: h > 0)) n from (
    select * exclude (ms, kept), list_min(list_filter(ms, lambda m: len(list_filter(range(1, 8), lambda i: kept[i] > 0 and m.t[i + 1] <> kept[i])) = 0)).hit hit from (
      select * exclude (wish), {_EACH.format('case when wish[i] > 0 and not list_contains(wish[1:i - 1], wish[i]) then wish[i] else 0 end')} kept from (
        select fr.*, was, seen, fp, fn, idsw, fragmentation, {_EACH.format(f'case when list_contains(ok, i * {NONE} + was[i]) then was[i] else 0 end')} wish from st join fr on fr.video_id = st.video_id and fr.k = st.k + 1))))),
mot as (select video_id, fp, fn, idsw, fragmentation from st qualify row_number() over (partition by video_id order by k desc) = 1)"""
CLEAR_MOT = f"{CHANGED},\n{_MOT} select * from mot"
REPORT = f"""{CHANGED},\n{_IDENTITY},\n{_MOT},
v as (select mot.*, num_gt, num_pred, 2 * idtp / (num_gt + num_pred)::double idf1 from mot join f1 using (video_id)),
r as (select video_id, sum(num_gt)::bigint num_gt, sum(num_pred)::bigint num_pred, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(idsw)::bigint idsw, sum(fragmentation)::bigint fragmentation, avg(idf1) idf1 from v group by rollup (video_id))
select video_id, num_gt, num_pred, fp, fn, idsw, fragmentation, round(idf1, 6) idf1, round(1 - (fn + fp + idsw) / num_gt::double, 6) mota, round(fn / num_gt::double, 6) miss_rate from r"""
