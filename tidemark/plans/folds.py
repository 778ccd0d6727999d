"""Statements for choices that depend on what was chosen before: recursions over a group's rows in order."""

from __future__ import annotations

from tidemark.functions.text import DWELL, MIN_SHOW, READ_CPS, STRIPPED
from tidemark.operators import identity as I
from tidemark.operators import layout as L

TRACKS = """e as (select vec_id % 10 video_id, vec_id track_id, label::bigint gt_id, embedding::double[] w, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) len, vec_id % 150 user_id from embeddings),
ev as (select user_id, list_sort(list(distinct event_id % 5000)) frames from events group by 1),
t as (select video_id, track_id, gt_id, list_transform(w, lambda x: case when len > 0 then x / len else x end) v, coalesce(frames, []) frames from e left join ev using (user_id))"""


#: Tracks with the mean of their samples, see :func:`projections.sampled_tracks`.
SAMPLED = f"""ev as (select user_id, list_sort(list(distinct event_id % 5000)) frames from events group by 1),
sm as (select vec_id, label, vec_id % 10 video_id, vec_id // 80 part, embedding::double[] w, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) + {I.EPS} len from embeddings where embedding is not null),
tr as (select video_id, min(vec_id) track_id, list(list_transform(w, lambda x: x / len) order by vec_id) s from sm group by video_id, label, part),
mn as (select video_id, track_id, list_transform(range(1, len(s[1]) + 1), lambda j: list_sum(list_transform(s, lambda x: x[j])) / len(s)) m from tr),
t as (select video_id, track_id, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda y: y * y))) + {I.EPS})) v, coalesce(frames, []) frames from mn left join ev on ev.user_id = track_id % 150)"""


def _relink(taus: str, tracks: str = TRACKS, apart: bool = False) -> str:
    """rl: the clusters' means and sizes carried from track to track, and with ``apart`` their frames, none of which a track
    that joins may share."""
    unit = f"list_transform(s, lambda x: x / (sqrt(list_sum(list_transform(s, lambda y: y * y))) + {I.EPS}))"
    none, held, own, sims = "", "", "", "list_transform(means, lambda m: list_dot_product(m, o.v))"
    if apart:
        none, held, own = " []::bigint[][] held,", " case when auto then list_concat(list_concat(held[1:i - 1], [list_concat(held[i], frames)]), held[i + 1:]) else list_append(held, frames) end,", " held, o.frames,"
        sims = "list_transform(range(1, len(means) + 1), lambda j: case when not list_has_any(held[j], o.frames) then list_dot_product(means[j], o.v) end)"
    return f"""{tracks}, o as (select *, row_number() over (partition by video_id order by track_id) k from t),
rl as (
  select distinct video_id, tau, 0::bigint k, []::double[][] means, []::bigint[] sizes,{none} null::bigint track_id, null::bigint cluster, null::double sim, null::bool auto from t, (select unnest({taus}::double[]) tau)
  union all
  select video_id, tau, k, case when auto then list_concat(list_concat(means[1:i - 1], [mean]), means[i + 1:]) else list_append(means, v) end,
    case when auto then list_concat(list_concat(sizes[1:i - 1], [sizes[i] + 1]), sizes[i + 1:]) else list_append(sizes, 1) end,{held} track_id, case when auto then i - 1 else len(means) end, sim, auto
  from (select *, {unit} mean from (select *, list_transform(range(1, len(v) + 1), lambda j: coalesce(means[i][j] * sizes[i], 0) + v[j]) s, sim > -1 and sim >= tau auto
    from (select *, list_position(sims, list_max(sims)) i, greatest(coalesce(list_max(sims), -1), -1) sim
      from (select rl.video_id, rl.tau, o.k, means, sizes,{own} o.track_id, o.v, {sims} sims from rl join o on o.video_id = rl.video_id and o.k = rl.k + 1)))))"""


RELINK = f"with recursive {_relink('[0.5, 0.6, 0.7, 0.8, 0.9]', SAMPLED, apart=True)} select video_id, tau, track_id, cluster, round(sim, 3) sim, auto from rl where k > 0"
RELINK_REPORT = f"""with recursive {_relink('[0.5, 0.7, 0.9]')}, b as (select rl.*, gt_id from rl join t using (video_id, track_id) where k > 0),
c as (select tau, sum(n * (n - 1) / 2) pairs from (select tau, count(*) n from b group by tau, video_id, cluster) group by 1), g as (select tau, sum(n * (n - 1) / 2) pairs from (select tau, count(*) n from b group by tau, video_id, cluster, gt_id) group by 1)
select b.tau, round(any_value(case when c.pairs > 0 then g.pairs / c.pairs else 1 end), 9) pair_precision, round(count(*) filter (not auto) / count(distinct video_id)::double, 9) taps_per_video, round(avg(auto::int), 9) auto_share from b join c using (tau) join g using (tau) group by 1"""

FRAGMENTS = f"""with recursive {TRACKS}, s as (select t.video_id, t.track_id, t.frames, max(list_dot_product(t.v, r.v)) sim from t join t r on r.video_id = t.video_id and r.track_id < 10 group by all),
b as (select video_id, max(sim) best from s group by 1),
n as (select s.*, row_number() over (partition by video_id order by sim desc, track_id) k from s join b using (video_id) where sim >= best - {I.FRAGMENT}),
c as (select x.video_id, x.track_id, list(y.track_id) clash from n x join n y on x.video_id = y.video_id and x.track_id <> y.track_id and len(list_intersect(x.frames, y.frames)) > {I.OVERLAP} group by all),
g as (
  select video_id, 0::bigint k, []::bigint[] taken from b
  union all
  select g.video_id, n.k, case when list_has_any(taken, coalesce(clash, []::bigint[])) then taken else list_append(taken, n.track_id) end from g join n on n.video_id = g.video_id and n.k = g.k + 1 left join c on c.video_id = n.video_id and c.track_id = n.track_id),
f as (select video_id, taken tracks from g qualify row_number() over (partition by video_id order by k desc) = 1),
v as (select s.video_id, max(sim) rival from s join f using (video_id) where not list_contains(tracks, track_id) group by 1),
m as (select video_id, tracks[1] track, tracks, best, coalesce(round_even(best - rival, 4), 1.0) margin from f join b using (video_id) left join v using (video_id))
select video_id, track, tracks, round(best, 6) sim, margin, best >= {I.TAU_SIM} and margin >= {I.TAU_MARGIN} confident from m"""


def diverse(boxes: str, margin: str, k: int) -> str:
    """dv: of each owner's candidate cuts, in order, those that repeat none of the ones taken."""
    again = f"list_max(list_transform(taken, lambda y: case when y.v = c.video_id then {I.DUP_VIDEO} + {I.DUP_NEAR} * greatest(0.0::double, 1 - abs(c.frame_idx - y.f) / {I.DUP_FRAMES}::double) else 0 end))"
    return f"""with recursive {boxes[5:]}, bx as (select video_id, frame_idx, min(x) x, min(y) y from pr group by all), sx as (select * from (select *, row_number() over (partition by video_id order by frame_idx) - 1 i from bx) where i % 15 = 0),
mx as (select *, round_even(round(coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) / 30.0::double, 0), 9), 4) motion from sx window w as (partition by video_id order by frame_idx)),
cx as (select video_id, frame_idx, {margin}::double margin, motion, video_id % 2 as owner from (select *, row_number() over (partition by video_id order by motion desc, frame_idx) r from mx) where r <= 6),
c as (select *, row_number() over (partition by owner order by margin desc, motion desc, video_id, frame_idx) k from cx),
dv as (
  select distinct owner, 0::bigint k, []::struct(v bigint, f bigint)[] taken from cx
  union all
  select c.owner, c.k, case when len(taken) < {k} and coalesce({again}, 0) < {I.DUP_MAX} then list_append(taken, {{'v': c.video_id, 'f': c.frame_idx}}) else taken end from dv join c on c.owner = dv.owner and c.k = dv.k + 1),
dt as (select owner, unnest(taken, recursive := true), unnest(range(1, len(taken) + 1)) pick from (select * from dv qualify row_number() over (partition by owner order by k desc) = 1)),
dc as (select c.* exclude (k), pick from dt join c on c.owner = dt.owner and c.video_id = dt.v and c.frame_idx = dt.f)"""


def donor_reference(boxes: str) -> str:
    part = lambda v, n: f"list_transform({v}, lambda x: x / ({n} + {I.EPS}))"
    length = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"""{diverse(boxes, '1.0', 30)}, em as (select vec_id % 1000 frame_idx, vec_id % 10 video_id, arg_min(embedding::double[], vec_id) v from embeddings group by all),
un as (select owner, {part('v', length('v'))} v from dc join em using (video_id, frame_idx)),
mn as (select owner, list(m order by i) v from (select owner, i, avg(x) m from (select owner, unnest(v) x, unnest(range(1, len(v) + 1)) i from un) group by all) group by 1)
select owner, list_transform({part('v', length('v'))}, lambda x: round(x, 6)) v from mn"""


def _need(text: str) -> str:
    return f"greatest({MIN_SHOW}::double, length(trim({text})) / {READ_CPS})"


#: Windows are whole seconds here, so a second is free or not.
COPY_WINDOWS = f"""with {{curve}}, w as (select video_id, f::double s, f + 4.0 as e from c where f % 3 = 0), v as (select distinct video_id from c where f = 0),
u as (select video_id, i, (select count(*) from w where w.video_id = v.video_id and s <= i and e >= i + 1) < {L.CONCURRENT} open from v, (select unnest(range(0, 20)) i)),
g as (select video_id, min(i)::double lo, max(i) + 1.0 hi from (select *, i - row_number() over (partition by video_id order by i) run from u where open) group by video_id, run),
n as (select *, {_need("'폴짝!'")} need from g)
select video_id, lo "start", lo + least(hi - lo, need * {DWELL}) "end" from n where hi - lo + 1e-6 >= need qualify row_number() over (partition by video_id order by lo) = 1"""

#: One text after another: snapped to its peak if that can be, else in the first gap.
TEXT_SCHEDULE = f"""with recursive {{curve}}, x as (select video_id plan_id, f::int text_idx, f + 1 k, v - 8 * floor(v / 8) peak, {_need("'와!'")} need from c),
s as (
  select distinct video_id plan_id, 0::bigint k, []::struct(a double, b double)[] taken, null::int text_idx, null::struct(a double, b double) got from c
  union all
  select plan_id, k, case when got is null then taken else list_append(taken, got) end, text_idx, got from (
    select *, case when b0 - a0 + 1e-6 >= need and peak <= b0 + 1e-6 and len(list_filter(crowd, lambda z: least(z.b, b0) > greatest(z.a, a0))) = 0 then {{{{'a': a0, 'b': b0}}}}
      else list_transform(list_filter(gaps, lambda z: z.b - z.a + 1e-6 >= need), lambda z: {{{{'a': z.a, 'b': z.a + least(z.b - z.a, need * {DWELL})}}}})[1] end got from (
      select *, least(8.0::double, a0 + need * {DWELL}) b0, list_filter(list_transform(range(0, len(inner_) + 1), lambda i: {{{{'a': case when i = 0 then 0.0::double else inner_[i].b end, 'b': case when i = len(inner_) then 8.0::double else least(inner_[i + 1].a, 8.0::double) end}}}}), lambda z: z.b > z.a) gaps from (
        select *, list_filter(crowd, lambda z: z.b > 0 and z.a < 8) inner_ from (
          select *, greatest(0.0::double, least(peak, 8 - need)) a0, list_filter(list_transform(range(1, len(ends)), lambda i: {{{{'a': ends[i], 'b': ends[i + 1]}}}}), lambda z: len(list_filter(taken, lambda w: w.a <= z.a and z.b <= w.b)) >= {L.CONCURRENT}) crowd from (
            select x.plan_id, x.k, x.text_idx, x.peak, x.need, taken, list_sort(list_distinct(list_concat(list_transform(taken, lambda w: w.a), list_transform(taken, lambda w: w.b)))) ends from s join x on x.plan_id = s.plan_id and x.k = s.k + 1))))))
select plan_id, text_idx, round(got.a, 6) "start", round(got.b, 6) "end" from s where got is not null"""


def wrap(table: str, limit: float, advance: float) -> str:
    """Lines of the texts of ``table`` (doc_id, t) by a fold over their words, lines of one wide word cut evenly."""
    blank = " || ".join(f"chr({ord(c)})" for c in STRIPPED)
    longer = "trim(a.c || ' ' || b.c, z)"
    most = max(1, int(limit // advance))
    folded = f"list_reduce(list_transform(string_split(coalesce(t, ''), ' '), lambda w: {{'d': []::varchar[], 'c': w}}), lambda a, b: case when a.c <> '' and length({longer}) * {advance} > {limit} then {{'d': list_append(a.d, a.c), 'c': b.c}} else {{'d': a.d, 'c': {longer}}} end)"
    cut = f"list_transform(range(0, length(x), {most}), lambda i: substr(x, i + 1, {most}))"
    return f"with y as (select doc_id, {folded} r from {table}, (select {blank} z)) select doc_id, list_filter(flatten(list_transform(list_append(r.d, r.c), lambda x: {cut})), lambda x: x <> '') lines from y"


def compile_clips(world: str, segments: str) -> str:
    """Clips of three blocks, each from what the blocks before it left of its sources' pieces."""
    least = 0.6

    def step(i: int) -> str:
        used = " union all ".join(f"select plan_id, source, t0, t1 from d{j}" for j in range(i)) or "select plan_id, source, 0.0::double t0, 0.0::double t1 from aw where false"
        gap = "list_transform(range(0, len(u) + 1), lambda i: {'lo': case when i = 0 then lo else greatest(lo, u[i].e) end, 'hi': case when i = len(u) then hi else least(hi, u[i + 1].s) end})"
        return f"""us{i} as (select plan_id, source, list({{'s': t0, 'e': t1}} order by t0) u from ({used}) group by all),
ap{i} as (select aw.plan_id, aw.source, aw.src_ord, p.ord, lo, hi, list_filter(coalesce(u, []), lambda w: least(hi, w.e) > greatest(lo, w.s)) u from aw join blk using (plan_id, block_idx) join pc p on p.source = aw.source and p.sel = blk.sel and p.exempt = aw.exempt left join us{i} on us{i}.plan_id = aw.plan_id and us{i}.source = aw.source where block_idx = {i}),
rs{i} as (select plan_id, source, src_ord, ord, lo, hi from ap{i} where len(u) = 0 union all select plan_id, source, src_ord, ord, g.lo, g.hi from (select *, unnest({gap}) g from ap{i} where len(u) > 0) where g.hi - g.lo >= {least}),
cd{i} as (select plan_id, {i} block_idx, source, src_ord, lo t0, hi t1 from rs{i} qualify row_number() over (partition by plan_id, source order by lo - hi, ord, lo) = 1),
x{i} as (select cd{i}.*, t1 - t0 len, zoom, dur, case when pace = 'fast' then 2.0::double else 4.0::double end secs, count(*) over (partition by plan_id) n from cd{i} join blk using (plan_id, block_idx)),
y{i} as (select *, n = 1 or len >= least(1.5, coalesce(dur / n, secs)) seen from x{i}),
z{i} as (select * exclude (n), count(*) over (partition by plan_id) n, row_number() over (partition by plan_id order by len desc, src_ord) r from (select *, count(*) filter (seen) over (partition by plan_id) m from y{i}) where zoom = 'gradual' or seen or m = 0),
k{i} as (select *, coalesce(dur / n, secs) per, dur is not null and coalesce(dur / n, secs) < {least} cut, case when zoom = 'gradual' then 1 when dur is not null and coalesce(dur / n, secs) < {least} then greatest(1, floor(dur / {least}))::int end k from z{i}),
l{i} as (select *, least(len, case when zoom = 'gradual' then coalesce(dur, len) when cut then dur / least(k, n) else per end) take from k{i} where k is null or r <= k),
d{i} as materialized (select plan_id, block_idx, source, src_ord, round_even(t0, 2) t0, round_even(t0 + take, 2) t1 from l{i} where zoom = 'gradual' or take >= {least})"""

    return f"""with {world}, {segments},
blk as (select plan_id, block_idx, case n % 3 when 0 then 'dynamic' when 1 then 'static' else 'all' end sel, case when n % 7 = 0 then 'gradual' else 'none' end zoom, case when n % 2 = 0 then 'fast' else 'calm' end pace, case when n % 4 = 0 then (c % 9 + 1)::double end dur from b),
aw as materialized (select plan_id, block_idx, source, src_ord, exempt from (select *, max(reserved::int) over (partition by plan_id, source) o from bs) where reserved or o = 0),
pr(source, s, e) as (values ('s0', 0.0::double, 9.0::double), ('s0', 12.0, 30.0), ('s1', 2.0, 20.0)),
sg as (select 's' || video_id source, ord, (ord - 1) * 3.0::double s, ord * 3.0::double - ord % 3 e, "group" g, coalesce(uncertain, false) unsure from gs),
ki as (select distinct source, sel, exempt from aw join blk using (plan_id, block_idx)),
el as (select ki.*, ord, s, e, sg.source in ('s0', 's1') and not unsure part from ki join sg using (source) where (sel = 'all' or g = sel) and (not unsure or exempt)),
pc as materialized (select * from (select source, sel, exempt, ord, s lo, e hi from el where not part union all select el.source, sel, exempt, ord, greatest(el.s, pr.s), least(el.e, pr.e) from el join pr on pr.source = el.source where part) where hi - lo >= {least}),
{step(0)},
{step(1)},
{step(2)}
select plan_id, block_idx, source, src_ord, t0, t1 from d0 union all select plan_id, block_idx, source, src_ord, t0, t1 from d1 union all select plan_id, block_idx, source, src_ord, t0, t1 from d2"""
