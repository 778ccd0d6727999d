"""Queries on edit lists: clips from order lines, blocks with crossfades and speeds, points through the map both ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import MIN_SHOW, READ_CPS, TITLE_DWELL
from tidemark.operators import editlist as E
from tidemark.plans import projections as P
from tidemark.plans.registry import query

_EDITS = f"""with c as (select l_orderkey plan_id, ((l_linenumber - 1) // 3)::int block_idx, l_linenumber::int clip_ord, 's' || min(l_suppkey) % 6 source, min(l_quantity)::double t0, min(l_quantity)::double + 0.6::double + (min(l_partkey) % 40) / 10.0::double t1 from lineitem group by l_orderkey, l_linenumber),
b as (select distinct plan_id, block_idx, case (plan_id + block_idx) % 3 when 0 then 'xfade' when 1 then 'cut' end transition, coalesce([1.0, 1.25, 0.5, null][plan_id % 4 + 1], 1.0)::double speed from c),
f as (select c.*, speed, case when transition = 'xfade' and row_number() over (partition by plan_id, block_idx order by clip_ord) > 1 then {E.CROSSFADE}::double else 0 end fade from c join b using (plan_id, block_idx)),
g as (select *, sum(t1 - t0 - fade) over (partition by plan_id, block_idx order by clip_ord) e from f),
tl as (select plan_id, block_idx, coalesce(sum(n) over (partition by plan_id order by block_idx rows between unbounded preceding and 1 preceding), 0) s, n from (select plan_id, block_idx, max(e) / any_value(speed) n from g group by all)),
ed as (select plan_id, block_idx, clip_ord, source, t0, t1, fade, speed, s + (e - (t1 - t0)) / speed out_start, s + e / speed out_end from g join tl using (plan_id, block_idx))"""


def _world(spark, d):
    """(clips, blocks)."""
    c = P.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("block_idx"), F.col("l_linenumber").cast("int").alias("clip_ord"))
    c = c.agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("double").alias("t0"), F.min("l_partkey").alias("p"))
    c = c.select("plan_id", "block_idx", "clip_ord", F.concat(F.lit("s"), (F.col("s") % 6).cast("string")).alias("source"), "t0", (F.col("t0") + 0.6 + F.col("p") % 40 / 10.0).alias("t1"))
    n = (F.col("plan_id") + F.col("block_idx")) % 3
    speed = F.element_at(F.array(F.lit(1.0), F.lit(1.25), F.lit(0.5), F.lit(None).cast("double")), (F.col("plan_id") % 4 + 1).cast("int"))
    b = c.select("plan_id", "block_idx").distinct().select("plan_id", "block_idx", F.when(n == 0, "xfade").when(n == 1, "cut").alias("transition"), speed.alias("speed"))
    return c, b


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("edit_list", f"{_EDITS} select plan_id, block_idx, clip_ord, source, round(t0, 6) t0, round(t1, 6) t1, fade, speed, round(out_start, 6) out_start, round(out_end, 6) out_end from ed")
def edit_list(spark, d):
    return _rounded(E.edit_list(*_world(spark, d)), "t0", "t1", "out_start", "out_end")


@query("time_map_output", f"{_EDITS}, p as (select plan_id, source, clip_ord as point, t0 + (t1 - t0) / 4 t from c) select p.plan_id, p.source, point, round(t, 6) t, block_idx, clip_ord, round(out_start + (t - t0) / speed, 6) as \"at\" from p join ed on ed.plan_id = p.plan_id and ed.source = p.source and t >= t0 and t < t1")
def time_map_output(spark, d):
    clips, blocks = _world(spark, d)
    points = clips.select("plan_id", "source", F.col("clip_ord").alias("point"), (F.col("t0") + (F.col("t1") - F.col("t0")) / 4).alias("t"))
    return _rounded(E.to_output(points, E.edit_list(clips, blocks)), "t", "at")


@query("time_map_source", f"""{_EDITS}, p as (select plan_id, unnest(range(0, floor(max(out_end))::int + 1)) + 0.0137::double x from ed group by 1), w as (select *, coalesce(lead(fade) over (partition by plan_id, block_idx order by clip_ord), 0) later from ed)
select p.plan_id, round(x, 6) as "at", block_idx, clip_ord, source, round(t0 + (x - out_start) * speed, 6) t, round(least(case when fade > 0 then least((x - out_start) * speed / fade, 1) else 1 end, case when later > 0 then least((out_end - x) * speed / later, 1) else 1 end), 6) share
from p join w on w.plan_id = p.plan_id and x >= out_start and x < out_end""")
def time_map_source(spark, d):
    edits = E.edit_list(*_world(spark, d))
    last = edits.groupBy("plan_id").agg(F.max("out_end").alias("m"))
    points = last.select("plan_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor("m"))).alias("k")).select("plan_id", (F.col("k") + 0.0137).alias("at"))
    return _rounded(E.to_source(points, edits), "at", "t", "share")


def _need(text: str) -> str:
    return f"greatest({MIN_SHOW}::double, length(trim({text})) / {READ_CPS})"


@query("edit_overlays", f"""{_EDITS}, whole as (select plan_id, max(out_end) total from ed group by 1),
bt as (select plan_id, block_idx, min(out_start) s, max(out_end) e from ed group by all),
cp as (select plan_id, block_idx, 'block ' || block_idx || ' of the plan ' || plan_id caption, case block_idx when 0 then 'auto' when 1 then 'left' end pos, case when plan_id % 3 = 0 then [0.25::double, 0.5::double] end span, s, e from bt where (plan_id + block_idx) % 4 > 0),
o as (
  select plan_id, 'title' kind, null::int block_idx, 'Plan ' || plan_id as text, 'top' pos, 0.0::double s, least(total, {_need("'Plan ' || plan_id")} * {TITLE_DWELL}) e from whole where plan_id % 5 > 0
  union all select plan_id, 'caption', block_idx, caption, case when pos = 'left' then pos else 'bottom' end, s + coalesce(span[1], 0) * (e - s), s + coalesce(span[2], 1) * (e - s) from cp
  union all select plan_id, 'badge', null, '{E.BADGE}', 'top-right', 0, total from whole
  union all select plan_id, 'notice', null, '{E.NOTICE}', 'top-right', 0, total from whole where plan_id % 2 = 0)
select plan_id, kind, block_idx, text, pos, round(s, 6) "start", round(e, 6) "end", round(case when kind in ('badge', 'notice') or least({E.TEXT_FADE}, (e - s) / 4) < {E.LEAST_FADE} then 0 else least({E.TEXT_FADE}, (e - s) / 4) end, 6) fade, kind = 'caption' and e - s > 0 and e - s < {_need('text')} hurried from o""")
def edit_overlays(spark, d):
    clips, blocks = _world(spark, d)
    edits = E.edit_list(clips, blocks)
    p, b = F.col("plan_id"), F.col("block_idx")
    said = F.concat(F.lit("block "), b.cast("string"), F.lit(" of the plan "), p.cast("string"))
    span = F.when(p % 3 == 0, F.array(F.lit(0.25), F.lit(0.5)))
    captions = blocks.select("plan_id", "block_idx", F.when((p + b) % 4 > 0, said).otherwise("").alias("caption"), F.when(b == 0, "auto").when(b == 1, "left").alias("caption_pos"), span.alias("caption_span"))
    plans = blocks.select("plan_id").distinct().select("plan_id", F.when(p % 5 > 0, F.concat(F.lit("Plan "), p.cast("string"))).alias("title"), (p % 2 == 0).alias("voice"))
    return _rounded(E.overlays(plans, captions, edits), "start", "end", "fade")
