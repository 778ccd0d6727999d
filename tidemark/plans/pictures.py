"""Queries on plans' fields and on places in the picture: columns that SQL can state one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import external, text
from tidemark.functions.geometry import box, rect
from tidemark.operators import layout, plan
from tidemark.plans import folds
from tidemark.plans import projections as P
from tidemark.plans.registry import query

W, H = 768, 432


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- plans as they come and with every field filled ----

_K = "k as (select p_partkey, p_name, p_type, p_size::bigint z, case when p_size % 2 = 0 then 'say ' || p_name else 'make a film' end request from part)"


def _raw_plans(spark, d):
    z = F.col("p_size")
    pick = lambda *x: F.element_at(F.array(*x), (z % len(x) + 1).cast("int"))
    null, kind = F.lit(None), "array<double>"
    span = pick(F.array(F.lit(-0.5), F.lit(0.7)), F.array(F.lit(0.5), F.lit(0.52)), F.array(F.lit(0.2)).cast(kind), null.cast(kind))
    block = F.struct(
        F.when(z % 2 == 0, F.col("p_type")).alias("caption"), F.when(z % 3 == 0, F.col("p_name")).alias("narration"), F.when(z % 7 == 0, 0.0).when(z % 7 > 1, z.cast("double")).alias("target_dur"),
        F.when(z % 6 == 0, 0.0).otherwise(z / 10.0).alias("speed"), pick(F.lit("top"), F.lit("nowhere"), F.lit("auto"), null).alias("caption_pos"), span.alias("caption_span"), F.when(z % 3 == 1, F.array(F.lit("a"))).alias("keywords"),
    )
    shout = F.struct(F.concat(F.lit("  hey "), z.cast("string")).alias("text"), F.when(z % 4 > 0, F.array(z.cast("int"), F.lit(-3))).alias("blocks"), F.lit("left").alias("pos"))
    p = P.spread(P.read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    j = F.to_json(F.struct(F.when(z % 4 > 0, F.col("p_name")).alias("title"), F.when(z % 5 > 0, F.array(block)).otherwise(F.array()).alias("blocks"), F.array(shout).alias("texts")))
    raw = F.from_json(j, f"title string, blocks array<struct<{plan.RAW_BLOCK.replace(', ', ',').replace(' ', ':')}>>, texts array<struct<{plan.RAW_TEXT.replace(', ', ',').replace(' ', ':')}>>")
    request = F.when(z % 2 == 0, F.concat(F.lit("say "), F.col("p_name"))).otherwise("make a film")
    return p.select("p_partkey", request.alias("request"), raw.alias("raw")).select("p_partkey", "request", plan.default_plan(F.col("raw.title"), F.col("raw.blocks"), F.col("raw.texts")).alias("plan"))


@query("default_plans", f"""with {_K}, b as (select *, z % 5 = 0 bare from k)
select p_partkey, case when z % 4 > 0 then p_name else '' end title, case when bare or z % 2 = 1 then '' else p_type end caption, case when bare or z % 3 > 0 then '' else p_name end narration, case when not bare and z % 7 > 1 then z::double end target_dur,
case when bare or z % 6 = 0 then 1.0::double else z / 10.0::double end speed, case when bare then 'bottom' else ['top', 'bottom', 'auto', 'bottom'][z % 4 + 1] end caption_pos, case when not bare and z % 4 = 0 then [0.0::double, 0.7::double] end caption_span,
case when z % 4 > 0 then 'hey ' || z end shout, case when z % 4 > 0 then 0 end from_block, case when z % 4 > 0 then z::int end to_block from b""")
def default_plans(spark, d):
    b, t = F.col("plan.blocks")[0], F.get("plan.texts", F.lit(0))
    fields = [b[c].alias(c) for c in ("caption", "narration", "target_dur", "speed", "caption_pos", "caption_span")]
    return _raw_plans(spark, d).select("p_partkey", "plan.title", *fields, t["text"].alias("shout"), F.get(t["blocks"], F.lit(0)).alias("from_block"), F.get(t["blocks"], F.lit(1)).alias("to_block"))


@query("plan_checks", f"""with {_K}, b as (select *, z % 5 = 0 bare from k), g as (select *, list_filter([case when bare or z % 3 <> 1 then 'sources' end, case when bare or z % 2 = 1 then 'caption' end, case when bare or z % 7 < 2 then 'dur' end], lambda x: x is not null) gaps from b)
select p_partkey, z % 4 = 0 and (bare or (z % 3 = 2 and z % 2 = 1 and z % 7 < 2 and (z % 6 = 0 or z = 10))) unstructured, not bare and z % 3 = 0 and not contains(request, p_name) invented,
case when len(gaps) > 0 then '블록0:' || array_to_string(gaps, '+') else '' end gaps from g""")
def plan_checks(spark, d):
    p = F.col("plan")
    return _raw_plans(spark, d).select("p_partkey", plan.is_unstructured(p).alias("unstructured"), plan.script_invented(p, F.col("request")).alias("invented"), F.array_join(plan.field_gaps(p, F.lit(False), F.lit(True)), ";").alias("gaps"))


@query("rewritten_captions", f"""with {_K}, f as (select *, case when z % 3 = 0 then 'fixed ' || z when z % 3 = 1 then p_type end fix from k)
select p_partkey plan_id, 0 block_idx, coalesce(fix, p_type) caption, case when z % 4 = 0 then coalesce(fix, p_type) when z % 4 = 1 then '' else 'told' end narration from f""")
def rewritten_captions(spark, d):
    z = F.col("p_size")
    p = P.read(spark, d, "part").select(F.col("p_partkey").alias("plan_id"), F.lit(0).alias("block_idx"), F.col("p_type").alias("caption"), F.when(z % 4 == 0, F.col("p_type")).when(z % 4 == 1, "").otherwise("told").alias("narration"), "p_size")
    fixes = p.where(z % 3 < 2).select("plan_id", "block_idx", F.when(z % 3 == 0, F.concat(F.lit("fixed "), z.cast("string"))).otherwise(F.col("caption")).alias("fix"))
    return plan.apply_rewrites(p.drop("p_size"), fixes, F.lit("make a film"))


@query("voice_rules", """with r as (select p_partkey, p_size z, case p_size % 3 when 0 then 'edit' when 1 then 'narration' end mode from part) select p_partkey, coalesce(mode = 'edit' and z % 2 = 0, case when mode is null and z % 2 = 0 then null else false end) allowed from r""")
def voice_rules(spark, d):
    z = F.col("p_size")
    mode = F.when(z % 3 == 0, "edit").when(z % 3 == 1, "narration")
    return P.read(spark, d, "part").select("p_partkey", text.voice_allowed(mode, z % 2 == 0, F.lit("make a film")).alias("allowed"))


# ---- places ----

_SIZE = layout.type_size(W, "copy")
_LINES = folds.wrap("(select p_partkey doc_id, p_name t from part)", 200.0, 0.55 * _SIZE)
_FOOT = float(max(30, H // 12))


@query("text_rects", f"""with l as ({_LINES}), m as (select doc_id p_partkey, {list(plan.POSITIONS)}[doc_id % 8 + 1] pos, list_max(list_transform(lines, lambda x: length(x))) * {0.55 * _SIZE} bw, len(lines) * {float(_SIZE)} + (len(lines) - 1) * {float(_SIZE) // 4} bh from l),
o as (select *, case pos when 'left' then {W * 0.28} when 'right' then {W * 0.72} else {W / 2} end cx, case pos when 'top' then {H * 0.20 + _SIZE / 2} when 'bottom' then {H - _FOOT - _SIZE / 2} else {H / 2} end cy from m),
x as (select *, case when not contains(pos, '-') then least(greatest(cx - bw / 2, 24), {W - 24} - bw) when pos like '%left' then {W * 0.05} else {W * 0.95} - bw end x, case when not contains(pos, '-') then cy - bh / 2 when pos = 'top-right' then {H * 0.18} when pos = 'top-left' then {H * 0.10} else {H - _FOOT} - bh end y from o)
select p_partkey, pos, round(x - 18, 6) x1, round(y - 14, 6) y1, round(x + bw + 18, 6) x2, round(y + bh + 14 + 4, 6) y2 from x""")
def text_rects(spark, d):
    lines = text.wrap_lines(F.col("p_name"), 200.0, 0.55 * _SIZE)
    pos = F.element_at(F.array(*map(F.lit, plan.POSITIONS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = P.read(spark, d, "part").select("p_partkey", pos.alias("pos"), lines.alias("lines"))
    return _rounded(p.select("p_partkey", "pos", layout.text_rect(F.col("pos"), W, H, F.col("lines"), 0.55 * _SIZE, float(_SIZE)).alias("r")).select("p_partkey", "pos", "r.*"), "x1", "y1", "x2", "y2")


@query("subject_side", f"""with {P.GT_SQL}, {P.PRED_SQL}, m as (select video_id, frame_idx % 10 as part, quantile_cont(x, 0.5) x1, quantile_cont(y, 0.5) y1, quantile_cont(x + 30, 0.5) x2, quantile_cont(y + 30, 0.5) y2 from pr where pk % 3 = 0 group by all),
s as (select *, {W - (W * 0.03 + 24)} - x2 r, x1 - {W * 0.03 + 24} l from m)
select video_id, part, case when r >= l then 'right' else 'left' end side, round(greatest(r, l), 6) room, round(y1 + 0.35 * (y2 - y1), 6) face_y, round(x1, 6) x1, round(x2, 6) x2 from s where greatest(r, l) >= {W * 0.2}""")
def subject_side(spark, d):
    b = P.pred_boxes(spark, d).where("pk % 3 = 0").select("video_id", (F.col("frame_idx") % 10).alias("part"), rect(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("r"))
    return _rounded(layout.beside_subject(b, ["video_id", "part"], W), "room", "face_y", "x1", "x2")


@query("zoom_path", """with b as (select p_partkey, p_size::int n, (p_partkey * 37 % 1000)::double x, (p_partkey * 53 % 600)::double y, 50.0::double + p_size * 10 w, 60.0::double + p_size * 15 h from part),
t as (select *, least(1080, h * 1.5 * 1.4) tall from b), u as (select *, tall * 1920 / 1080 wide from t), e as (select *, case when wide > 1920 then 1920 else wide end ew, case when wide > 1920 then 1920 * 1080 / 1920.0::double else tall end eh, (x + w / 2) * 1.5 px, (y + 0.35 * h) * 1.5 py from u),
c as (select *, least(greatest(px, ew / 2), 1920 - ew / 2) cx, least(greatest(py, eh / 2), 1080 - eh / 2) cy from e), f as (select *, unnest(range(0, n)) i from c), a as (select *, i / greatest(n - 1, 1)::double q from f), s as (select *, q * q * (3 - 2 * q) k from a)
select p_partkey, i::int i, round(1920 + (ew - 1920) * k, 9) zw, round(1080 + (eh - 1080) * k, 9) zh, round(960 + (cx - 960) * k, 9) zx, round(540 + (cy - 540) * k, 9) zy from s""")
def zoom_path(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    b = box((k * 37 % 1000).cast("double"), (k * 53 % 600).cast("double"), 50.0 + z * 10, 60.0 + z * 15)
    w, h = F.lit(1920.0), F.lit(1080.0)
    clips = P.read(spark, d, "part").select("p_partkey", z.cast("int").alias("n"), w.alias("w"), h.alias("h"), layout.zoom_target(b, F.lit(1.5), w, h).alias("t")).select("p_partkey", "n", "w", "h", "t.*")
    return _rounded(layout.zoom_frames(clips).select("p_partkey", "i", "zw", "zh", "zx", "zy"), "zw", "zh", "zx", "zy", digits=9)


@query("source_sizes", """select c_custkey video_id, case when c_custkey % 3 = 0 then 1 + c_nationkey / 10.0::double else 1.0::double end scale, case when c_custkey % 3 = 0 then 3840 when c_custkey % 3 = 1 then c_nationkey::int * 10 end src_w, case when c_custkey % 3 = 0 then 2160 when c_custkey % 3 = 1 then c_nationkey::int * 5 end src_h from customer""")
def source_sizes(spark, d):
    c = P.read(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").cast("int").alias("n"))
    k = F.col("video_id") % 3
    maps = c.where(k == 0).select("video_id", (1 + F.col("n") / 10.0).alias("scale"), F.lit(3840).alias("src_w"), F.lit(2160).alias("src_h"))
    return layout.source_map(c, maps, c.where(k < 2).select("video_id", (F.col("n") * 10).alias("w"), (F.col("n") * 5).alias("h")))


@query("text_windows", f"""with k as (select p_partkey, p_size::double w0, p_size + (p_partkey % 7)::double w1, [[0.2::double, 0.5::double], [0.0::double, 1.0::double], null][p_partkey % 3 + 1] span, greatest({text.MIN_SHOW}::double, length(trim(p_name)) / {text.READ_CPS}) need from part),
s as (select *, coalesce(w0 + (w1 - w0) * span[1], w0) a, coalesce(w0 + (w1 - w0) * span[2], w1) b from k)
select p_partkey, round(case when b - a + 1e-6 >= need then a when w1 - w0 + 1e-6 >= need then w0 end, 6) "start", round(case when b - a + 1e-6 >= need then b when w1 - w0 + 1e-6 >= need then w1 end, 6) "end" from s""")
def text_windows(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size").cast("double")
    span = F.element_at(F.array(F.array(F.lit(0.2), F.lit(0.5)), F.array(F.lit(0.0), F.lit(1.0)), F.lit(None).cast("array<double>")), (k % 3 + 1).cast("int"))
    got = layout.resolve_window(z, z + (k % 7).cast("double"), span, text.required_secs(F.col("p_name")))
    return _rounded(P.read(spark, d, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.*"), "start", "end")


@query("merged_tags", "select distinct user_id video_id, event_type tag from events union select user_id, 'tag' || event_id % 5 from events where user_id % 4 <> 0")
def merged_tags(spark, d):
    e = P.read(spark, d, "events").withColumn("video_id", F.col("user_id"))
    answers = e.select("video_id", F.concat(F.lit("tag"), (F.col("event_id") % 5).cast("string")).alias("tag"))
    return external.merge_answers(e.select("video_id", F.col("event_type").alias("tag")), answers, e.where("user_id % 4 = 0"))
