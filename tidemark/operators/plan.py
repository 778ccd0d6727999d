"""Edit plans: cleaning what an author wrote, choosing sources, and compiling blocks into clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import clean_text, let
from tidemark.operators.segments import SELECT_TRICK, is_trick
from tidemark.operators.timeline import clip, subtract
from tidemark.session import discard, materialize

# Fixed values.
POSITIONS = ("top", "bottom", "left", "right", "top-left", "top-right", "bottom-left", "bottom-right")
AUTO = "auto"
MAX_BLOCKS, MAX_TEXTS, DUR_MIN, DUR_MAX, SHOUT_CHARS, MIN_SPAN = 6, 2, 2.0, 12.0, 8, 0.05
TRICK_CONF, MIN_SHOW, MIN_CLIP = 0.6, 1.5, 0.6
PACE = {"fast": 2.0, "calm": 4.0}

RAW_BLOCK = "select string, target_dur double, pace string, transition string, subject string, zoom string, speed double, caption string, caption_pos string, caption_span array<double>, keywords array<string>, scene string, narration string, sources array<string>"
RAW_TEXT = "text string, blocks array<int>, pos string, span array<double>"


def clean_span(v: Column) -> Column:
    """[start, end] within 0..1, or null unless there are two numbers at least 0.05 apart in order."""
    a, b = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(v, F.lit(i)))) for i in (0, 1))
    ok = (F.size(v) == 2) & F.get(v, F.lit(0)).isNotNull() & F.get(v, F.lit(1)).isNotNull()
    return F.when(ok & (b - a >= MIN_SPAN), F.array(a, b))


def default_block(b: Column, **given: Column) -> Column:
    """A block with every field filled: empty strings and zero numbers count as absent. ``given`` fields are taken in
    place of the block's own."""
    own = lambda n: given[n] if n in given else b[n]
    text = lambda n: F.coalesce(own(n), F.lit("")).alias(n)
    word = lambda n, d: F.coalesce(own(n), F.lit(d)).alias(n)
    array = lambda n: F.coalesce(own(n), F.array().cast("array<string>")).alias(n)
    dur, speed, pos = own("target_dur"), own("speed"), own("caption_pos")
    return F.struct(
        word("select", "all"), F.when(dur != 0, dur).alias("target_dur"), word("pace", "fast"), word("transition", "cut"), word("subject", "full"), word("zoom", "none"),
        F.coalesce(F.when(speed != 0, speed), F.lit(1.0)).alias("speed"), text("caption"), F.when(pos.isin(*POSITIONS, AUTO), pos).otherwise("bottom").alias("caption_pos"),
        (given["caption_span"] if "caption_span" in given else clean_span(b["caption_span"])).alias("caption_span"), array("keywords"), text("scene"), text("narration"), array("sources"),
    )


def default_text(t: Column, text: Column | None = None) -> Column:
    """A text over blocks [from, to]: both ends at least 0 and in order; an unknown position is auto."""
    two = F.transform(F.slice(t["blocks"], 1, 2), lambda i: F.greatest(i, F.lit(0)))
    return F.struct(
        F.trim(F.coalesce(t["text"] if text is None else text, F.lit(""))).alias("text"),
        F.when(F.size(t["blocks"]) > 0, let(two, lambda x: F.array(F.array_min(x), F.array_max(x)))).alias("blocks"),
        F.when(t["pos"].isin(*POSITIONS), t["pos"]).otherwise(AUTO).alias("pos"),
        clean_span(t["span"]).alias("span"),
    )


def default_plan(title: Column, blocks: Column, texts: Column) -> Column:
    """A whole plan: one default block if there is none; texts without words or blocks are left out."""
    none = F.from_json(F.lit("{}"), RAW_BLOCK)
    b = F.transform(F.when(F.size(blocks) > 0, blocks).otherwise(F.array(none)), lambda x: default_block(x))
    t = F.filter(F.transform(F.coalesce(texts, F.array().cast(f"array<struct<{RAW_TEXT.replace(' ', ':').replace(',:', ',')}>>")), lambda x: default_text(x)), lambda x: (F.length(x["text"]) > 0) & x["blocks"].isNotNull())
    return F.struct(F.coalesce(title, F.lit("")).alias("title"), b.alias("blocks"), t.alias("texts"))


def is_unstructured(plan: Column) -> Column:
    """Whether a plan says nothing: one block, no title, every field at its default."""
    b = plan["blocks"][0]
    bare = (F.size(b["keywords"]) == 0) & (b["caption"] == "") & (b["narration"] == "") & b["target_dur"].isNull() & (b["zoom"] == "none") & (b["speed"] == 1.0) & (b["select"] == "all")
    return (F.size(plan["blocks"]) == 1) & (plan["title"] == "") & bare


def script_invented(plan: Column, request: Column) -> Column:
    """Whether there is narration and none of it stands in the request."""
    said = F.filter(F.transform(plan["blocks"], lambda b: b["narration"]), lambda n: F.length(F.trim(n)) > 0)
    return (F.size(said) > 0) & ~F.exists(said, lambda n: F.contains(request, n))


def field_gaps(plan: Column, narration: Column, captions: Column) -> Column:
    """For each block that lacks something, ``블록i:a+b``."""

    def lacks(b, i):
        miss = lambda c, name: F.when(c, F.lit(name))
        names = F.array_compact(F.array(
            miss((F.size(b["keywords"]) == 0) & (F.size(b["sources"]) == 0), "sources"),
            miss(~narration & captions & (b["caption"] == ""), "caption"),
            miss(~narration & b["target_dur"].isNull(), "dur"),
        ))
        return F.when(F.size(names) > 0, F.concat(F.lit("블록"), i.cast("string"), F.lit(":"), F.array_join(names, "+")))

    return F.array_compact(F.transform(plan["blocks"], lacks))


BLOCK_FIELDS = ("select", "target_dur", "pace", "transition", "subject", "zoom", "speed", "caption", "caption_pos", "caption_span", "keywords", "scene", "narration", "sources")


def _replaced(b: Column, names: tuple[str, ...] = BLOCK_FIELDS, **fields) -> Column:
    return F.struct(*[fields.get(n, b[n]).alias(n) for n in names])


def authored_plan(raw: Column, request: Column, avail: Column, narration: Column, captions: Column, voice_choice: Column) -> Column:
    """What an author wrote (title, voice, blocks, texts), cleaned, or null if it is no plan.

    At most six blocks; sources only from ``avail``, each once; lengths within 2..12 s; no change of speed; a
    zoom means the subject; blocks that say nothing are dropped. Copies of the request are removed from texts.
    A voice reads every caption or none, and a caption that is read stays for its whole block. Of the first two
    texts those stay that have words, begin at a block there is and count at most eight characters; with a
    voice, one. A plan without any text is none, unless captions weren't wanted.
    """
    return let(raw, lambda r: _authored(r, request, avail, narration, captions, voice_choice))


def _authored(raw: Column, request: Column, avail: Column, narration: Column, captions: Column, voice_choice: Column) -> Column:
    """:func:`authored_plan` of an answer that is already read: each use of ``raw`` would read it again."""
    empty, words = F.lit(""), F.array().cast("array<string>")

    def block(b):
        dur = F.coalesce(b["target_dur"], F.lit(0.0))
        return default_block(
            b, sources=F.filter(F.array_distinct(F.coalesce(b["sources"], words)), lambda s: F.array_contains(avail, s)), target_dur=F.when(dur > 0, F.least(F.greatest(dur, F.lit(DUR_MIN)), F.lit(DUR_MAX))),
            caption=F.when(captions, clean_text(b["caption"], request)).otherwise(empty), narration=F.when(narration, clean_text(b["narration"], request)).otherwise(empty),
            speed=F.lit(1.0), caption_pos=F.lit("bottom"), keywords=words, pace=F.lit("fast"), transition=F.lit("cut"), subject=F.when(b["zoom"] == "gradual", "foster").otherwise("full"), scene=empty,
        )

    voiced = voice_choice & F.coalesce(raw["voice"], F.lit(False))

    def speak(b):
        read = voiced & (b["caption"] != "")
        whole = read | ((b["narration"] != "") & (b["narration"] == b["caption"]))
        return _replaced(b, narration=F.when(read, b["caption"]).otherwise(b["narration"]), caption_span=F.when(~whole, b["caption_span"]))

    def says(b):
        return (F.size(b["sources"]) > 0) | (b["select"] != "all") | (b["caption"] != "") | (b["narration"] != "")

    first = F.slice(F.coalesce(raw["texts"], F.array().cast("array<struct<text:string,blocks:array<int>,pos:string,span:array<double>>>")), 1, MAX_TEXTS)

    def finish(blocks):
        last = F.size(blocks) - 1
        begun = F.filter(first, lambda t: F.array_min(F.slice(t["blocks"], 1, 2)) <= last)
        texts = F.transform(F.transform(begun, lambda t: default_text(t, clean_text(t["text"], request))), lambda t: _replaced(t, ("text", "blocks", "pos", "span"), pos=F.lit(AUTO), blocks=F.transform(t["blocks"], lambda i: F.least(i, last))))
        short = F.filter(texts, lambda t: (F.length(t["text"]) > 0) & t["blocks"].isNotNull() & (F.length(F.replace(t["text"], F.lit(" "), empty)) <= SHOUT_CHARS))
        spoken = voice_choice & F.exists(blocks, lambda b: b["narration"] != "")
        kept = F.slice(short, F.lit(1), F.when(~captions, 0).when(spoken, 1).otherwise(MAX_TEXTS))
        return let(kept, lambda t: whole_plan(blocks, t))

    def whole_plan(blocks, texts):
        said = F.exists(blocks, lambda b: (b["caption"] != "") | (b["narration"] != "")) | (F.size(texts) > 0)
        plan = F.struct(clean_text(raw["title"], request).alias("title"), blocks.alias("blocks"), texts.alias("texts"))
        return F.when((F.size(blocks) > 0) & (~captions | said), plan)

    cleaned = F.filter(F.transform(F.slice(F.coalesce(raw["blocks"], F.array().cast(raw_array())), 1, MAX_BLOCKS), block), says)
    return let(F.transform(cleaned, speak), finish)


def _listed(v: Column, kind: str) -> Column:
    """A VARIANT that should be an array: one value alone is an array of it, anything else null."""
    return F.coalesce(F.try_variant_get(v, "$", f"array<{kind}>"), let(F.try_variant_get(v, "$", kind), lambda x: F.when(x.isNotNull(), F.array(x))))


def raw_plan(answer: Column) -> Column:
    """What an author's answer (JSON text) holds, as :func:`authored_plan` reads it, from a VARIANT.

    Answers vary: a number may come as text, one source or block without its list, and fields that nobody knows. Each
    field is taken if it can be read as what it should be and is null otherwise, so one odd field costs nothing but
    itself. Text that isn't JSON, or no object, gives a plan with nothing in it.

    An answer is parsed once and read in one go; only what may stand without its list stays a VARIANT in that.
    """
    each = lambda fields: [f.split(" ") for f in fields.split(", ")]
    kept = lambda fields, lists: ",".join(f"`{n}`:{'variant' if n in lists else k}" for n, k in each(fields))
    of_block, of_text = ("sources", "keywords", "caption_span"), ("blocks", "span")
    kind = f"struct<title:string,voice:boolean,blocks:array<struct<{kept(RAW_BLOCK, of_block)}>>,texts:array<struct<{kept(RAW_TEXT, of_text)}>>>"

    def rows(x, fields: str, lists: tuple[str, ...]):
        return F.transform(x, lambda r: F.struct(*[(_listed(r[n], k[6:-1]) if n in lists else r[n]).alias(n) for n, k in each(fields)]))

    def read(v):
        return F.struct(v["title"].alias("title"), v["voice"].alias("voice"), rows(v["blocks"], RAW_BLOCK, of_block).alias("blocks"), rows(v["texts"], RAW_TEXT, of_text).alias("texts"))

    return let(F.try_variant_get(F.try_parse_json(answer), "$", kind), read)


def raw_array() -> str:
    """Type of an author's blocks."""
    return f"array<struct<{RAW_BLOCK.replace(', ', ',').replace(' ', ':')}>>"


def fill_gaps(user: Column, author: Column, request: Column, avail: Column, narration: Column, captions: Column) -> Column:
    """The user's blocks with empty slots filled from the author's block of the same position; what the user gave stays."""

    def fill(b, a):
        free = (F.size(b["keywords"]) == 0) & (F.size(b["sources"]) == 0)
        offered = F.filter(F.array_distinct(F.coalesce(a["sources"], F.array().cast("array<string>"))), lambda s: F.array_contains(avail, s))
        words = clean_text(a["caption"], request)
        write = ~narration & captions & (b["caption"] == "") & (words != "")
        dur = F.when(a["target_dur"] > 0, F.least(F.greatest(a["target_dur"], F.lit(DUR_MIN)), F.lit(DUR_MAX)))
        filled = _replaced(
            b, sources=F.when(free, offered).otherwise(b["sources"]), caption=F.when(write, words).otherwise(b["caption"]), caption_span=F.when(write, clean_span(a["caption_span"])).otherwise(b["caption_span"]),
            target_dur=F.when(narration, b["target_dur"]).otherwise(F.coalesce(b["target_dur"], dur)),
        )
        return F.when(a.isNull(), b).otherwise(filled)

    padded = F.transform(user, lambda b, i: F.struct(b.alias("b"), F.get(author, i).alias("a")))
    return F.transform(padded, lambda x: fill(x["b"], x["a"]))


def apply_rewrites(blocks: DataFrame, fixes: DataFrame, request: Column, field: str = "caption") -> DataFrame:
    """Blocks (plan_id, block_idx, caption, narration) with the fixes' (plan_id, block_idx, fix) cleaned words in place;
    empty or equal ones change nothing, and narration that read the old caption reads the new one."""
    j = blocks.join(fixes, ["plan_id", "block_idx"], "left").withColumn("_new", clean_text(F.col("fix"), request))
    use = F.coalesce((F.col("_new") != "") & (F.col("_new") != F.col(field)), F.lit(False))
    if field == "caption":
        follows = use & (F.col("narration") != "") & (F.col("narration") == F.col("caption"))
        j = j.withColumn("narration", F.when(follows, F.col("_new")).otherwise(F.col("narration")))
    return j.withColumn(field, F.when(use, F.col("_new")).otherwise(F.col(field))).select(blocks.columns)


def attribute_directives(sentences: DataFrame, requests: DataFrame) -> DataFrame:
    """Lengths ("5초") and close-ups of a request, each given to the sentence that stands nearest to it: per sentence
    (plan_id, block_idx) ``target_dur`` of the first length given to it and ``zoom``.

    Only sentences that stand in the request count; on equal distance the first sentence.
    """
    s = sentences.join(requests, "plan_id").withColumn("pos", F.expr("locate(sentence, request)") - 1).where("pos >= 0 and length(sentence) > 0")

    def places(pattern):
        parts = F.split("request", pattern)
        found = F.regexp_extract_all("request", F.lit(f"({pattern})"), F.lit(1))
        at = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(found, 1, i - 1), F.lit(0), lambda n, x: n + F.length(x)))
        return F.when(F.size(found) > 0, F.arrays_zip(at.alias("at"), found.alias("word")))

    def given(pattern, kind):
        d = requests.select("plan_id", F.explode(places(pattern)).alias("d")).select("plan_id", F.col("d.at").alias("at"), F.col("d.word").alias("word"), F.lit(kind).alias("kind"))
        near = d.join(s.select("plan_id", "block_idx", "pos"), "plan_id")
        return near.groupBy("plan_id", "at", "word", "kind").agg(F.min_by("block_idx", F.struct(F.abs(F.col("pos") - F.col("at")), "block_idx")).alias("block_idx"))

    both = given(r"\d+(?:\.\d+)?\s*초", "dur").unionByName(given(r"클로즈\s*업", "zoom"))
    secs = F.regexp_extract("word", r"(\d+(?:\.\d+)?)", 1).cast("double")
    got = both.groupBy("plan_id", "block_idx").agg(F.min_by(F.when(F.col("kind") == "dur", secs), F.when(F.col("kind") == "dur", F.col("at"))).alias("target_dur"), F.max(F.when(F.col("kind") == "zoom", F.lit("gradual"))).alias("zoom"))
    return sentences.select("plan_id", "block_idx").join(got, ["plan_id", "block_idx"], "left").withColumn("zoom", F.coalesce("zoom", F.lit("none")))


def block_sources(blocks: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """Sources of each block: (plan_id, block_idx, source, src_ord, exempt, reserved).

    ``blocks`` has plan_id, block_idx, sources, keywords; ``sources`` plan_id, source, src_ord; ``tags`` source, tag. Named
    sources that exist are taken and reserved. Otherwise keywords pick the sources with a tag that holds the
    keyword or stands in it: picked sources are reserved and exempt from the uncertainty rule, and if every
    keyword picks some, only picked ones are taken, else all.
    """
    return _held_sources(blocks, sources, tags).select("plan_id", "block_idx", F.inline("_a"))


def _held_sources(blocks: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows of :func:`block_sources` as an array ``_a`` a block, in order of plans."""
    words = F.array().cast("array<string>")
    tagged = sources.join(tags.groupBy("source").agg(F.collect_set("tag").alias("tags")), "source", "left")
    held = tagged.groupBy("plan_id").agg(F.collect_list(F.struct("source", "src_ord", F.coalesce("tags", words).alias("tags"))).alias("_s"))
    # a plan's sources are few, and one exchange by plan takes the place of a join for each rule; neither side is
    # broadcast, as it is larger than the estimate from its table
    j = blocks.select("plan_id", "block_idx", F.coalesce("sources", words).alias("_n"), F.array_distinct(F.filter(F.coalesce("keywords", words), lambda k: F.length(k) > 0)).alias("_k")).hint("merge").join(held, "plan_id")
    meets = lambda k, t: F.contains(k, t) | F.contains(t, k)
    pins = lambda k, s: F.exists(s["tags"], lambda t: meets(k, t))
    j = j.withColumn("_named", F.filter("_s", lambda s: F.array_contains("_n", s["source"])))
    j = j.withColumn("_found", F.size(F.filter("_k", lambda k: F.exists("_s", lambda s: pins(k, s)))))
    row = lambda s, exempt, reserved: F.struct(s["source"].alias("source"), s["src_ord"].alias("src_ord"), exempt.alias("exempt"), reserved.alias("reserved"))
    by_name = F.transform("_named", lambda s: row(s, F.lit(False), F.lit(True)))
    each = F.transform("_s", lambda s: let(F.exists("_k", lambda k: pins(k, s)), lambda pin: row(s, pin, pin)))
    by_word = F.filter(each, lambda x: x["reserved"] | (F.size("_k") == 0) | (F.size("_k") != F.col("_found")))
    return j.select("plan_id", "block_idx", F.when(F.size("_named") > 0, by_name).otherwise(by_word).alias("_a"))


def allowed_sources(blocks: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """:func:`reserve` of :func:`block_sources`, plan by plan while each block's sources are still an array: the join by plan
    has sorted them, so nothing is sorted or shuffled again."""
    own = F.transform(F.filter("_a", lambda x: x["reserved"]), lambda x: x["source"])
    j = _held_sources(blocks, sources, tags).withColumn("_o", F.array_distinct(F.flatten(F.collect_list(own).over(Window.partitionBy("plan_id")))))
    return j.select("plan_id", "block_idx", F.inline(F.filter("_a", lambda x: x["reserved"] | ~F.exists("_o", lambda o: o.eqNullSafe(x["source"])))))


def reserve(allowed: DataFrame) -> DataFrame:
    """Without the sources that another block of the plan reserved and this one didn't."""
    owned = F.max(F.col("reserved").cast("int")).over(Window.partitionBy("plan_id", "source"))
    return allowed.withColumn("_o", owned).where(F.col("reserved") | (F.col("_o") == 0)).drop("_o")


def eligible(select: Column, group: Column, action: Column, conf: Column, uncertain: Column, exempt: Column) -> Column:
    """Whether a segment suits a block: sure tricks if tricks are asked for; else the right group and, unless the source
    is exempt, certain."""
    trick = is_trick(action) & (conf >= TRICK_CONF)
    plain = ((select == "all") | (group == select)) & (~F.coalesce(uncertain, F.lit(False)) | exempt)
    return F.when(select == SELECT_TRICK, trick).otherwise(plain)


def pieces(kinds: DataFrame, segments: DataFrame, presence: DataFrame) -> DataFrame:
    """What of each source suits each kind of block, whatever has been shown: source, select, exempt, ord, lo, hi, and
    ``rank``, the longest first and of equally long ones the first.

    ``kinds`` has source, select, exempt. Eligible segments that are certain are cut to the times the subject is there
    (``presence``: source, start, end), where anything is known of that; pieces under 0.6 s don't count.
    """
    kind = ["source", "select", "exempt"]
    ok = eligible(F.col("select"), F.col("group"), F.col("action"), F.col("conf"), F.col("uncertain"), F.col("exempt"))
    known = presence.select("source").distinct().withColumn("_known", F.lit(True))
    s = kinds.join(segments, "source").where(ok).join(known, "source", "left").withColumn("_cut", F.coalesce("_known", F.lit(False)) & ~F.coalesce("uncertain", F.lit(False)))
    s = s.select(*kind, "ord", "start", "end", "_cut")
    whole = s.where("not _cut").select(*kind, "ord", F.col("start").alias("lo"), F.col("end").alias("hi"))
    part = clip(s.where("_cut").drop("_cut"), presence, ["source"]).select(*kind, "ord", "lo", "hi")
    out = whole.unionByName(part).where(F.col("hi") - F.col("lo") >= MIN_CLIP)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*kind).orderBy(F.desc(F.col("hi") - F.col("lo")), "ord", "lo")))


def candidates(wanted: DataFrame, stock: DataFrame, used: DataFrame, bucket: float = 10.0) -> DataFrame:
    """Per block and source the longest stretch that may be shown: plan_id, block_idx, source, src_ord, t0, t1.

    ``wanted`` has plan_id, block_idx, source, src_ord, select, exempt, ``stock`` is of :func:`pieces`, and ``used``
    (plan_id, source, start, end) what the plan has shown. The longest is the first piece by rank that nothing used
    meets, or a longer rest of one that is met; so with n pieces met only the first n + 1 are looked at.
    """
    kind, block = ["source", "select", "exempt"], ["plan_id", "block_idx", "source"]
    cut = lambda df, lo, hi: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    near = wanted.hint("merge").join(used, ["plan_id", "source"])
    met = cut(near, "start", "end").join(cut(stock, "lo", "hi"), [*kind, "_b"]).where(F.least("hi", "end") > F.greatest("lo", "start"))
    met = met.select(*block, "src_ord", "ord", "rank", F.col("lo").alias("start"), F.col("hi").alias("end")).distinct()
    rest = subtract(met, used, ["plan_id", "source"], ["block_idx", "src_ord", "ord", "rank"], MIN_CLIP)
    n = met.groupBy(*block).agg(F.count("*").alias("_n"))
    tried = wanted.join(n, block, "left").withColumn("rank", F.explode(F.sequence(F.lit(1), (F.coalesce("_n", F.lit(0)) + 1).cast("int"))))
    whole = tried.join(met.select(*block, "rank"), [*block, "rank"], "left_anti").join(stock, [*kind, "rank"])
    names = [*block, "src_ord", "ord", "lo", "hi"]
    best = F.min_by(F.struct("lo", "hi"), F.struct(F.col("lo") - F.col("hi"), "ord", "lo")).alias("x")
    return whole.select(names).unionByName(rest.select(names)).groupBy(*block, "src_ord").agg(best).select(*block, "src_ord", F.col("x.lo").alias("t0"), F.col("x.hi").alias("t1"))


def choose_clips(blocks: DataFrame, cands: DataFrame) -> DataFrame:
    """Clips of each block from its sources' candidates: plan_id, block_idx, source, src_ord, t0, t1.

    A zoom shows one stretch, the longest. Otherwise every source gets one clip and an equal share of the
    block's length (or the pace's); sources too short to be seen are left out if others remain, and if shares
    fall below 0.6 s only the longest few are kept.
    """
    block = ["plan_id", "block_idx"]
    c = cands.join(blocks.select(*block, "zoom", "pace", "target_dur").hint("merge"), block).withColumn("len", F.col("t1") - F.col("t0"))
    per_block = Window.partitionBy(*block)
    longest = Window.partitionBy(*block).orderBy(F.desc("len"), "src_ord")
    pace = F.when(F.col("pace") == "fast", PACE["fast"]).otherwise(PACE["calm"])
    share = F.coalesce(F.col("target_dur") / F.col("n"), pace)
    c = c.withColumn("n", F.count("*").over(per_block)).withColumn("per", share).withColumn("seen", (F.col("n") == 1) | (F.col("len") >= F.least(F.lit(MIN_SHOW), F.col("per"))))
    c = c.withColumn("m", F.count_if("seen").over(per_block)).where((F.col("zoom") == "gradual") | F.col("seen") | (F.col("m") == 0))
    c = c.withColumn("n", F.count("*").over(per_block)).withColumn("per", share).withColumn("r", F.row_number().over(longest))
    few = F.greatest(F.lit(1), F.floor(F.col("target_dur") / MIN_CLIP)).cast("int")
    cut = F.col("target_dur").isNotNull() & (F.col("per") < MIN_CLIP)
    c = c.withColumn("k", F.when(F.col("zoom") == "gradual", 1).when(cut, few)).where(F.col("k").isNull() | (F.col("r") <= F.col("k")))
    per = F.when(F.col("zoom") == "gradual", F.coalesce("target_dur", "len")).when(cut, F.col("target_dur") / F.least("k", "n")).otherwise(F.col("per"))
    c = c.withColumn("take", F.least(per, "len")).where((F.col("zoom") == "gradual") | (F.col("take") >= MIN_CLIP))
    return c.select(*block, "source", "src_ord", F.bround("t0", 2).alias("t0"), F.bround(F.col("t0") + F.col("take"), 2).alias("t1"))


def compile_plans(blocks: DataFrame, sources: DataFrame, tags: DataFrame, segments: DataFrame, presence: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Clips of all plans' blocks. A block may not show what an earlier block of its plan did, so blocks go one after
    another, all plans at a time; each step's clips are written to the shared folder."""
    spark = blocks.sparkSession
    allowed = materialize(allowed_sources(blocks, sources, tags), "allowed-sources")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    done = spark.createDataFrame([], f"plan_id {kind(blocks, 'plan_id')}, block_idx {kind(blocks, 'block_idx')}, source {kind(sources, 'source')}, src_ord {kind(sources, 'src_ord')}, t0 double, t1 double")
    wanted = materialize(blocks.select("plan_id", "block_idx", "select").hint("merge").join(allowed, ["plan_id", "block_idx"]), "wanted-sources")
    stock = materialize(pieces(wanted.select("source", "select", "exempt").distinct(), segments, presence), "pieces")
    old: list[str] = []
    for i in range(max_blocks):
        own, now = blocks.where(F.col("block_idx") == i), []
        new = choose_clips(own, candidates(wanted.where(F.col("block_idx") == i), stock, _as_used(done)))
        done = materialize(done.unionByName(new), f"clips-{i}", now)
        discard(spark, old)
        old = now
    return done


def _as_used(clips: DataFrame) -> DataFrame:
    return clips.select("plan_id", "source", F.col("t0").alias("start"), F.col("t1").alias("end"))
