"""License scan by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a text is joined, by hash and then by the words themselves, to the
positions where a template has that pair. A hit at text position p and template position q votes for diagonal
p - q. A base phrase stands wherever all of its pairs vote for one diagonal. For longer templates each diagonal is
merged with its neighbours, at most ``GAP`` or a twentieth of the template away (words were added, lost or
changed on the way), and the merged span is verified: template pairs count, each once on the nearest diagonal,
as long as their places in the text rise with their places in the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP, GAP_SHARE = 2, 20
MIN_SHARE = 0.8

# Fixed values: (label, words, whether it is a base phrase), of any length; first phrases, then whole licenses.
TEMPLATES = (
    ("cc-by", "cc by", True),
    ("gpl", "general public license", True),
    ("reserved", "all rights reserved", True),
    ("agpl", "gnu affero general public license version 3", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", False),
    ("cc-by-nc", "licensed under cc by nc 4 0", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", False),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", False),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False),
    ("lgpl", "gnu lesser general public license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", False),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", False),
    ("public-domain", "this is free and unencumbered software released into the public domain", False),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
     software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
     sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
     conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
     the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
     merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any
     claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
     or the use or other dealings in the software""", False),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
     the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
     warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
     liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
     whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
     software""", False),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
     conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following
     disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
     in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and
     contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
     fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
     incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
     data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
     including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
     damage""", False),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
     damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
     applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be
     misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
     product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be
     misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution""", False),
)


def words_of(text):
    """Array of words of a text column: A-Z lower-cased, null as empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def template_pairs(spark, templates=TEMPLATES) -> DataFrame:
    """(t, q, a, b, h): the pairs of each template, numbered from 0."""
    rows = [(t, q, a, b) for t, (_, text, _) in enumerate(templates) for w in (text.split(),) for q, (a, b) in enumerate(zip(w, w[1:]))]
    return spark.createDataFrame(rows, "t int, q int, a string, b string").select("*", F.xxhash64("a", "b").alias("h"))


def template_sizes(spark, templates=TEMPLATES) -> DataFrame:
    """(t, label, base, pairs, drift): number of pairs, and how far from a diagonal others are merged with it."""
    rows = [(t, label, base, n := len(text.split()) - 1, max(GAP, n // GAP_SHARE)) for t, (label, text, base) in enumerate(templates)]
    return spark.createDataFrame(rows, "t int, label string, base boolean, pairs int, drift int")


def votes(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Rows (doc_id, key, t, q, diag): pair q of a template stands at q + diag. Those of a repeated row fall together."""
    w = docs.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("w"))
    two = w.where(F.size("w") > 1).select("doc_id", "key", F.posexplode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p", "x"))
    two = two.select("doc_id", "key", "p", F.col("x.a").alias("a"), F.col("x.b").alias("b")).withColumn("h", F.xxhash64("a", "b"))
    # The templates are the fixed values above, about a thousand pairs whatever the input.
    t = F.broadcast(template_pairs(docs.sparkSession, templates)).alias("t")
    d = two.alias("d")
    hit = d.join(t, (F.col("d.h") == F.col("t.h")) & (F.col("d.a") == F.col("t.a")) & (F.col("d.b") == F.col("t.b")))
    return hit.select("doc_id", "key", "t.t", "t.q", (F.col("p") - F.col("q")).alias("diag")).distinct()


def _near(anchors: DataFrame, others: DataFrame) -> DataFrame:
    """Anchors (doc_id, key, t, at, drift) with each of the others (doc_id, key, t, diag, ...) at most drift away. Both
    go by a bucket of drift + 1 diagonals as well, so that a long text's diagonals aren't compared with one another."""
    bucket = lambda c: F.floor(F.col(c) / (F.col("drift") + 1))
    a = anchors.withColumn("bucket", F.explode(F.array(*[bucket("at") + i for i in (-1, 0, 1)]))).alias("a")
    o = others.withColumn("bucket", bucket("diag")).drop("drift").alias("o")
    same = F.col("a.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("a.key") == F.col("o.key")) & (F.col("a.t") == F.col("o.t")) & (F.col("a.bucket") == F.col("o.bucket"))
    rest = [F.col(f"o.{c}") for c in others.columns if c not in ("doc_id", "key", "t", "drift")]
    return a.join(o, same & (F.abs(F.col("at") - F.col("diag")) <= F.col("drift"))).select("a.doc_id", "a.key", "a.t", "at", *rest)


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified spans: (doc_id, key, label, base, start, share)."""
    spark = docs.sparkSession
    hit = materialize(votes(docs, templates), "votes")
    sizes = F.broadcast(template_sizes(spark, templates))
    diag = hit.groupBy("doc_id", "key", "t", "diag").agg(F.count("*").alias("n")).join(sizes, "t")
    whole = diag.where("base and n = pairs").select("doc_id", "key", "label", "base", F.col("diag").alias("start"), F.lit(1.0).alias("share"))

    own = ["doc_id", "key", "t"]
    # a span can't be verified where all of a text's votes for the template together are too few
    every = F.sum("n").over(Window.partitionBy(*own))
    diag = diag.where("not base").withColumn("every", every).where(F.col("every") >= MIN_SHARE * F.col("pairs"))
    diag = materialize(diag.select(*own, "diag", "n", "drift", "pairs"), "diagonals")
    enough = _near(diag.withColumnRenamed("diag", "at").drop("n"), diag.select(*own, "diag", "n", "drift", "pairs"))
    enough = enough.groupBy(*own, "at").agg(F.sum("n").alias("n"), F.first("pairs").alias("pairs")).where(F.col("n") >= MIN_SHARE * F.col("pairs"))
    anchors = enough.select(*own, "at").join(sizes.select("t", "drift"), "t")
    merged = _near(anchors, hit.join(sizes.select("t", "drift"), "t"))
    place = F.struct(F.abs(F.col("diag") - F.col("at")), "diag", (F.col("q") + F.col("diag")).alias("p"))
    merged = merged.groupBy(*own, "at", "q").agg(F.min(place)["p"].alias("p"))
    before = F.max("p").over(Window.partitionBy(*own, "at").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    rising = merged.withColumn("before", before).where(F.col("before").isNull() | (F.col("p") > F.col("before")))
    found = rising.groupBy(*own, "at").agg(F.count("*").alias("n"), F.min("p").alias("start")).join(sizes, "t").withColumn("share", F.col("n") / F.col("pairs"))
    found = found.where(F.col("share") >= MIN_SHARE).groupBy("doc_id", "key", "label", "base", "start").agg(F.max("share").alias("share"))
    return whole.unionByName(found)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Null text counts as empty (no words, no labels, score 0); null ids are kept and matched null-safely;
    repeated rows each get the same result; other columns aren't read. ``score`` is the largest verified
    share of a template, 1 where a base phrase stands.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("base"), F.col("start"))
    found = spans(docs, templates).groupBy("doc_id", "key").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        names("label").alias("labels"),
        F.max("share").alias("score"),
    )
    d = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words")).alias("d")
    f = found.alias("f")
    out = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select(F.col("d.doc_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))


def oracle() -> str:
    t = ", ".join(f"({i}, '{label}', {base}, '{' '.join(text.split())}')" for i, (label, text, base) in enumerate(TEMPLATES))
    return rf"""
with t0(t, label, base, txt) as (values {t}),
t1 as (select t, label, base, string_split(txt, ' ') w from t0),
m as (select t, label, base, len(w) - 1 pairs, greatest({GAP}, (len(w) - 1) // {GAP_SHARE}) drift from t1),
tp as (select t, q - 1 q, w[q] a, w[q + 1] b from (select *, unnest(range(1, len(w))) q from t1)),
d as (select row_number() over () r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') w from documents),
p as (select r, p - 1 p, w[p] a, w[p + 1] b from (select r, w, unnest(range(1, len(w))) p from d)),
h as (select distinct r, t, q, p, p - q diag from p join tp using (a, b)),
dg as (select r, t, diag, count(*) n from h group by all),
whole as (select r, label, true base, diag as start, 1.0::double share from dg join m using (t) where base and n = pairs),
an as (select x.r, x.t, x.diag as mid, sum(y.n) n, m.pairs from dg x join m on m.t = x.t join dg y on y.r = x.r and y.t = x.t and abs(y.diag - x.diag) <= m.drift where not m.base group by all having sum(y.n) >= {MIN_SHARE} * m.pairs),
pk as (select an.r, an.t, an.mid, h.q, arg_min(h.p, (abs(h.diag - an.mid), h.diag)) p from an join m on m.t = an.t join h on h.r = an.r and h.t = an.t and abs(h.diag - an.mid) <= m.drift group by all),
ri as (select *, max(p) over (partition by r, t, mid order by q rows between unbounded preceding and 1 preceding) before from pk),
sp as (select r, t, mid, count(*) n, min(p) as start from ri where before is null or p > before group by all),
s as (select * from whole union all select r, label, false, start, n::double / pairs from sp join m using (t) where n::double / pairs >= {MIN_SHARE}),
f as (select r, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') base_labels, array_to_string(list_sort(list(distinct label)), ',') labels, max(share) score from s group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score
from d left join f using (r)"""
