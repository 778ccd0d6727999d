"""The retrieval store: tables of subjects, their fields, video analyses and text chunks with vectors.

Tables are Parquet below a root that Spark writes to. A write stages the new state of a table under its own
version and then points to it, so a reader sees the old state or the new one, and a failed job changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.vectors import cosine, doubles

# Fixed values.
TRAITS = ("활동성", "독립성", "사교성", "안정성", "호기심")
VIS_FIELD, VIS_CHUNK, LAYERS = ("public", "public_soft", "staff"), ("public", "staff"), ("L1", "L2")
DIMENSION = 1024

SCHEMAS = {
    "dogs": "dog_id string, name string, status string, created_at timestamp",
    "dog_fields": "id long, dog_id string, field string, value string, soft_value string, vis string",
    "video_analysis": "dog_id string, video_id string, job_id string, analyzed_at timestamp, segments array<struct<start:double,end:double,group:string,action:string,conf:double,uncertain:boolean>>, profile string",
    "chunks": "id long, dog_id string, layer string, trait string, conf float, vis string, video_id string, t_start float, t_end float, text string, embedding array<float>",
}


# ---- states as DataFrames: each takes the old rows and gives the new ones ----


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with equal keys; of several new rows of a key, the last by ``_ord``
    where there is one."""
    if "_ord" in new.columns:
        w = Window.partitionBy(*keys).orderBy(F.desc("_ord"))
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_ord")
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def replace_group(old: DataFrame, new: DataFrame, keys: list[str], groups: DataFrame | None = None, keep_if_empty: bool = False) -> DataFrame:
    """All rows of the given groups (default: those in ``new``) make way for ``new``. With ``keep_if_empty`` nothing is
    deleted while ``new`` has no row, so a run that yields nothing leaves what was there."""
    if keep_if_empty and new.isEmpty():
        return old
    gone = (new if groups is None else groups).select(keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def with_ids(old: DataFrame, new: DataFrame, order: list[str], column: str = "id") -> DataFrame:
    """``new`` with ids that go on from the highest of ``old``, in the given order. Positions within sorted partitions are
    offset by the partitions' counts, so the numbering isn't one task's work."""
    top = old.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    s = new.drop(column).sort(*order).withColumn("_p", F.spark_partition_id())
    s = s.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    n = s.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    first = n.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(first.select("_p", "_o")), "_p").withColumn(column, F.lit(top) + F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def cascade(rows: DataFrame, dogs: DataFrame) -> DataFrame:
    """Rows whose subject is still there."""
    return rows.join(dogs.select("dog_id"), "dog_id", "left_semi")


def violations(df: DataFrame, not_null: list[str] | None = None, allowed: dict[str, tuple] | None = None, unique: list[str] | None = None, parent: DataFrame | None = None, dimension: int | None = None) -> DataFrame:
    """Number of rows against each rule: (rule, n), only rules that are broken.

    Nulls pass a check of allowed values; ``unique`` counts rows beyond the first of a key.
    """
    checks = [(f"not null: {c}", F.col(c).isNull()) for c in not_null or []]
    checks += [(f"allowed: {c}", F.coalesce(~F.col(c).isin(*v), F.lit(False))) for c, v in (allowed or {}).items()]
    if dimension:
        checks.append(("dimension: embedding", F.coalesce(F.size("embedding") != dimension, F.lit(False))))
    spark = df.sparkSession
    out = spark.createDataFrame([], "rule string, n long")
    if checks:
        counted = df.agg(*[F.count_if(c).alias(f"r{i}") for i, (_, c) in enumerate(checks)])
        rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, (name, _) in enumerate(checks)])
        out = out.unionByName(counted.select(F.inline(rows)))
    if unique:
        out = out.unionByName(df.groupBy(*unique).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(f"unique: {', '.join(unique)}").alias("rule"), "n"))
    if parent is not None:
        out = out.unionByName(df.where("dog_id is not null").join(parent.select("dog_id"), "dog_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("parent: dog_id").alias("rule"), "n"))
    return out.where("n > 0")


def require(df: DataFrame, **rules) -> DataFrame:
    """``df`` itself, or ValueError naming the broken rules."""
    bad = violations(df, **rules).orderBy("rule").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule} ({r.n} rows)" for r in bad))
    return df


# ---- queries ----


def visible_fields(fields: DataFrame, staff: bool = False) -> DataFrame:
    """Card fields one may see: staff see all as they are; others see public values, and for public_soft the softened
    value, if there is one that isn't empty."""
    if staff:
        return fields.withColumn("shown", F.col("value"))
    soft = F.when(F.length("soft_value") > 0, F.col("soft_value"))
    out = fields.withColumn("shown", F.when(F.col("vis") == "public", F.col("value")).when(F.col("vis") == "public_soft", soft))
    return out.where((F.col("vis") == "public") | F.col("shown").isNotNull())


def load_card(dogs: DataFrame, fields: DataFrame, dog_id: str, staff: bool = False) -> tuple[str, str, DataFrame]:
    """(name, status, visible fields by id); KeyError for an unknown subject."""
    row = dogs.where(F.col("dog_id") == dog_id).first()
    if row is None:
        raise KeyError(dog_id)
    return row.name, row.status, visible_fields(fields.where(F.col("dog_id") == dog_id), staff).orderBy("id").select("field", F.col("shown").alias("value"))


def open_chunks(chunks: DataFrame, staff: bool = False) -> DataFrame:
    return chunks if staff else chunks.where(F.col("vis") != "staff")


def search(chunks: DataFrame, query: list[float], k: int = 5, staff: bool = False, dog_id=None, vec: str = "embedding", ident: str = "id") -> DataFrame:
    """The k chunks of highest cosine to ``query`` (score), ties to the smaller id; vectors without a cosine are last, with
    a null score. The gate and the subject are filters of the scan; the top k is taken without a full sort."""
    rows = open_chunks(chunks, staff)
    rows = rows if dog_id is None else rows.where(F.col("dog_id") == dog_id)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", cosine(doubles(vec), q)).drop(vec)
    return scored.orderBy(F.col("score").desc_nulls_last(), ident).limit(k)


def l2_rows(videos: DataFrame, cited: DataFrame) -> DataFrame:
    """Chunk rows of videos (dog_id, video_id, behavior, caption, scene_tags): one of the behaviour with the cited
    segment (dog_id, video_id, start, end, conf), one of the caption without; empty texts give none."""
    c = cited.select("dog_id", "video_id", F.struct("start", "end", "conf").alias("c"))
    v = videos.join(c, ["dog_id", "video_id"], "left")
    tags = F.array_join(F.array_sort(F.array_distinct(F.coalesce("scene_tags", F.array().cast("array<string>")))), ", ")
    scene = F.when(F.length(tags) > 0, F.concat(F.lit(" — 장면: "), tags)).otherwise("")
    secs = F.rint("c.start").cast("long").cast("string")
    where = F.concat(F.lit(" ("), F.col("video_id"), F.lit(" 영상"), F.when(F.col("c").isNotNull(), F.concat(F.lit(" "), secs, F.lit("초"))).otherwise(""), F.lit(")"))
    plain = F.concat(F.lit(" ("), F.col("video_id"), F.lit(" 영상)"))
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    one = lambda kind, text, end, cite: F.struct(
        F.lit(kind).alias("kind"), F.when(F.length(said(text)) > 0, F.concat(said(text), scene, end)).alias("text"),
        *[(F.col(f"c.{x}") if cite else F.lit(None).cast("double")).alias(n) for x, n in (("start", "t_start"), ("end", "t_end"), ("conf", "conf"))],
    )
    both = v.select("dog_id", "video_id", F.inline(F.array(one("behavior", "behavior", where, True), one("caption", "caption", plain, False))))
    return both.where("text is not null")


def ingest_gate(meta: DataFrame) -> None:
    """Refuse a job (foster_uncertain array) in which a video's subject is still open."""
    open_ = meta.select(F.explode("foster_uncertain").alias("v")).distinct().orderBy("v").limit(100).collect()
    if open_:
        raise RuntimeError("subject not confirmed in: " + ", ".join(r.v for r in open_))


def merge_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key/value documents (key, value) merged at the top level, the new value winning."""
    return upsert(old, new, ["key"])


def scene_tags(auto: DataFrame, human: DataFrame, fallback: DataFrame) -> DataFrame:
    """(video_id, tags): a person's tags replace the automatic ones of a video as a whole; if there are neither, the
    fallback's; names that begin with an underscore aren't videos."""
    j = auto.select("video_id", F.col("tags").alias("a")).join(human.select("video_id", F.col("tags").alias("h")), "video_id", "full")
    own = j.select("video_id", F.coalesce("h", "a").alias("tags"))
    own = fallback.select("video_id", "tags") if own.isEmpty() else own
    return own.where(~F.col("video_id").startswith("_"))


def verified(claims: DataFrame, records: DataFrame, judge: Column, keys: list[str]) -> DataFrame:
    """Claims (keys, claim) with ``supported``: whether any record of the same key supports it; ``judge`` is a Column over
    claim and record. Claims without records aren't supported."""
    j = claims.join(records, keys, "left").withColumn("_ok", F.col("record").isNotNull() & judge)
    return j.groupBy(*keys, "claim").agg(F.bool_or(F.coalesce("_ok", F.lit(False))).alias("supported"))


def verified_everywhere(claims: DataFrame, records: DataFrame, judge: Column, keys: list[str]) -> DataFrame:
    """As :func:`verified`, but every record of the key must support the claim; claims without records pass."""
    j = claims.join(records, keys, "left").withColumn("_ok", F.col("record").isNull() | judge)
    return j.groupBy(*keys, "claim").agg(F.bool_and(F.coalesce("_ok", F.lit(True))).alias("supported"))


# ---- tables on storage ----


class Store:
    """Versioned Parquet tables below ``root``. ``write`` gives a table a new state; readers follow the pointer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def init(self) -> None:
        """Create the tables that aren't there; harmless to repeat."""
        for name, schema in SCHEMAS.items():
            if self._version(name) is None:
                self.write(name, self.spark.createDataFrame([], schema))

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self, name: str) -> str | None:
        p, fs = self._fs(self._pointer(name))
        if not fs.exists(p):
            return None
        return self.spark.read.text(self._pointer(name)).first()[0]

    def read(self, name: str) -> DataFrame:
        version = self._version(name)
        if version is None:
            raise FileNotFoundError(f"{name}: init() the store first")
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        """Stage the rows, point to them, and drop the state before the last."""
        before = self._version(name)
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]).write.parquet(f"{self.root}/{name}/{version}")
        p, fs = self._fs(self._pointer(name))
        out = fs.create(p, True)
        out.write(bytearray(version, "ascii"))
        out.close()
        for status in fs.listStatus(self._fs(f"{self.root}/{name}")[0]):
            if status.isDirectory() and status.getPath().getName() not in (version, before):
                fs.delete(status.getPath(), True)

    def upsert_card(self, dog: DataFrame, fields: DataFrame) -> None:
        """A subject and all of its fields: the row is replaced or added, its fields replaced as a whole."""
        require(fields, not_null=["field", "value", "vis"], allowed={"vis": VIS_FIELD})
        self.write("dogs", upsert(self.read("dogs"), dog.withColumn("created_at", F.current_timestamp()), ["dog_id"]))
        old = self.read("dog_fields")
        kept = old.join(dog.select("dog_id"), "dog_id", "left_anti")
        self.write("dog_fields", kept.unionByName(with_ids(old, fields.select("dog_id", "field", "value", "soft_value", "vis", "ord"), ["dog_id", "ord"]).drop("ord")))

    def ingest(self, dog_id: str, analyses: DataFrame, l2: DataFrame) -> None:
        """Video analyses by (dog, video), and the L2 chunks of those videos, which are left alone if ``l2`` is empty."""
        one = self.spark.createDataFrame([(dog_id, dog_id, "unknown")], "dog_id string, name string, status string").withColumn("created_at", F.current_timestamp())
        self.write("dogs", insert_absent(self.read("dogs"), one, ["dog_id"]))
        new = analyses.withColumn("analyzed_at", F.current_timestamp())
        self.write("video_analysis", upsert(self.read("video_analysis"), new.select(self.read("video_analysis").columns), ["dog_id", "video_id"]))
        self._replace_chunks(l2, ["dog_id", "layer", "video_id"], analyses.select("dog_id", F.lit("L2").alias("layer"), "video_id"), True)

    def replace_traits(self, dog_id: str, l1: DataFrame) -> None:
        """All L1 chunks of a subject make way for the given ones, which may be none."""
        group = self.spark.createDataFrame([(dog_id, "L1")], "dog_id string, layer string")
        self._replace_chunks(l1, ["dog_id", "layer"], group, False)

    def _replace_chunks(self, new: DataFrame, keys: list[str], group: DataFrame, keep_if_empty: bool) -> None:
        old = self.read("chunks")
        require(new, not_null=["dog_id", "layer", "text", "embedding"], allowed={"layer": LAYERS, "vis": VIS_CHUNK}, parent=self.read("dogs"))
        fresh = with_ids(old, new, ["dog_id", "layer", "video_id", "text"]).select(old.columns)
        self.write("chunks", replace_group(old, fresh, keys, group, keep_if_empty))

    def delete(self, dog_id: str) -> None:
        """A subject, and with it everything that is its own."""
        dogs = self.read("dogs").where(F.col("dog_id") != dog_id)
        self.write("dogs", dogs)
        for name in ("dog_fields", "video_analysis", "chunks"):
            self.write(name, cascade(self.read(name), self.read("dogs")))
