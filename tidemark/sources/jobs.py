"""Starting a job: inputs copied into its folder, one state document beside them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidemark.sources.workspace import Workspace


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_meta(spark: SparkSession, ws: Workspace, **fields) -> dict:
    """The job's document with the fields replaced; null documents start empty. One writer at a time."""
    p, fs = _fs(spark, ws.meta)
    old = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(ws.meta).collect())) if fs.exists(p) else {}
    new = old | fields
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(new, ensure_ascii=False), "utf-8"))
    out.close()
    return new


def init_job(spark: SparkSession, ws: Workspace, inputs: list[str], **meta) -> dict:
    """Copy the inputs into the job's folder, in any store Spark can reach, and mark it uploaded; missing inputs raise."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, fs = _fs(spark, ws.input_dir)
    fs.mkdirs(target)
    for path in inputs:
        src, source_fs = _fs(spark, path)
        if not source_fs.exists(src):
            raise FileNotFoundError(path)
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, src, fs, target, False, conf)
    return write_meta(spark, ws, state="uploaded", **meta)
