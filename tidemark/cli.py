"""Command line: score a stage against ground truth, report on folders, fill and search the store."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.operators import segments as S
from tidemark.operators import tracking as T
from tidemark.operators.store import DIMENSION, Store, load_card, search
from tidemark.sources import records as R
from tidemark.sources.workspace import Workspace

KEYS = ["video_id"]


def _tracking(spark: SparkSession, gt: str, pred: str, thr: float) -> DataFrame:
    # of a frame that a file lists more than once, the last line counts
    g, p = (T.last_per_frame(R.read_frames(spark, x).withColumn("ord", F.monotonically_increasing_id())).drop("ord") for x in (gt, pred))
    g = g.join(p.select("video_id").distinct(), "video_id", "left_semi")
    return T.evaluate_tracking(R.explode_frames(g), R.explode_frames(p), g.select(*T.FRAME), thr)


def _clusters(spark: SparkSession, gt: str, pred: str, thr: float) -> DataFrame:
    mapping, asked, _ = R.read_reid(spark, pred)
    truth, _, _ = R.read_reid(spark, gt)
    return S.evaluate_clusters(truth.withColumnRenamed("cluster", "gt_id"), mapping.withColumnRenamed("cluster", "pred_id"), KEYS, asked)


#: What scores each stage, of (session, ground truth, predictions, IoU threshold).
STAGES = {
    "m1": _tracking,
    "m2": _clusters,
    "m3": lambda spark, gt, pred, thr: S.evaluate_motion(R.read_segments(spark, gt), R.read_segments(spark, pred), KEYS),
    "m4": lambda spark, gt, pred, thr: S.evaluate_actions(R.read_actions(spark, gt), R.read_actions(spark, pred), KEYS),
    "m5": lambda spark, gt, pred, thr: S.evaluate_matches(R.read_matches(spark, gt), R.read_matches(spark, pred), KEYS, thr),
}


def evaluate(spark: SparkSession, stage: str, gt: str, pred: str, thr: float = T.IOU) -> DataFrame:
    """Metrics of all videos that both paths hold, one row a video."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    return STAGES[stage](spark, gt, pred, thr)


def judge(metrics: DataFrame, stage: str, thresholds: DataFrame) -> DataFrame:
    names = [c for c, t in metrics.dtypes if c not in KEYS and t in ("bigint", "int", "double")]
    return S.check_thresholds(S.long_metrics(metrics, KEYS, stage, names), thresholds)


def render(rows: list) -> str:
    table = [["video", "metric", "value", "rule", "bound", "status"]] + [[str(r.video_id), r.metric, f"{r.value:.4f}", r.rule, "" if r.bound is None else f"{r.bound:g}", r.status] for r in rows]
    width = [max(len(x[i]) for x in table) for i in range(6)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(x, width)).rstrip() for x in table)


def verdict(checks: DataFrame) -> str:
    """FAIL, PASS or unset over all videos."""
    row = S.overall(checks, []).first()
    return row.status if row else "unset"


def report(spark: SparkSession, gt_dir: str, pred_dir: str, thr: float = T.IOU) -> str:
    """Tracking scores of all videos of two folders, and the total."""
    rows = T.tracking_report(evaluate(spark, "m1", f"{gt_dir}/*_m1.jsonl", f"{pred_dir}/*_m1.jsonl", thr)).orderBy(F.col("video_id").asc_nulls_last()).collect()
    table = [["video", "num_gt", "miss", "fp", "idsw", "frag", "mota", "idf1"]]
    table += [["TOTAL" if r.video_id is None else str(r.video_id), str(r.num_gt or 0), f"{r.miss_rate:.2f}", str(r.fp or 0), str(r.idsw or 0), str(r.fragmentation or 0), f"{r.mota:.2f}", f"{r.idf1:.2f}"] for r in rows]
    width = [max(len(x[i]) for x in table) for i in range(len(table[0]))]
    return "\n".join("  ".join(c.rjust(w) if i else c.ljust(w) for i, (c, w) in enumerate(zip(x, width))) for x in table) + "\nTOTAL's idf1 is the mean over videos."


def run_eval(spark, a) -> None:
    empty = spark.createDataFrame([], "stage string, metric string, min double, max double")
    thresholds = R.read_thresholds(spark, a.thresholds) if a.thresholds else empty
    checks = judge(evaluate(spark, a.stage, a.gt, a.pred, a.iou_thr), a.stage, thresholds)
    rows = checks.orderBy("video_id", "metric").collect()
    if a.json:
        print(json.dumps({"stage": a.stage, "checks": [r.asDict() for r in rows], "overall": verdict(checks)}, ensure_ascii=False, indent=2))
    else:
        print(f"{render(rows)}\noverall: {verdict(checks)}")


def run_report(spark, a) -> None:
    print(report(spark, a.gt_dir, a.pred_dir, a.iou_thr))


def run_init(spark, a) -> None:
    Store(spark, a.store).init()


def run_card(spark, a) -> None:
    store = Store(spark, a.store)
    store.init()
    subject, fields = ingest.read_card(spark, a.file)
    named = lambda df: df.withColumn("dog_id", F.lit(a.dog))
    store.upsert_card(named(subject).select("dog_id", "name", "status"), named(fields))
    print(f"{a.dog}: {fields.count()} fields")


def run_ingest(spark, a) -> None:
    n = ingest.ingest_job(Store(spark, a.store), a.dog, a.job, *ingest.job_tables(spark, Workspace(a.root, a.job)))
    print(", ".join(f"{k} {v}" for k, v in n.items()))


def run_search(spark, a) -> None:
    from tidemark.functions.external import stub_embed

    store = Store(spark, a.store)
    if a.card:
        name, status, fields = load_card(store.read("dogs"), store.read("dog_fields"), a.dog)
        print(f"{name} ({status})")
        for r in fields.collect():
            print(f"  {r.field}: {r.value}")
    for r in search(store.read("chunks"), stub_embed(DIMENSION)([a.question])[0], a.k, dog_id=a.dog).collect():
        shown = [f"{r.score or 0:.3f}", r.layer, r.video_id and f"@{r.video_id}", r.conf is not None and f"conf={r.conf:.2f}", r.trait and f"[{r.trait}]", r.text]
        print("  ".join(x for x in shown if x))


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tidemark")
    sub = ap.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, settings in options:
            p.add_argument(*flags.split(), **settings)

    needed, thr, store, dog = {"required": True}, ("--iou-thr", {"type": float, "default": T.IOU}), ("--store", {"required": True}), ("dog", {})
    command("eval", run_eval, ("--stage", needed), ("--gt", needed), ("--pred", needed), thr, ("--thresholds", {}), ("--json", {"action": "store_true"}))
    command("report", run_report, ("--gt-dir", needed), ("--pred-dir", needed), thr)
    command("init", run_init, store)
    command("card", run_card, store, dog, ("--file", needed))
    command("ingest", run_ingest, store, ("job", {}), ("--dog", needed), ("--root", needed))
    command("search", run_search, store, dog, ("question", {}), ("-k", {"type": int, "default": 5}), ("--card", {"action": "store_true"}))
    return ap


def main(argv: list[str] | None = None) -> int:
    from tidemark.session import get_spark

    a = parser().parse_args(argv)
    a.run(get_spark("tidemark-cli"), a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
