"""Model calls behind functions that are passed in, with stand-ins that need no model.

A backend is called with a list of inputs and gives a list of outputs; it is built once a task. Inputs are
reduced to distinct ones before the call, and results can be kept in a table, so nothing is asked twice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 20


def stub_embed(dim: int = 1024) -> Callable[[list[str]], list[list[float]]]:
    """Signed hashes of a text's words, scaled to length 1; the same text always gives the same vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in (t or "").split():
                h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def stub_judge(classes: tuple[str, ...] = ("yes", "no")) -> Callable[[list[str]], list[list[tuple[str, float]]]]:
    """Log probabilities of the classes from a hash of the input; the masses add up to one."""

    def judge(texts: list[str]) -> list[list[tuple[str, float]]]:
        out = []
        for t in texts:
            parts = [1 + hashlib.sha1(f"{c}|{t}".encode()).digest()[0] for c in classes]
            out.append([(c, math.log(p / sum(parts))) for c, p in zip(classes, parts)])
        return out

    return judge


def stub_lookup(table: dict[str, str]) -> Callable[[list[str]], list[str]]:
    return lambda keys: [table.get(k, "") for k in keys]


def call(df: DataFrame, column: str, out: str, kind: str, backend: Callable[[], Callable], cache: DataFrame | None = None, batch: int = BATCH, tries: int = 3, tasks: int | None = None) -> DataFrame:
    """``df`` with ``out``, the backend's answer to ``column``. Distinct non-null inputs are asked, those in ``cache``
    (column, out) aren't; a failing batch is tried again; ``tasks`` limits how many calls run at once."""
    ask = df.select(column).where(F.col(column).isNotNull()).distinct()
    if cache is not None:
        ask = ask.join(cache.select(column), column, "left_anti")
    ask = ask.repartition(tasks) if tasks else ask

    def run(batches):
        f = backend()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                yield pd.DataFrame({column: own[column], out: _answer(f, own[column].tolist(), tries)})

    answers = ask.mapInPandas(run, f"{column} {df.schema[column].dataType.simpleString()}, {out} {kind}")
    if cache is not None:
        answers = answers.unionByName(cache.select(column, out))
    return df.join(answers, column, "left")


def _answer(f, inputs: list, tries: int) -> list:
    for left in range(tries - 1, -1, -1):
        try:
            got = f(inputs)
            if len(got) != len(inputs):
                raise ValueError(f"{len(inputs)} inputs, {len(got)} answers")
            return got
        except Exception:
            if not left:
                raise
    return []


def embed_texts(df: DataFrame, column: str, dim: int = 1024, backend: Callable[[], Callable] | None = None, **options) -> DataFrame:
    """``df`` with ``embedding``; an answer of another length raises."""
    out = call(df, column, "embedding", "array<float>", backend or (lambda: stub_embed(dim)), **options)
    bad = F.raise_error(F.concat(F.lit("embedding has length "), F.size("embedding").cast("string"))).cast("array<float>")
    return out.withColumn("embedding", F.when(F.col("embedding").isNull() | (F.size("embedding") == dim), F.col("embedding")).otherwise(bad))


def supported(answers: Column, tau: float = 0.70) -> Column:
    """Whether a judge's (class, logprob) list supports a claim: no's share of yes and no is below ``tau``; without either,
    it does."""
    mass = lambda c: F.aggregate(F.filter(answers, lambda a: F.startswith(F.lower(a["class"]), F.lit(c))), F.lit(0.0), lambda s, a: s + F.exp(a["logprob"]))
    yes, no = mass("y"), mass("n")
    return F.when(yes + no > 0, no / (yes + no) < tau).otherwise(F.lit(True))


def verify_and_rewrite(claims: DataFrame, judge: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 1) -> DataFrame:
    """Claims that hold, after up to ``rounds`` rewrites of those that don't; what still doesn't is dropped. ``judge`` adds
    a boolean ``supported``, ``rewrite`` changes the text of the rows it is given."""
    good = None
    for left in range(rounds, -1, -1):
        judged = judge(claims)
        fine = judged.where("supported").drop("supported")
        good = fine if good is None else good.unionByName(fine)
        if left:
            claims = rewrite(judged.where(~F.col("supported")).drop("supported"))
    return good


def merge_answers(tags: DataFrame, answers: DataFrame, human: DataFrame) -> DataFrame:
    """Tags (video_id, tag) with newly answered ones, each once; videos a person tagged keep theirs untouched."""
    fresh = answers.join(human.select("video_id").distinct(), "video_id", "left_anti")
    return tags.select("video_id", "tag").unionByName(fresh.select("video_id", "tag")).distinct()
