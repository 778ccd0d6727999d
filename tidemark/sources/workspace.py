"""Where a job's files are, as paths below one root that Spark can read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Workspace:
    """``job=None`` is the development layout, where ground truth lies beside the predictions."""

    root: str
    job: str | None = None

    def _at(self, *parts: str) -> str:
        base = f"{self.root.rstrip('/')}/jobs/{self.job}" if self.job else self.root.rstrip("/")
        return "/".join([base, *parts])

    @property
    def analysis_dir(self) -> str:
        return self._at("analysis")

    @property
    def preds_dir(self) -> str:
        return self._at("preds")

    @property
    def input_dir(self) -> str:
        return self._at("input" if self.job else "videos")

    @property
    def gt_dir(self) -> str:
        return f"{self.root.rstrip('/')}/gt"

    @property
    def cards_dir(self) -> str:
        return self._at("cards")

    @property
    def out_dir(self) -> str:
        return self._at("out")

    @property
    def meta(self) -> str:
        return self._at("meta.json")

    def preds(self, stage: str, video: str = "*") -> str:
        return f"{self.preds_dir}/{video}_{stage}.{'jsonl' if stage == 'm1' else 'json'}"

    def gt(self, stage: str, video: str = "*") -> str:
        return f"{self.gt_dir}/{video}_{stage}.{'jsonl' if stage == 'm1' else 'json'}"

    def analysis_map(self, video: str = "*") -> str:
        return f"{self.analysis_dir}/{video}.map.json"

    def out(self, name: str) -> str:
        return f"{self.out_dir}/{name}"


#: States of a job and those that may follow.
STATES = {
    "uploaded": ("validated",),
    "validated": ("prepared", "needs_foster_pick"),
    "needs_foster_pick": ("prepared",),
    "prepared": ("rendering", "needs_mode_pick"),
    "needs_mode_pick": ("rendering",),
    "rendering": ("done",),
    "done": ("rendering",),
}


def advance(jobs, moves):
    """Jobs (job_id, state) with the moves (job_id, to) applied that their state allows; ``moved`` tells which were."""
    from pyspark.sql import functions as F

    allowed = F.create_map(*[x for s, t in STATES.items() for x in (F.lit(s), F.array(*map(F.lit, t)))])
    j = jobs.join(moves, "job_id", "left")
    ok = F.col("to").isNotNull() & F.coalesce(F.array_contains(F.element_at(allowed, F.col("state")), F.col("to")), F.lit(False))
    return j.select("job_id", F.when(ok, F.col("to")).otherwise(F.col("state")).alias("state"), ok.alias("moved"))
