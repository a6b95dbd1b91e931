"""Driver-side orchestration: the phases of a pipeline run, retries, and the sweep's watermark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PHASES = ("reembed", "scrape", "embed", "dedup", "done")


@dataclass(frozen=True)
class Run:
    """State of a pipeline run. ``waits`` counts polls of the scrape phase, ``hops`` all steps; at their limits the run fails."""

    phase: str = "scrape"
    status: str = "running"
    waits: int = 0
    hops: int = 0
    error: str | None = None


def advance(run: Run, ready: bool, remaining: int, max_waits: int = 12, max_hops: int = 10_000) -> Run:
    """One step: scrape waits until ``ready``, the other phases repeat while work is ``remaining``."""
    if run.status != "running":
        return run
    if run.hops >= max_hops:
        return replace(run, status="failed", error="too many hops")
    run = replace(run, hops=run.hops + 1)
    if run.phase == "scrape" and not ready:
        if run.waits + 1 >= max_waits:
            return replace(run, waits=run.waits + 1, status="failed", error="the scrape did not get ready")
        return replace(run, waits=run.waits + 1)
    if run.phase != "scrape" and remaining > 0:
        return run
    following = PHASES[PHASES.index(run.phase) + 1]
    return replace(run, phase=following, waits=0, status="done" if following == "done" else "running")


class Permanent(Exception):
    """An error that no repetition mends."""


def deliver(handler: Callable, message, attempts: int = 3, terminal: Callable | None = None) -> bool:
    """At-least-once delivery: up to ``attempts`` calls, one for a permanent error; then the terminal hook. True on success."""
    for k in range(attempts):
        try:
            handler(message)
            return True
        except Permanent as error:
            last = error
            break
        except Exception as error:  # noqa: BLE001
            last = error
    if terminal:
        terminal(message, last)
    return False


def outage(attempted: int, failed: int) -> bool:
    """A sweep in which every lookup failed must not advance its cursor; a partial failure may."""
    return attempted > 0 and failed == attempted


class HighWater:
    """A stored mark up to which pairs have been judged: a table of marks below ``path``, of which the largest holds. It moves
    after a sweep that was no outage, never back, and a repeated call changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> int | None:
        rows = self.spark.read.schema("mark long").option("ignoreMissingFiles", True)
        try:
            return rows.parquet(self.path).agg(F.max("mark")).first()[0]
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def advance(self, mark: int, attempted: int, failed: int) -> bool:
        before = self.read()
        if outage(attempted, failed) or before is not None and mark <= before:
            return False
        self.spark.createDataFrame([(mark,)], "mark long").write.mode("append").parquet(self.path)
        return True
