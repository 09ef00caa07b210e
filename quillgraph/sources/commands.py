"""Commands run on the driver: benchmark adapters and rebuild hooks."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Names under which a command finds what it is to run.
ENV_RUN, ENV_BENCHMARK, ENV_RESULT, ENV_WORKDIR = "BENCHMARK_RUN_ID", "BENCHMARK_ID", "BENCHMARK_RESULT_PATH", "BENCHMARK_WORKDIR"
SCORES = "run_id string, benchmark_id string, status string, summary string, metric string, value double, unit string"


@dataclass
class RunRequest:
    run_id: str
    benchmark_id: str
    command: str
    workdir: str = "."
    env: dict[str, str] = field(default_factory=dict)
    timeout: float = 3600.0


def run_benchmark(request: RunRequest, result: Path) -> dict:
    """Run a benchmark's command in a shell and read the result that it writes: ``status, summary, scores``.

    A command that can't start, ends with an error, writes nothing or writes
    something else than the agreed JSON gives a run of the status
    ``launch_failed``, ``command_failed``, ``missing_result`` or
    ``invalid_result`` without scores.
    """
    failed = lambda status, summary: {"run_id": request.run_id, "benchmark_id": request.benchmark_id, "status": status, "summary": summary, "scores": []}
    own = {ENV_RUN: request.run_id, ENV_BENCHMARK: request.benchmark_id, ENV_RESULT: str(result), ENV_WORKDIR: request.workdir}
    try:
        done = subprocess.run(["sh", "-c", request.command], cwd=request.workdir, env=os.environ | request.env | own, capture_output=True, text=True, timeout=request.timeout)
    except (OSError, subprocess.TimeoutExpired) as e:
        return failed("launch_failed", str(e))
    if done.returncode:
        return failed("command_failed", f"exit code {done.returncode}: {done.stderr.strip()[-500:]}")
    if not result.is_file():
        return failed("missing_result", "the command wrote no result")
    try:
        found = json.loads(result.read_text())
        scores = [{"metric": str(s["metric_id"]), "value": float(s["value"]), "unit": str(s["unit"])} for s in found["scores"]]
        return {"run_id": request.run_id, "benchmark_id": request.benchmark_id, "status": str(found["status"]), "summary": str(found["summary"]), "scores": scores}
    except (ValueError, KeyError, TypeError) as e:
        return failed("invalid_result", f"{type(e).__name__}: {e}")


def score_rows(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """A row for each score of runs; a run without scores has one row with nulls."""
    rows = [(r["run_id"], r["benchmark_id"], r["status"], r["summary"], s.get("metric"), s.get("value"), s.get("unit")) for r in runs for s in (r["scores"] or [{}])]
    return spark.createDataFrame(rows, SCORES)


def rebuild(command: str | None, workdir: str = ".") -> str:
    """Run a rebuild hook: ``rebuilt``, or ``skipped`` if there is none or it fails."""
    if not command:
        return "skipped"
    try:
        return "skipped" if subprocess.run(["sh", "-c", command], cwd=workdir, capture_output=True).returncode else "rebuilt"
    except OSError:
        return "skipped"
