"""Workflows: named steps with dependencies over DataFrames, batches of items with a limit on concurrency."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import DataFrame, SparkSession

#: Handler of a step: (input, results of its dependencies by name) to a result.
Handler = Callable[[object, dict[str, object]], object]


@dataclass
class Step:
    name: str
    handler: Handler
    dependencies: tuple[str, ...] = ()
    timeout: float = 300.0
    required: bool = True


@dataclass
class Outcome:
    """status is completed or failed; a step's own is completed, failed or cancelled."""

    status: str
    results: dict[str, object] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    steps: dict[str, str] = field(default_factory=dict)


def run_workflow(steps: list[Step], given: object, concurrent: int = 4) -> Outcome:
    """Runs every step as soon as its dependencies have ended, several at a time.

    A step that raises or overruns its timeout fails; if it is required, so does the workflow. A step whose dependency failed
    is run all the same with that result missing if the dependency was optional, and cancelled if it was required. A step
    that depends on an unknown one is cancelled. Steps are driver-side plans: what they return is lazy until a later action.
    """
    by_name = {s.name: s for s in steps}
    out, pending, ended = Outcome("completed"), dict(by_name), set()
    pool = ThreadPoolExecutor(max_workers=concurrent)
    running: dict = {}

    def fail(step: Step, why: str, status: str = "failed") -> None:
        out.steps[step.name] = status
        ended.add(step.name)
        if step.required or status == "cancelled":
            out.errors[step.name] = why

    try:
        while pending or running:
            for name, step in list(pending.items()):
                broken = [d for d in step.dependencies if d not in by_name or out.steps.get(d) == "cancelled" or (out.steps.get(d) == "failed" and by_name[d].required)]
                if broken:
                    del pending[name]
                    fail(step, f"dependency failed: {broken}", "cancelled")
                elif all(d in ended for d in step.dependencies) and len(running) < concurrent:
                    del pending[name]
                    needed = {d: out.results.get(d) for d in step.dependencies}
                    running[pool.submit(step.handler, given, needed)] = (step, monotonic())
            if not running:
                if pending and not any(all(d in ended for d in s.dependencies) for s in pending.values()):
                    for step in list(pending.values()):  # a circle
                        fail(step, "dependencies never end", "cancelled")
                    pending.clear()
                continue
            left = min(s.timeout - (monotonic() - t) for s, t in running.values())
            done, _ = wait(running, timeout=max(0.0, left), return_when=FIRST_COMPLETED)
            for future in done:
                step, _ = running.pop(future)
                try:
                    out.results[step.name] = future.result()
                    out.steps[step.name] = "completed"
                    ended.add(step.name)
                except Exception as e:  # any failure of a step is its own
                    fail(step, str(e))
            for future, (step, began) in list(running.items()):
                if monotonic() - began >= step.timeout:
                    running.pop(future)
                    future.cancel()
                    fail(step, f"timeout after {step.timeout} s")
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    out.status = "failed" if out.errors else "completed"
    return out


def report(spark: SparkSession, name: str, steps: list[Step], given: object) -> DataFrame:
    """(pipeline, stage, status, metric, value) of a workflow whose steps give one-row DataFrames of numbers.

    Stages are isolated: one that fails has a row of its own, with its error as metric and no value.
    """
    done = run_workflow(steps, given)
    rows = []
    for step in steps:
        status, found = done.steps[step.name], done.results.get(step.name)
        try:
            metrics = found.first().asDict() if found is not None else {}
        except Exception as e:  # a lazy plan that fails when it runs
            status, metrics = "failed", {}
            done.errors[step.name] = str(e).splitlines()[0]
        rows += [(name, step.name, status, k, float(v) if v is not None else None) for k, v in metrics.items()]
        if status != "completed":
            rows.append((name, step.name, status, done.errors.get(step.name, ""), None))
    return spark.createDataFrame(rows, "pipeline string, stage string, status string, metric string, value double")


def process_batch(items: DataFrame, processor: Callable[[object], object], key: str, value: str, concurrent: int = 8, timeout: float = 30.0) -> DataFrame:
    """(key, result, error) of a Python function over a column's values, `concurrent` at a time in each task.

    A value whose call raises, or doesn't end in time, has an error and no result; all others are unaffected. Results are texts.
    """
    import pandas as pd

    def run(batches):
        pool = ThreadPoolExecutor(max_workers=concurrent)
        try:
            for pdf in batches:
                calls = [pool.submit(processor, x) for x in pdf[value]]
                results, errors = [], []
                for call in calls:
                    try:
                        results.append(str(call.result(timeout=timeout)))
                        errors.append(None)
                    except Exception as e:  # an item's failure is its own
                        results.append(None)
                        errors.append(str(e) or type(e).__name__)
                yield pd.DataFrame({key: pdf[key], "result": results, "error": errors})
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return items.select(key, value).mapInPandas(run, f"{key} {dict(items.dtypes)[key]}, result string, error string")
