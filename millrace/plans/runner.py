"""Running an action under a name, with hooks before, records during and counters after it."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.metrics import Counters, report
from millrace.plans.naming import checked_name
from millrace.sources.files import Files


class RunRecorder(Protocol):
    """Told about a run's course; any method may do nothing."""

    def on_running(self, name: str) -> None: ...

    def on_counters(self, name: str, counters: dict[str, dict[str, int]]) -> None: ...

    def on_finished(self, name: str, seconds: float, error: str | None) -> None: ...


class NoRecorder:
    def on_running(self, name: str) -> None:
        pass

    def on_counters(self, name: str, counters: dict[str, dict[str, int]]) -> None:
        pass

    def on_finished(self, name: str, seconds: float, error: str | None) -> None:
        pass


#: Called with the session and the run's name before it starts.
Hook = Callable[[SparkSession, str], None]


def describe_job(spark: SparkSession, name: str) -> None:
    """The standard hook: Spark shows the run under its name."""
    spark.sparkContext.setJobDescription(name)


def check_serialises(*functions: Callable) -> None:
    """Fail before anything is submitted if a function can't be sent to executors."""
    for f in functions:
        try:
            cloudpickle.dumps(f)
        except Exception as e:
            raise TypeError(f"{getattr(f, '__name__', f)} can't be sent to executors: {e}") from e


@dataclass
class Runner:
    """Runs actions one after another; ``fail_on_counters`` raises if counters can't be had."""

    spark: SparkSession
    hooks: Sequence[Hook] = (describe_job,)
    recorder: RunRecorder = field(default_factory=NoRecorder)
    fail_on_counters: bool = False
    checkpointed: bool = False

    def run(self, name: str, action: Callable[[], Any], counters: Counters | None = None, functions: Sequence[Callable] = ()) -> tuple[Any, str]:
        """The action's result and the run's report.

        ``functions`` that the plan sends to executors are checked before anything is submitted.
        """
        if self.checkpointed:
            checked_name(name)
        check_serialises(*functions)
        for hook in self.hooks:
            hook(self.spark, name)
        self.spark.sparkContext.addJobTag(f"run-{checked_tag(name)}")
        self.recorder.on_running(name)
        began, error = time.monotonic(), None
        try:
            result = action()
            found: dict[str, dict[str, int]] = {}
            try:
                found = counters.by_group() if counters else {}
            except Exception:
                if self.fail_on_counters:
                    raise
            self.recorder.on_counters(name, found)
            return result, report(found)
        except Exception:
            error = traceback.format_exc(limit=3)
            raise
        finally:
            self.spark.sparkContext.removeJobTag(f"run-{checked_tag(name)}")
            self.recorder.on_finished(name, time.monotonic() - began, error)

    def step(self, name: str, build: Callable[[], DataFrame], folder: str, functions: Sequence[Callable] = ()) -> DataFrame:
        """The step's table, written as Parquet below ``folder`` under its name; one that an earlier run finished is read instead.

        So a run that failed goes on after its last whole step.
        """
        path = f"{folder.rstrip('/')}/{checked_name(name)}"
        if not Files(self.spark).exists(f"{path}/_SUCCESS"):
            self.run(name, lambda: build().write.mode("overwrite").parquet(path), functions=functions)
        return self.spark.read.parquet(path)

    def stop(self, name: str) -> None:
        """Cancel the jobs of a run, from another thread."""
        self.spark.sparkContext.cancelJobsWithTag(f"run-{checked_tag(name)}")


def checked_tag(name: str) -> str:
    return name.replace(",", ";") or "unnamed"
