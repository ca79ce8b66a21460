"""Session construction with library defaults, overrides and property checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Settings every session gets unless the caller overrides them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Marks a property that must be present, whatever its value.
REQUIRED = object()


def merge_properties(defaults: Mapping[str, str], overrides: Mapping[str, str] | None) -> dict[str, str]:
    """Defaults updated by overrides: the caller's value always wins."""
    return {**defaults, **(overrides or {})}


def check_properties(properties: Mapping[str, str], rules: Mapping[str, object]) -> None:
    """Refuse a property map before anything is built from it.

    ``rules`` maps a property to a forbidden value, to a collection of them, or
    to :data:`REQUIRED` if it only has to be there.
    """
    for key, rule in rules.items():
        value = properties.get(key)
        if rule is REQUIRED:
            if value is None:
                raise ValueError(f"property {key} is required")
        elif value in (rule if isinstance(rule, (set, frozenset, list, tuple)) else (rule,)):
            raise ValueError(f"property {key} must not be {value!r}")


def build_session(
    app_name: str = "millrace",
    master: str | None = None,
    properties: Mapping[str, str] | None = None,
    rules: Mapping[str, object] | None = None,
) -> SparkSession:
    """A session with :data:`DEFAULTS`, ``properties`` over them, checked against ``rules``."""
    merged = merge_properties(DEFAULTS, properties)
    check_properties(merged, rules or {})
    builder = SparkSession.builder.appName(app_name).config(map=merged)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that the driver and all executors share.

    Where it is unset, as in tests, a local folder becomes it, but only if all
    tasks run in this machine's one process; a cluster must name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has; what is written there goes when the driver ends, also after a failure."""
    top = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{top}/{label}"
