"""Memory in use by the driver and the executors, as rows."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOG = logging.getLogger(__name__)


def process_mb() -> float:
    """Resident memory of this Python process in MB; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/status") as f:
            return next((int(line.split()[1]) / 1024 for line in f if line.startswith("VmRSS:")), 0.0)
    except OSError:
        return 0.0


def memory_usage(spark: SparkSession) -> DataFrame:
    """(place, used_mb, limit_mb): the driver's Python process and heap, and the storage memory of every executor."""
    context = spark.sparkContext
    runtime = context._jvm.java.lang.Runtime.getRuntime()
    mb = 1024.0 * 1024.0
    rows = [("driver python", process_mb(), None), ("driver heap", (runtime.totalMemory() - runtime.freeMemory()) / mb, runtime.maxMemory() / mb)]
    status = context._jsc.sc().getExecutorMemoryStatus().toList()
    for i in range(status.size()):
        entry = status.apply(i)
        most, free = entry._2()._1(), entry._2()._2()
        rows.append((f"storage {entry._1()}", (most - free) / mb, most / mb))
    return spark.createDataFrame(rows, "place string, used_mb double, limit_mb double")


@contextmanager
def watched(name: str) -> Iterator[None]:
    """Log the time and the memory of the driver's process around a step."""
    began, before = time.time(), process_mb()
    try:
        yield
    finally:
        _LOG.info("%s: %.1f s, %.1f MB before, %.1f MB after", name, time.time() - began, before, process_mb())
