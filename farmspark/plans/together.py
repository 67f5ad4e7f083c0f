"""Independent frames built at the same time.

A rule writes its key sets while its frame is built, each a small job that
waits for the one before.  Rules that do not depend on each other are built in
threads of the driver, so that their jobs share the executors; the threads hold
plans only, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

V = TypeVar("V")

#: jobs submitted side by side
THREADS = 8


def together(spark: SparkSession, *builders: Callable[[], V]) -> list[V]:
    """The results of ``builders`` in their order; the first error is raised
    after the others have ended.  Threads take over the caller's job group and
    local properties."""
    if len(builders) < 2:
        return [b() for b in builders]
    with ThreadPoolExecutor(min(THREADS, len(builders))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(b)) for b in builders]
    return [r.result() for r in running]
