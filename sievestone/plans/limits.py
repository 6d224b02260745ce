"""Time limits for work on Spark: its jobs carry a tag, and jobs with it are cancelled once its time is up."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from sievestone.plans.service import TaskError

#: Seconds between two cancellations of work that has overrun, and that it gets to end in before it is left to itself.
PAUSE, GRACE = 0.2, 20.0


class Overrun(RuntimeError):
    """Work that took longer than it may; its jobs were stopped."""


def limited(spark: SparkSession, work: Callable[[], object], seconds: float):
    """What work() gives, if it gives it within so many seconds; else its Spark jobs are stopped and Overrun is raised.

    The work runs in a thread whose jobs carry a tag of their own, so no other job of the session is touched.  A job that begins
    after the time is up is stopped as well, also one that begins after this function has raised.
    """
    tag, box = f"sievestone-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            box["result"] = work()
        except BaseException as e:  # raised again where the caller waits
            box["error"] = e
        finally:
            spark.sparkContext.removeJobTag(tag)

    def stop() -> None:
        while thread.is_alive():
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(PAUSE)

    thread = InheritableThread(target=run, session=spark, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        stopper = threading.Thread(target=stop, daemon=True)
        stopper.start()
        stopper.join(GRACE)
        raise Overrun(f"took more than {seconds:g} seconds")
    if "error" in box:
        raise box["error"]
    return box["result"]


def attempts(spark: SparkSession, work: Callable[[], object], seconds: float, name: str, tries: int = 2) -> tuple[object, dict]:
    """(what work() gives, how it ran), with a time limit and at most so many tries.

    A failure of the work itself (TaskError) is final; work that overruns or dies, as with its executors, is tried again.  After
    the last try it fails as ALGORITHM_ERROR and tells why.
    """
    log = []
    for attempt in range(1, tries + 1):
        began = time.monotonic()
        try:
            found = limited(spark, work, seconds)
        except TaskError:
            raise
        except Exception as e:  # whatever it is, the next try may do without it
            log.append(f"{name}, try {attempt}: {type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}")
            continue
        return found, {"attempt": attempt, "wall_ms": round(1000 * (time.monotonic() - began)), "failed_tries": log}
    raise TaskError("ALGORITHM_ERROR", f"{name} failed {tries} times; {log[-1]}", log=log)
