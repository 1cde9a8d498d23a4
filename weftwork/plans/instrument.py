"""What a plan does: its text, the sums of its metrics, and the time it takes. Logging in one place."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

#: Metrics that are summed over all nodes of a plan, by the name the engine gives them.
SUMMED = {"filesSize": "bytes_read", "numFiles": "files_read", "shuffleBytesWritten": "shuffle_bytes", "spillSize": "spill_bytes"}


def set_up_logging(level: str = "INFO") -> logging.Logger:
    """The root logger with time, level and place; what was set up before is replaced. Gives the library's logger."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
    return logging.getLogger("weftwork")


def explained(df: DataFrame) -> str:
    """The formatted physical plan, without running it."""
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def figures(df: DataFrame) -> dict[str, int]:
    """Runs the plan once and sums its metrics over the whole tree: rows, bytes read, shuffled and spilled, nodes."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = plan.execute().count()
    out = {"rows": rows, "nodes": 0} | dict.fromkeys(SUMMED.values(), 0)
    waiting, seen = [plan], set()
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if node.id() in seen:
            continue
        seen.add(node.id())
        out["nodes"] += 1
        metrics = node.metrics().iterator()
        while metrics.hasNext():
            pair = metrics.next()
            if (name := SUMMED.get(pair._1())) and pair._2().value() > 0:
                out[name] += pair._2().value()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        children = node.children().iterator()
        while children.hasNext():
            waiting.append(children.next())
    return out


def place(n: int) -> int:
    """The place of the 95th percentile among n sorted samples, from 0."""
    return min(n - 1, max(0, round(0.95 * n + 0.5) - 1))


def measured(tasks: Sequence[Callable[[], object]], repeats: int = 1, concurrency: int = 1) -> dict[str, float]:
    """Latencies in milliseconds and throughput per second of driver-side tasks, run in a thread pool.

    Each task is one whole query or batch; Spark runs as many jobs at once as there are threads.
    """
    taken: list[float] = []

    def run(task: Callable[[], object]) -> None:
        began = time.perf_counter()
        task()
        taken.append((time.perf_counter() - began) * 1e3)

    began = time.perf_counter()
    with ThreadPoolExecutor(concurrency) as pool:
        for done in [pool.submit(run, t) for _ in range(repeats) for t in tasks]:
            done.result()
    wall = time.perf_counter() - began
    if not taken:
        return {"count": 0}
    s = sorted(taken)
    middle = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    return {"count": len(s), "mean_ms": sum(s) / len(s), "median_ms": middle, "p95_ms": s[place(len(s))], "least_ms": s[0], "most_ms": s[-1], "per_second": len(s) / wall if wall else 0.0}
