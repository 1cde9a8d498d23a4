"""Evaluation over scales: quality of every engine, latency and throughput, written as JSON with a chart."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.metrics import tradeoffs
from weftwork.plans import apps, instrument

LOG = "weftwork.evaluation"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file (a report) on whatever file system ``path`` lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def engine_report(queries: DataFrame, engines: Mapping[str, apps.Engine], types: DataFrame, reference: str, k: int = 10, repeats: int = 1, concurrency: int = 1) -> list[dict]:
    """A row per engine: queries, precision, recall, and the measured latencies of the whole batch. Few rows."""
    quality = [r.asDict() for r in apps.evaluate(queries, engines, types, reference, k).collect()]
    for row in quality:
        engine = engines[row["engine"]]
        row |= instrument.measured([lambda e=engine: e(queries, k).write.format("noop").mode("overwrite").save()], repeats, concurrency)
    return quality


def fused_report(queries: DataFrame, recommenders: Mapping[str, apps.Engine], types: DataFrame, reference: str, k: int = 10, repeats: int = 1, concurrency: int = 1) -> list[dict]:
    """The same for recommenders of fused rankings; overlap is recall against the reference recommender."""
    return [{**{("overlap" if c == "recall" else c): v for c, v in r.items()}} for r in engine_report(queries, recommenders, types, reference, k, repeats, concurrency)]


def bar_chart(rows: list[dict], value: str, label: str = "engine", width: int = 480) -> str:
    """An SVG of horizontal bars of a small report."""
    most = max((float(r.get(value) or 0) for r in rows), default=0) or 1.0
    bars = []
    for n, r in enumerate(rows):
        x, y = float(r.get(value) or 0), 24 + 28 * n
        bars.append(f'<text x="4" y="{y + 14}">{escape(str(r[label]))}</text><rect x="150" y="{y}" width="{(width - 240) * x / most:.1f}" height="20"/><text x="{156 + (width - 240) * x / most:.1f}" y="{y + 14}">{x:.4g}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{32 + 28 * len(rows)}" font-family="sans-serif" font-size="12"><text x="4" y="14">{escape(value)}</text>{"".join(bars)}</svg>'


def over_scales(spark: SparkSession, scales: Mapping[str, str], report: Callable[[str], list[dict]], out: str, charts: tuple[str, ...] = ("precision", "recall", "mean_ms")) -> dict[str, list[dict]]:
    """``report(scale)`` of each scale whose artifacts (a path per scale) are there; the others are skipped and logged.

    Each report is written as JSON with its charts under ``out``, and ``summary.json`` has, over all scales, the best
    engine of each metric.
    """
    log = instrument.logging.getLogger(LOG)
    done: dict[str, list[dict]] = {}
    for scale, path in scales.items():
        if not exists(spark, path):
            log.warning("scale %s skipped: nothing at %s", scale, path)
            continue
        done[scale] = report(scale)
        write_text(spark, f"{out}/{scale}.json", json.dumps(done[scale], indent=1))
        for value in charts:
            if any(value in r for r in done[scale]):
                write_text(spark, f"{out}/{scale}-{value}.svg", bar_chart(done[scale], value))
    best = {}
    for scale, rows in done.items():
        frame = spark.createDataFrame([(r["engine"], float(r.get("precision") or 0), float(r.get("mean_ms") or 0)) for r in rows], "engine string, precision double, mean_ms double")
        best[scale] = {r["metric"]: r["best"] for r in tradeoffs(frame, ["mean_ms"], ["precision"]).collect()}
    write_text(spark, f"{out}/summary.json", json.dumps({"scales": list(done), "skipped": [s for s in scales if s not in done], "best": best}, indent=1))
    return done


def sorted_catalog(catalog: DataFrame) -> DataFrame:
    """The catalogue in the order of its ids, range-partitioned: no task sorts it whole."""
    return catalog.orderBy(F.col("product_id"))
