"""Keeping term statistics and latest chunks up to date from a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftwork.operators.maintain import replace_partitions
from weftwork.operators.textindex import term_counts, tokenized
from weftwork.storage import cut, remove_path


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n): events per window; later ones than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def maintain_postings(chunks: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upsert each batch's raw postings (chunk_id, product_id, term, n) into a table bucketed by chunk.

    Only the buckets that a batch touches are read and replaced; more buckets make a small batch rewrite less. A chunk
    delivered twice in a batch counts once (the greatest row stands), one that comes again replaces its old postings, and
    one that comes again empty loses them, also where its bucket is left without rows.
    """
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int").alias("bucket")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != "chunk_id"]
        once = cut(batch.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct(*rest)).alias("row")).select("chunk_id", "row.*"))
        new = term_counts(tokenized(once)).withColumn("bucket", bucket)
        touched = {r[0] for r in once.select(bucket).distinct().collect()}  # at most ``buckets`` rows
        try:
            old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
            kept = old.join(once.select("chunk_id"), "chunk_id", "left_anti").select(*new.columns)
            rows = cut(kept.unionByName(new))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = cut(new)
        replace_partitions(rows, path, ["bucket"])
        for empty in touched - {r[0] for r in rows.select("bucket").distinct().collect()}:
            remove_path(spark, f"{path}/bucket={empty}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
