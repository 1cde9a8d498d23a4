"""How often every distinct term occurs in a collection, and in how many records.

Recursive radix spilling: each task counts the terms of its batches, and spills the counts to the shared folder,
partitioned by the first bits of the term's hash. Partitions over ``leaf_rows`` are split by the next bits, again and
again, until they fit or hold one term only. Each leaf is then aggregated by DuckDB under a memory limit, which
spills to the shared folder itself when it must.

Terms are the maximal runs of a-z and 0-9 of the lower-cased text, with one apostrophe and a further run if they follow
directly. A record is a key whose text is neither null nor blank. ``mark`` is ``rare`` below ``rare_below`` records,
``common`` above ``common_share`` of all records (``rare`` where both hold), else null.

Defined results: null and blank texts are no records; rows with a null key are dropped; rows delivered again count
once; a text without terms is a record; other columns are ignored; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from math import ceil, log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.sets import latest
from weftwork.storage import cut, remove_path, scratch_path

TERM = r"[a-z0-9]+(?:'[a-z0-9]+)?"
#: Bits of the hash taken at a level, at least and at most; at most this many levels; counted rows that one leaf may hold; its memory.
BITS, MOST_BITS, LEVELS, LEAF_ROWS, LEAF_MB = 4, 10, 12, 2_000_000, 400
#: A task spills its counter when it holds so many terms.
HELD = 200_000
#: The row that carries the number of records; no term is empty.
RECORDS = ""
SPILLED = "digest long, term string, occurrences long, records long"


def counted(texts: DataFrame) -> DataFrame:
    """Counts of each task, flushed whenever its counter is full: ``texts`` has one column."""
    pattern = re.compile(TERM)

    def rows(occurrences: Counter, records: Counter) -> pa.RecordBatch:
        terms = list(records)
        digests = [xxhash.xxh3_64_intdigest(t) >> 1 for t in terms]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(terms, pa.string()), pa.array([occurrences[t] for t in terms], pa.int64()), pa.array([records[t] for t in terms], pa.int64())], ["digest", "term", "occurrences", "records"])

    def run(batches):
        occurrences: Counter = Counter()
        records: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or not text.strip():
                    continue
                found = pattern.findall(text.lower())
                occurrences.update(found)
                records.update({RECORDS, *found})
                if len(records) > HELD:
                    yield rows(occurrences, records)
                    occurrences, records = Counter(), Counter()
        if records:
            yield rows(occurrences, records)

    return texts.mapInArrow(run, SPILLED)


def radix(begin: int, bits: int):
    """So many bits of the digest behind the first ``begin`` of its 63 bits."""
    return F.shiftright("digest", 63 - begin - bits).bitwiseAND(2**bits - 1).cast("int")


def leaves(df: DataFrame, root: str, leaf_rows: int, bits: int = BITS, levels: int = LEVELS) -> list[str]:
    """Spill ``df`` under ``root`` and split what is too large; the folders of the leaves.

    One job per level splits all its oversized folders, by as many bits (at least ``bits``, at most ``MOST_BITS``) as the
    largest of them needs. Only one row of sizes per folder reaches the driver.
    """
    spark, done, part, taken, columns = df.sparkSession, [], df, 0, []
    for level in range(levels):
        columns.append(f"r{level}")
        path, bits = f"{root}/level-{level}", min(bits, 63 - taken)
        part.withColumn(columns[-1], radix(taken, bits)).write.partitionBy(*columns).parquet(path)
        taken += bits
        spilled = spark.read.schema(SPILLED + "".join(f", {c} int" for c in columns)).parquet(path)
        sizes = spilled.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), (F.min("digest") == F.max("digest")).alias("one")).collect()
        large = []
        for s in sizes:
            folder = "/".join([path, *(f"{c}={s[c]}" for c in columns)])
            (done if s["n"] <= leaf_rows or s["one"] or level + 1 == levels or taken >= 63 else large).append((folder, s["n"]))
        if not large:
            break
        part = spark.read.schema(SPILLED + "".join(f", {c} int" for c in columns)).option("basePath", path).parquet(*[f for f, _ in large])
        bits = max(bits, min(MOST_BITS, ceil(log2(max(n for _, n in large) / leaf_rows)) + 1))
    return [f for f, _ in done]


def summed(df: DataFrame, root: str, folders: list[str], leaf_mb: int = LEAF_MB) -> DataFrame:
    """(term, occurrences, records): every leaf by one DuckDB, one task per leaf."""
    spark = df.sparkSession
    if not folders:
        return spark.createDataFrame([], "term string, occurrences long, records long")
    local = root.split(":", 1)[1] if root.startswith("file:") else (root if root.startswith("/") else None)

    def run(batches):
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
                leaf = ds.dataset(path, filesystem=system, format="parquet", schema=pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))
                with duckdb.connect() as con:
                    con.execute(f"SET threads = 1; SET memory_limit = '{leaf_mb}MB'")
                    if local:
                        con.execute(f"SET temp_directory = '{local}/duck-{uuid.uuid4().hex}'")
                    con.register("leaf", leaf)
                    con.execute("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM leaf GROUP BY term")
                    while rows := con.fetchmany(50_000):
                        terms, occurrences, records = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["term", "occurrences", "records"])

    paths = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 10_000), "folder")
    return paths.mapInArrow(run, "term string, occurrences long, records long")


def frequencies(df: DataFrame, key: str, text: str, rare_below: int = 3, common_share: float = 0.25, leaf_rows: int = LEAF_ROWS, bits: int = BITS) -> DataFrame:
    """(term, occurrences, records, mark) of every term of the collection."""
    root = scratch_path(df.sparkSession, "terms")
    texts = latest(df, key, text).select(F.col(text).cast("string"))
    try:
        total = cut(summed(df, root, leaves(counted(texts), root, leaf_rows, bits)))
    finally:
        remove_path(df.sparkSession, root)
    records = total.where(F.col("term") == RECORDS).agg(F.max("records").alias("all_records"))  # one row
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_share * F.col("all_records"), "common")
    return total.where(F.col("term") != RECORDS).crossJoin(F.broadcast(records)).select("term", "occurrences", "records", mark.alias("mark"))
