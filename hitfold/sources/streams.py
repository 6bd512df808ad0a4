"""Whole files as streams of bytes, from any file system that Spark reads, in memory that does not depend on their size.

Spark's text reader opens, decompresses and splits a file at newlines without looking at what the lines hold. A task that gets the lines of a file in
order has the file's bytes: archives of any format can be read forward from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the ending by which a file is decompressed and never split.
_ONE_TASK = r"(?i)\.gz$"


def ordered_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(file_path, value binary): the lines of every file, each file's in order and within one task.

    A file that ends in ``.gz`` is decompressed and read by one task. Spark splits all others; their lines are brought together by an external
    sort, so that a file of any size passes through one task line by line.
    """
    rows = spark.read.options(**options).option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_from"), F.col("value").cast("binary").alias("value"))
    whole = F.col("file_path").rlike(_ONE_TASK)
    split = rows.where(~whole).withColumn("_row", F.monotonically_increasing_id())
    dealt = split.repartition("file_path").sortWithinPartitions("file_path", "_from", "_row")
    return rows.where(whole).select("file_path", "value").unionByName(dealt.select("file_path", "value"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Inside a task: (file_path, bytes) pieces of the files that ``ordered_lines`` deals out. A newline is added to a last line without one."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index("value"))
        runs = batch.column(batch.schema.get_field_index("file_path")).cast(pa.string())
        start = 0
        for end in _ends(runs):
            yield runs[start].as_py(), b"\n".join(values.slice(start, end - start).to_pylist()) + b"\n"
            start = end


def _ends(paths: pa.Array) -> list[int]:
    """Where runs of equal paths end."""
    return pa.compute.run_end_encode(paths).run_ends.to_pylist() if len(paths) else []
