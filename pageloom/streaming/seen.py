"""Ids that earlier batches have cleaned, as runs of sorted files that are merged as they grow.

Every batch adds one run of its own ids. `FAN` runs of a level become one run of the next, cut into files by ranges of
ids, so n batches leave some FAN * log n runs and an id is written log n times. A run lists the range of each of its files; a batch
opens only the files whose range it meets: none of the old ones where ids rise, and never more than the
runs hold, however many batches there were.

A batch may run again after a loss. It then overwrites its own run, and it neither reads nor merges runs of its own
number: whatever is merged belongs to batches that are done. A merge that broke off leaves ids twice, which changes nothing.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sinks.writers import remove_folder

FAN = 8
FILE_ROWS = 1_000_000
SLICES = 64


class Run(NamedTuple):
    level: int
    first: int
    last: int
    path: str


def folder_of(output: str) -> str:
    """Beside the batches; readers of the output pass over names with an underscore."""
    return f"{output.rstrip('/')}/_seen"


def runs(spark: SparkSession, output: str) -> list[Run]:
    """The finished runs below an output folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder_of(output))
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(root):
        return []
    found = []
    for status in files.listStatus(root):
        name = re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", status.getPath().getName())
        # The list of ranges is written last.
        if name and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_ranges/_SUCCESS")):
            found.append(Run(*map(int, name.groups()), status.getPath().toString()))
    return sorted(found)


def _write(ids: DataFrame, path: str, rows: int) -> None:
    files = max(1, -(-rows // FILE_ROWS))
    sorted_ids = ids.repartitionByRange(files, "page_id").sortWithinPartitions("page_id")
    sorted_ids.write.mode("overwrite").parquet(f"{path}/ids")
    written = ids.sparkSession.read.schema("page_id bigint").parquet(f"{path}/ids")
    ranges = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/_ranges")


def remember(spark: SparkSession, output: str, batch_id: int, ids: DataFrame) -> None:
    """Add the ids (page_id) of a batch as a run of its own."""
    ids = ids.filter("page_id IS NOT NULL").select("page_id").distinct()
    _write(ids, f"{folder_of(output)}/run-0-{batch_id}-{batch_id}", ids.count())


def merge(spark: SparkSession, output: str, batch_id: int) -> None:
    """Merge full levels, as far as their batches came before this one."""
    level = 0
    while True:
        done = [r for r in runs(spark, output) if r.last < batch_id]
        here = [r for r in done if r.level == level]
        if len(here) < FAN:
            if all(r.level <= level for r in done):
                return
        else:
            ids = spark.read.schema("page_id bigint").parquet(*(f"{r.path}/ids" for r in here)).distinct()
            target = f"{folder_of(output)}/run-{level + 1}-{here[0].first}-{max(r.last for r in here)}"
            _write(ids, target, ids.count())
            for run in here:
                remove_folder(spark, run.path)
        level += 1


def files_met(spark: SparkSession, output: str, batch_id: int, ids: DataFrame) -> list[str]:
    """Files of earlier batches whose range holds some id of this one, judged by `SLICES` ranges of its ids."""
    before = [r for r in runs(spark, output) if r.last < batch_id]
    if not before:
        return []
    ranges = spark.read.parquet(*(f"{r.path}/_ranges" for r in before)).collect()  # one row a file
    dealt = ids.select("page_id").filter("page_id IS NOT NULL").repartitionByRange(SLICES, "page_id")
    slices = dealt.groupBy(F.spark_partition_id().alias("slice")).agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    mine = slices.select("low", "high").collect()  # at most SLICES rows
    return sorted({r.file for r in ranges if any(s.low <= r.high and r.low <= s.high for s in mine)})


def seen_before(spark: SparkSession, output: str, batch_id: int, ids: DataFrame) -> DataFrame | None:
    """`page_id` of earlier batches, from the files that this batch's ids (page_id) may meet; None when there are none."""
    files = files_met(spark, output, batch_id, ids)
    return spark.read.schema("page_id bigint").parquet(*files) if files else None
