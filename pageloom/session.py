"""Session settings the jobs are planned for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A page is one row of a few KB to a few MB of HTML that grows tenfold as nodes.
    "spark.sql.files.maxPartitionBytes": "64m",
}


def local_session(cores: str = "*", **extra: str) -> SparkSession:
    """Local session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pageloom")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# A plan over rows that no file states the size of counts as this much or more.
_UNKNOWN = 1 << 50


def stored_bytes(frame: DataFrame) -> int:
    """What the tables below `frame` say they hold."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(frame: DataFrame, bytes_a_core: int = 128 << 20) -> DataFrame:
    """Rows of an input of few splits dealt over all cores; a large input has splits enough and stays where it is read.

    Few is what its tables say they hold, less than `bytes_a_core` for each core. Files of one row group would
    otherwise keep one core busy each, whatever is done to their rows.
    """
    size, cores = stored_bytes(frame), frame.sparkSession.sparkContext.defaultParallelism
    if cores == 1 or size > cores * bytes_a_core:
        return frame
    return frame.repartition(cores if size <= cores * (8 << 20) else 3 * cores)


def deal_pages(frame: DataFrame, pages: DataFrame) -> DataFrame:
    """`frame`, one row per page of `pages`, placed by page, over more parts as the tables grow.

    A page takes many times the memory once its nodes are rows that shuffled bytes would tell, and a narrow table makes
    pages a thousand times its own size. So parts are counted by what is stored, and are not put together again
    after the shuffle unless the tables are small.
    """
    size, least = stored_bytes(pages), int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not (1 << 20) <= size < _UNKNOWN:
        return frame.repartition("page_id", "page_hash")
    return frame.repartition(max(least, min(size // (64 << 10), 2000 + size // (2 << 20))), "page_id", "page_hash")
