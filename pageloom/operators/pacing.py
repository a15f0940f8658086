"""Request pacing: when each request may go out if a host wants a minimum gap.

send(i) = max(arrival(i), send(i-1) + gap) unrolls to i*gap + max over j <= i of
(arrival(j) - j*gap). A busy host is cut into time slices: each slice numbers and maximises
its own requests, and only one row per slice meets the others of the host. A slice that holds a burst is cut further, by the
number of requests before: its requests are counted in bins of time, and every `slice_rows` of them start a new part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing
SLICE_ROWS = 100_000
BINS = 1 << 16


def _cuts(sliced: DataFrame, host: str, slice_rows: int) -> DataFrame:
    """`cut_host, cut_slice, cut_bin, part` of the bins of slices with more than `slice_rows` requests; nothing where no slice has."""
    counted = sliced.groupBy(host, "slice", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(host, "slice")
    before = F.sum("n").over(whole.orderBy("bin").rowsBetween(FIRST, 0)) - F.col("n")
    counted = counted.select("*", F.sum("n").over(whole).alias("all"), before.alias("before"))
    return counted.filter(F.col("all") > slice_rows).select(
        F.col(host).alias("cut_host"), F.col("slice").alias("cut_slice"), F.col("bin").alias("cut_bin"), F.floor(F.col("before") / slice_rows).alias("part")
    )


def pace_requests(
    requests: DataFrame, host: str, arrival_us: str, tie: str, gap_us: int, slice_us: int = 60_000_000, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add `send_us` (integer microseconds). `tie` orders requests that arrive together and is unique."""
    sliced = requests.withColumn("slice", F.floor(F.col(arrival_us) / slice_us))
    width = max(1, slice_us // BINS)
    sliced = sliced.withColumn("bin", F.floor((F.col(arrival_us) - F.col("slice") * slice_us) / width))
    cuts = _cuts(sliced, host, slice_rows)
    same_bin = F.col(host).eqNullSafe(F.col("cut_host")) & F.col("slice").eqNullSafe(F.col("cut_slice")) & F.col("bin").eqNullSafe(F.col("cut_bin"))
    parted = sliced.join(cuts, same_bin, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    in_part = Window.partitionBy(host, "slice", "part").orderBy(arrival_us, tie)
    local = parted.withColumn("nth", F.row_number().over(in_part).cast("bigint") - 1)
    lead = F.col(arrival_us) - F.col("nth") * gap_us
    local = local.withColumns(
        {
            "lead_here": F.max(lead).over(in_part.rowsBetween(FIRST, 0)),
            "lead_part": F.max(lead).over(in_part.rowsBetween(FIRST, LAST)),
            "size": F.count("*").over(in_part.rowsBetween(FIRST, LAST)),
        }
    )
    parts = local.filter(F.col("nth") == 0).select(host, "slice", "part", "lead_part", "size")
    earlier = Window.partitionBy(host).orderBy("slice", "part").rowsBetween(FIRST, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    parts = parts.withColumn("lead_before", F.max(F.col("lead_part") - F.col("before") * gap_us).over(earlier))
    parts = parts.select(F.col(host).alias("of_host"), F.col("slice").alias("of_slice"), F.col("part").alias("of_part"), "before", "lead_before")
    same_part = F.col(host).eqNullSafe(F.col("of_host")) & F.col("slice").eqNullSafe(F.col("of_slice")) & (F.col("part") == F.col("of_part"))
    joined = local.drop("lead_part", "size").join(parts, same_part)
    best = F.greatest(F.col("lead_here") - F.col("before") * gap_us, F.col("lead_before"))
    send = (F.col("before") + F.col("nth")) * gap_us + best
    return joined.withColumn("send_us", send).select(*requests.columns, "send_us")
