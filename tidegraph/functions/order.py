"""Global order without a single task: ranks and running sums in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

_WITHIN = (1 << 33) - 1


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in the given order. Rows are counted per range partition, then shifted."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    mono = F.monotonically_increasing_id()
    marked = materialize(ranged.withColumn("_m", mono).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit(_WITHIN))), "ranked")
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # a row a partition
    shift = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return marked.join(F.broadcast(shift), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_m", "_p", "_i", "_s")


def running_sums(df: DataFrame, rank: str, columns: list[str], block: int = 1 << 16) -> DataFrame:
    """``df`` with each column replaced by its running sum in order of ``rank`` (0, 1, 2, ...)."""
    df = df.withColumn("_b", F.floor(F.col(rank) / block).cast("long"))
    totals = df.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in columns])
    inside = Window.partitionBy("_b").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(shift, "_b").withColumns({c: F.sum(c).over(inside) + F.col(f"_t_{c}") for c in columns})
    return out.drop("_b", *[f"_t_{c}" for c in columns])
