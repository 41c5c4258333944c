"""Ranks and neighbours within groups of any size: no task holds a group, whatever share of the rows it has.

Rows are range-sorted by group and order over all tasks; each task numbers its own rows, and a group that goes on over
several ranges is continued by offsets. At most one group crosses from one range into the next, so the offsets are no
more than there are ranges and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.session import materialize


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "k") -> DataFrame:
    """df with `name`: the rank (from 1) of a row in its group of `keys` by `order`. NULL keys form a group of their own;
    equal rows get different ranks in any order. An empty df stays empty."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*keys, *order).withColumn("_rank_p", F.spark_partition_id())
    local = placed.withColumn("_rank_n", F.row_number().over(Window.partitionBy("_rank_p", *keys).orderBy(*order)))
    local = materialize(local, "ranked")
    # per range: the size of its first and of its last group
    whole = F.struct(*[F.col(c).cast("string") for c in keys])
    sizes = local.groupBy("_rank_p", *keys).agg(F.max("_rank_n").alias("c")).withColumn("_whole", whole)
    ends = sizes.groupBy("_rank_p").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct(*keys, "_whole", "c")).alias("first"), F.max(F.struct(*keys, "_whole", "c")).alias("last")).orderBy("_rank_p")
    offsets, open_group, before = [], None, 0
    for r in ends.select("_rank_p", "groups", F.col("first._whole").alias("fg"), F.col("last._whole").alias("lg"), F.col("first.c").alias("fc"), F.col("last.c").alias("lc")).collect():  # one row a range
        first, last = tuple(r["fg"]), tuple(r["lg"])
        carried = before if first == open_group else 0
        if carried:
            offsets.append((r["_rank_p"], carried, *first))
        before = carried + r["fc"] if r["groups"] == 1 else r["lc"]
        open_group = last
    names = [f"_g{i}" for i in range(len(keys))]
    table = spark.createDataFrame(offsets, "_rank_op int, _rank_o long, " + ", ".join(f"{n} string" for n in names))
    on = F.col("_rank_p") == F.col("_rank_op")
    for k, n in zip(keys, names):
        on = on & F.col(k).cast("string").eqNullSafe(F.col(n))
    return local.join(F.broadcast(table), on, "left").withColumn(name, (F.col("_rank_n") + F.coalesce("_rank_o", F.lit(0))).cast("long")).select(*df.columns, name)
