"""Attributes as known at event time: dyadic time nodes turn the interval join into an equi-join.

Validity intervals are decomposed into nodes of a few dyadic levels (node n of level l covers the days
[n * 2**l, (n + 1) * 2**l)). An event enumerates the nodes that enclose its day, one per level that any interval lies
in, and equi-joins them; the exact half-open test on valid and recorded time then decides. The finest level covers
interval ends, so no interval needs more than a few nodes per level and no event more than one per level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import materialize

#: Powers of two in days: 1024 days for the ends, 8192 days for long inner stretches.
LEVELS = (10, 13)
#: Events that one task of the join takes on average.
TASK_EVENTS = 1 << 17
#: Keys that are salted at most: those that hold at least 1/HOT_KEYS of the events. The table of them is broadcast.
HOT_KEYS = 100_000


def _labelled(level: int) -> Callable[[Column], Column]:
    return lambda n: F.struct(F.lit(level).cast("byte").alias("l"), n.alias("n"))


def _nodes(a: Column, b: Column, levels: Sequence[int]) -> Column:
    """Array of struct(l, n) that covers [a, b); at the finest level also nodes that only touch an end."""
    none = F.expr("cast(array() as array<int>)")

    def seq(lo: Column, hi: Column) -> Column:
        return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(none)

    parts, parent = [], None
    for level in sorted(levels, reverse=True):
        size = 1 << level
        finest = level == min(levels)
        lo = F.shiftright(a, level) if finest else F.shiftright(a + (size - 1), level)
        hi = F.shiftright(b + (size - 1), level) if finest else F.shiftright(b, level)
        if parent is None:
            numbers = seq(lo, hi)
        else:
            plo, phi, f = parent[0], parent[1], 1 << (parent[2] - level)
            numbers = F.when(plo < phi, F.concat(seq(lo, F.least(hi, plo * f)), seq(F.greatest(lo, phi * f), hi))).otherwise(seq(lo, hi))
        parts.append(F.transform(numbers, _labelled(level)))
        parent = (lo, hi, level)
    return F.concat(*parts)


def hot_keys(per_key: DataFrame, key: str, total: int, task_events: int = TASK_EVENTS) -> DataFrame:
    """(_hot, _salts) of the keys that fill tasks alone, from (key, n): at most HOT_KEYS rows, over how many tasks each is
    to be spread."""
    share = min(HOT_KEYS, max(64, total // task_events))
    return per_key.where(F.col("n") * share >= total).select(F.col(key).alias("_hot"), F.greatest(F.ceil(F.col("n") / task_events), F.lit(1)).cast("int").alias("_salts"))


def asof_join(
    events: DataFrame,
    intervals: DataFrame,
    key: str,
    event_day: str,
    event_time: str,
    levels: Sequence[int] = LEVELS,
    task_events: int = TASK_EVENTS,
) -> DataFrame:
    """Every event with the interval of its key that holds at its day and was known at its time.

    events: `key`, `event_day` (date), `event_time` (timestamp) and any other columns. intervals: `key`, `value`,
    `valid_from`, `valid_to` (exclusive, NULL open), `recorded_from`, `recorded_to` (exclusive, NULL open), as the ledger
    gives them. Result: the event columns and `value`, `valid_from`; events without a match are left out.

    Intervals of one ledger are disjoint, so an event matches once. Events with NULL key, day or time match nothing.
    The events are read twice: once for the counts of their keys, once for the join, in as many tasks as their number
    asks for. Hot keys are salted by their counts: their events are spread over tasks and their few intervals repeated.
    """
    e = events.where(F.col(key).isNotNull() & F.col(event_day).isNotNull() & F.col(event_time).isNotNull())
    day = F.unix_date(F.col(event_day))
    per_key = materialize(e.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi")), "per-key")
    all_ = per_key.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    total, lo, hi = all_["n"] or 0, all_["lo"] or 0, -1 if all_["hi"] is None else all_["hi"]
    hot = F.broadcast(hot_keys(per_key, key, total, task_events))
    tasks = max(1, -(-total // task_events))

    # only the part of an interval that events can reach is decomposed; the exact test still uses its true ends
    a = F.greatest(F.unix_date("valid_from"), F.lit(lo))
    b = F.least(F.coalesce(F.unix_date("valid_to"), F.lit(hi + 1)), F.lit(hi + 1))
    i = intervals.select(F.col(key).alias("_k"), "value", "valid_from", "valid_to", "recorded_from", "recorded_to", a.alias("_a"), b.alias("_b")).where("_a < _b")
    i = i.withColumn("_node", F.explode(_nodes(F.col("_a"), F.col("_b"), levels))).select("*", F.col("_node.l").alias("_l"), F.col("_node.n").alias("_n")).drop("_a", "_b", "_node")
    i = materialize(i, "nodes")
    used = sorted(r["_l"] for r in i.select("_l").distinct().collect())  # at most one row a level
    salted = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    i = i.join(hot, i["_k"] == F.col("_hot"), "left").withColumn("_s", salted).drop("_hot", "_salts")

    e = e.join(hot, e[key] == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(F.col(event_time)), F.col("_salts")).cast("int")).otherwise(0)).drop("_hot", "_salts")
    keys = [(key, "_k"), ("_en", "_n"), ("_salt", "_s")]
    if len(used) > 1:
        e = e.withColumn("_node", F.explode(F.array(*[F.struct(F.lit(v).cast("byte").alias("l"), F.shiftright(day, v).alias("n")) for v in used]))).select("*", F.col("_node.l").alias("_el"), F.col("_node.n").alias("_en")).drop("_node")
        keys.append(("_el", "_l"))
    else:
        e = e.withColumn("_en", F.shiftright(day, used[0] if used else min(levels)))
    e, i = e.repartition(tasks * max(1, len(used)), *[x for x, _ in keys]), i.repartition(tasks * max(1, len(used)), *[x for _, x in keys])
    on = reduce(lambda p, q: p & q, [F.col(x) == F.col(y) for x, y in keys])
    exact = (
        (F.col(event_day) >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col(event_day) < F.col("valid_to")))
        & (F.col(event_time) >= F.col("recorded_from"))
        & (F.col("recorded_to").isNull() | (F.col(event_time) < F.col("recorded_to")))
    )
    return e.join(i, on & exact).select(*[F.col(c) for c in events.columns], "value", "valid_from")
