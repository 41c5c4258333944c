"""History of changing attributes: a bitemporal ledger built by a sweep over recorded time.

Each ledger row says that `value` held for `[valid_from, valid_to)` and that this was what was known during
`[recorded_from, recorded_to)`. A late record splits the interval it falls into: the interval's row is closed (its
`recorded_to` is set) and two new rows are opened. Nothing is overwritten, so every earlier state of knowledge can be
read again; the rows with open `recorded_to` are the present history.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEDGER = ("value", "valid_from", "valid_to", "recorded_from", "recorded_to")


def sweep(recorded: Sequence[int], valid: Sequence[int], value: Sequence[str]) -> list[tuple]:
    """Ledger rows (value, valid_from, valid_to, recorded_from, recorded_to) of one key, records in recorded order.

    Open ends are None. Rows that were never visible (opened and closed at one instant) are left out.
    """
    starts: list[int] = []
    state: dict[int, tuple] = {}  # start -> (value, end, recorded_from)
    out: list[tuple] = []

    def close(start: int, at: int) -> None:
        v, end, since = state[start]
        if since < at:
            out.append((v, start, end, since, at))

    for r, d, v in zip(recorded, valid, value):
        if d in state:
            old, end, _ = state[d]
            if old != v:
                close(d, r)
                state[d] = (v, end, r)
            continue
        i = bisect_right(starts, d)
        end = starts[i] if i < len(starts) else None
        if i:
            before = starts[i - 1]
            close(before, r)
            state[before] = (state[before][0], d, r)
        starts.insert(i, d)
        state[d] = (v, end, r)
    out.extend((state[d][0], d, state[d][1], state[d][2], None) for d in starts)
    return out


def bitemporal_ledger(df: DataFrame, key: str, valid: str, recorded: str, value: str, tie: str) -> DataFrame:
    """The ledger of `df`: (key, value, valid_from date, valid_to date, recorded_from ts, recorded_to ts).

    Rows with NULL in key, valid, recorded or value don't count. Of records with equal key, valid and recorded time
    the one with the largest `tie` counts. Repeated rows and later records that repeat the value add nothing. An empty
    table gives an empty ledger. Only the named columns are used, so other columns may have any name.

    Records are first reduced per (key, valid day) to the changes of value, which combines on the map side and spreads
    a hot key over its days; a key then holds at most one list entry per day and change, and is swept in one pass.
    """
    v = df.select(
        F.col(key).alias("k"), F.unix_date(F.col(valid).cast("date")).alias("d"), F.unix_micros(F.col(recorded).cast("timestamp")).alias("r"), F.col(value).cast("string").alias("u"), F.col(tie).alias("t")
    ).where("k is not null and d is not null and r is not null and u is not null")
    per_day = v.groupBy("k", "d").agg(F.array_sort(F.collect_set(F.struct("r", "t", "u"))).alias("v"))
    changes = per_day.select("k", F.expr("transform(filter(v, (x, i) -> i = 0 or not (x.u <=> v[i - 1].u)), x -> struct(x.r as r, x.t as t, d as d, x.u as u))").alias("v"))
    keys = changes.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))
    flat = keys.select("k", F.expr("transform(v, x -> x.r)").alias("r"), F.expr("transform(v, x -> x.d)").alias("d"), F.expr("transform(v, x -> x.u)").alias("u"))
    schema = pa.schema([("k", pa.string()), ("value", pa.string()), ("valid_from", pa.int32()), ("valid_to", pa.int32()), ("recorded_from", pa.int64()), ("recorded_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("r").offsets.to_pylist()
            r, d, u = (b.column(c).flatten().to_pylist() for c in ("r", "d", "u"))
            base, rows, names = ends[0], [], []
            for i, k in enumerate(b.column("k").to_pylist()):
                lo, hi = ends[i] - base, ends[i + 1] - base
                own = sweep(r[lo:hi], d[lo:hi], u[lo:hi])
                rows += own
                names += [k] * len(own)
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns))], schema=schema)

    kind = df.schema[key].dataType.simpleString()
    swept = flat.withColumn("k", F.col("k").cast("string")).mapInArrow(run, "k string, value string, valid_from int, valid_to int, recorded_from long, recorded_to long")
    return swept.select(
        F.col("k").cast(kind).alias(key),
        "value",
        *(F.date_from_unix_date(c).alias(c) for c in ("valid_from", "valid_to")),
        *(F.timestamp_micros(c).alias(c) for c in ("recorded_from", "recorded_to")),
    )


def as_recorded(ledger: DataFrame, at: Column | None = None) -> DataFrame:
    """The history as it was known at `at`; the present history without it."""
    return ledger.where("recorded_to is null") if at is None else ledger.where((F.col("recorded_from") <= at) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > at)))


def coalesce_periods(history: DataFrame, key: str) -> DataFrame:
    """Neighbouring periods of one value become one: (key, value, valid_from, valid_to), valid_to exclusive or NULL.

    Takes disjoint, gapless periods per key; a key has at most one per day, so its window is bounded.
    """
    w = Window.partitionBy(key).orderBy("valid_from")
    starts = history.withColumn("_before", F.lag("value").over(w)).where(~F.col("_before").eqNullSafe(F.col("value")))
    return starts.select(key, "value", "valid_from", F.lead("valid_from").over(w).alias("valid_to"))
