"""Filling fixed-capacity containers along a space-filling curve.

Documents are range-sorted by the Hilbert key of their projected vectors, so neighbours on the curve are alike. Each
range is packed on its own: a container opens with the first document still waiting and is completed, from a window of
its neighbours on the curve, by the largest document that fits, again and again.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that wait at once; a container holds only documents of one window of the curve.
WINDOW = 1024
#: Tokens a range holds on average; a range closes at most a window's last container early. Larger corpora have larger
#: ranges, never more than RANGES of them.
RANGE_TOKENS = 4_000_000
RANGES = 20_000
#: The curve is cut into so many cells, whose sizes decide where ranges begin.
CELL_BITS = 16


def pack(sizes: Sequence[int], capacity: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(item, part, container, tokens): items in order. An item is cut only if it exceeds the capacity: into full
    containers and one rest, which is packed like an item. Items of size 0 are left out."""
    out: list[tuple[int, int, int, int]] = []
    container = 0
    waiting: list[tuple[int, int, int]] = []  # (size, item, part) by size
    queue: list[tuple[int, int, int]] = []
    head, gone = 0, set()

    def complete() -> None:
        nonlocal head, container
        while queue[head] in gone:
            gone.discard(queue[head])
            head += 1
        first = queue[head]
        head += 1
        waiting.pop(bisect_right(waiting, first) - 1)
        left, chosen = capacity - first[0], [first]
        while left > 0 and waiting:
            k = bisect_right(waiting, (left, 1 << 62, 0)) - 1
            if k < 0:
                break
            # of equal sizes the earliest on the curve
            size = waiting[k][0]
            k = bisect_right(waiting, (size, -1, 0))
            item = waiting.pop(k)
            gone.add(item)
            chosen.append(item)
            left -= size
        out.extend((i, p, container, s) for s, i, p in chosen)
        container += 1

    for i, size in enumerate(sizes):
        part = 0
        while size > capacity:
            out.append((i, part, container, capacity))
            container += 1
            part += 1
            size -= capacity
        if size > 0:
            insort(waiting, (size, i, part))
            queue.append((size, i, part))
            if len(waiting) >= window:
                complete()
    while waiting:
        complete()
    return out


def ranges(measured: DataFrame, id_column: str, curve_bits: int, range_tokens: int | None = None) -> DataFrame:
    """measured with `range`: consecutive stretches of the curve of about equal tokens.

    They follow from the tokens of each cell of the curve (at most 2 ** CELL_BITS rows reach the driver), so they don't
    depend on how the input is partitioned. A cell that fills several ranges alone, as copies of one text do, is dealt out
    to them by hash of the id.
    """
    spark = measured.sparkSession
    cell = F.shiftrightunsigned("curve", max(0, curve_bits - CELL_BITS)).cast("int")
    cells = measured.groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("t")).orderBy("cell").collect()
    total = sum(c["t"] for c in cells)
    size = range_tokens or max(RANGE_TOKENS, total // RANGES)
    table, before, at = [], 0, 0
    for c in cells:
        if c["t"] > size:  # ranges of its own
            at += before > 0
            parts = -(-c["t"] // size)
            table.append((c["cell"], at, parts))
            at, before = at + parts, 0
            continue
        if before + c["t"] > size:
            at, before = at + 1, 0
        table.append((c["cell"], at, 1))
        before += c["t"]
    t = spark.createDataFrame(table, "cell int, first int, parts int")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.col(id_column)), F.col("parts"))).otherwise(0)
    return measured.withColumn("cell", cell).join(F.broadcast(t), "cell").withColumn("range", (F.col("first") + part).cast("int")).drop("cell", "first", "parts")


def packed(measured: DataFrame, id_column: str, containers: Sequence[tuple[str, int]], curve_bits: int, range_tokens: int | None = None) -> DataFrame:
    """(contenant, container, doc, part, tokens) for each named capacity. `measured` has n_tokens and curve.

    Each range is packed on its own, so the result is the same for any partitioning of the input.
    """
    schema = f"contenant string, container string, {id_column} long, part int, tokens int"
    placed = ranges(measured.where("n_tokens > 0").select(id_column, "n_tokens", "curve"), id_column, curve_bits, range_tokens)
    n = max(1, (placed.agg(F.max("range")).first()[0] or 0) + 1)
    ordered = placed.repartitionByRange(n, "range").sortWithinPartitions("range", "curve", id_column)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(it)
        if not parts:
            return
        for r, b in pd.concat(parts).groupby("range", sort=False):
            ids, sizes = b[id_column].to_numpy(), b["n_tokens"].tolist()
            for name, capacity in containers:
                rows = pack(sizes, capacity)
                yield pd.DataFrame({"contenant": name, "container": [f"{r}-{x[2]}" for x in rows], id_column: [int(ids[x[0]]) for x in rows], "part": [x[1] for x in rows], "tokens": [x[3] for x in rows]})

    return ordered.mapInPandas(run, schema)


def nearness(packing: DataFrame, measured: DataFrame, id_column: str) -> DataFrame:
    """(contenant, within, at_random): mean squared distance of documents' vectors (v0, v1, ...) to the mean of their
    container, and to the mean of all. Containers of one document don't count. The nearer to 0 `within`, the more alike
    are the documents of a container."""
    v = [c for c in measured.columns if c[0] == "v" and c[1:].isdigit()]
    j = packing.select("contenant", "container", id_column).join(measured.select(id_column, *v), id_column)
    spread = lambda: sum((F.var_pop(c) for c in v[1:]), F.var_pop(v[0]))
    per = j.groupBy("contenant", "container").agg(F.count(F.lit(1)).alias("n"), spread().alias("s")).where("n > 1")
    inside = per.groupBy("contenant").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("within"))
    return inside.join(F.broadcast(j.groupBy("contenant").agg(spread().alias("at_random"))), "contenant").select("contenant", F.round("within", 6).alias("within"), F.round("at_random", 6).alias("at_random"))


def fill_report(packing: DataFrame, capacities: DataFrame) -> DataFrame:
    """(contenant, capacite, n_containers, tokens, unused_share)."""
    per = packing.groupBy("contenant").agg(F.countDistinct("container").alias("n_containers"), F.sum("tokens").alias("tokens"))
    j = capacities.select(F.col("nom").alias("contenant"), "capacite").join(per, "contenant", "left").fillna(0, ["n_containers", "tokens"])
    room = F.col("n_containers") * F.col("capacite")
    return j.select("contenant", "capacite", "n_containers", "tokens", F.round(F.when(room > 0, 1 - F.col("tokens") / room).otherwise(0.0), 6).alias("unused_share"))
