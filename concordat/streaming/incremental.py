"""Incremental pairing of two systems' rows as they arrive.

Both systems' rows come as one stream (side 0 or 1). Per key the latest row of each side is kept as state; whenever a
key has both sides, or one of them changes, its differing fields are emitted. A side that never comes is reported when
the watermark passes the key's last event by `patience`, so state doesn't grow without bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "a string, b string, at long"


def incremental_differences(rows: DataFrame, key: str, side: str, at: str, fields: Sequence[str], lateness: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """(key, state, fld) of a streaming `rows`: state is `differs`, `equal` or `missing_0` / `missing_1`.

    Late rows (an earlier `at` than the row held) change nothing. NULL keys are left out.
    """
    import json

    names = list(fields)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, None, 0]
        if state.hasTimedOut:
            gone = 1 if held[1] is None else 0
            state.remove()
            yield pd.DataFrame([(k[0], f"missing_{gone}", None)], columns=["key", "state", "fld"])
            return
        changed = False
        for b in batches:
            for r in b.sort_values("at").to_dict("records"):
                i, t = int(r["side"]), int(r["at"].timestamp() * 1000)
                old = json.loads(held[i]) if held[i] else None
                new = {n: None if r[n] is None or r[n] != r[n] else r[n] for n in names}
                if old is None or t >= old["t"]:
                    changed |= old is None or old["v"] != new
                    held[i] = json.dumps({"t": t, "v": new})
                held[2] = max(held[2], t)
        state.update(tuple(held))
        if held[0] and held[1]:
            if changed:
                a, c = json.loads(held[0])["v"], json.loads(held[1])["v"]
                diff = [n for n in names if a[n] != c[n]]
                out = [(k[0], "differs", n) for n in diff] or [(k[0], "equal", None)]
                yield pd.DataFrame(out, columns=["key", "state", "fld"])
        else:
            state.setTimeoutTimestamp(max(held[2], state.getCurrentWatermarkMs()) + patience_ms)

    x = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(side).cast("int").alias("side"), F.col(at).cast("timestamp").alias("at"), *[F.col(f).cast("string").alias(f) for f in names])
    return x.withWatermark("at", lateness).groupBy("key").applyInPandasWithState(step, "key string, state string, fld string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
