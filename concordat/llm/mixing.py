"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked to the target shares of the sources and to the corpus's
own shares of languages and topics, within each source's bound on repetitions. A document is then taken as often as its
cell's weight says: the whole part surely, the fraction by a calibrated probability, decided by a hash of its id.

The size of the mix is a parameter, by default a share of the corpus, so a scarce source never shrinks it: such a source
stops at its repetitions, its shortfall is reported, and the others share what it leaves in proportion to their targets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import materialize

#: Tokens of the mix as a share of the tokens of all documents that have a target.
SIZE = 0.5
#: Steps of the search for each source's threshold: the shares' error is about one step's tokens.
STEPS = 4096
#: Raking ends when no weight changes by more; marginals that can't be met together leave a cycle, ended by ROUNDS. What
#: was reached is in the reports.
SETTLED, ROUNDS = 1e-7, 2000


def allowed_tokens(tokens: np.ndarray, shares: np.ndarray, repetitions: np.ndarray, size: float) -> np.ndarray:
    """Tokens of each source in a mix of `size`: its share of what no source held back by its repetitions takes."""
    most, out = tokens * repetitions, np.zeros(len(tokens))
    free = (most > 0) & (shares > 0)
    while free.any():
        want = shares / shares[free].sum() * (size - out.sum())
        held = free & (want >= most)
        if not held.any():
            out[free] = want[free]
            break
        out[held] = most[held]
        free &= ~held
    return out


def _scaled(w: np.ndarray, cells: np.ndarray, cap: np.ndarray, goal: float) -> np.ndarray:
    """min(w * f, cap) with the factor f that gives `goal` tokens; the caps where even they don't."""
    if (cells * cap).sum() <= goal or not w.any():
        return cap.copy() if (cells * cap).sum() <= goal else w
    ratio = np.where(w > 0, cap / np.maximum(w, 1e-300), np.inf)
    order = np.argsort(ratio)
    full = np.concatenate([[0.0], np.cumsum((cells * cap)[order])])[:-1]
    rest = (cells * w)[order][::-1].cumsum()[::-1]
    f = (goal - full) / np.maximum(rest, 1e-300)
    k = int(np.argmax(f <= ratio[order]))
    return np.minimum(w * max(f[k], 0.0), cap)


def rake(cells: np.ndarray, sources: np.ndarray, others: Sequence[np.ndarray], goals: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Weights of the cells. cells: tokens; sources, others: the cell's source and further categories as numbers.

    goals: tokens of each source. Further marginals keep the corpus's shares. The source marginal is raked last, so it
    holds exactly; the others as closely as they can be met together with it.
    """
    cap = caps[sources]
    w = np.minimum(np.ones(len(cells)), cap)
    natural = [np.bincount(o, cells) / cells.sum() for o in others]
    for _ in range(ROUNDS):
        before = w.copy()
        for o, share in zip(others, natural):
            for k in range(len(share)):
                here = o == k
                w[here] = _scaled(w[here], cells[here], cap[here], share[k] * goals.sum())
        for k in range(len(goals)):
            here = sources == k
            w[here] = _scaled(w[here], cells[here], cap[here], goals[k])
        if np.abs(w - before).max() < SETTLED:
            break
    return w


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """The targets by source; a fixed table of a row a source."""
    return sorted((r["source"], float(r["poids"] or 0), int(r["max_repetitions"] or 0)) for r in targets.collect() if r["source"] is not None)


def mix(docs: DataFrame, id_column: str, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """(id, source, lang, topic, n_tokens, copies) of the documents taken; copies is at most the source's max_repetitions.

    docs: id, source, lang, topic, n_tokens. targets: source, poids, max_repetitions; a source without target isn't
    taken, one without documents gets nothing and the others share its part. total: tokens of the mix, SIZE of the tokens
    of the sources with a target if not given. NULL sources match no target. The cell table has at most
    (targets) x (languages) x 8 rows, languages being a short list, so it may be collected.
    """
    spark = docs.sparkSession
    goal = _targets(targets)
    names = {s: i for i, (s, _, _) in enumerate(goal)}
    d = docs.where((F.col("n_tokens") > 0) & F.col("source").isin(list(names)))
    columns = [id_column, "source", "lang", "topic", "n_tokens"]
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")).orderBy("source", "lang", "topic").collect()
    if not cells:
        return d.select(*columns, F.lit(0).alias("copies")).where(F.lit(False))
    t = np.array([c["t"] for c in cells], float)
    src = np.array([names[c["source"]] for c in cells])
    langs, topics = sorted({c["lang"] for c in cells}), sorted({c["topic"] for c in cells})
    shares, caps = np.array([g[1] for g in goal]), np.array([float(g[2]) for g in goal])
    goals = allowed_tokens(np.bincount(src, t, len(goal)), shares, caps, t.sum() * SIZE if total is None else total)
    w = rake(t, src, [np.array([langs.index(c["lang"]) for c in cells]), np.array([topics.index(c["topic"]) for c in cells])], goals, caps)
    whole = np.floor(w + 1e-9)
    table = spark.createDataFrame([(c["source"], c["lang"], c["topic"], int(a), float(b)) for c, a, b in zip(cells, whole, np.maximum(w - whole, 0))], "source string, lang string, topic int, whole int, part double")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ranked = d.join(F.broadcast(table), ["source", "lang", "topic"]).withColumn("ratio", F.when(F.col("part") > 0, u / F.col("part")))
    # a source's threshold: the fractions' documents are taken in order of ratio until the source's rest is filled
    step = F.least(F.floor(F.col("ratio") / (F.col("ratio") + 1) * STEPS), F.lit(STEPS - 1)).cast("int")
    hist = ranked.where("part > 0").groupBy("source", step.alias("step")).agg(F.sum("n_tokens").alias("t")).collect()
    rest = goals - np.bincount(src, t * whole, len(goal))
    cut = []
    for s, i in names.items():
        own = np.zeros(STEPS)
        for h in hist:
            if h["source"] == s:
                own[h["step"]] += h["t"]
        options = np.concatenate([[0.0], np.cumsum(own)])
        cut.append((s, int(np.abs(options - max(rest[i], 0)).argmin())))  # as many steps as come closest to the rest
    cuts = spark.createDataFrame(cut, "source string, steps int")
    taken = ranked.join(F.broadcast(cuts), "source").withColumn("copies", (F.col("whole") + F.when(F.col("ratio").isNotNull() & (step < F.col("steps")), 1).otherwise(0)).cast("int"))
    return taken.where("copies > 0").select(*columns, "copies")


def share_report(mixed: DataFrame, docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, allowed_share, actual_share, shortfall, n_docs, tokens, max_copies) of every source of the
    targets. allowed_share is what its repetitions and the size let it have, shortfall what that lacks of the target."""
    spark = mixed.sparkSession
    goal = _targets(targets)
    have = {r["source"]: float(r["t"]) for r in docs.where(F.col("source").isin([g[0] for g in goal])).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a target
    tokens = np.array([have.get(g[0]) or 0.0 for g in goal])
    allowed = allowed_tokens(tokens, np.array([g[1] for g in goal]), np.array([float(g[2]) for g in goal]), tokens.sum() * SIZE if total is None else total)
    allowed = allowed / max(allowed.sum(), 1e-300)
    rows = [(g[0], g[1], round(float(a), 6), round(max(g[1] - float(a), 0.0), 6)) for g, a in zip(goal, allowed)]
    per = {r["source"]: r for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("t"), F.max("copies").alias("c")).collect()}  # one row a target
    drawn = sum(r["t"] for r in per.values())
    out = [(s, p, a, round(per[s]["t"] / drawn, 6) if s in per else 0.0, lack, *((per[s]["n"], per[s]["t"], per[s]["c"]) if s in per else (0, 0, 0))) for s, p, a, lack in rows]
    return spark.createDataFrame(out, "source string, target_share double, allowed_share double, actual_share double, shortfall double, n_docs long, tokens long, max_copies int")


def marginal_report(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(marginal, category, target_share, actual_share) of languages and topics; the targets are the shares among all
    documents of the sources with a target."""

    def shares(df: DataFrame, weight: Column, name: str) -> DataFrame:
        items = F.explode(F.array(F.struct(F.lit("lang").alias("marginal"), F.col("lang").alias("category")), F.struct(F.lit("topic").alias("marginal"), F.col("topic").cast("string").alias("category"))))
        per = materialize(df.select(items.alias("x"), weight.alias("t")).groupBy("x.marginal", "x.category").agg(F.sum("t").alias("t")), "marginals")  # a row a category
        return per.join(F.broadcast(per.groupBy("marginal").agg(F.sum("t").alias("all"))), "marginal").select("marginal", "category", F.round(F.col("t") / F.col("all"), 6).alias(name))

    known = docs.where((F.col("n_tokens") > 0) & F.col("source").isin([g[0] for g in _targets(targets)]))
    natural = shares(known, F.col("n_tokens").cast("long"), "target_share")
    actual = shares(mixed, F.col("n_tokens").cast("long") * F.col("copies"), "actual_share")
    return natural.join(actual, ["marginal", "category"], "left").fillna(0.0, ["actual_share"])
