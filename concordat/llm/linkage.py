"""Matching entities across sources without keys: collective graph linkage.

1. Candidate graph: records of both sides that share a combination of two attribute values are joined by an edge, whose
   weight adds up the rarity of every combination shared. A combination that is too common to tell records apart is
   refined by one further attribute after the other, the most telling first, then by attributes that find no candidates
   of their own and by parts of names, so hot values never pair all with all. Records of a common combination that
   share nothing more meet too, all of them.
2. Meta-blocking: an edge stays only if its weight is a fair share of the best weight at one of its ends.
3. Similarity: each attribute's agreement or disagreement adds log-odds; how telling an agreement is follows from how
   often the attribute agrees by chance, measured over all records.
4. Collective refinement: an edge gains from the edges between its neighbours (other records of the same two entities),
   recomputed until no edge's best partner changes.
5. Assignment: the best edge is taken, its ends removed, and so on; the similarity becomes a confidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.session import materialize

#: A combination of values is telling while it joins at most so many pairs; beyond, it is refined by one more attribute.
BLOCK_PAIRS = 400
#: Default of candidate_graph, not of link: records of a common combination that share nothing more all meet up to so
#: many pairs.
REST_PAIRS = 10_000
#: Letters of a name's first and last part, by which common combinations are refined too.
PART = 3
#: An edge stays with this share of the best weight at either end.
KEEP_SHARE = 0.5
#: Odds that an attribute agrees between records of one thing, given that both sides hold it.
AGREE = 0.92
#: Share of a neighbour edge's similarity that is passed on. Below 1, so the scores settle.
DAMPING = 0.35
#: Edges that one task can assign; more are first reduced by rounds of mutually best edges.
TASK_EDGES = 1 << 20


@dataclass(frozen=True)
class Attribute:
    """A compared attribute.

    block: used for candidates. fuzzy: texts that are nearly equal count as nearly agreeing. implied_by: an attribute
    whose agreement nearly brings this one's along, so that it then says little. swapped: an attribute this one may have
    changed places with. scored: without it the attribute only finds candidates.
    """

    name: str
    block: bool = True
    fuzzy: bool = False
    agree: float = AGREE
    implied_by: str | None = None
    swapped: str | None = None
    scored: bool = True


def _hashed(df: DataFrame, every: Sequence[str]) -> DataFrame:
    """(id, h): one hash an attribute, NULL where it is missing. A combination's key is the XOR of its hashes."""
    return df.select("id", F.array(*[F.when(F.col(n).isNotNull(), F.xxhash64(F.lit(n), F.col(n))) for n in every]).alias("h"))


def _twos(hashed: DataFrame, n: int) -> DataFrame:
    """(id, key, mask, last) for every two of the first n attributes that a record holds; last is the later one."""
    items = [F.struct(F.get("h", F.lit(i)).bitwiseXOR(F.get("h", F.lit(j))).alias("key"), F.lit(1 << i | 1 << j).alias("mask"), F.lit(j).alias("last")) for i, j in combinations(range(n), 2)]
    return hashed.select("id", F.explode(F.filter(F.array(*items), lambda x: x["key"].isNotNull())).alias("k")).select("id", "k.*")


def candidate_graph(left: DataFrame, right: DataFrame, names: Sequence[str], block_pairs: int = BLOCK_PAIRS, refine: Sequence[str] = (), part_of: dict[str, str] | None = None, rest_pairs: int | None = REST_PAIRS, task_edges: int = TASK_EDGES) -> DataFrame:
    """(l, r, weight). left, right: `id` and the attributes as comparable text, NULL where missing.

    Combinations grow along one order of the attributes (`names`, then `refine`), so each is made once: two of `names`,
    and while a combination joins too many pairs, each later attribute that its records hold. So two records become
    candidates at the first telling combination along that order of what they share. part_of names the attribute that
    another is a part of, so that it adds nothing to it.

    Records whose shared attributes all together are still common (over `block_pairs`) have equal evidence for every
    partner there: all pairs are candidates. With `rest_pairs` (link gives none) that holds up to so many pairs, and in
    larger groups the k-th of one side, in order of all its values, and the k-th of the other meet only.
    """
    every, part_of = [*names, *refine], part_of or {}
    bits = F.array(*[F.lit(1 << k) for k in range(len(every))])
    whole = F.array(*[F.lit(1 << every.index(part_of[n]) if n in part_of else 0) for n in every])
    at = lambda x, i: F.element_at(x, i + 1)
    weight = F.log(F.lit(2.0) + F.lit(float(block_pairs)) / F.sqrt(F.col("na") * F.col("nb"))).alias("w")
    hashed = [materialize(_hashed(x, every), "hashed") for x in (left, right)]
    a, b = (_twos(h, len(names)) for h in hashed)
    edges = None

    def add(found: DataFrame) -> None:
        nonlocal edges
        edges = found if edges is None else edges.unionByName(found)

    def split(rows: DataFrame) -> list[DataFrame]:
        return [rows.where(F.col("side") == s) for s in (0, 1)]

    def meet(rows: DataFrame, on: Sequence[str]) -> DataFrame:
        x, y = split(rows)
        return x.select(F.col("id").alias("l"), *on, weight).join(y.select(F.col("id").alias("r"), *on), list(on)).select("l", "r", "w")

    while True:
        both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
        blocks = both.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na > 0 and nb > 0")
        kept = materialize(both.join(blocks, "key"), "kept")  # a value that only one side has joins nothing
        few = F.col("na") * F.col("nb") <= block_pairs
        add(meet(kept.where(few), ["key"]))
        common = kept.where(~few)
        if common.isEmpty():
            break
        ks = F.filter(F.sequence(F.col("last") + 1, F.lit(len(every))), lambda i: (i < len(every)) & F.get("h", i).isNotNull() & (F.col("mask").bitwiseAND(at(whole, i)) == 0))
        longer = [x.join(h, "id").select("id", "side", F.col("key").alias("parent"), "na", "nb", "h", "mask", F.explode(ks).alias("last")) for x, h in zip(split(common), hashed)]
        longer = [x.select("id", "side", "parent", F.col("key0").alias("key"), F.col("mask").bitwiseOR(at(bits, F.col("last"))).alias("mask"), "last") for x in (y.withColumn("key0", F.col("parent").bitwiseXOR(F.get("h", F.col("last")))) for y in longer)]
        nxt = materialize(longer[0].unionByName(longer[1]), "longer")
        # who shares one more attribute with somebody of the other side has candidates further on; the others meet here
        shared = nxt.groupBy("parent", "key").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).where("n0 > 0 and n1 > 0").select("parent", "key")
        ahead = nxt.join(shared, ["parent", "key"], "left_semi").select("id", "side", F.col("parent").alias("key")).distinct()
        alone = materialize(common.join(ahead, ["id", "side", "key"], "left_anti").select("id", "side", "key", "na", "nb"), "alone")
        if not alone.isEmpty():
            add(_rest(alone, common, hashed, rest_pairs, weight, task_edges))
        a, b = (x.select("id", "key", "mask", "last") for x in split(nxt))
    return edges.groupBy("l", "r").agg(F.sum("w").alias("weight"))


def _rest(alone: DataFrame, common: DataFrame, hashed: Sequence[DataFrame], rest_pairs: int | None, weight: Column, task_edges: int) -> DataFrame:
    """Edges of the records that share a common combination and nothing more with anybody: with all of the combination
    while that makes at most `rest_pairs` pairs (None: always), else rank by rank, over again until each has met
    somebody. A group of more than `task_edges` pairs is dealt to as many tasks as it takes."""
    count = lambda x, n: x.groupBy("key").agg(*[F.count_if(F.col("side") == s).alias(f"{n}{s}") for s in (0, 1)])
    pairs = F.greatest(F.col("m0") * F.col("nb"), F.col("m1") * F.col("na"))
    sized = alone.join(count(alone, "m"), "key").withColumn("parts", F.ceil(pairs / task_edges).cast("int"))
    sized = materialize(sized, "rest")
    rows = common.select("id", "side", "key", "na", "nb")
    small = F.lit(True) if rest_pairs is None else pairs <= rest_pairs
    few, many = sized.where(small), sized.where(~small)
    # the alone are dealt to the parts of their group, each of which holds all rows of the other side
    dealt = few.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    whole = rows.join(few.select("key", "parts").distinct(), "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edge = lambda x, y: x.select(F.col("id").alias("l"), "key", "part", weight).join(y.select(F.col("id").alias("r"), "key", "part"), ["key", "part"]).select("l", "r", "w")
    out = edge(dealt.where("side = 0"), whole.where("side = 1")).unionByName(edge(whole.where("side = 0"), dealt.where("side = 1")))
    if rest_pairs is None or many.isEmpty():
        return out
    # both sides in order of all their values: counted per hash range first, so that no window holds a whole group
    order = hashed[0].select("id", F.lit(0).alias("side"), "h").unionByName(hashed[1].select("id", F.lit(1).alias("side"), "h"))
    hot = rows.join(many.select("key").distinct(), "key", "left_semi").join(order, ["id", "side"]).withColumn("o", F.xxhash64(F.to_json("h")))
    hot = materialize(hot.withColumn("part", F.shiftrightunsigned("o", 52)).drop("h"), "hot")
    per = hot.groupBy("key", "side", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # at most 4,096 rows a window
    ranked = hot.join(before, ["key", "side", "part"]).withColumn("k", F.row_number().over(Window.partitionBy("key", "side", "part").orderBy("o", "id")) - 1 + F.col("before"))
    ranked = ranked.withColumn("slot", F.pmod("k", F.least("na", "nb")))
    x, y = ranked.where("side = 0"), ranked.where("side = 1")
    met = x.select(F.col("id").alias("l"), "key", "slot", weight).join(y.select(F.col("id").alias("r"), "key", "slot"), ["key", "slot"])
    return out.unionByName(met.select("l", "r", "w"))


def with_parts(df: DataFrame, attributes: Sequence[Attribute]) -> tuple[DataFrame, dict[str, str]]:
    """df with the first and the last letters of every fuzzy attribute, and what each is a part of."""
    parts = {f"{a.name} {end}": a.name for a in attributes if a.fuzzy for end in ("first", "last")}
    cut = {"first": F.left, "last": F.right}
    return df.withColumns({p: cut[p.rsplit(" ", 1)[1]](F.col(n), F.lit(PART)) for p, n in parts.items()}), parts


def prune(edges: DataFrame, keep: float = KEEP_SHARE) -> DataFrame:
    """Weighted node pruning: the edge's weight against the best weight of both ends."""
    best_l = edges.groupBy("l").agg(F.max("weight").alias("ml"))
    best_r = edges.groupBy("r").agg(F.max("weight").alias("mr"))
    return edges.join(best_l, "l").join(best_r, "r").where((F.col("weight") >= keep * F.col("ml")) | (F.col("weight") >= keep * F.col("mr"))).select("l", "r", "weight")


def _chance(left: DataFrame, right: DataFrame, attributes: Sequence[Attribute]) -> dict[str, float]:
    """Probability that two records agree in an attribute by chance: sum over values of both sides' shares."""

    def counts(df: DataFrame, n: str) -> DataFrame:
        items = F.explode(F.array(*[F.struct(F.lit(a.name).alias("a"), F.col(a.name).alias("v")) for a in attributes]))
        return df.select(items.alias("x")).select("x.a", "x.v").where("v is not null").groupBy("a", "v").agg(F.count(F.lit(1)).cast("double").alias(n))

    a, b = counts(left, "na"), counts(right, "nb")
    ta, tb = a.groupBy("a").agg(F.sum("na").alias("ta")), b.groupBy("a").agg(F.sum("nb").alias("tb"))
    both = a.join(b, ["a", "v"]).groupBy("a").agg(F.sum(F.col("na") * F.col("nb")).alias("s")).join(ta, "a").join(tb, "a")
    found = {r["a"]: r["s"] / r["ta"] / r["tb"] for r in both.collect()}  # one row an attribute
    return {x.name: min(0.5, max(1e-6, found.get(x.name, 1e-6))) for x in attributes}


def similarity(pairs: DataFrame, attributes: Sequence[Attribute], chance: dict[str, float]) -> Column:
    """Log-odds (base 2) that a pair is one thing, from columns l_<name> and r_<name>; missing values say nothing."""
    total = F.lit(0.0)
    for a in attributes:
        if not a.scored:
            continue
        x, y, u = F.col(f"l_{a.name}"), F.col(f"r_{a.name}"), chance[a.name]
        agree, differ = math.log2(a.agree / u), math.log2((1 - a.agree) / (1 - u))
        odds = F.when(x == y, F.lit(agree))
        if a.fuzzy:
            longest = F.greatest(F.length(x), F.length(y))
            close = 1 - F.levenshtein(x, y) / longest
            part = F.when((F.length(x) == 1) | (F.length(y) == 1), F.when(F.left(x, F.lit(1)) == F.left(y, F.lit(1)), F.lit(2.0)).otherwise(F.lit(differ)))
            letters = lambda t: F.array_join(F.array_sort(F.split(t, "")), "")  # noqa: E731  letters that changed places
            inside = (F.least(F.length(x), F.length(y)) >= 4) & (x.contains(y) | y.contains(x))
            odds = odds.when(part.isNotNull(), part).when((close >= 0.75) | inside | (letters(x) == letters(y)), F.lit(0.75 * agree)).when(close >= 0.6, F.lit(0.2 * agree))
        odds = odds.when(x != y, F.lit(differ))
        if a.swapped:
            other = a.swapped
            odds = F.when((x == F.col(f"r_{other}")) & (F.col(f"l_{other}") == y) & (x != y), F.lit(0.9 * agree)).otherwise(odds)
        if a.implied_by:
            odds = F.when(F.col(f"l_{a.implied_by}") == F.col(f"r_{a.implied_by}"), F.when(x == y, F.lit(0.3)).when(x != y, F.lit(-1.0))).otherwise(odds)
        total = total + F.coalesce(odds, F.lit(0.0))
    return total


def _gains(e: DataFrame) -> DataFrame:
    """(l, r, gain): the best positive score among the edges of the same two entities that share neither end.

    Five edges of an entity pair are enough to know it for each: the best one; without its left end, the best, and the
    best that has another right end than that; and the same the other way round. So nothing is squared.
    """
    pair, cell = ["el", "er"], F.struct("score", "l", "r")
    one = e.where("score > 0").groupBy(*pair).agg(F.max(cell).alias("x"))
    e1 = e.where("score > 0").join(one, pair)
    two = e1.groupBy(*pair).agg(F.max(F.when(F.col("l") != F.col("x.l"), cell)).alias("f1"), F.max(F.when(F.col("r") != F.col("x.r"), cell)).alias("g1"))
    e2 = e1.join(two, pair)
    three = e2.groupBy(*pair).agg(
        F.first("x").alias("x"), F.first("f1").alias("f1"), F.first("g1").alias("g1"),
        F.max(F.when((F.col("l") != F.col("x.l")) & (F.col("r") != F.col("f1.r")), cell)).alias("f2"),
        F.max(F.when((F.col("r") != F.col("x.r")) & (F.col("l") != F.col("g1.l")), cell)).alias("g2"),
    ).where("f1 is not null or g1 is not null")
    fits = [F.when((F.col(f"{c}.l") != F.col("l")) & (F.col(f"{c}.r") != F.col("r")), F.col(f"{c}.score")) for c in ("x", "f1", "f2", "g1", "g2")]
    return e.join(three, pair).select("l", "r", F.greatest(*fits).alias("gain"))


def refine(edges: DataFrame, groups_left: DataFrame, groups_right: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(l, r, base, score): scores propagated between neighbour edges until every left record's best partner stays.

    groups: (id, entity) of each side. Edges (l, r) and (l2, r2) are neighbours when l, l2 are of one entity and r, r2
    too. An edge gains a damped share of the best positive score among the neighbours that share neither end with it.
    The damping makes the scores settle, so the rounds end.
    """
    e = edges.join(groups_left.select(F.col("id").alias("l"), F.col("entity").alias("el")), "l").join(groups_right.select(F.col("id").alias("r"), F.col("entity").alias("er")), "r")
    e = materialize(e.select("l", "r", "el", "er", "base", F.col("base").alias("score")), "graph")
    last = None
    while True:
        e = e.join(_gains(e), ["l", "r"], "left")
        e = materialize(e.select("l", "r", "el", "er", "base", (F.col("base") + damping * F.coalesce("gain", F.lit(0.0))).alias("score")), "graph")
        best = e.groupBy("l").agg(F.max(F.struct("score", -F.col("r"))).alias("b"))
        now = best.agg(F.bit_xor(F.xxhash64("l", "b.col2"))).first()[0]
        if now == last:
            return e
        last = now


def assign(edges: DataFrame, least: float, task_edges: int = TASK_EDGES) -> DataFrame:
    """One-to-one pairs (l, r, score): best edges first, ties by ids; edges under `least` are left out.

    While there are more edges than one task can take, rounds of mutually best edges reduce them; that takes the same
    edges as going through them in order does. Then one task goes through the rest.
    """
    rest, taken = materialize(edges.where(F.col("score") >= least).select("l", "r", "score"), "rest"), None
    order = [F.col("score").desc(), "l", "r"]
    while rest.count() > task_edges:
        ranked = rest.withColumn("a", F.row_number().over(Window.partitionBy("l").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("r").orderBy(*order)))
        mutual = materialize(ranked.where("a = 1 and b = 1").select("l", "r", "score"), "mutual")
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = materialize(rest.join(mutual.select("l"), "l", "left_anti").join(mutual.select("r"), "r", "left_anti"), "rest")

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gone_l, gone_r = set(), set()
        for b in batches:
            keep = []
            for l, r in zip(b["l"].tolist(), b["r"].tolist()):
                good = l not in gone_l and r not in gone_r
                keep.append(good)
                if good:
                    gone_l.add(l)
                    gone_r.add(r)
            yield b[keep]

    last = rest.coalesce(1).sortWithinPartitions(*order).mapInPandas(through, "l long, r long, score double")
    return last if taken is None else taken.unionByName(last)


def link(left: DataFrame, right: DataFrame, attributes: Sequence[Attribute], least: float = 12.0) -> DataFrame:
    """One-to-one links (l, r, score, confidence) between two tables without a common key.

    left, right: `id` (unique), `entity` (groups records of one thing within a table; may equal id) and the attributes as
    comparable text, NULL where missing. Records without two shared attribute values with any other stay unlinked. Repeated
    records compete for one partner; ties go to the smaller ids. Empty tables give no links.
    """
    names = [a.name for a in attributes]
    left, right = (materialize(x.select("id", "entity", *names), "records") for x in (left, right))
    (in_parts, parts), (others, _) = with_parts(left, attributes), with_parts(right, attributes)
    chance = _chance(left, right, attributes)
    telling = sorted(attributes, key=lambda a: (chance[a.name], a.name))
    more = [*[a.name for a in telling if not a.block], *parts]
    graph = prune(materialize(candidate_graph(in_parts, others, [a.name for a in telling if a.block], BLOCK_PAIRS, more, parts, None), "candidates"))
    l, r = left.select(F.col("id").alias("l"), *[F.col(n).alias(f"l_{n}") for n in names]), right.select(F.col("id").alias("r"), *[F.col(n).alias(f"r_{n}") for n in names])
    pairs = graph.join(l, "l").join(r, "r")
    scored = pairs.select("l", "r", similarity(pairs, attributes, chance).alias("base"))
    # an edge gains at most the damped score of another, which is at most the best base / (1 - damping)
    most = sum(math.log2(a.agree / chance[a.name]) for a in attributes if a.scored) * DAMPING / (1 - DAMPING)
    out = assign(refine(scored.where(F.col("base") >= least - max(most, 0.0)), left, right), least)
    return out.withColumn("confidence", F.round(1 / (1 + F.pow(F.lit(2.0), -(F.col("score") - F.lit(least)) / 4)), 4))
