"""Population-level hypotheses on what explains anomalies. They add causes and priority, never change a verdict.

Every test returns rows (finding_id, l, r, target_field, hypothesis, support, detail) and is an aggregation over fields
or values, so it shuffles partial counts, not findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.config import Mapping
from concordat.functions import kinds as K
from concordat.operators.ranks import ranked
from concordat.operators.verdicts import INVESTIGATE, by_kind
from concordat.session import materialize

KEY = ["finding_id", "l", "r", "target_field"]


def investigated(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("verdict").isin(INVESTIGATE))


def _verified(rows: DataFrame, hypothesis: str, support: Column | None = None, detail: Column | None = None) -> DataFrame:
    return rows.select(*KEY, F.lit(hypothesis).alias("hypothesis"), (F.lit(None).cast("double") if support is None else support).alias("support"), (F.lit("") if detail is None else detail).alias("detail"))


def systemic_fields(findings: DataFrame, share: float, count: int) -> DataFrame:
    """(target_field, k, n, share, subcategory): fields whose findings are nearly all anomalous; the most frequent
    subcategory, ties to the first in alphabetical order."""
    per = findings.groupBy("target_field").agg(F.count_if(F.col("verdict").isin(INVESTIGATE)).alias("k"), F.count(F.lit(1)).alias("n")).where((F.col("k") >= count) & (F.col("k") / F.col("n") >= share))
    subs = investigated(findings).groupBy("target_field", "subcategory").agg(F.count(F.lit(1)).alias("c")).groupBy("target_field").agg(F.min_by("subcategory", F.struct(-F.col("c"), "subcategory")).alias("subcategory"))
    return per.join(subs, "target_field", "left").select("target_field", "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), "subcategory")


def systemic(findings: DataFrame, share: float, count: int) -> DataFrame:
    fields = systemic_fields(findings, share, count)
    return _verified(investigated(findings).join(F.broadcast(fields.select("target_field", "share")), "target_field"), "H-SYSTEMIC", F.col("share"))  # one row a field


def bijection_fields(findings: DataFrame, count: int) -> DataFrame:
    """(target_field, n_pairs): anomalies that recode expected values one to one, a value being shared by persons."""
    p = investigated(findings).where("expected is not null and target_norm is not null").groupBy("target_field", "expected", "target_norm").agg(F.count(F.lit(1)).alias("c"), F.min("person_id").alias("p1"), F.max("person_id").alias("p2"))
    by_e = p.groupBy("target_field", "expected").agg(F.count(F.lit(1)).alias("targets"), F.sum("c").alias("c"), F.min("p1").alias("p1"), F.max("p2").alias("p2"))
    by_t = p.groupBy("target_field", "target_norm").agg(F.count(F.lit(1)).alias("sources")).groupBy("target_field").agg(F.max("sources").alias("sources"))
    f = by_e.groupBy("target_field").agg(F.max("targets").alias("targets"), F.sum("c").alias("n_pairs"), F.max((F.col("p1") != F.col("p2")).cast("int")).alias("shared"))
    return f.join(by_t, "target_field").where((F.col("targets") == 1) & (F.col("sources") == 1) & (F.col("shared") == 1) & (F.col("n_pairs") >= count)).select("target_field", "n_pairs")


def bijection(findings: DataFrame, count: int) -> DataFrame:
    rows = investigated(findings).where("expected is not null and target_norm is not null").join(F.broadcast(bijection_fields(findings, count)), "target_field")  # one row a field
    return _verified(rows, "H-BIJECTION", F.lit(1.0), F.concat_ws(" -> ", "expected", "target_norm"))


SWAPPED = ["target_field", "lo", "hi"]


def swaps(findings: DataFrame) -> DataFrame:
    """Pairs of anomalies of one field that hold each other's expected value, of different persons, each used once.

    The k-th of one direction, by finding id, meets the k-th of the other. Where both are of one person, they and those
    left over go on among themselves, rare persons first, until no two of different persons are left; what then is left on
    both sides, all of one person, takes the ends of swaps that this person has no part in. So there are as many swaps as
    there can be. Findings without person swap with nobody. Pairs: (target_field, finding_a, l_a, r_a, finding_b, l_b, r_b, value_a, value_b).

    Only values that occur the other way round too are ranked, and over all tasks, so a systematic recoding, however
    frequent, never lies in one. Every further round pairs at least two findings of each group that is left.
    """
    x = findings.where((F.col("verdict") == "ANOMALIE") & F.col("expected").isNotNull() & F.col("target_norm").isNotNull() & F.col("person_id").isNotNull() & (F.col("expected") != F.col("target_norm")))
    x = x.select(*KEY, "person_id", "expected", F.least("expected", "target_norm").alias("lo"), F.greatest("expected", "target_norm").alias("hi"))
    x = x.withColumn("up", F.col("expected") == F.col("lo"))
    both = x.groupBy(*SWAPPED).agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d")).where("u and d")
    free, taken = materialize(x.join(both.select(*SWAPPED), SWAPPED, "left_semi"), "swappable"), None
    cell = F.struct("person_id", *KEY)
    while True:
        ends = [f(F.when(F.col("up") == s, cell)).alias(f"{n}{m}") for s, n in ((True, "a"), (False, "b")) for f, m in ((F.min, "0"), (F.max, "1"))]
        groups = free.groupBy(*SWAPPED).agg(*ends).where("a0.person_id <> b1.person_id or a1.person_id <> b0.person_id")
        groups = materialize(groups, "swap-groups")
        if groups.isEmpty():
            break
        rest = free.join(groups.select(*SWAPPED), SWAPPED, "left_semi")
        if taken is None:
            k = ranked(rest, [*SWAPPED, "up"], ["finding_id", "l", "r"])
        else:  # both sides by how often a person occurs, one of them backwards, so that persons alike don't meet again
            often = rest.groupBy(*SWAPPED, "up", "person_id").agg(F.count(F.lit(1)).alias("c"))
            rest = rest.join(often, [*SWAPPED, "up", "person_id"]).withColumn("o", F.when(F.col("up"), F.col("c")).otherwise(-F.col("c")))
            rest = rest.withColumn("h", F.xxhash64("person_id") * F.when(F.col("up"), 1).otherwise(-1))
            k = ranked(rest, [*SWAPPED, "up"], ["o", "h", "finding_id", "l", "r"])
        k = materialize(k, "ranks")
        s, d = k.where("up").alias("a"), k.where("not up").alias("b")
        on = reduce(lambda p, q: p & q, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*SWAPPED, "k")])
        met = s.join(d, on & (F.col("a.person_id") != F.col("b.person_id")))
        ends_of = (("finding_id", "finding"), ("l", "l"), ("r", "r"), ("person_id", "person"))
        cells = [F.col(f"{n}.{c}").alias(f"{m}_{n}") for n in "ab" for c, m in ends_of]
        j = materialize(met.select(F.col("a.target_field").alias("target_field"), *cells, F.col("a.lo").alias("value_a"), F.col("a.hi").alias("value_b")), "swaps")
        if j.isEmpty():  # then the ends of each group
            one = F.when(F.col("a0.person_id") != F.col("b1.person_id"), F.struct(F.col("a0").alias("a"), F.col("b1").alias("b"))).otherwise(F.struct(F.col("a1").alias("a"), F.col("b0").alias("b")))
            x1 = groups.select("*", one.alias("x"))
            j = materialize(x1.select("target_field", *[F.col(f"x.{n}.{c}").alias(f"{m}_{n}") for n in "ab" for c, m in ends_of], F.col("lo").alias("value_a"), F.col("hi").alias("value_b")), "swaps")
        taken = j if taken is None else taken.unionByName(j)
        used = reduce(DataFrame.unionByName, [j.select("target_field", F.col(f"finding_{n}").alias("finding_id"), F.col(f"l_{n}").alias("l"), F.col(f"r_{n}").alias("r")) for n in "ab"])
        on = reduce(lambda p, q: p & q, [F.col(f"f.{c}").eqNullSafe(F.col(f"u.{c}")) for c in KEY])
        free = materialize(free.alias("f").join(used.alias("u"), on, "left_anti"), "free")
    if taken is not None:
        return _with_last_swaps(taken, free).drop("person_a", "person_b")
    schema = "target_field string, finding_a string, l_a long, r_a long, finding_b string, l_b long, r_b long, value_a string, value_b string"
    return findings.sparkSession.createDataFrame([], schema)


def _with_last_swaps(taken: DataFrame, free: DataFrame) -> DataFrame:
    """taken, and what is still free on both sides of a group, all of one person p: the n-th of them and the n-th swap
    without p become two swaps."""
    left = free.groupBy(*SWAPPED).agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d"), F.first("person_id").alias("p")).where("u and d").select(*SWAPPED, "p")
    left = materialize(left, "last-groups")
    if left.isEmpty():
        return taken
    k = ranked(free.join(left, SWAPPED, "left_semi"), [*SWAPPED, "up"], ["finding_id", "l", "r"])
    a, b = (k.where(c).select(*SWAPPED, "k", *[F.col(x).alias(f"{x}_{n}") for x in ("finding_id", "l", "r", "person_id")]) for n, c in (("x", "up"), ("y", "not up")))
    open_ = taken.join(left.withColumnsRenamed({"lo": "value_a", "hi": "value_b"}), ["target_field", "value_a", "value_b"]).where("person_a <> p and person_b <> p").drop("p")
    s = ranked(open_, ["target_field", "value_a", "value_b"], ["finding_a", "finding_b", "l_a", "r_a"]).withColumnsRenamed({"value_a": "lo", "value_b": "hi"})
    both = materialize(a.join(b, [*SWAPPED, "k"]).join(s, [*SWAPPED, "k"]), "exchanged")
    names = (("finding", "finding_id"), ("l", "l"), ("r", "r"), ("person", "person_id"))
    first = both.select("target_field", *[F.col(f"{c}_x").alias(f"{n}_a") for n, c in names], *[F.col(f"{n}_b") for n, _ in names], F.col("lo").alias("value_a"), F.col("hi").alias("value_b"))
    second = both.select("target_field", *[F.col(f"{n}_a") for n, _ in names], *[F.col(f"{c}_y").alias(f"{n}_b") for n, c in names], F.col("lo").alias("value_a"), F.col("hi").alias("value_b"))
    kept = taken.join(both.select("target_field", "finding_a", "l_a", "r_a"), ["target_field", "finding_a", "l_a", "r_a"], "left_anti")
    return kept.unionByName(first).unionByName(second)


def permutation(findings: DataFrame) -> DataFrame:
    s = swaps(findings)
    sides = [s.select(F.col(f"finding_{x}").alias("finding_id"), F.col(f"l_{x}").alias("l"), F.col(f"r_{x}").alias("r"), "target_field", F.col(f"finding_{y}").alias("other")) for x, y in ("ab", "ba")]
    return _verified(sides[0].unionByName(sides[1]), "H-PERMUTATION", None, F.col("other"))


def _values(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_l, _r, cs): each pair's candidate columns as text, in the order of `columns`."""
    return pairs.select(F.col("l").alias("_l"), F.col("r").alias("_r"), F.array(*[F.col("a_" + c).cast("string") for c in columns]).alias("cs"))


def alternative_sources(findings: DataFrame, pairs: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """(target_field, col, hits, explains, population, support, mapped_support) of every candidate column of a field
    that has anomalies. A pair's findings are brought together and meet its columns once, each normalised once a kind; a
    row per finding and column that gives its value is counted, so the plan doesn't grow with columns or kinds."""
    used = {f.target: set(f.sources) for f in mapping.fields}
    columns = [c for c in columns if c not in mapping.hypotheses["excluded_columns"]]
    of_kind: dict[str, list[str]] = {}
    for f in mapping.fields:
        of_kind.setdefault(f.kind, []).append(f.target)
    pop = findings.where("l is not null and r is not null and target_norm is not null").where(F.col("target_field").isin(list(used)))
    # at most one finding a field of the mapping is in a list
    per = pop.groupBy("l", "r").agg(F.collect_list(F.struct("target_field", "target_norm", F.col("verdict").isin(INVESTIGATE).alias("bad"), F.col("verdict").isin("CONFORME", "JUSTIFIE").alias("good"))).alias("fs"))
    x = per.join(_values(pairs, columns), (F.col("l") == F.col("_l")) & (F.col("r") == F.col("_r"))).select("fs", "cs")
    at = F.sequence(F.lit(0), F.lit(len(columns) - 1)) if columns else F.expr("cast(array() as array<int>)")

    def given(kind: str, targets: list[str]) -> Column:
        """The kind's findings, each with -1 and the positions of the columns that give its value."""
        ours = F.filter("fs", lambda f: f["target_field"].isin(targets))
        hit = lambda cs: F.transform(ours, lambda f: F.struct(f["target_field"].alias("target_field"), f["bad"].alias("bad"), f["good"].alias("good"), F.concat(F.array(F.lit(-1)), F.filter(at, lambda i: F.get(cs, i) == f["target_norm"])).alias("ns")))
        return F.when(F.size(ours) > 0, K.let(F.transform("cs", lambda c: K.canonical(kind, c)), hit))

    each = x.select(F.explode(F.array(*[given(k, t) for k, t in sorted(of_kind.items())])).alias("found")).select(F.explode("found").alias("f")).select("f.*")
    counted = each.select("target_field", "bad", "good", F.explode("ns").alias("n")).groupBy("target_field", "n").agg(F.count(F.lit(1)).alias("hits"), F.count_if("bad").alias("explains"), F.count_if("good").alias("agreeing"))
    cells = counted.groupBy("target_field").agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("hits", "explains", "agreeing")))).alias("m"))  # one entry a column
    all_, own_ = F.element_at("m", F.lit(-1)), F.try_element_at("m", F.col("n"))
    long = cells.where(all_["explains"] > 0).select("target_field", "m", F.explode(at).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    named = long.select("target_field", F.element_at(F.array(*[F.lit(c) for c in columns]).cast("array<string>"), F.col("n") + 1).alias("col"), zero(own_["hits"]).alias("hits"), zero(own_["explains"]).alias("explains"), all_["hits"].alias("population"), all_["agreeing"].alias("agreeing"))
    own = [(t, c) for t, cs in used.items() for c in cs]
    is_own = reduce(lambda p, q: p | q, [(F.col("target_field") == t) & (F.col("col") == c) for t, c in own], F.lit(False))
    return named.where(~is_own).select("target_field", "col", "hits", "explains", "population", F.round(F.col("hits") / F.col("population"), 6).alias("support"), F.round(F.col("agreeing") / F.col("population"), 6).alias("mapped_support"))


def candidate_rules(alternatives: DataFrame, mapping: Mapping) -> DataFrame:
    """The alternative columns that hold: enough rows, enough support, more than the mapped column, something explained."""
    h = mapping.hypotheses
    return alternatives.where((F.col("population") >= h["alt_source_count"]) & (F.col("support") >= h["alt_source_support"]) & (F.col("support") > F.col("mapped_support")) & (F.col("explains") >= 1))


def alternative_source(findings: DataFrame, pairs: DataFrame, mapping: Mapping, columns: Sequence[str], rules: DataFrame) -> DataFrame:
    """Anomalies whose value a candidate rule's column gives; only that column is normalised. rules: at most fields x
    columns rows."""
    kind_of = {f.target: f.kind for f in mapping.fields}
    kind = F.try_element_at(F.map_from_arrays(F.array(*[F.lit(t) for t in kind_of]), F.array(*[F.lit(k) for k in kind_of.values()])), F.col("target_field"))
    at = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("col")).cast("int") - 1
    x = investigated(findings).where(F.col("target_field").isin(list(kind_of))).join(F.broadcast(rules.select("target_field", "col", "support")), "target_field")
    x = x.join(_values(pairs, columns), (F.col("l") == F.col("_l")) & (F.col("r") == F.col("_r"))).withColumns({"_kind": kind, "_raw": F.get("cs", at)})
    value = K.let(F.struct("_kind", "_raw"), lambda s: by_kind(s["_kind"], s["_raw"], K.canonical, sorted(set(kind_of.values()))))
    return _verified(x.where(value == F.col("target_norm")), "H-ALT-SOURCE", F.col("support"), F.col("col"))


def history_record(findings: DataFrame, pairs: DataFrame, history: DataFrame, key: str, effective: str, row: str) -> DataFrame:
    """Interval anomalies whose target date is a record's effective date: detail says first, last or which record."""
    x = investigated(findings).where(F.col("rule").startswith("interval") & F.col("target_norm").isNotNull()).join(pairs.select(F.col("l").alias("_l"), F.col("r").alias("_r"), F.col("history_key")), (F.col("l") == F.col("_l")) & (F.col("r") == F.col("_r")))
    h = ranked(history.where(F.col(key).isNotNull() & F.col(effective).isNotNull()).select(key, effective, row), [key], [effective, row])
    n = h.groupBy(key).agg(F.max("k").alias("n"))
    first = h.groupBy(key, F.col(effective).cast("string").alias("_d")).agg(F.min("k").alias("k"))
    x = x.join(first, (F.col("history_key") == F.col(key)) & (F.col("target_norm") == F.col("_d"))).drop(key).join(n, F.col("history_key") == F.col(key))
    label = F.when(F.col("k") == 1, "first").when(F.col("k") == F.col("n"), "last").otherwise(F.concat(F.lit("record "), F.col("k")))
    return _verified(x, "H-HISTORY-RECORD", None, label)


def alternative_interpretation(findings: DataFrame) -> DataFrame:
    good = F.map_filter("alternatives", lambda k, v: v.isin("CONFORME", "JUSTIFIE"))
    return _verified(investigated(findings).where(F.size(good) > 0), "H-ALT-INTERPRETATION", None, F.array_join(F.array_sort(F.map_keys(good)), ","))


def type_absent(missing: DataFrame, target_types: DataFrame) -> DataFrame:
    """Missing rows whose type the target system doesn't hold at all. missing: KEY and `assignment_type`."""
    return _verified(missing.join(target_types.select("assignment_type").distinct(), "assignment_type", "left_anti"), "H-TYPE-ABSENT", None, F.col("assignment_type"))


def percent(c: Column) -> Column:
    """A share as whole percent, halves to the even number: 0.825 is 82%."""
    return F.format_string("%.0f%%", F.bround(c * 100, 0))


def pattern_findings(verified: DataFrame) -> DataFrame:
    """(hypothesis, target_field, detail, finding_id, l, r): which findings form which pattern; detail tells patterns of
    one field apart. Record labels count from two findings on."""
    grouped = F.when(F.col("hypothesis").isin("H-HISTORY-RECORD", "H-ALT-SOURCE", "H-TYPE-ABSENT"), F.col("detail")).otherwise("")
    m = verified.select("hypothesis", "target_field", grouped.alias("detail"), "finding_id", "l", "r").distinct()
    per = m.where("hypothesis = 'H-HISTORY-RECORD'").groupBy("target_field", "detail").agg(F.count(F.lit(1)).alias("n")).where("n < 2").select(F.lit("H-HISTORY-RECORD").alias("hypothesis"), "target_field", "detail")
    return m.join(F.broadcast(per), ["hypothesis", "target_field", "detail"], "left_anti")  # at most a row a field and label


def patterns(verified: DataFrame) -> DataFrame:
    """(hypothesis, target_field, detail, n): groups of findings of one cause; which ones pattern_findings says."""
    return pattern_findings(verified).groupBy("hypothesis", "target_field", "detail").agg(F.count(F.lit(1)).alias("n"))


def described(patterns: DataFrame) -> DataFrame:
    """patterns with a sentence for readers."""
    text = {
        "H-SYSTEMIC": "nearly all findings of the field are anomalies", "H-BIJECTION": "expected values are recoded one to one", "H-PERMUTATION": "values are swapped between two persons",
        "H-ALT-SOURCE": "the value is that of another column", "H-HISTORY-RECORD": "the date is that of another record", "H-ALT-INTERPRETATION": "another reading agrees", "H-TYPE-ABSENT": "the other system holds no such type",
    }
    said = F.try_element_at(F.create_map(*[F.lit(x) for kv in text.items() for x in kv]), F.col("hypothesis"))
    return patterns.withColumn("description", F.concat(said, F.when(F.col("detail") != "", F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))).otherwise(""), F.lit(": "), F.col("n"), F.lit(" findings")))


def probable_cause(verified: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """(finding_id, l, r, target_field, probable_cause, hypotheses): the first verified hypothesis by precedence."""
    order = F.array_position(F.array(*[F.lit(h) for h in precedence]), F.col("hypothesis"))
    return verified.groupBy(*KEY).agg(F.min_by("hypothesis", order).alias("probable_cause"), F.array_sort(F.collect_set("hypothesis")).alias("hypotheses"))


def attach(findings: DataFrame, causes: DataFrame) -> DataFrame:
    """findings with probable_cause and hypotheses (an empty array where there is none)."""
    on = reduce(lambda p, q: p & q, [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in KEY])
    return findings.alias("f").join(causes.alias("c"), on, "left").select("f.*", "c.probable_cause", F.coalesce("c.hypotheses", F.expr("cast(array() as array<string>)")).alias("hypotheses"))


def prioritised(findings: DataFrame, scoring: dict) -> DataFrame:
    """findings (of attach) with priority: 100 x criticality / 5 x confidence x verdict x factors of the distinct verified
    hypotheses, at most 100; NULL unless the finding is to be investigated. priority_breakdown shows the factors."""

    def weigh(c: Column, weights: dict) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), c), F.lit(1.0))

    product = F.aggregate("hypotheses", F.lit(1.0), lambda acc, h: acc * weigh(h, scoring["factor"]))
    value = F.lit(float(scoring["scale"])) * F.coalesce("criticality", F.lit(1)) / 5 * weigh(F.col("confidence"), scoring["confidence"]) * weigh(F.col("verdict"), scoring["verdict"]) * product
    x = findings.withColumn("priority", F.when(F.col("verdict").isin(INVESTIGATE), F.round(F.least(value, F.lit(100.0)), 1)))
    number = lambda c: c.cast("decimal(10,2)").cast("string")
    steps = [
        F.lit(f"{float(scoring['scale']):g}"), F.concat(F.lit("criticality "), F.coalesce("criticality", F.lit(1)).cast("string"), F.lit("/5")),
        F.concat(F.lit("confidence "), number(weigh(F.col("confidence"), scoring["confidence"]))), F.concat(F.lit("verdict "), number(weigh(F.col("verdict"), scoring["verdict"]))),
    ]
    causes = F.transform("hypotheses", lambda h: F.concat(h, F.lit(" "), number(weigh(h, scoring["factor"]))))
    return x.withColumn("priority_breakdown", F.when(F.col("priority").isNotNull(), F.concat_ws(" x ", F.concat(F.array(*steps), causes))))


def score(findings: DataFrame, causes: DataFrame, scoring: dict) -> DataFrame:
    """findings with probable_cause, hypotheses, priority and priority_breakdown."""
    return prioritised(attach(findings, causes), scoring)


def report_order() -> list[Column]:
    """Priority first (none last), then criticality, confidence, person, key and field; ids make it total."""
    conf = F.array_position(F.array(F.lit("ELEVEE"), F.lit("MOYENNE"), F.lit("FAIBLE")), F.col("confidence"))
    return [F.col("priority").desc_nulls_last(), F.col("criticality").desc_nulls_last(), conf, F.col("person_id"), F.col("assignment_key"), F.col("target_field"), F.col("l"), F.col("r")]


def screen_order() -> list[Column]:
    """Priority first (none last), then person and field; ids make it total."""
    return [F.col("priority").desc_nulls_last(), F.col("person_id"), F.col("target_field"), F.col("l"), F.col("r")]


def persons_by_priority(findings: DataFrame) -> DataFrame:
    """(person_id, n, max_priority, rank_label): persons with findings to investigate, in order of priority; a person's
    reference E1, E2 ... is its place. Ranks come from all tasks."""
    per = investigated(findings).where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("max_priority"))
    k = ranked(per.withColumns({"_all": F.lit(0), "_o": -F.coalesce("max_priority", F.lit(-1.0))}), ["_all"], ["_o", "person_id"])
    return k.select("person_id", "n", "max_priority", F.concat(F.lit("E"), F.col("k")).alias("ref"))


def examples(findings: DataFrame, n: int = 3) -> DataFrame:
    """(target_field, verdict, examples): the first n `expected -> found` of each field and verdict to investigate, by
    finding id. Ranks come from all tasks, so no task holds the findings of a field."""
    shown = F.concat(F.coalesce("expected", F.lit("")), F.lit(" -> "), F.coalesce("target_raw", F.lit("")))
    x = investigated(findings).select("target_field", "verdict", "finding_id", "l", "r", shown.alias("s"))
    first = ranked(x, ["target_field", "verdict"], ["finding_id", "l", "r"]).where(F.col("k") <= n)
    per = first.groupBy("target_field", "verdict").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("e"))  # n entries a row
    return per.select("target_field", "verdict", F.array_join(F.transform("e", lambda x: x["s"]), " | ").alias("examples"))
