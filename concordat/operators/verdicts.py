"""Verdicts: every mapped field of every pair against the value the mapping expects.

The mapping is compiled to Catalyst expressions. Each pair is first unfolded into one row per field and reading with the
raw inputs only; one branch per family of rules then normalises and decides, so that no row carries the expressions of
all fields. Verdicts: CONFORME (equal to the source), JUSTIFIE (other than the source but as expected), ANOMALIE,
INDETERMINE (can't be computed or read).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.config import Field, Mapping
from concordat.functions import kinds as K

VERDICTS = ["CONFORME", "JUSTIFIE", "ANOMALIE", "INDETERMINE"]
INVESTIGATE = ["ANOMALIE", "INDETERMINE"]
#: Names of the columns of a pair: its own, and those of its two rows behind these prefixes.
A, B = "a_", "b_"


def _raw(n: int) -> list[str]:
    """Names of the raw sources of a row."""
    return [f"s{k + 1}" for k in range(n)]


#: Columns every rule finds at least.
_RAW = _raw(3)


def by_kind(kind: Column, value: Column, f: Callable[[str, Column], Column], kinds: Sequence[str]) -> Column:
    """f of the row's kind."""
    out = None
    for k in kinds:
        x = f(k, value)
        out = F.when(kind == k, x) if out is None else out.when(kind == k, x)
    return out


def decide(expected: Column, unknown: Column, source: Column, target: Column, target_unreadable: Column) -> Column:
    """Unreadable target, then unknown expectation, then equality: with the source too it is conform, else justified."""
    return (
        F.when(target_unreadable | unknown, "INDETERMINE")
        .when(expected.eqNullSafe(target), F.when(F.col("direct") & source.eqNullSafe(target), "CONFORME").otherwise("JUSTIFIE"))
        .otherwise("ANOMALIE")
    )


def unfold(pairs: DataFrame, mapping: Mapping, fields: Sequence[Field], extra: Callable[[Field], tuple[str | None, str | None]]) -> DataFrame:
    """pairs x fields x readings: keys, field, kind, rule, reading, active, raw sources s1, s2 ..., x1, x2 and raw target.

    Stated as one SQL expression, which the analyser takes in one go.
    """
    text = lambda c: f"cast(`{c}` as string)" if c else "cast(null as string)"
    quoted = lambda v: "cast(null as string)" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    items, names = [], _raw(max([len(_RAW), *[len(f.sources) for f in fields]]))
    for f in fields:
        i = mapping.interpretations.get(f.interpretation) if f.interpretation else None
        for choice in (i.choice, *i.alternatives) if i else (None,):
            s = [A + c for c in f.sources] + [None] * (len(names) - len(f.sources))
            if f.rule.startswith("situation") and i:
                s[0] = A + choice if choice in ("CodeSuspensionAccès", "CodeStatutEmploi") else choice
            x1, x2 = extra(f)
            cells = {
                "target_field": quoted(f.target), "kind": quoted(f.kind), "rule": quoted(f.rule), "criticality": str(f.criticality), "reading": quoted(choice), "active": str(not i or choice == i.choice).lower(),
                **{n: text(c) for n, c in zip(names, s)}, "x1": text(x1), "x2": text(x2), "target_raw": text(B + f.target),
                "pad": f"cast({f.params['pad'] if 'pad' in f.params else 'null'} as int)", "separator": quoted(f.params.get("separator")),
            }
            items.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in cells.items()) + ")")
    return pairs.selectExpr("person_id", "assignment_key", "l", "r", f"explode(array({', '.join(items)})) as x").select("person_id", "assignment_key", "l", "r", "x.*")


def _finish(rows: DataFrame, expected: Column, unknown: Column, source: Column | None, kinds: Sequence[str], subcategory: Column | None = None, verdict: Column | None = None, confidence: Column | None = None, target: Column | None = None) -> DataFrame:
    """Bind the normalised inputs as columns, then decide. source None: the rule has no direct counterpart."""
    null = F.lit(None).cast("string")
    x = rows.withColumns(
        {
            "expected": expected,
            "unknown": unknown,
            "source_norm": null if source is None else source,
            "direct": F.lit(source is not None),
            "target_norm": by_kind(F.col("kind"), F.col("target_raw"), K.canonical, kinds) if target is None else target,
            "target_bad": by_kind(F.col("kind"), F.col("target_raw"), K.unreadable, kinds),
        }
    )
    plain = decide(F.col("expected"), F.col("unknown"), F.col("source_norm"), F.col("target_norm"), F.col("target_bad"))
    x = x.withColumn("plain", plain)
    x = x.withColumn("verdict", F.col("plain") if verdict is None else verdict)
    x = x.withColumn("subcategory", null if subcategory is None else subcategory).withColumn("confidence", F.lit("ELEVEE") if confidence is None else confidence)
    expected_shown = F.when(~F.col("unknown"), F.col("expected"))
    return x.select(*OUT[:4], "target_field", "kind", "rule", "criticality", "reading", "active", F.col("s1").alias("source_raw"), "target_raw", expected_shown.alias("expected"), "target_norm", "verdict", "subcategory", "confidence")


OUT = ["person_id", "assignment_key", "l", "r", "target_field", "kind", "rule", "criticality", "reading", "active", "source_raw", "target_raw", "expected", "target_norm", "verdict", "subcategory", "confidence"]


def rule_direct(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    value = by_kind(F.col("kind"), F.col("s1"), K.canonical, kinds)
    return _finish(rows, value, by_kind(F.col("kind"), F.col("s1"), K.unreadable, kinds), value, kinds)


def rule_accent_tolerant(rows: DataFrame) -> DataFrame:
    """As direct; where only accents or case differ, the tolerant reading justifies with medium confidence."""
    value = K.text(F.col("s1"))
    rows = rows.withColumns({"_la": K.text_loose(F.col("s1")), "_lb": K.text_loose(F.col("target_raw"))})
    near = (F.col("plain") == "ANOMALIE") & (F.col("reading") == "tolerant") & F.col("_la").isNotNull() & (F.col("_la") == F.col("_lb"))
    return _finish(rows, value, F.lit(False), value, ["text"], F.when(near, "accents or case"), F.when(near, "JUSTIFIE").otherwise(F.col("plain")), F.when(near, "MOYENNE").otherwise("ELEVEE"))


def rule_email(rows: DataFrame, domain: str, digits: int, prefix: str) -> DataFrame:
    """Initial and name without accents, last digits of the id, domain; compared by parts or strictly. Never CONFORME."""
    first, last, ident = (K.text(F.col(c)) for c in _RAW)
    rows = rows.withColumns({"_f": first, "_l": last, "_i": ident, "_t": K.text(F.col("target_raw"))})
    rows = rows.withColumns(
        {
            "_d": F.right(F.regexp_replace("_i", r"\D", ""), F.lit(digits)),
            "_n": F.regexp_replace(F.lower(K.strip_accents(F.col("_l"))), " ", ""),
            "_a": F.lower(K.strip_accents(F.left("_f", F.lit(1)))),
            "_dom": F.substring_index("_t", "@", -1),
        }
    )
    rows = rows.withColumn("_local", F.concat("_a", "_n", "_d"))
    left = F.when(F.col("_t").contains("@"), F.expr("left(_t, length(_t) - length(_dom) - 1)")).otherwise("")
    rows = rows.withColumns({"_pre": F.regexp_extract(left, prefix, 0), "_left": left})
    rows = rows.withColumn("_rest", F.expr("substring(_left, length(_pre) + 1)"))
    low = F.lower(F.col("_rest"))
    ok_domain, ok_initial = F.lower("_dom") == domain.lower(), F.left(low, F.lit(1)) == F.col("_a")
    ok_name, ok_digits = F.expr("substring(lower(_rest), 2)").startswith(F.col("_n")), low == F.col("_local")
    exact = (F.col("_pre") == "") & (F.col("_rest") == F.col("_local")) & (F.col("_dom") == domain)
    expected = F.concat("_local", F.lit("@" + domain))
    unknown = F.col("_f").isNull() | F.col("_l").isNull() | F.col("_i").isNull()
    good = ok_domain & ok_initial & ok_name & ok_digits
    by_parts = F.when(F.col("_t").isNull(), "ANOMALIE").when(good, "JUSTIFIE").otherwise("ANOMALIE")
    verdict = F.when(F.col("unknown"), "INDETERMINE").when(F.col("reading") == "strict", F.when(F.col("_t").eqNullSafe(F.col("expected")), "JUSTIFIE").otherwise("ANOMALIE")).otherwise(by_parts)
    sub = (
        F.when(F.col("unknown"), None)
        .when(F.col("_t").isNull(), "no address")
        .when(F.col("reading") == "strict", None)
        .when(exact, None)
        .when(good & (F.col("_pre") != ""), "environment prefix")
        .when(good, "case")
        .when(~ok_domain, "other domain")
        .when(ok_initial, "id doesn't match")
        .otherwise("not by the rule")
    )
    conf = F.when((F.col("reading") != "strict") & good & ~exact, "MOYENNE").otherwise("ELEVEE")
    return _finish(rows, expected, unknown, None, ["text_loose"], sub, verdict, conf, target=F.col("_t"))


def rule_concat(rows: DataFrame) -> DataFrame:
    """Code, padded under the padded reading, separator and label; an anomaly says which half differs."""
    code = K.code(F.col("s1"))
    rows = rows.withColumns({"_c": code, "_l": K.text(F.col("s2"))})
    padded = F.when((F.col("reading") == "padded") & F.col("_c").rlike(r"^\d+$"), F.expr("case when length(_c) >= pad then _c else lpad(_c, pad, '0') end")).otherwise(F.col("_c"))
    rows = rows.withColumn("_p", padded)
    expected = F.concat("_p", F.col("separator"), F.col("_l"))
    rows = rows.withColumn("_t", K.text(F.col("target_raw")))
    at = F.expr("instr(_t, separator)")
    head, tail = F.expr("left(_t, greatest(instr(_t, separator) - 1, 0))"), F.expr("substring(_t, instr(_t, separator) + length(separator))")
    sub = F.when(
        F.col("plain") == "ANOMALIE",
        F.when(F.col("_t").isNull(), "no value").when(at == 0, "no separator").when((head != F.col("_p")) & (tail != F.col("_l")), "code and label").when(head != F.col("_p"), "code").otherwise("label"),
    )
    return _finish(rows, expected, F.col("_c").isNull() | F.col("_l").isNull(), F.col("_l"), ["text"], sub, target=F.col("_t"))


def _situation(mapping: Mapping, what: str) -> Column:
    out = F.lit(None).cast("string")
    for row in mapping.tables["situation"]:
        out = F.when(F.col("_code").isin([str(c) for c in row["codes"]]), F.lit(row[what])).otherwise(out)
    return out


def rule_situation(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """Label, reason or return date of a situation code; x1 is the lookup's reason, x2 says that codes disagree."""
    rows = rows.withColumn("_code", K.code(F.col("s1")))
    rows = rows.withColumns({"_label": _situation(mapping, "label"), "_reason": _situation(mapping, "reason"), "_return": _situation(mapping, "return"), "_date": K.canonical("date", F.col("s2")), "_datebad": K.unreadable("date", F.col("s2")), "_found": K.code(F.col("x1"))})
    label, reason, back = (F.col("rule") == r for r in ("situation_label", "situation_reason", "situation_return"))
    expected = F.when(label, F.col("_label")).when(reason & (F.col("_reason") == "lookup"), F.col("_found")).when(back & (F.col("_return") == "source"), F.col("_date"))
    unknown = F.col("_label").isNull() | (reason & (F.col("_reason") == "lookup") & F.col("_found").isNull()) | (back & (F.col("_return") == "source") & F.col("_datebad"))
    return _finish(rows, expected, unknown, None, ["text", "code", "date"], confidence=F.when(F.col("x2") == "true", "MOYENNE").otherwise("ELEVEE"))


def rule_decision_table(rows: DataFrame, mapping: Mapping, f: Field) -> DataFrame:
    """Value of the first row whose conditions all hold; booleans are read as such, other conditions as codes."""
    out = F.lit(None).cast("string")
    for row in reversed(mapping.tables[f.params["table"]]):
        tests = []
        for column, want in row["when"].items():
            raw = F.col(_raw(len(f.sources))[f.sources.index(column)])
            tests.append(K.boolean(raw) == want if isinstance(want, bool) else K.code(raw) == str(want))
        out = F.when(reduce(lambda p, q: p & q, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(str(row["value"]))).otherwise(out)
    rows = rows.withColumn("_v", out)
    return _finish(rows, F.col("_v"), F.col("_v").isNull(), None, [f.kind])


def rule_flag(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """Boolean flag of a type letter; other letters are unknown."""
    out = F.lit(None).cast("string")
    for letter, flags in mapping.tables["flags"].items():
        for target, value in flags.items():
            out = F.when((F.col("_t") == letter) & (F.col("target_field") == target), F.lit(str(value).lower())).otherwise(out)
    rows = rows.withColumn("_t", F.upper(K.text(F.col("s1")))).withColumn("_v", out)
    return _finish(rows, F.col("_v"), F.col("_v").isNull(), None, ["bool"])


def rule_interval(rows: DataFrame) -> DataFrame:
    """Start: the later of own date and unit's start (literal reading: the earlier). End: the earlier of both ends."""
    rows = rows.withColumns({"_d": K.date(F.col("s1")), "_bad": K.unreadable("date", F.col("s1")), "_u": F.col("x1").cast("date")})
    start = F.when(F.col("reading") == "literal", F.least("_d", "_u")).otherwise(F.greatest("_d", "_u"))
    expected = F.when(F.col("rule") == "interval_start", start).otherwise(F.least("_d", "_u")).cast("string")
    return _finish(rows, expected, F.col("_bad"), F.col("_d").cast("string"), ["date"], confidence=F.when(F.col("x2").isNotNull() & ~F.col("_bad"), "MOYENNE").otherwise("ELEVEE"))


def evaluate(pairs: DataFrame, mapping: Mapping) -> DataFrame:
    """One row per pair, field and reading (active and alternatives); see families()."""
    return reduce(DataFrame.unionByName, [x for x, _ in families(pairs, mapping)])


def families(pairs: DataFrame, mapping: Mapping, placed: bool = True) -> Iterator[tuple[DataFrame, bool]]:
    """The evaluated rows of each family of rules, and whether any of its fields has readings, made when asked for. `pairs` holds matched pairs: person_id,
    assignment_key, l, r, a_<source columns>, b_<target columns>, unit_start, unit_end, history_note, lookup_reason,
    codes_disagree, and CodeGestionAccès as the lookup gives it.

    The pairs are placed by `l` before they are unfolded, so that what is folded per pair and field afterwards is together
    already and only pairs are shuffled, not findings; where nothing is folded they needn't be placed."""
    if placed:
        pairs = pairs.repartition("l")
    groups: dict[str, list[Field]] = {}
    for f in mapping.fields:
        family = "situation" if f.rule.startswith("situation") else "interval" if f.rule.startswith("interval") else f.rule
        groups.setdefault(family, []).append(f)

    def extra(f: Field) -> tuple[str | None, str | None]:
        if f.rule == "interval_start":
            return "unit_start", "history_note"
        if f.rule == "interval_end":
            return "unit_end", "history_note"
        if f.rule.startswith("situation"):
            return "lookup_reason", "codes_disagree"
        return None, None

    for family, fields in groups.items():
        parts = [fields] if family != "decision_table" else [[f] for f in fields]
        for fs in parts:
            rows = unfold(pairs, mapping, fs, extra)
            if family == "direct":
                done = rule_direct(rows, sorted({f.kind for f in fs}))
            elif family == "accent_tolerant":
                done = rule_accent_tolerant(rows)
            elif family == "email":
                p = mapping.interpretations[fs[0].interpretation].params
                done = rule_email(rows, p["domain"], p["digits"], p["prefix"])
            elif family == "concat":
                done = rule_concat(rows)
            elif family == "situation":
                done = rule_situation(rows, mapping)
            elif family == "decision_table":
                done = rule_decision_table(rows, mapping, fs[0])
            elif family == "flag":
                done = rule_flag(rows, mapping)
            else:
                done = rule_interval(rows)
            yield done, any(f.interpretation for f in fs)


def findings(evaluated: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Active readings with their alternatives folded in: `alternatives` maps a reading to its verdict; a verdict that
    another reading changes has at most medium confidence; `rule_params` holds the active reading and what each other one
    gives. `missing` rows (pseudo-field `affectation`) are added."""
    # all readings of one field of one pair share a key, so the window never holds more than a handful of rows
    w = Window.partitionBy("l", "r", "target_field")
    other = F.filter(F.collect_list(F.when(~F.col("active"), F.struct("reading", "verdict", "expected"))).over(w), lambda x: x.isNotNull())
    x = evaluated.withColumn("_alt", F.array_sort(other)).where("active")
    x = x.withColumn("alternatives", F.map_from_entries(F.transform("_alt", lambda a: F.struct(a["reading"], a["verdict"]))))
    told = F.transform("_alt", lambda a: F.struct(F.concat(F.lit("alternative["), a["reading"], F.lit("]")).alias("k"), F.concat(a["verdict"], F.lit(" (expected "), F.coalesce(a["expected"], F.lit("nothing")), F.lit(")")).alias("v")))
    own = F.when(F.col("reading").isNotNull(), F.array(F.struct(F.lit("reading").alias("k"), F.col("reading").alias("v")))).otherwise(F.expr("cast(array() as array<struct<k:string,v:string>>)"))
    x = x.withColumn("rule_params", F.map_from_entries(F.concat(own, told)))
    differs = F.exists("_alt", lambda a: a["verdict"] != F.col("verdict"))
    x = x.withColumn("confidence", F.when(differs & (F.col("confidence") == "ELEVEE"), "MOYENNE").otherwise(F.col("confidence"))).drop("_alt")
    return _with(_named(x), missing)


def _named(x: DataFrame) -> DataFrame:
    return x.drop("active").withColumn("finding_id", F.concat_ws(":", "person_id", "assignment_key", "target_field"))


def _with(x: DataFrame, missing: DataFrame | None) -> DataFrame:
    return x if missing is None else x.unionByName(missing, allowMissingColumns=True)


def judge(pairs: DataFrame, mapping: Mapping, missing: DataFrame | None = None) -> DataFrame:
    """findings(evaluate(pairs)), family by family: where a family's fields have one reading there is nothing to fold."""
    none = F.expr("cast(map() as map<string,string>)")
    parts = [findings(x) if several else _named(x.withColumns({"alternatives": none, "rule_params": none})) for x, several in families(pairs, mapping)]
    return _with(reduce(DataFrame.unionByName, parts), missing)


def active_verdicts(pairs: DataFrame, mapping: Mapping) -> Iterator[DataFrame]:
    """(finding_id, l, r, target_field, target_norm, verdict) of judge(), a table a family of rules: other readings change
    none of them, so only the active one is evaluated, nothing is folded and no row leaves its place."""
    for x, _ in families(pairs, mapping.active(), placed=False):
        yield _named(x).select("finding_id", "l", "r", "target_field", "target_norm", "verdict")


def readings(findings: DataFrame) -> DataFrame:
    """(target_field, reading, active, verdict) of every reading of findings, as agreement() takes them."""
    each = F.concat(F.array(F.struct(F.col("reading").alias("key"), F.col("verdict").alias("value"), F.lit(True).alias("active"))), F.transform(F.map_entries("alternatives"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(False).alias("active"))))
    return findings.where("reading is not null").select("target_field", F.explode(each).alias("x")).select("target_field", F.col("x.key").alias("reading"), "x.active", F.col("x.value").alias("verdict"))


def summary(columns: Sequence[str]) -> Column:
    """`name=value, ...` of the columns that hold something."""
    return F.concat_ws(", ", *[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(c.removeprefix(A).removeprefix(B) + "="), F.col(c))) for c in columns])


def missing_findings(pairs: DataFrame, mapping: Mapping) -> DataFrame:
    """A finding per row without partner, on the pseudo-field `affectation`. `shown`, if there, is what its system holds."""
    s = lambda v: F.lit(v).cast("string")
    in_target = F.col("method") == "MISSING_IN_TARGET"
    crit = F.when(in_target, mapping.missing_in_target).otherwise(mapping.missing_in_source)
    held = F.col("shown") if "shown" in pairs.columns else s(None)
    return pairs.where(F.col("method").isin("MISSING_IN_TARGET", "MISSING_IN_SOURCE")).select(
        "person_id", "assignment_key", "l", "r", s("affectation").alias("target_field"), s("text").alias("kind"), s("missing").alias("rule"), crit.alias("criticality"), s(None).alias("reading"),
        F.when(in_target, held).alias("source_raw"), F.when(~in_target, held).alias("target_raw"), s(None).alias("expected"), s(None).alias("target_norm"), s("ANOMALIE").alias("verdict"), F.lower("method").alias("subcategory"), s("ELEVEE").alias("confidence"),
        F.expr("cast(map() as map<string,string>)").alias("alternatives"), F.create_map(s("method"), F.col("method")).alias("rule_params"), F.concat_ws(":", "person_id", "assignment_key", s("affectation")).alias("finding_id"),
    )


def agreement(evaluated: DataFrame, mapping: Mapping) -> DataFrame:
    """(target_field, reading, active, evaluated, agreeing, rate) of every reading; INDETERMINE isn't counted."""
    x = evaluated.where("reading is not null").groupBy("target_field", "reading", "active").agg(F.count_if(F.col("verdict") != "INDETERMINE").alias("evaluated"), F.count_if(F.col("verdict").isin("CONFORME", "JUSTIFIE")).alias("agreeing"))
    return x.withColumn("rate", F.round(F.when(F.col("evaluated") > 0, F.col("agreeing") / F.col("evaluated")).otherwise(0.0), 6))


def verdict_counts(findings: DataFrame) -> DataFrame:
    """(verdict, n): all four verdicts, 0 where there is none."""
    spark = findings.sparkSession
    enum = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return enum.join(findings.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict", "left").fillna(0, ["n"])


def verdict_by_field(findings: DataFrame) -> DataFrame:
    """Fields by verdicts, with a total row ('TOTAL'): one rollup, pivoted over the four verdicts."""
    counted = findings.groupBy("target_field").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], F.count(F.lit(1)).alias("n"))
    names = [*[v.lower() for v in VERDICTS], "n"]
    return counted.unionByName(counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).select(F.lit("TOTAL").alias("target_field"), *names))
