"""Queries of the reconciliation operators over the two systems' tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.config import Field, Mapping, load
from concordat.functions import kinds as K
from concordat.operators import history, hypotheses, matching, verdicts
from concordat.plans.general import latest, sql_code, sql_date, sql_effective
from concordat.session import materialize, materialize_parts, table

MAPPING = load()
#: The columns of system A.
SOURCE_COLUMNS = (
    "Matricule NomFamille PrénomUsuel DateEmbaucheRécente TypeAffectation DateEntréePoste DateSortiePoste CodePoste IntituléPoste CodeEmploi IntituléEmploi ÉchelleSalariale LibelléÉchelleSalariale CodeImputation "
    "LibelléImputation CodeDirection LibelléDirection CodeSite LibelléSite CatégorieEmploi EstPermanent EstTempsPlein CodeStatutEmploi CodeRaisonStatut LibelléRaisonStatut CodeSuspensionAccès DateEffetRaison "
    "DateRetourAnticipée IdentifiantResponsable NomResponsable CodeQuart HeuresNormeHebdo HeuresNormeQuotidienne"
).split()
#: Columns that name or date a row and say nothing of the assignment.
TECHNICAL = ("row_id", "detail_id", "charge_le", "saisi_le")


# ---------------------------------------------------------------- the two systems
Tables = str | dict[str, DataFrame]


def flag_type(primary: Column, temporary: Column, mapping: Mapping = MAPPING) -> Column:
    """The type letter of a pair of flags; NULL where a flag is unreadable or the mapping knows no such pair."""
    out = F.lit(None).cast("string")
    for letter, flags in mapping.tables["flags"].items():
        out = F.when((primary == flags["isPrimaryAssignment"]) & (temporary == flags["isTemporaryAssignment"]), letter).otherwise(out)
    return out


def typed(spark: SparkSession, d: Tables, system: str, mapping: Mapping = MAPPING) -> DataFrame:
    """All rows of a system with person_id and assignment_type (NULL where unknown)."""
    if system == "A":
        t, person = table(spark, d, "rh_source"), "Matricule"
        kind = F.upper(K.present(F.col("TypeAffectation")))
    else:
        t, person = table(spark, d, "temps_target"), "personId"
        kind = flag_type(K.boolean(F.col("isPrimaryAssignment")), K.boolean(F.col("isTemporaryAssignment")), mapping)
    return t.withColumns({"person_id": K.code(F.col(person)), "assignment_type": kind})


def side(spark: SparkSession, d: Tables, system: str, keyless: bool = False, mapping: Mapping = MAPPING) -> DataFrame:
    """Latest row per person and type with its raw columns, person_id, assignment_type and row_id. keyless: rows without
    type (one a person) and without person (all of them) too, which no other row can be told to repeat. Tables without
    `charge_le` hold no deliveries: all of their rows count."""
    rows, key = typed(spark, d, system, mapping), ["person_id", "assignment_type"]
    if "charge_le" not in rows.columns:
        return rows if keyless else rows.where("person_id is not null and assignment_type is not null")
    if not keyless:
        return latest(rows.where("person_id is not null and assignment_type is not null"), key, ["charge_le", "row_id"])
    return latest(rows.where("person_id is not null"), key, ["charge_le", "row_id"]).unionByName(rows.where("person_id is null"))


def prepared(spark: SparkSession, d: Tables, mapping: Mapping = MAPPING) -> dict[str, DataFrame]:
    """The tables with one row an assignment, written once, for plans that go over the two systems again and again."""
    out = {n: table(spark, d, n) for n in ("poste_detail", "motifs")}
    for system, name in (("A", "rh_source"), ("B", "temps_target")):
        t = table(spark, d, name)
        out[name] = t if "charge_le" not in t.columns else materialize(side(spark, d, system, True, mapping).drop("charge_le", "person_id", "assignment_type"), name)
    return out


def similarity_values(system: str, mapping: Mapping = MAPPING) -> list[Column]:
    """The fields that pairs are scored by, as comparable text v0, v1 ..."""
    return [K.comparable(x.kind, F.col(x.source if system == "A" else x.target)).alias(f"v{i}") for i, x in enumerate(mapping.similarity)]


def matched(spark: SparkSession, d: Tables, mapping: Mapping = MAPPING) -> DataFrame:
    """(l, r, score, method) over both systems' assignments: same person and type, then across types, then those that
    one system only holds."""
    sides = [materialize(side(spark, d, x, True, mapping).select(F.col("row_id").alias("id"), F.col("person_id").alias("person"), F.col("assignment_type").alias("kind"), *similarity_values(x, mapping)), "side") for x in "AB"]
    return materialize(matching.match_assignments(*sides, "person", "kind", [f"v{i}" for i in range(len(mapping.similarity))], mapping.cross_type_least), "matched")


#: What a finding on a missing assignment shows of the row.
SHOWN_A = ("TypeAffectation", "CodePoste", "CodeEmploi", "CodeDirection", "DateEntréePoste")
SHOWN_B = ("positionId", "divisionId", "assignmentStartDate", "isPrimaryAssignment", "isTemporaryAssignment")


def keyed(spark: SparkSession, d: Tables, system: str, mapping: Mapping = MAPPING, columns: Sequence[str] = ()) -> DataFrame:
    """(id, person_id, assignment_type, assignment_key, columns) of a system's assignments."""
    own = F.coalesce(K.code(F.col("CodePoste")), F.col("row_id").cast("string")) if system == "A" else F.concat(F.lit("target-"), F.col("row_id"))
    key = F.concat_ws(":", F.coalesce("assignment_type", F.lit("?")), own)
    return side(spark, d, system, True, mapping).select(F.col("row_id").alias("id"), "person_id", "assignment_type", key.alias("assignment_key"), *columns)


def unmatched(spark: SparkSession, d: Tables, pairs: DataFrame, mapping: Mapping = MAPPING) -> DataFrame:
    """The assignments that `pairs` (of matched) leaves to one system: l or r, method, person_id, assignment_type, key and
    what is shown of them."""
    columns = ["l", "r", "method", "person_id", "assignment_type", "assignment_key", "shown"]
    out = None
    for system, own, other, shown in (("A", "l", "r", SHOWN_A), ("B", "r", "l", SHOWN_B)):
        rows = keyed(spark, d, system, mapping, shown).withColumn("shown", verdicts.summary(shown)).withColumnRenamed("id", own)
        x = pairs.where(F.col(other).isNull()).join(rows, own).select(*columns)
        out = x if out is None else out.unionByName(x)
    return out


def position_history(spark: SparkSession, d: Tables) -> DataFrame:
    """Records with readable position and date; the unit may be NULL."""
    t = table(spark, d, "poste_detail")
    return t.select(K.code(F.col("IdentifiantPoste")).alias("poste"), K.effective_date(F.col("DateEffetAffectation")).alias("effective"), K.code(F.col("CodeDirectionAffectée")).alias("unit"), "detail_id").where("poste is not null and effective is not null")


def reasons(spark: SparkSession, d: Tables) -> DataFrame:
    """Lookup by normalised code, one row a code (the last by its raw text)."""
    m = table(spark, d, "motifs").select(K.code(F.col("CodeCatégorieStatut")).alias("reason"), F.col("CodeStatutSystèmeExterne").alias("lookup_reason"), F.col("CodeGestionAccès"), F.col("CodeCatégorieStatut").alias("_o"))
    return m.where("reason is not null").groupBy("reason").agg(F.max_by(F.struct("lookup_reason", "CodeGestionAccès"), "_o").alias("x")).select("reason", "x.*")


def joined(spark: SparkSession, d: Tables, columns_a: Sequence[str], columns_b: Sequence[str], dates: bool = False, lookup: bool = False, pairs: DataFrame | None = None, mapping: Mapping = MAPPING) -> DataFrame:
    """Pairs of equal person and type, or those of `pairs` (of matched), with the columns asked for, so scans read no
    others. A pair across types goes by the type of system A."""
    keyless = pairs is not None
    a = side(spark, d, "A", keyless, mapping).select("person_id", "assignment_type", F.col("row_id").alias("l"), K.code(F.col("CodePoste")).alias("history_key"), K.code(F.col("CodeDirection")).alias("history_unit"), K.code(F.col("CodeRaisonStatut")).alias("reason"), *[F.col(c).alias("a_" + c) for c in dict.fromkeys(columns_a)])
    b = side(spark, d, "B", keyless, mapping).select("person_id", "assignment_type", F.col("row_id").alias("r"), *[F.col(c).alias("b_" + c) for c in dict.fromkeys(columns_b)])
    p = a.join(b, ["person_id", "assignment_type"]) if pairs is None else pairs.where("l is not null and r is not null").select("l", "r").join(a, "l").join(b.drop("person_id", "assignment_type"), "r")
    p = p.withColumn("assignment_key", F.concat_ws(":", F.coalesce("assignment_type", F.lit("?")), F.coalesce("history_key", "l")))
    if dates:
        p = history.attach_interval(p, position_history(spark, d), "history_key", "history_unit", "poste", "effective", "unit", "detail_id")
    if lookup:
        p = p.join(F.broadcast(reasons(spark, d)), "reason", "left")  # a fixed table of 60 rows
        codes = F.array_distinct(F.array_compact(F.array(K.code(F.col("a_CodeSuspensionAccès")), K.code(F.col("a_CodeStatutEmploi")), K.code(F.col("CodeGestionAccès")))))
        p = p.withColumn("codes_disagree", (F.size(codes) > 1).cast("string"))
    return p


def pairs_for(spark: SparkSession, d: Tables, fields: Sequence[Field], all_columns: bool = False, pairs: DataFrame | None = None, mapping: Mapping = MAPPING) -> DataFrame:
    situation = any(f.rule.startswith("situation") for f in fields)
    dated = any(f.rule.startswith("interval") for f in fields)
    a = [c for f in fields for c in f.sources] + (["CodeSuspensionAccès", "CodeStatutEmploi"] if situation else [])
    if all_columns:
        a = [c for c in table(spark, d, "rh_source").columns if c not in TECHNICAL]
    return joined(spark, d, a, [f.target for f in fields], dated, situation, pairs, mapping)


def evaluated(spark: SparkSession, d: Tables, fields: Sequence[Field]) -> DataFrame:
    pairs = pairs_for(spark, d, fields)
    if len({f.rule.split("_")[0] for f in fields}) > 1:
        pairs = materialize(pairs, "pairs")
    return verdicts.evaluate(pairs, MAPPING.only(fields))


ROW = ["person_id", "assignment_key", "target_field", "reading", "expected", "target_norm", "verdict"]


def fields_of(*rules: str, kind: str | None = None) -> list[Field]:
    return [f for f in MAPPING.fields if f.rule in rules and (kind is None or f.kind == kind)]


CODED = list(MAPPING.fields)
FAMILIES: dict[str, list[Field]] = {
    "verdict_direct_code": fields_of("direct", kind="code"),
    "verdict_direct_date": fields_of("direct", kind="date"),
    "verdict_direct_number": fields_of("direct", kind="number"),
    "verdict_direct_text": fields_of("direct", kind="text"),
    "verdict_concat_code_label": fields_of("concat"),
    "verdict_decision_table": fields_of("decision_table"),
    "verdict_flag": fields_of("flag"),
    "verdict_situation": fields_of("situation_label", "situation_reason", "situation_return"),
    "verdict_assignment_dates": fields_of("interval_start", "interval_end"),
    "verdict_accent_tolerant": fields_of("accent_tolerant"),
    "verdict_email": fields_of("email"),
}


def _family(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: evaluated(spark, d, FAMILIES[name]).select(*ROW)


def all_findings(spark: SparkSession, d: str, fields: Sequence[Field] = MAPPING.fields) -> DataFrame:
    return verdicts.judge(materialize(pairs_for(spark, d, fields), "pairs"), MAPPING.only(fields))


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.verdict_counts(all_findings(spark, d, CODED))


def verdict_by_field(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.verdict_by_field(all_findings(spark, d, CODED))


def whole_findings(spark: SparkSession, d: str) -> DataFrame:
    """All fields of all matched pairs, those across types included, and the assignments that one system only holds."""
    t = prepared(spark, d)
    found = matched(spark, t)
    pairs = materialize(pairs_for(spark, t, MAPPING.fields, pairs=found), "pairs")
    return verdicts.judge(pairs, MAPPING, verdicts.missing_findings(unmatched(spark, t, found), MAPPING))


def verdict_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """All 25 fields, names and addresses included, and the pseudo-field `affectation` of assignments without partner."""
    return verdicts.verdict_counts(whole_findings(spark, d))


def interpretation_agreement(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.agreement(evaluated(spark, d, [f for f in CODED if f.interpretation]), MAPPING)


def interpretation_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose verdict depends on the reading, with their confidence."""
    x = all_findings(spark, d, [f for f in CODED if f.interpretation])
    alt = F.array_join(F.transform(F.array_sort(F.map_entries("alternatives")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return x.where(F.exists(F.map_values("alternatives"), lambda v: v != F.col("verdict"))).select("person_id", "assignment_key", "target_field", "verdict", alt.alias("alternatives"), "confidence")


# ---------------------------------------------------------------- pairing
def _missing(system: str, other: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        key = ["person_id", "assignment_type"]
        return side(spark, d, system).select(*key, "row_id").join(side(spark, d, other).select(*key), key, "left_anti")

    return run


def full_outer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(assignment_type, state, n): assignments held by both systems or by one."""
    key = ["person_id", "assignment_type"]
    a, b = side(spark, d, "A").select(*key, F.lit(1).alias("a")), side(spark, d, "B").select(*key, F.lit(1).alias("b"))
    state = F.when(F.col("b").isNull(), "missing_in_target").when(F.col("a").isNull(), "missing_in_source").otherwise("paired")
    return a.join(b, key, "full_outer").groupBy("assignment_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def type_census(spark: SparkSession, d: str) -> DataFrame:
    a, b = (side(spark, d, s).groupBy("assignment_type").agg(F.count(F.lit(1)).alias(n)) for s, n in (("A", "n_source"), ("B", "n_target")))
    return a.join(b, "assignment_type", "full_outer").fillna(0, ["n_source", "n_target"])


def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Both sides are normalised before they meet, so the join moves canonical values only."""
    s, key = MAPPING.similarity, ["person_id", "assignment_type"]
    a = side(spark, d, "A").select(*key, *[K.comparable(x.kind, F.col(x.source)).alias(f"x{i}") for i, x in enumerate(s)])
    b = side(spark, d, "B").select(*key, *[K.comparable(x.kind, F.col(x.target)).alias(f"y{i}") for i, x in enumerate(s)])
    values = a.join(b, key)
    return values.select(*key, matching.similarity([F.col(f"x{i}") for i in range(len(s))], [F.col(f"y{i}") for i in range(len(s))]).alias("score"))


def assignment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both systems, deliveries included: same person and type first, then across types."""
    sides = [materialize(typed(spark, d, x).select(F.col("row_id").alias("id"), F.col("person_id").alias("person"), F.col("assignment_type").alias("kind"), *similarity_values(x)), "side") for x in "AB"]
    return matching.match_assignments(*sides, "person", "kind", [f"v{i}" for i in range(len(MAPPING.similarity))], MAPPING.cross_type_least)


def assignment_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a faulty copy, blocked by customer and status: blocks of one, of a few and of many rows."""
    o = table(spark, d, "orders").where("o_custkey is not null")
    text = lambda c: F.col(c).cast("string")
    a = o.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", F.to_date("o_orderdate").cast("string").alias("v0"), text("o_orderpriority").alias("v1"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("v2"))
    hurt = F.col("id") % 7
    b = a.select((F.col("id") * 10).alias("id"), "o_custkey", "o_orderstatus", F.when(hurt != 1, F.col("v0")).alias("v0"), F.when(hurt == 2, "9-NONE").otherwise(F.col("v1")).alias("v1"), F.when(hurt == 3, "0.00").otherwise(F.col("v2")).alias("v2"))
    return matching.match_blocks(a, b, ["o_custkey", "o_orderstatus"], ["v0", "v1", "v2"])


def unit_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Last contiguous run of each unit a position ever had."""
    x = history.current_intervals(position_history(spark, d), "poste", "effective", "unit", "detail_id")
    return x.select("poste", F.coalesce("value", F.lit("")).alias("unit"), F.col("unit_start").cast("string").alias("unit_start"), F.coalesce(F.col("unit_end").cast("string"), F.lit("")).alias("unit_end"))


# ---------------------------------------------------------------- hypotheses on findings of the systems
def _investigated_dates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fields = FAMILIES["verdict_assignment_dates"]
    pairs = materialize(pairs_for(spark, d, fields), "pairs")
    return verdicts.judge(pairs, MAPPING.only(fields)), pairs


def hyp_history_record(spark: SparkSession, d: str) -> DataFrame:
    f, pairs = _investigated_dates(spark, d)
    x = hypotheses.history_record(f, pairs, position_history(spark, d), "poste", "effective", "detail_id")
    return x.select("finding_id", "target_field", "detail")


def hyp_alt_interpretation(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.alternative_interpretation(all_findings(spark, d, [f for f in CODED if f.interpretation])).select("finding_id", "target_field", "detail")


def alt_source_support(spark: SparkSession, d: str) -> DataFrame:
    """Support of eight coded source columns, those of its SQL, as another origin of each coded field that has anomalies;
    alt_source_all takes all columns and fields."""
    fields = FAMILIES["verdict_direct_code"]
    pairs = materialize(pairs_for(spark, d, fields, all_columns=True), "pairs")
    f = verdicts.judge(pairs, MAPPING.only(fields))
    columns = ["CodeEmploi", "CodeDirection", "CodeImputation", "CodeSite", "ÉchelleSalariale", "CodePoste", "CodeStatutEmploi", "CodeQuart"]
    return hypotheses.alternative_sources(f, pairs, MAPPING.only(fields), columns)


def with_origins(spark: SparkSession, d: Tables, pairs: DataFrame, mapping: Mapping = MAPPING) -> tuple[DataFrame, list[str]]:
    """pairs (with all columns of system A) with those of the position's latest record and of the reason's lookup row, and
    the names of all columns that another origin is looked for in."""
    h, m = table(spark, d, "poste_detail"), table(spark, d, "motifs")
    ch, cm = ([c for c in t.columns if c not in TECHNICAL] for t in (h, m))
    dated = h.withColumns({"poste": K.code(F.col("IdentifiantPoste")), "effective": K.effective_date(F.col("DateEffetAffectation"))}).where("poste is not null and effective is not null")
    last = latest(dated, ["poste"], ["effective", "detail_id"]).withColumn("DateEffetAffectation", F.col("effective"))
    last = last.select(F.col("poste").alias("history_key"), *[F.col(c).cast("string").alias(f"a_poste_detail:{c}") for c in ch])
    rows = m.select(K.code(F.col("CodeCatégorieStatut")).alias("reason"), F.struct(*cm).alias("x"), F.col("CodeCatégorieStatut").alias("_o")).where("reason is not null").groupBy("reason").agg(F.max_by("x", "_o").alias("x"))
    rows = rows.select("reason", *[F.col("x")[c].cast("string").alias(f"a_motifs:{c}") for c in cm])
    own = [c for c in table(spark, d, "rh_source").columns if c not in TECHNICAL]
    columns = [*own, *[f"poste_detail:{c}" for c in ch], *[f"motifs:{c}" for c in cm]]
    excluded = mapping.hypotheses["excluded_columns"]
    return pairs.join(last, "history_key", "left").join(F.broadcast(rows), "reason", "left"), [c for c in columns if c.split(":")[-1] not in excluded]  # a fixed table of 60 rows


def _alt_all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    t = prepared(spark, d)
    own = materialize(pairs_for(spark, t, MAPPING.fields, all_columns=True, pairs=matched(spark, t)), "own")
    pairs, columns = with_origins(spark, t, own)
    pairs = materialize(pairs, "pairs")
    # only what the hypothesis looks at, a family of rules at a time: all families' plan under all readings is too large
    f = materialize_parts(verdicts.active_verdicts(pairs, MAPPING), "findings")
    return f, pairs, columns, hypotheses.alternative_sources(f, pairs, MAPPING, columns)


def alt_source_all(spark: SparkSession, d: str) -> DataFrame:
    """Support of every column of system A, of the position's latest record and of the lookup, for every field."""
    return _alt_all(spark, d)[3]


def hyp_alt_source(spark: SparkSession, d: str) -> DataFrame:
    """Findings that another origin explains, by the rules that hold."""
    f, pairs, columns, alternatives = _alt_all(spark, d)
    rules = materialize(hypotheses.candidate_rules(alternatives, MAPPING), "rules")
    return hypotheses.alternative_source(f, pairs, MAPPING, columns, rules).select("finding_id", "target_field", "detail", "support")


# ---------------------------------------------------------------- SQL
def sql_text(c: str) -> str:
    s = f"trim(regexp_replace({c}, '[\\s\\x{{a0}}]+', ' ', 'g'))"
    return f"(case when lower({s}) not in ('', 'nan', 'nat', 'none', 'null', '<na>', 'n/a', '-') then {s} end)"


_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _let(x: str, name: str, body: str) -> str:
    return f"(list_transform([{x}], lambda {name}: {body})[1])"


def sql_repair(c: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read again where that leaves fewer marks of the fault."""
    marks = lambda x: f"len(regexp_extract_all({x}, '{K.MARKERS}'))"
    again = lambda x: f"try(decode(unhex(list_aggregate(list_transform(string_split({x}, ''), lambda q: printf('%02x', ord(q))), 'string_agg', ''))))"
    narrow = lambda x: f"regexp_full_match({x}, '[\\x00-\\x{{ff}}]*')"
    as_bytes = f"translate(a, '{K.CP1252_CHARS}', '{''.join(map(chr, K.CP1252_BYTES))}')"
    kept = lambda x: _let(again(x), "d", f"case when {marks('d')} < {marks('a')} then d end")
    first = _let(as_bytes, "w", f"case when {narrow('w')} and not regexp_matches(a, '[\\x{{80}}-\\x{{9f}}]') then {kept('w')} end")
    return _let(c, "a", f"case when regexp_matches(a, '{K.MARKERS}') then coalesce({first}, case when {narrow('a')} then {kept('a')} end, a) else a end")


def sql_clean(c: str) -> str:
    """Text kind: repaired, composed, collapsed; NULL where empty."""
    return _let(f"trim(regexp_replace(nfc_normalize({sql_repair(c)}), '{_WS}', ' ', 'g'))", "z", "case when lower(z) not in ('', 'nan', 'nat', 'none', 'null', '<na>', 'n/a', '-') then z end")


def sql_strip_accents(c: str) -> str:
    single = {k: v for k, v in K._PLAIN.items() if len(v) == 1}
    out = f"translate(b, '{''.join(single)}', '{''.join(single.values())}')"
    for k, v in K._PLAIN.items():
        if len(v) > 1 and ord(k) < 0x250:
            out = f"replace({out}, '{k}', '{v}')"
    return _let(c, "b", f"case when regexp_matches(b, '[^\\x00-\\x7f]') then regexp_replace({out}, '[\\x{{300}}-\\x{{36f}}]', '', 'g') else b end")


def sql_plain_number(c: str) -> str:
    s = f"replace(trim({c}), ',', '.')"
    tail = f"regexp_replace(case when contains({s}, '.') then regexp_replace(regexp_replace({s}, '0+$', ''), '[.]$', '') else {s} end, '^0+([0-9])', '\\1')"
    return f"(case when regexp_matches({s}, '^[0-9]+([.][0-9]*)?$') then {tail} end)"


def sql_bool(c: str) -> str:
    t = ", ".join(f"'{x}'" for x in K.TRUE_TOKENS)
    f = ", ".join(f"'{x}'" for x in K.FALSE_TOKENS)
    return f"(case when lower(trim({c})) in ({t}) then 'true' when lower(trim({c})) in ({f}) then 'false' end)"


_SQL_KIND = {"code": sql_code, "text": sql_text, "number": sql_plain_number, "bool": sql_bool, "date": lambda c: f"strftime({sql_date(c)}, '%Y-%m-%d')"}


def _bad(kind: str, c: str) -> str:
    return "false" if kind in ("code", "text") else f"({sql_code(c)} is not null and {_SQL_KIND[kind](c)} is null)"


_SQL_FLAGS = f"case when {sql_bool('isPrimaryAssignment')} = 'true' and {sql_bool('isTemporaryAssignment')} = 'false' then 'P' when {sql_bool('isPrimaryAssignment')} = 'false' and {sql_bool('isTemporaryAssignment')} = 'true' then 'A' when {sql_bool('isPrimaryAssignment')} = 'false' and {sql_bool('isTemporaryAssignment')} = 'false' then 'S' end"
_SIDE = {
    "A": f"(select * from (select *, {sql_code('Matricule')} person_id, upper({sql_text('TypeAffectation')}) assignment_type from rh_source) where person_id is not null and assignment_type is not null qualify row_number() over (partition by person_id, assignment_type order by charge_le desc, row_id desc) = 1)",
    "B": f"(select * from (select *, {sql_code('personId')} person_id, {_SQL_FLAGS} assignment_type from temps_target) where person_id is not null and assignment_type is not null qualify row_number() over (partition by person_id, assignment_type order by charge_le desc, row_id desc) = 1)",
}
#: Latest row per person and type, rows without type (one a person) and without person (all) included.
_SQL_KEYLESS = {
    x: f"(select * from (select *, {sql_code(person)} person_id, {kind} assignment_type from {t}) qualify person_id is null or row_number() over (partition by person_id, assignment_type order by charge_le desc, row_id desc) = 1)"
    for x, t, person, kind in (("A", "rh_source", "Matricule", f"upper({sql_text('TypeAffectation')})"), ("B", "temps_target", "personId", _SQL_FLAGS))
}
_HISTORY = f"""hist as (select * from (select {sql_code('IdentifiantPoste')} poste, {sql_effective('DateEffetAffectation')} eff, {sql_code('"CodeDirectionAffectée"')} unit, detail_id from poste_detail) where poste is not null and eff is not null),
 starts as (select poste, unit, eff, detail_id from (select *, row_number() over w rn, lag(unit) over w before from hist window w as (partition by poste order by eff, detail_id)) where rn = 1 or unit is distinct from before),
 runs as (select *, lead(eff) over w next_eff, row_number() over w run, count(*) over (partition by poste) n_runs from starts window w as (partition by poste order by eff, detail_id)),
 spans as (select * from runs qualify row_number() over (partition by poste, unit order by run desc) = 1)"""
_SQL_JOIN = f"from {_SIDE['A']} a join {_SIDE['B']} b on a.person_id = b.person_id and a.assignment_type = b.assignment_type"
_PAIRS = f"""{_HISTORY},
 look as (select {sql_code('"CodeCatégorieStatut"')} reason, arg_max("CodeStatutSystèmeExterne", "CodeCatégorieStatut") lookup_reason, arg_max("CodeGestionAccès", "CodeCatégorieStatut") gestion from motifs group by 1),
 one as (select poste, min(eff) first_eff from runs where n_runs = 1 group by 1),
 p as (select a.person_id, a.assignment_type || ':' || coalesce({sql_code('a.CodePoste')}, cast(a.row_id as varchar)) assignment_key, a.*, b.* exclude (person_id, assignment_type, row_id, charge_le),
  look.lookup_reason, look.gestion, case when one.poste is not null then one.first_eff else s.eff end unit_start, case when one.poste is null then s.next_eff - 1 end unit_end
  {_SQL_JOIN}
  left join look on look.reason = {sql_code('a.CodeRaisonStatut')} left join one on one.poste = {sql_code('a.CodePoste')}
  left join spans s on s.poste = {sql_code('a.CodePoste')} and s.unit = {sql_code('a.CodeDirection')})"""


def _sql_field(f: Field) -> list[str]:
    """A SELECT per reading over p."""
    i = MAPPING.interpretations.get(f.interpretation) if f.interpretation else None
    out = []
    q = [f'p."{c}"' for c in f.sources]
    t = f'p."{f.target}"'
    for choice in (i.choice, *i.alternatives) if i else (None,):
        unk, src, over, t_text = "false", "null", "cast(null as varchar)", None
        if f.rule == "accent_tolerant":
            exp = src = sql_clean(q[0])
            t_text = sql_clean(t)
            if choice == "tolerant":
                loose = lambda x: f"replace(lower({sql_strip_accents(x)}), 'ß', 'ss')"
                over = _let(exp, "m", _let(t_text, "n", f"case when m is distinct from n and {loose('m')} = {loose('n')} then 'JUSTIFIE' end"))
        elif f.rule == "email":
            pr = i.params
            first, last, ident = (sql_clean(x) for x in q)
            t_text = sql_clean(t)
            low = lambda x: f"lower({sql_strip_accents(x)})"
            digits = f"right(regexp_replace({ident}, '[^0-9]', '', 'g'), {pr['digits']})"
            local = f"({low(f'left({first}, 1)')} || replace({low(last)}, ' ', '') || {digits})"
            exp, unk = f"({local} || '@{pr['domain']}')", f"({first} is null or {last} is null or {ident} is null)"
            if choice == "strict":
                good = f"coalesce({t_text} = {exp}, false)"
            else:
                inner = f"contains(y, '@') and lower(split_part(y, '@', -1)) = '{pr['domain']}' and lower(regexp_replace(left(y, length(y) - length(split_part(y, '@', -1)) - 1), '{pr['prefix']}', '')) = {local}"
                good = _let(t_text, "y", f"coalesce({inner}, false)")
            over = f"case when {unk} then 'INDETERMINE' when {good} then 'JUSTIFIE' else 'ANOMALIE' end"
        elif f.rule == "direct":
            exp = src = _SQL_KIND[f.kind](q[0])
            unk = _bad(f.kind, q[0])
        elif f.rule == "concat":
            c, label = sql_code(q[0]), sql_text(q[1])
            padded = f"case when regexp_matches({c}, '^[0-9]+$') and length({c}) < {f.params['pad']} then lpad({c}, {f.params['pad']}, '0') else {c} end" if choice == "padded" else c
            exp, src, unk = f"({padded}) || '{f.params['separator']}' || {label}", label, f"({c} is null or {label} is null)"
        elif f.rule.startswith("situation"):
            raw = "p.gestion" if choice == "CodeGestionAccès" else f'p."{choice}"'
            rows = MAPPING.tables["situation"]
            pick = lambda k: "case " + " ".join(f"when {sql_code(raw)} in ({', '.join(repr(str(c)) for c in r['codes'])}) then '{r[k]}'" for r in rows) + " end"  # noqa: B023,E731
            if f.rule == "situation_label":
                exp, unk = f"({pick('label')})", f"(({pick('label')}) is null)"
            elif f.rule == "situation_reason":
                found = sql_code("p.lookup_reason")
                exp, unk = f"(case when ({pick('reason')}) = 'lookup' then {found} end)", f"(({pick('label')}) is null or (({pick('reason')}) = 'lookup' and {found} is null))"
            else:
                exp, unk = f"(case when ({pick('return')}) = 'source' then {_SQL_KIND['date'](q[1])} end)", f"(({pick('label')}) is null or (({pick('return')}) = 'source' and {_bad('date', q[1])}))"
        elif f.rule == "decision_table":
            rows = MAPPING.tables[f.params["table"]]
            exp = "(case " + " ".join("when " + " and ".join(f"{sql_code(chr(112) + '.' + chr(34) + k + chr(34))} = '{v}'" for k, v in r["when"].items()) + f" then '{r['value']}'" for r in rows) + " end)"
            unk = f"({exp} is null)"
        elif f.rule == "flag":
            exp = "(case " + " ".join(f"when upper({sql_text(q[0])}) = '{k}' then '{str(v[f.target]).lower()}'" for k, v in MAPPING.tables["flags"].items()) + " end)"
            unk = f"({exp} is null)"
        else:
            own = sql_date(q[0])
            fn, unit = ("least" if f.rule == "interval_end" or choice == "literal" else "greatest"), "p.unit_end" if f.rule == "interval_end" else "p.unit_start"
            exp, src, unk = f"strftime({fn}({own}, {unit}), '%Y-%m-%d')", f"strftime({own}, '%Y-%m-%d')", _bad("date", q[0])
        target = t_text or _SQL_KIND[f.kind](t)
        direct = "true" if f.rule in ("direct", "accent_tolerant", "concat", "interval_start", "interval_end") else "false"
        out.append(
            f"select p.person_id, p.assignment_key, '{f.target}' target_field, {repr(choice) if choice else 'cast(null as varchar)'} reading, {str(not i or choice == i.choice).lower()} active, cast({exp} as varchar) e, cast({src} as varchar) s, {unk} unk, cast({target} as varchar) t, {'false' if t_text else _bad(f.kind, t)} bad, {direct} direct, {over} fixed from p"
        )
    return out


def sql_evaluated(fields: Sequence[Field]) -> str:
    """CTEs up to `ev`: every field and reading with its verdict."""
    union = " union all ".join(s for f in fields for s in _sql_field(f))
    return f"""with {_PAIRS}, raw as ({union}),
 ev as (select person_id, assignment_key, target_field, reading, active, case when not unk then e end expected, t target_norm,
  case when fixed is not null then fixed when bad or unk then 'INDETERMINE' when e is not distinct from t then case when direct and s is not distinct from t then 'CONFORME' else 'JUSTIFIE' end else 'ANOMALIE' end verdict from raw)"""


_MISSING = "select x.person_id, x.assignment_type, x.row_id from {0} x left join {1} y on x.person_id = y.person_id and x.assignment_type = y.assignment_type where y.person_id is null"
_V = ", ".join(f"count(*) filter (where verdict = '{v}') {v.lower()}" for v in verdicts.VERDICTS)


def _sql_comparable(kind: str, c: str) -> str:
    full = {"code": sql_code, "number": lambda x: f"coalesce({sql_plain_number(x)}, '?' || {sql_text(x)})", "date": lambda x: f"coalesce(strftime({sql_date(x)}, '%Y-%m-%d'), '?' || {sql_text(x)})"}
    return full[kind](c)


def _sql_similarity_of(a: str, b: str) -> str:
    both = [(_sql_comparable(x.kind, f'{a}."{x.source}"'), _sql_comparable(x.kind, f'{b}."{x.target}"')) for x in MAPPING.similarity]
    n = " + ".join(f"(({p}) is not null or ({q}) is not null)::int" for p, q in both)
    k = " + ".join(f"coalesce(({p}) = ({q}), false)::int" for p, q in both)
    return f"(case when ({n}) > 0 then round(({k}) / ({n}), 4) else 0.0 end)"


def _sql_similarity() -> str:
    return f"select a.person_id, a.assignment_type, {_sql_similarity_of('a', 'b')} score from {_SIDE['A']} a join {_SIDE['B']} b on a.person_id = b.person_id and a.assignment_type = b.assignment_type"


def _sql_summary(t: str, columns: Sequence[str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"""case when {t}."{c}" <> '' then '{c}=' || {t}."{c}" end""" for c in columns) + ")"


def sql_match(name: str, left: str, right: str, block: Sequence[str], values: Sequence[tuple[str, str]], exact: int = matching.EXACT) -> str:
    """CTEs up to `name`_out (l, r, score, method): the rows of `left` and `right` (with row_id) of equal `block`. Blocks up
    to `exact` rows a side by the best total over all sets of partners, the first in order among equals; larger ones cell
    by cell. values: expressions over a and b."""
    n = " + ".join(f"(({p}) is not null or ({q}) is not null)::int" for p, q in values)
    k = " + ".join(f"coalesce(({p}) = ({q}), false)::int" for p, q in values)
    score = f"(case when ({n}) > 0 then round(({k}) / ({n}), 4) else 0.0 end)"
    by, on = ", ".join(block), " and ".join(f"a.{c} = b.{c}" for c in block)
    there = " and ".join(f"{c} is not null" for c in block)
    row = "struct_pack(" + ", ".join(f"{c} := a.{c}" for c in block) + ")"
    ctes = [
        f"{name}_l as (select *, row_number() over (partition by {by} order by row_id) - 1 i, count(*) over (partition by {by}) n from ({left}) where {there})",
        f"{name}_r as (select *, row_number() over (partition by {by} order by row_id) - 1 j, count(*) over (partition by {by}) m from ({right}) where {there})",
        f"{name}_c as (select {row} blk, a.row_id l, b.row_id r, i, j, n, m, least(n, m) short, greatest(n, m) long, case when n <= m then i else j end k, case when n <= m then j else i end c, {score} score from {name}_l a join {name}_r b on {on})",
        f"{name}_s0 as (select distinct blk, short, long, 0 mask, 0.0::double total, []::bigint[] path from {name}_c where long > 1 and long <= {exact})",
    ]
    for t in range(1, exact + 1):
        ctes.append(
            f"{name}_s{t} as (select blk, short, long, mask, max(total) total, arg_min(path, (-round(total, 9), path)) path from (select s.blk, s.short, s.long, s.mask | (1 << c.c) mask, s.total + c.score total, list_append(s.path, c.c) path from {name}_s{t - 1} s join {name}_c c on c.blk = s.blk and c.k = {t - 1} where s.short >= {t} and (s.mask >> c.c) & 1 = 0) group by all)"
        )
    ends = " union all ".join(f"select blk, total, path from {name}_s{t} where short = {t}" for t in range(1, exact + 1))
    ctes += [
        f"{name}_best as (select blk, arg_min(path, (-round(total, 9), path)) path from ({ends}) group by 1)",
        f"{name}_g as (select blk, 0 step, []::bigint[] ui, []::bigint[] uj, null::bigint l, null::bigint r, null::double score from (select distinct blk from {name}_c where long > {exact}) union all select g.blk, step + 1, list_append(ui, c.i), list_append(uj, c.j), c.l, c.r, c.score from {name}_g g join {name}_c c on c.blk = g.blk where not list_contains(ui, c.i) and not list_contains(uj, c.j) qualify row_number() over (partition by g.blk order by c.score desc, c.i, c.j) = 1)",
        f"{name}_out as (select l, r, score, 'UNIQUE' method from {name}_c where long = 1 union all select l, r, score, 'OPTIMAL' from {name}_c c join {name}_best b on b.blk = c.blk where c.c = b.path[c.k + 1] union all select l, r, score, 'GREEDY' from {name}_g where l is not null)",
    ]
    return ", ".join(ctes)


def _sql_assignment_pairs() -> str:
    values = [(_sql_comparable(x.kind, f'a."{x.source}"'), _sql_comparable(x.kind, f'b."{x.target}"')) for x in MAPPING.similarity]
    a, b = f"select *, {sql_code('Matricule')} person, upper({sql_text('TypeAffectation')}) kind from rh_source", f"select *, {sql_code('personId')} person, {_SQL_FLAGS} kind from temps_target"
    rest = lambda t, c: f"select * exclude (i, n) from (select *, 0 i, 0 n from ({t})) where row_id not in (select {c} from same_out)"
    null = "null::double score"
    return f"""with recursive {sql_match("same", a, b, ["person", "kind"], values)}, {sql_match("cross_", rest(a, "l"), rest(b, "r"), ["person"], values)},
 paired as (select * from same_out union all select l, r, score, 'CROSS_TYPE' from cross__out where score >= {MAPPING.cross_type_least})
 select * from paired union all select row_id, null, {null}, 'MISSING_IN_TARGET' from rh_source where row_id not in (select l from paired) union all select null, row_id, {null}, 'MISSING_IN_SOURCE' from temps_target where row_id not in (select r from paired)"""


def _sql_assignment_orders() -> str:
    a = "select o_orderkey row_id, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') v0, o_orderpriority v1, cast(cast(round(o_totalprice, 2) as decimal(18,2)) as varchar) v2 from orders where o_custkey is not null"
    b = f"select row_id * 10 row_id, o_custkey, o_orderstatus, case when row_id % 7 <> 1 then v0 end v0, case when row_id % 7 = 2 then '9-NONE' else v1 end v1, case when row_id % 7 = 3 then '0.00' else v2 end v2 from ({a})"
    return f"with recursive {sql_match('o', a, b, ['o_custkey', 'o_orderstatus'], [(f'a.v{i}', f'b.v{i}') for i in range(3)])} select * from o_out"


_ALT_COLUMNS = ["CodeEmploi", "CodeDirection", "CodeImputation", "CodeSite", "ÉchelleSalariale", "CodePoste", "CodeStatutEmploi", "CodeQuart"]


def _sql_alt() -> str:
    fields = FAMILIES["verdict_direct_code"]
    parts = []
    for f in fields:
        src, t = sql_code(f'p."{f.sources[0]}"'), sql_code(f'p."{f.target}"')
        for c in _ALT_COLUMNS:
            if c in f.sources:
                continue
            v = sql_code(f'p."{c}"')
            parts.append(f"select '{f.target}' target_field, '{c}' col, count(*) filter (where {v} = {t}) hits, count(*) filter (where {v} = {t} and {src} is distinct from {t}) explains, count(*) population, count(*) filter (where {src} is not distinct from {t}) good, count(*) filter (where {src} is distinct from {t}) bad from p where {t} is not null")
    return f"with {_PAIRS}, u as ({' union all '.join(parts)}) select target_field, col, hits, explains, population, round(hits / population, 6) support, round(good / population, 6) mapped_support from u where bad > 0"


SQL: dict[str, str] = {
    **{k: f"{sql_evaluated(v)} select person_id, assignment_key, target_field, reading, expected, target_norm, verdict from ev" for k, v in FAMILIES.items()},
    "verdict_counts": f"{sql_evaluated(CODED)} select v.verdict, count(ev.verdict) n from (select unnest(['CONFORME', 'JUSTIFIE', 'ANOMALIE', 'INDETERMINE']) verdict) v left join ev on ev.verdict = v.verdict and ev.active group by 1",
    "verdict_by_field": f"{sql_evaluated(CODED)} select coalesce(target_field, 'TOTAL') target_field, {_V}, count(*) n from ev where active group by rollup (target_field)",
    "interpretation_agreement": f"{sql_evaluated([f for f in CODED if f.interpretation])}, g as (select target_field, reading, active, count(*) filter (where verdict <> 'INDETERMINE') evaluated, count(*) filter (where verdict in ('CONFORME', 'JUSTIFIE')) agreeing from ev group by all) select *, round(case when evaluated > 0 then agreeing / evaluated else 0 end, 6) rate from g",
    "missing_in_target": _MISSING.format(_SIDE["A"], _SIDE["B"]),
    "missing_in_source": _MISSING.format(_SIDE["B"], _SIDE["A"]),
    "full_outer_pairs": f"select coalesce(a.assignment_type, b.assignment_type) assignment_type, case when b.person_id is null then 'missing_in_target' when a.person_id is null then 'missing_in_source' else 'paired' end state, count(*) n from {_SIDE['A']} a full join {_SIDE['B']} b on a.person_id = b.person_id and a.assignment_type = b.assignment_type group by all",
    "type_census": f"select coalesce(a.assignment_type, b.assignment_type) assignment_type, coalesce(n_source, 0) n_source, coalesce(n_target, 0) n_target from (select assignment_type, count(*) n_source from {_SIDE['A']} group by 1) a full join (select assignment_type, count(*) n_target from {_SIDE['B']} group by 1) b on a.assignment_type = b.assignment_type",
    "similarity_scores": _sql_similarity(),
    "assignment_pairs": _sql_assignment_pairs(),
    "assignment_orders": _sql_assignment_orders(),
    "unit_intervals": f"with {_HISTORY} select poste, coalesce(unit, '') unit, strftime(eff, '%Y-%m-%d') unit_start, coalesce(strftime(next_eff - 1, '%Y-%m-%d'), '') unit_end from spans",
    "hyp_alt_interpretation": f"{sql_evaluated([f for f in CODED if f.interpretation])}, alt as (select person_id, assignment_key, target_field, string_agg(reading, ',' order by reading) detail from ev where not active and verdict in ('CONFORME', 'JUSTIFIE') group by all) select ev.person_id || ':' || ev.assignment_key || ':' || ev.target_field finding_id, ev.target_field, detail from ev join alt using (person_id, assignment_key, target_field) where active and verdict in ('ANOMALIE', 'INDETERMINE')",
    "interpretation_sweep": f"{sql_evaluated([f for f in CODED if f.interpretation])}, alt as (select person_id, assignment_key, target_field, string_agg(reading || '=' || verdict, ';' order by reading) alternatives, list(distinct verdict) vs from ev where not active group by all) select ev.person_id, ev.assignment_key, ev.target_field, ev.verdict, alternatives, 'MOYENNE' confidence from ev join alt using (person_id, assignment_key, target_field) where active and len(list_filter(vs, lambda x: x <> ev.verdict)) > 0",
    "alt_source_support": _sql_alt(),
    "hyp_history_record": f"{sql_evaluated(FAMILIES['verdict_assignment_dates'])}, k as (select poste, strftime(eff, '%Y-%m-%d') d, n, min(k) k from (select poste, eff, row_number() over (partition by poste order by eff, detail_id) k, count(*) over (partition by poste) n from hist) group by all) select ev.person_id || ':' || ev.assignment_key || ':' || ev.target_field finding_id, ev.target_field, case when k = 1 then 'first' when k = n then 'last' else 'record ' || k end detail from ev join k on k.poste = split_part(ev.assignment_key, ':', 2) and k.d = ev.target_norm where active and verdict in ('ANOMALIE', 'INDETERMINE')",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _family(k) for k in FAMILIES},
    "verdict_counts": verdict_counts,
    "verdict_by_field": verdict_by_field,
    "verdict_counts_all": verdict_counts_all,
    "interpretation_agreement": interpretation_agreement,
    "interpretation_sweep": interpretation_sweep,
    "missing_in_target": _missing("A", "B"),
    "missing_in_source": _missing("B", "A"),
    "full_outer_pairs": full_outer_pairs,
    "type_census": type_census,
    "similarity_scores": similarity_scores,
    "assignment_pairs": assignment_pairs,
    "assignment_orders": assignment_orders,
    "unit_intervals": unit_intervals,
    "hyp_history_record": hyp_history_record,
    "hyp_alt_interpretation": hyp_alt_interpretation,
    "alt_source_support": alt_source_support,
    "alt_source_all": alt_source_all,
    "hyp_alt_source": hyp_alt_source,
}
