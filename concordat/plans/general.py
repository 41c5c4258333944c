"""Queries of the general problems 3, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import kinds as K
from concordat.operators import asof, bitemporal, setrec
from concordat.session import table


def position_records(spark: SparkSession, d: str) -> DataFrame:
    """Readable records of poste_detail: (code_poste, unit, effective, saisi_le, detail_id)."""
    t = table(spark, d, "poste_detail")
    return t.select(
        K.code(F.col("IdentifiantPoste")).alias("code_poste"),
        K.code(F.col("CodeDirectionAffectée")).alias("unit"),
        K.effective_date(F.col("DateEffetAffectation")).alias("effective"),
        "saisi_le",
        "detail_id",
    ).where("code_poste is not null and unit is not null and effective is not null")


def position_ledger(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal.bitemporal_ledger(position_records(spark, d), "code_poste", "effective", "saisi_le", "unit", "detail_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    periods = bitemporal.coalesce_periods(bitemporal.as_recorded(position_ledger(spark, d)), "code_poste")
    return periods.select(
        "code_poste",
        F.col("value").alias("unit"),
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format(F.date_sub("valid_to", 1), "yyyy-MM-dd"), F.lit("")).alias("valid_to"),
    )


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger, superseded rows included."""
    return position_ledger(spark, d).select(
        "code_poste",
        F.col("value").alias("unit"),
        *(F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c) for c in ("valid_from", "valid_to")),
        *(F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c) for c in ("recorded_from", "recorded_to")),
    )


def events_with_unit(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    m = table(spark, d, "mouvement").select(
        "mouvement_id", K.code(F.col("CodePoste")).alias("code_poste"), F.to_date("event_ts").alias("event_day"), F.col("event_ts").cast("timestamp").alias("event_ts"), K.code(F.col("divisionId")).alias("division")
    )
    if "division" in columns:
        m = m.where("division is not null")
    else:
        m = m.drop("division")
    return asof.asof_join(m, position_ledger(spark, d), "code_poste", "event_day", "event_ts")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return events_with_unit(spark, d, ["division"]).where("value <> division").select("mouvement_id", F.col("value").alias("unit")).distinct()


def p6_unit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events (each delivery once) per unit that was in effect and known."""
    e = events_with_unit(spark, d, []).select("mouvement_id", "value").distinct()
    return e.groupBy(F.col("value").alias("unit")).agg(F.count(F.lit(1)).alias("n_events"))


#: Compared fields: name in system B, name in system A, kind.
COMPARED = [
    ("positionId", "CodeEmploi", "code"),
    ("divisionId", "CodeDirection", "code"),
    ("divisionCode", "CodeImputation", "code"),
    ("siteCode", "CodeSite", "code"),
    ("payGradeId", "ÉchelleSalariale", "code"),
    ("onboardDate", "DateEmbaucheRécente", "date"),
    ("assignmentStartDate", "DateEntréePoste", "date"),
    ("weeklyHoursOverride", "HeuresNormeHebdo", "number"),
    ("dailyHoursOverride", "HeuresNormeQuotidienne", "number"),
]
KEY = ["person_id", "assignment_type"]


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key; combines on the map side, so a key with many rows stays cheap."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*key, "_x.*")


def assignments(spark: SparkSession, d: str, system: str) -> DataFrame:
    """One row per person and assignment type of a system, compared fields in canonical form under their names in B."""
    side = 1 if system == "A" else 0
    t = table(spark, d, "rh_source" if system == "A" else "temps_target")
    if system == "A":
        kind = F.upper(K.present(F.col("TypeAffectation")))
        person = "Matricule"
    else:
        kind = F.when(K.boolean(F.col("isPrimaryAssignment")), "P").when(K.boolean(F.col("isTemporaryAssignment")), "A").otherwise("S")
        person = "personId"
    fields = [K.comparable(f[2], F.col(f[side])).alias(f[0]) for f in COMPARED]
    rows = t.select(K.code(F.col(person)).alias("person_id"), kind.alias("assignment_type"), *fields, "charge_le", "row_id")
    return latest(rows.where("person_id is not null and assignment_type is not null"), KEY, ["charge_le", "row_id"]).drop("charge_le", "row_id")


def p5_differences(spark: SparkSession, d: str) -> DataFrame:
    """Every difference with what A says (expected) and what B holds (target), in canonical form."""
    return setrec.field_differences(assignments(spark, d, "A"), assignments(spark, d, "B"), KEY, [f[0] for f in COMPARED])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_differences(spark, d).select(*KEY, "fld")


# ---------------------------------------------------------------- the same in SQL

def sql_code(c: str) -> str:
    s = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
    return f"(case when {c} is null or lower({s}) in ('', 'nan', 'nat', 'none', 'null', '<na>', 'n/a', '-') then null when regexp_matches({s}, '^[0-9]+([.]0*)?$') then case when ltrim(regexp_replace({s}, '[.]0*$', ''), '0') = '' then '0' else ltrim(regexp_replace({s}, '[.]0*$', ''), '0') end else {s} end)"


def sql_date(c: str) -> str:
    s = f"trim({c})"
    return (
        f"coalesce(try_cast(case when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9:.]+Z?)?$') then substr({s}, 1, 10) "
        f"when regexp_matches({s}, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') then replace({s}, '/', '-') "
        f"when regexp_matches({s}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') then substr({s}, 7, 4) || '-' || substr({s}, 4, 2) || '-' || substr({s}, 1, 2) end as date), null)"
    )


def sql_effective(c: str) -> str:
    s = f"trim({c})"
    n = f"try_cast(regexp_replace({s}, '[.]0+$', '') as integer)"
    return f"(case when regexp_matches({s}, '^[0-9]+([.]0+)?$') then case when {n} between 1 and 2958465 then date '1899-12-30' + {n} end else {sql_date(c)} end)"


_RECORDS = f"""rec as (select * from (select {sql_code('IdentifiantPoste')} code_poste, {sql_code('"CodeDirectionAffectée"')} unit, {sql_effective('DateEffetAffectation')} eff, saisi_le, detail_id
  from poste_detail) where code_poste is not null and unit is not null and eff is not null)"""

def sql_number(c: str) -> str:
    s = f"replace(trim({c}), ',', '.')"
    return f"(case when {c} is null or lower({s}) in ('', 'nan', 'nat', 'none', 'null', '<na>', 'n/a', '-') then null else coalesce(cast(try_cast({s} as double) as varchar), '?' || {s}) end)"


def _sql_side(system: str) -> str:
    side = 1 if system == "A" else 0
    person = "Matricule" if system == "A" else "personId"
    kind = "upper(trim(TypeAffectation))" if system == "A" else "case when lower(trim(isPrimaryAssignment)) in ('true', '1', 'oui', 'vrai') then 'P' when lower(trim(isTemporaryAssignment)) in ('true', '1', 'oui', 'vrai') then 'A' else 'S' end"
    read = {"code": sql_code, "number": sql_number, "date": lambda c: f"(case when {sql_code(c)} is not null then coalesce(strftime({sql_date(c)}, '%Y-%m-%d'), '?' || trim({c})) end)"}
    fields = ", ".join(f"""{read[f[2]](f'"{f[side]}"')} v{i}""" for i, f in enumerate(COMPARED))
    t = "rh_source" if system == "A" else "temps_target"
    return f"(select * from (select {sql_code(person)} person_id, {kind} assignment_type, {fields}, charge_le, row_id from {t}) where person_id is not null and assignment_type is not null qualify row_number() over (partition by person_id, assignment_type order by charge_le desc, row_id desc) = 1)"


_DIFF = f"""with j as (select coalesce(a.person_id, b.person_id) person_id, coalesce(a.assignment_type, b.assignment_type) assignment_type,
  a.person_id is null no_a, b.person_id is null no_b, {', '.join(f'a.v{i} a{i}, b.v{i} b{i}' for i in range(len(COMPARED)))}
  from {_sql_side('A')} a full join {_sql_side('B')} b on a.person_id = b.person_id and a.assignment_type = b.assignment_type)
 """ + " union all ".join(
    [
        "select person_id, assignment_type, 'missing_in_target' fld from j where no_b",
        "select person_id, assignment_type, 'missing_in_source' fld from j where no_a",
        *(f"select person_id, assignment_type, '{f[0]}' fld from j where not no_a and not no_b and a{i} is distinct from b{i}" for i, f in enumerate(COMPARED)),
    ]
)

SQL = {
    "p5_found": _DIFF,
    "p3_found": f"""with {_RECORDS},
 cur as (select code_poste, eff, arg_max(unit, (saisi_le, detail_id)) unit from rec group by 1, 2),
 chg as (select *, lag(unit) over (partition by code_poste order by eff) before from cur)
 select code_poste, unit, strftime(eff, '%Y-%m-%d') valid_from,
  coalesce(strftime(lead(eff) over (partition by code_poste order by eff) - interval 1 day, '%Y-%m-%d'), '') valid_to
 from chg where before is distinct from unit""",
    "p6_found": f"""with {_RECORDS},
 ev as (select distinct mouvement_id, {sql_code('CodePoste')} code_poste, event_ts, {sql_code('divisionId')} division from mouvement),
 best as (select mouvement_id, division, arg_max(unit, (eff, saisi_le, detail_id)) unit from ev join rec using (code_poste)
  where division is not null and eff <= cast(event_ts as date) and saisi_le <= event_ts group by 1, 2)
 select distinct mouvement_id, unit from best where unit <> division""",
    "p6_unit_counts": f"""with {_RECORDS},
 ev as (select distinct mouvement_id, {sql_code('CodePoste')} code_poste, event_ts from mouvement),
 best as (select mouvement_id, arg_max(unit, (eff, saisi_le, detail_id)) unit from ev join rec using (code_poste)
  where eff <= cast(event_ts as date) and saisi_le <= event_ts group by 1)
 select unit, count(*) n_events from best group by 1""",
}
QUERIES = {"p3_found": p3_found, "p3_ledger": p3_ledger, "p5_found": p5_found, "p5_differences": p5_differences, "p6_found": p6_found, "p6_unit_counts": p6_unit_counts}
