"""Queries of the analysis, feedback, privacy, source and normaliser operators, and their SQL.

Population hypotheses run on findings between orders and a copy with deterministic faults, stated once as portable SQL,
so that swaps, recodings, systemic differences and other origins all occur; the rest runs on the tables as they are. In
the field `rest` each order is a person of its own, so that the SQL of the swaps, which pairs by rank, is theirs exactly;
swaps that one person stands in the way of are held against brute force in the tests.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import kinds as K
from concordat.operators import feedback, hypotheses, privacy, report, verdicts
from concordat.operators.feedback import ExpertRule
from concordat.plans import pipeline
from concordat.plans import reconciliation as R
from concordat.plans.general import COMPARED, latest, sql_code, sql_date, sql_effective
from concordat.plans.reconciliation import MAPPING, sql_bool, sql_plain_number
from concordat.session import materialize, shared_dir, table, track
from concordat.sources import files

#: Findings between orders (with their customer) and the faulty copy; {o} and {c} stand for the tables.
FAULTY = """
select cast(o_custkey as string) || ':' || o_orderstatus || ':' || cast(o_orderkey as string) || ':' || f as finding_id, o_orderkey as l, o_orderkey as r, f as target_field,
 case when f = 'rest' then 'o' || cast(o_orderkey as string) else cast(o_custkey as string) end as person_id, o_orderstatus || ':' || cast(o_orderkey as string) as assignment_key, crit as criticality, e as expected, t as target_raw, t as target_norm, o_orderstatus as assignment_type,
 case when e = t then 'CONFORME' else 'ANOMALIE' end as verdict, case when e = t then null when t is null then 'empty' else 'other value' end as subcategory,
 case when o_orderkey % 5 = 0 then 'MOYENNE' else 'ELEVEE' end as confidence, cast(c_nationkey as string) as nation, c_mktsegment as segment, cast(o_orderkey % 9 as string) as ninth
from (
 select o.*, c.*, 'unit' as f, 4 as crit, cast(c_nationkey as string) as e, case when o_orderkey % 17 = 3 and c_nationkey in (3, 4) then cast(7 - c_nationkey as string) else cast(c_nationkey as string) end as t from {o} o join {c} c on o_custkey = c_custkey
 union all
 select o.*, c.*, 'segment' as f, 2 as crit, c_mktsegment as e, 'S-' || c_mktsegment as t from {o} o join {c} c on o_custkey = c_custkey
 union all
 select o.*, c.*, 'rest' as f, 5 as crit, cast(o_orderkey % 7 as string) as e, cast(o_orderkey % 9 as string) as t from {o} o join {c} c on o_custkey = c_custkey
 union all
 select o.*, c.*, 'priority' as f, 3 as crit, o_orderpriority as e, case when o_orderkey % 29 = 1 then null else o_orderpriority end as t from {o} o join {c} c on o_custkey = c_custkey
) x"""
H = MAPPING.hypotheses


def faulty(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(FAULTY, o=table(spark, d, "orders"), c=table(spark, d, "customer"))


def hyp_systemic(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.systemic_fields(faulty(spark, d), H["systemic_share"], H["systemic_count"])


def hyp_bijection(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.bijection_fields(faulty(spark, d), H["bijection_count"])


def hyp_permutation(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.swaps(faulty(spark, d)).select("target_field", "finding_a", "finding_b", "value_a", "value_b")


def hyp_type_absent(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of system A that B lacks, of types that B doesn't hold; the copy of B here lost its temporary ones."""
    a, b = (R.side(spark, d, x).select("person_id", "assignment_type", F.col("row_id").alias("l")) for x in "AB")
    b = b.where("assignment_type <> 'A'")
    gone = a.join(b.select("person_id", "assignment_type"), ["person_id", "assignment_type"], "left_anti")
    missing = gone.select(F.concat_ws(":", "person_id", "assignment_type", F.lit("affectation")).alias("finding_id"), "l", F.lit(None).cast("long").alias("r"), F.lit("affectation").alias("target_field"), "assignment_type")
    return hypotheses.type_absent(missing, b).select("finding_id", "detail")


def verified(f: DataFrame) -> DataFrame:
    return hypotheses.systemic(f, H["systemic_share"], H["systemic_count"]).unionByName(hypotheses.bijection(f, H["bijection_count"])).unionByName(hypotheses.permutation(f))


def scored(spark: SparkSession, d: str) -> DataFrame:
    f = faulty(spark, d)
    return hypotheses.score(f, hypotheses.probable_cause(verified(f), H["precedence"]), MAPPING.scoring)


def probable_cause(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("probable_cause is not null").groupBy("target_field", "probable_cause", F.array_join("hypotheses", ",").alias("hypotheses")).agg(F.count(F.lit(1)).alias("n"))


def priority_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("finding_id", "target_field", "verdict", "priority")


def priority_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("priority is not null").select("finding_id", "target_field", "priority_breakdown")


def priority_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten findings to look at first: a report, so it has a limit."""
    return scored(spark, d).orderBy(*hypotheses.report_order()).limit(10).select("finding_id", "priority", "probable_cause")


def patterns(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.described(hypotheses.patterns(verified(faulty(spark, d))))


def pattern_findings(spark: SparkSession, d: str) -> DataFrame:
    """Which findings form which pattern."""
    return hypotheses.pattern_findings(verified(faulty(spark, d))).select("hypothesis", "target_field", "detail", "finding_id")


def persons_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.persons_by_priority(scored(spark, d))


def field_examples(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.examples(faulty(spark, d))


def field_order(spark: SparkSession, d: str) -> DataFrame:
    return report.field_order(faulty(spark, d))


def finding_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the anomalies of two fields, as a screen shows them."""
    x = report.selected(scored(spark, d), ["ANOMALIE"], ["unit", "priority"])
    return x.select("finding_id", report.label(x).alias("label"))


def agreement_percent(spark: SparkSession, d: str) -> DataFrame:
    """Share of anomalies per field and person's market segment, as whole percent."""
    per = faulty(spark, d).groupBy("target_field", "segment").agg((F.count_if(F.col("verdict") == "ANOMALIE") / F.count(F.lit(1))).alias("share"))
    return per.select("target_field", "segment", hypotheses.percent(F.col("share")).alias("share"))


def finding_problems(spark: SparkSession, d: str) -> DataFrame:
    """What must never be in findings, over all of them; no row is the good result."""
    x = report.explained(faulty(spark, d).withColumns({"rule": F.lit("direct"), "kind": F.lit("text"), "source_raw": F.col("expected")}), MAPPING)
    return report.problems(x.withColumn("rule_id", F.coalesce("rule_id", F.lit("R-ORDERS")))).select("finding_id", "problem")


# ---------------------------------------------------------------- feedback
RULES = [
    ExpertRule("R-EXPERT-001", "accept_value_mapping", "unit", {"mapping": {"3": "4"}}, "agreed recoding"),
    ExpertRule("R-EXPERT-002", "accept_hypothesis", "segment", {"hypothesis": "H-BIJECTION"}, "prefix of the other system"),
    ExpertRule("R-EXPERT-003", "accept_subcategory", "priority", {"subcategory": "empty"}, "not kept there"),
    ExpertRule("R-EXPERT-004", "accept_alternative_source", "rest", {"column": "ninth"}, "other origin"),
]


def with_candidates(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("candidates", F.create_map(F.lit("nation"), "nation", F.lit("segment"), "segment", F.lit("ninth"), "ninth"))


def feedback_rules(spark: SparkSession, d: str) -> DataFrame:
    x = feedback.apply_rules(with_candidates(spark, d), RULES)
    return x.groupBy("target_field", "expert_rule", "initial_verdict", "verdict").agg(F.count(F.lit(1)).alias("n"))


def feedback_preview(spark: SparkSession, d: str) -> DataFrame:
    f = materialize(with_candidates(spark, d), "preview")
    out = None
    for r in RULES:
        p = feedback.preview(f, r)
        out = p if out is None else out.unionByName(p)
    return out


def corrections(f: DataFrame) -> DataFrame:
    """One in eleven anomalies is corrected; of those, one in three was judged on another expected value."""
    stale = F.col("l") % 3 == 0
    return f.where("verdict = 'ANOMALIE' and l % 11 = 0").select("finding_id", F.lit("JUSTIFIE").alias("new_verdict"), F.when(stale, F.lit("before")).otherwise(F.col("expected")).alias("c_expected"), F.col("target_raw").alias("c_target_raw"))


def feedback_corrections(spark: SparkSession, d: str) -> DataFrame:
    f = faulty(spark, d)
    return feedback.apply_corrections(f, corrections(f)).groupBy("target_field", "correction", "verdict").agg(F.count(F.lit(1)).alias("n"))


def feedback_status(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule and correction took effect."""
    f = materialize(with_candidates(spark, d), "status")
    c = corrections(f).unionByName(spark.createDataFrame([("gone", "CONFORME", None, None)], "finding_id string, new_verdict string, c_expected string, c_target_raw string"))
    rules = [*RULES, ExpertRule("R-EXPERT-005", "accept_subcategory", "rest", {"subcategory": "other value"}, "tried out", active=False)]
    return feedback.status(rules, feedback.apply_corrections(feedback.apply_rules(f, rules), c), c)


def usable_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of system A that an alternative source of a date field may name."""
    t = table(spark, d, "rh_source")
    return feedback.usable_columns(t, [c for c in t.columns if c not in R.TECHNICAL], "date")


def feedback_suggestions(spark: SparkSession, d: str) -> DataFrame:
    f = scored(spark, d)
    return feedback.suggestions(f, corrections(faulty(spark, d)), RULES[2:3])


# ---------------------------------------------------------------- report
def report_records(spark: SparkSession, d: str) -> DataFrame:
    """The 24 columns of the flat record of the anomalies, every column text."""
    x = scored(spark, d).where("verdict = 'ANOMALIE'").withColumns({"rule": F.lit("direct"), "kind": F.lit("code"), "source_raw": F.col("expected"), "rule_params": F.create_map(F.lit("segment"), F.col("segment"))})
    return report.record(report.told(report.explained(x, MAPPING)))


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the customers that anomalies of `unit` go back to, NULL cells dropped."""
    f = faulty(spark, d).where("verdict = 'ANOMALIE' and target_field = 'unit'")
    cited = f.select("finding_id", F.lit("customer").alias("tbl"), F.col("person_id").cast("long").alias("row_id"))
    rows = report.evidence_rows(cited, {"customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id").select("row_id", "c_name", "c_mktsegment", "c_nationkey")})
    return rows.select("finding_id", "row_id", F.explode("vals").alias("col", "val"))


def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """Last value per key over each order's lines, merged as evidence maps."""
    l = table(spark, d, "lineitem")
    e = l.select(F.col("l_orderkey").cast("string").alias("finding_id"), F.col("l_returnflag").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("ord"), F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("supp"), F.col("l_suppkey").cast("string")).alias("vals"), F.lit(None).cast("string").alias("note"))
    m = report.merge_evidence(e)
    return m.select("finding_id", "id", F.col("vals")["part"].alias("part"), F.col("vals")["supp"].alias("supp"))


def finding_json(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies of `unit` as nested JSON."""
    f = faulty(spark, d).where("verdict = 'ANOMALIE' and target_field = 'unit'").select("finding_id", "target_field", "expected", "target_raw", F.array("segment", "nation").alias("tags"))
    return report.nested_json(f)


def clipped_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first 80 characters of each document on one line."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", privacy.clip(F.col("text"), 80).alias("clipped"))


# ---------------------------------------------------------------- privacy
def leak_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", privacy.leaks(F.col("text")).cast("int").alias("n_leaks"))


def mask_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", privacy.mask(F.col("text")).alias("masked"))


def _secrets(spark: SparkSession, d: str) -> DataFrame:
    """Persons of both systems, names of system A by person, names of B and of those responsible."""
    a, b = table(spark, d, "rh_source"), table(spark, d, "temps_target")
    people = a.select(K.code(F.col("Matricule")).alias("person")).unionByName(b.select(K.code(F.col("personId")).alias("person")))
    named = {label: a.select(K.code(F.col("Matricule")).alias("person"), F.trim(c).alias("value")) for label, c in (("NOM", "NomFamille"), ("PRENOM", "PrénomUsuel"))}
    return privacy.secrets(people, named, [a.select(F.trim("NomResponsable")), b.select(F.trim("surname")), b.select(F.trim("givenName"))])


def secret_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _secrets(spark, d)


def pseudonymize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with persons, their names and other secrets of both systems replaced."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return privacy.pseudonymize(docs, "doc_id", "text", _secrets(spark, d), "key")


def known_leaks(spark: SparkSession, d: str) -> DataFrame:
    return privacy.known_leaks(table(spark, d, "documents").where("text is not null"), "doc_id", "text", _secrets(spark, d), "key")


def tokens_positions(spark: SparkSession, d: str) -> DataFrame:
    return privacy.tokens(table(spark, d, "rh_source").select(K.code(F.col("CodePoste")).alias("id")), "id", "POSTE")


def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, dates and quotations of each anomaly's explanation that its record lacks. Every seventh explanation here
    speaks of another order."""
    x = report.told(scored(spark, d).where("verdict = 'ANOMALIE'"))
    said = F.when(F.col("l") % 7 == 0, F.concat("explanation", F.lit(" See order "), (F.col("l") + 100001).cast("string"))).otherwise(F.col("explanation"))
    record = F.concat_ws(" ", "target_field", "expected", "target_raw", "probable_cause", "person_id")
    return x.select("finding_id", F.size(privacy.ungrounded(said, record)).alias("n_ungrounded"))


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many answers on anomalies may be used. They are made here: some aren't JSON, cite what they weren't given, hold
    other keys, or numbers that the record lacks."""
    x = report.told(scored(spark, d).where("verdict = 'ANOMALIE'"))
    cited = F.concat(F.lit('["o:'), F.col("l"), F.when(F.col("l") % 5 == 1, F.lit("9")).otherwise(""), F.lit('"]'))
    text = F.when(F.col("l") % 7 == 2, F.lit("The order 424242 says so too.")).otherwise(F.lit("The value differs from the one expected."))
    answer = F.when(F.col("l") % 11 == 3, F.lit("I can't say.")).otherwise(F.concat(F.lit('{"synthese": "'), text, F.lit('", "'), F.when(F.col("l") % 13 == 4, "sources").otherwise("preuves"), F.lit('": '), cited, F.lit("}")))
    context = x.select("finding_id", F.concat_ws(" ", "expected", "target_raw").alias("payload"), F.array(F.concat(F.lit("o:"), F.col("l"))).alias("evidence"))
    return privacy.checked_answers(x.select("finding_id", answer.alias("answer")), context, "finding_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def unexplained(spark: SparkSession, d: str) -> DataFrame:
    return privacy.unexplained(scored(spark, d)).select("finding_id", "target_field")


def dossier_per_person(spark: SparkSession, d: str) -> DataFrame:
    return privacy.dossiers(scored(spark, d))


def flow_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether documents may leave, by source class and leaks."""
    t = table(spark, d, "documents").where("text is not null")
    classes = {s: ("internal" if s in ("note_rh", "proces_verbal", "releve") else "public") for s in ("note_rh", "courriel", "billet", "avis", "procedure", "releve", "clavardage", "proces_verbal", "sondage", "glossaire")}
    decision = privacy.flow_decision(F.array(F.coalesce("source", F.lit("?"))), classes, ["public"], privacy.leaks(F.col("text")), True)
    return t.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- normalisers and configuration
def excel_serial_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "poste_detail").select("detail_id", K.effective_date(F.col("DateEffetAffectation")).cast("string").alias("effective"))


def normalize_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temps_target").select("row_id", *[K.code(F.col(c)).alias(c) for c in ("personId", "divisionId", "positionId", "siteCode", "payGradeId")])


def normalize_bool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rh_source").select("row_id", *[K.boolean(F.col(c)).cast("string").alias(c) for c in ("EstPermanent", "EstTempsPlein")])


def normalize_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rh_source").select("row_id", K.number(F.col("HeuresNormeHebdo")).alias("weekly"), K.number(F.col("HeuresNormeQuotidienne")).alias("daily"))


def normalize_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temps_target").select("row_id", *[K.canonical("date", F.col(c)).alias(c) for c in ("onboardDate", "assignmentStartDate")])


def normalize_states(spark: SparkSession, d: str) -> DataFrame:
    """Empty, unreadable and readable values of each kind."""
    t = table(spark, d, "poste_detail")
    c = F.col("DateEffetAffectation")
    state = F.when(K.is_empty(c), "empty").when(K.effective_date(c).isNull(), "unreadable").otherwise("value")
    return t.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Names as text, without accents, and as loose text."""
    t = table(spark, d, "rh_source")
    return t.select("row_id", *[x for c in ("NomFamille", "PrénomUsuel") for x in (K.text(F.col(c)).alias(f"{c}_text"), K.strip_accents(K.text(F.col(c))).alias(f"{c}_plain"), K.text_loose(F.col(c)).alias(f"{c}_loose"))])


def padded_codes(spark: SparkSession, d: str) -> DataFrame:
    """Unit codes with zeros on the left up to four characters; longer ones stay whole."""
    return table(spark, d, "rh_source").select("row_id", K.zfill(K.code(F.col("CodeDirection")), 4).alias("unit"))


def repair_surnames(spark: SparkSession, d: str) -> DataFrame:
    """Surnames whose common encoding fault the core normaliser repairs."""
    t = table(spark, d, "temps_target").select("row_id", "surname")
    fixed = K.let(F.col("surname"), K.repair_encoding)
    return t.withColumn("repaired", fixed).where("repaired <> surname")


def config_gaps(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.uncovered(spark, d)


def latest_position_record(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of each position."""
    t = table(spark, d, "poste_detail").select(K.code(F.col("IdentifiantPoste")).alias("poste"), K.effective_date(F.col("DateEffetAffectation")).alias("effective"), K.code(F.col("CodeDirectionAffectée")).alias("unit"), "detail_id")
    x = latest(t.where("poste is not null and effective is not null"), ["poste"], ["effective", "detail_id"])
    return x.select("poste", F.col("effective").cast("string").alias("effective"), F.coalesce("unit", F.lit("")).alias("unit"), "detail_id")


def pair_sheet(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of both systems and the rows without partner."""
    t = R.prepared(spark, d)
    return pipeline.pair_sheet(spark, t, R.matched(spark, t), MAPPING).drop("l", "r")


def missing_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on assignments that one system only holds."""
    t = R.prepared(spark, d)
    alone = R.unmatched(spark, t, R.matched(spark, t))
    return verdicts.missing_findings(alone, MAPPING).select("finding_id", "l", "r", "criticality", "subcategory", F.coalesce("source_raw", "target_raw").alias("held"))


def candidate_rules(spark: SparkSession, d: str) -> DataFrame:
    """Columns that explain the anomalies of a field better than its own. System B's dates of hiring here are those of
    entry, so that there is one."""
    fields = [f for f in MAPPING.fields if f.kind in ("date", "number") and f.rule == "direct"]
    pairs = materialize(R.pairs_for(spark, d, fields, all_columns=True).withColumn("b_onboardDate", F.coalesce("a_DateEntréePoste", "b_onboardDate")), "pairs")
    m = MAPPING.only(fields)
    f = materialize(verdicts.judge(pairs, m), "findings")
    columns = ["DateEmbaucheRécente", "DateEntréePoste", "DateEffetRaison", "HeuresNormeHebdo", "HeuresNormeQuotidienne"]
    return hypotheses.candidate_rules(hypotheses.alternative_sources(f, pairs, m, columns), m)


def file_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Bundle round trip: the lookup table written as CSV to the folder all executors share, and read again, with the
    file's status."""
    folder = os.path.join(shared_dir(spark), f"concordat-bundle-{uuid.uuid4().hex}")
    rows = table(spark, d, "motifs")
    track(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/motifs.csv")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(rows.toPandas().to_csv(sep=";", index=False).encode("utf-8-sig")))  # a fixed table of 60 rows
    out.close()
    before = materialize(files.digests(spark, folder), "digests")
    back = files.read_csv(spark, f"{folder}/motifs.csv")
    n = materialize(back.agg(F.count(F.lit(1)).alias("rows_read"), F.min("_row").alias("first_row")), "bundle")
    return materialize(files.unchanged(before, files.digests(spark, folder)).select("name", "status").crossJoin(F.broadcast(n)), "integrity")  # one row


_F = f"f as ({FAULTY.replace('{o}', 'orders').replace('{c}', 'customer').replace('as string', 'as varchar')})"
_SYS = "sys as (select target_field, count(*) filter (where verdict = 'ANOMALIE') k, count(*) n from f group by 1 having k >= 5 and k / n >= 0.8)"
_BIJ = """p as (select target_field, expected, target_norm, count(*) c, min(person_id) p1, max(person_id) p2 from f where verdict = 'ANOMALIE' and expected is not null and target_norm is not null group by all),
 be as (select target_field, expected, count(*) targets, sum(c) c, min(p1) p1, max(p2) p2 from p group by all), bt as (select target_field, max(s) sources from (select target_field, target_norm, count(*) s from p group by all) group by 1),
 bij as (select be.target_field, cast(sum(c) as bigint) n_pairs from be join bt using (target_field) group by 1 having max(targets) = 1 and max(sources) = 1 and max((p1 <> p2)::int) = 1 and sum(c) >= 5)"""
_SWAP = """sw as (select *, least(expected, target_norm) lo, greatest(expected, target_norm) hi, row_number() over (partition by target_field, expected, target_norm order by finding_id) k from f where verdict = 'ANOMALIE' and expected is not null and target_norm is not null and expected <> target_norm),
 swaps as (select a.target_field, a.finding_id finding_a, b.finding_id finding_b, a.expected value_a, b.expected value_b from sw a join sw b on a.target_field = b.target_field and a.lo = b.lo and a.hi = b.hi and a.k = b.k and a.expected = a.lo and b.expected = b.hi and a.person_id <> b.person_id)"""
_VER = """ver as (select finding_id, target_field, 'H-SYSTEMIC' h from f join sys using (target_field) where verdict = 'ANOMALIE' union all select finding_id, target_field, 'H-BIJECTION' from f join bij using (target_field) where verdict = 'ANOMALIE' and target_norm is not null union all select finding_a, target_field, 'H-PERMUTATION' from swaps union all select finding_b, target_field, 'H-PERMUTATION' from swaps)"""
_W = {**MAPPING.scoring["factor"]}
_SCORED = f"""cause as (select finding_id, arg_min(h, case h when 'H-PERMUTATION' then 1 when 'H-BIJECTION' then 5 else 6 end) probable_cause, string_agg(distinct h, ',' order by h) hypotheses, product(case h {' '.join(f"when '{k}' then {v}" for k, v in _W.items())} end) factor from ver group by 1),
 scored as (select f.*, cause.probable_cause, cause.hypotheses, case when verdict = 'ANOMALIE' then round(least(100.0 * criticality / 5 * case confidence when 'ELEVEE' then 1.0 else 0.7 end * coalesce(factor, 1.0), 100.0) + 1e-9, 1) end priority from f left join cause using (finding_id))"""
_ALL = f"with {_F}, {_SYS}, {_BIJ}, {_SWAP}, {_VER}, {_SCORED}"
_CORR = "corr as (select finding_id, case when l % 3 = 0 then 'before' else expected end ce from f where verdict = 'ANOMALIE' and l % 11 = 0)"
_W_ = "\\p{L}\\p{N}_"
_LONG = lambda c: f"regexp_replace(regexp_replace({c}, '(^|[^{_W_}])[0-9]{{7,}}($|[^{_W_}])', '\\1{privacy.NUMBER_MASK}\\2', 'g'), '(^|[^{_W_}])[0-9]{{7,}}($|[^{_W_}])', '\\1{privacy.NUMBER_MASK}\\2', 'g')"
_KEY = lambda c: f"array_to_string(regexp_extract_all({c}, '[{_W_}]+'), ' ')"
_SECRETS = f"""people as (select person, 'EMP-' || case when length(cast(n as varchar)) < 2 then '0' || n else cast(n as varchar) end tok from (select person, row_number() over (order by person) n from (select distinct person from (select {sql_code('Matricule')} person from rh_source union all select {sql_code('personId')} from temps_target) where person is not null))),
 named as (select {sql_code('Matricule')} person, unnest(['NOM-', 'PRENOM-']) lab, unnest([1, 2]) place, unnest([trim(NomFamille), trim("PrénomUsuel")]) v from rh_source),
 allsec as (select {_KEY('person')} k, tok, 0 place from people union all select {_KEY('v')}, lab || tok, place from named join people using (person) where length(v) >= 3
  union all select {_KEY('v')}, '{privacy.HIDDEN}', 1000 from (select trim(NomResponsable) v from rh_source union all select trim(surname) from temps_target union all select trim(givenName) from temps_target) where length(v) >= 3),
 secrets as (select k, arg_min(tok, (place, length(tok), tok)) tok from allsec where k <> '' group by 1),
 runs as (select distinct doc_id, array_to_string(ws[i:i + n - 1], ' ') w from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from (select doc_id, regexp_extract_all(text, '[{_W_}]+') ws from documents where text is not null)), (select unnest(range(1, 9)) n) where i + n - 1 <= len(ws)),
 hits as (select doc_id, list({{'w': w, 'tok': tok}} order by length(w) desc, w) t, count(*) n_secrets from runs join secrets on k = w group by 1)"""
_SUB = f"regexp_replace(acc, '(^|[^{_W_}])' || array_to_string(list_transform(string_split(x.w, ' '), lambda p: regexp_escape(p)), '[^{_W_}]+') || '($|[^{_W_}])', '\\1' || x.tok || '\\2', 'g')"
_NUM = lambda c: f"cast(cast({c} as decimal(10,2)) as varchar)"
_FACTORS = "case h " + " ".join(f"when '{k}' then {v}" for k, v in _W.items()) + " end"
_SHOWN = lambda c: f"case when {c} is null then '(vide)' when {c} = 'true' then 'vrai' when {c} = 'false' then 'faux' when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then {c} else '« ' || {c} || ' »' end"
_TOLD = "target_field || ': expected ' || coalesce(expected, '(empty)') || ', found ' || coalesce(target_raw, '(empty)') || ' (' || coalesce(probable_cause, 'no verified cause') || ').'"
_BREAK = f"'100 x criticality ' || coalesce(criticality, 1) || '/5 x confidence ' || case confidence when 'ELEVEE' then '1.00' else '0.70' end || ' x verdict 1.00' || coalesce((select string_agg(' x ' || h || ' ' || {_NUM(_FACTORS)}, '' order by h) from (select unnest(string_split(scored.hypotheses, ',')) h)), '')"
_DESC = "case h when 'H-SYSTEMIC' then 'nearly all findings of the field are anomalies' when 'H-BIJECTION' then 'expected values are recoded one to one' else 'values are swapped between two persons' end"
_SIM = R._sql_similarity_of("a", "b")
_MATCHED = f"""sa as {R._SQL_KEYLESS['A']}, sb as {R._SQL_KEYLESS['B']},
 same as (select a.row_id l, b.row_id r, {_SIM} score, 'UNIQUE' method from sa a join sb b on a.person_id = b.person_id and a.assignment_type = b.assignment_type),
 la as (select * from sa where row_id not in (select l from same)), lb as (select * from sb where row_id not in (select r from same)),
 crossed as (select a.row_id l, b.row_id r, {_SIM} score, 'CROSS_TYPE' method from la a join lb b on a.person_id = b.person_id),
 best1 as (select * from crossed qualify row_number() over (partition by l order by score desc, r) = 1 and row_number() over (partition by r order by score desc, l) = 1),
 pr as (select * from same union all select * from best1 where score >= 0.6),
 mt as (select * from pr union all select row_id, null, null, 'MISSING_IN_TARGET' from sa where row_id not in (select l from pr) union all select null, row_id, null, 'MISSING_IN_SOURCE' from sb where row_id not in (select r from pr)),
 ka as (select *, coalesce(assignment_type, '?') || ':' || coalesce({sql_code('CodePoste')}, cast(row_id as varchar)) k from sa), kb as (select *, coalesce(assignment_type, '?') || ':target-' || row_id k from sb)"""
_LEAKS = f"cast(len(regexp_extract_all(text, '{privacy.EMAIL}')) + len(list_filter(regexp_extract_all(regexp_replace(text, '{privacy.EMAIL}', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[0-9]{{7,}}'))) as integer)"

_ALL_PAIRS = R.sql_evaluated(list(MAPPING.fields)).removeprefix("with ").replace(R._SQL_JOIN, "from pr join sa a on a.row_id = pr.l join sb b on b.row_id = pr.r").replace("a.assignment_type || ':'", "coalesce(a.assignment_type, '?') || ':'")
_P5 = {x: (t, n, k) for x, t, n, k in (("A", "rh_source", "Matricule", "upper(trim(TypeAffectation))"), ("B", "temps_target", "personId", f"case when {sql_bool('isPrimaryAssignment')} = 'true' then 'P' when {sql_bool('isTemporaryAssignment')} = 'true' then 'A' else 'S' end"))}
_P5_SIDE = {x: f"(select * from (select {sql_code(n)} person_id, {k} assignment_type, " + ", ".join(f"""{R._sql_comparable(f[2], chr(34) + f[1 if x == 'A' else 0] + chr(34))} v{i}""" for i, f in enumerate(COMPARED)) + f", charge_le, row_id from {t}) where person_id is not null and assignment_type is not null qualify row_number() over (partition by person_id, assignment_type order by charge_le desc, row_id desc) = 1)" for x, (t, n, k) in _P5.items()}

_ORIGINS = {"date": lambda c: f"strftime({sql_date(c)}, '%Y-%m-%d')", "number": sql_plain_number}
_CANDIDATES = f"with {R._PAIRS}, q as (select * replace (coalesce(\"DateEntréePoste\", onboardDate) as onboardDate) from p), u as (" + " union all ".join(
    f"""select '{f.target}' target_field, '{c}' col, count(*) filter (where {_ORIGINS[f.kind](chr(34) + c + chr(34))} = t) hits, count(*) filter (where {_ORIGINS[f.kind](chr(34) + c + chr(34))} = t and e is distinct from t) explains, count(*) population, count(*) filter (where e is not distinct from t and not bad) good, count(*) filter (where e is distinct from t or bad) n_bad from (select *, {_ORIGINS[f.kind](chr(34) + f.target + chr(34))} t, {_ORIGINS[f.kind](chr(34) + f.sources[0] + chr(34))} e, {R._bad(f.kind, chr(34) + f.sources[0] + chr(34))} bad from q) where t is not null"""
    for f in MAPPING.fields if f.kind in ("date", "number") and f.rule == "direct"
    for c in ("DateEmbaucheRécente", "DateEntréePoste", "DateEffetRaison", "HeuresNormeHebdo", "HeuresNormeQuotidienne") if c not in f.sources
) + f") select target_field, col, hits, explains, population, round(hits / population, 6) support, round(good / population, 6) mapped_support from u where n_bad > 0 and population >= {H['alt_source_count']} and round(hits / population, 6) >= {H['alt_source_support']} and round(hits / population, 6) > round(good / population, 6) and explains >= 1"

# The columns of the positions' records and of the lookup that may be another origin.
_DETAIL = ["IdentifiantPoste", "IdentifiantEmploi", "CodeDirectionAffectée", "DateEffetAffectation", "CodeBudget", "IndicateurGestion", "CodePosteSecondaire", "HeuresSemaineContrat", "HeuresJourContrat", "JoursTravailléesSemaine"]
_LOOKUP = ["CodeCatégorieStatut", "CodeStatutSystèmeExterne", "CodeGestionAccès"]


def _sql_origins() -> str:
    """CTEs up to `alt`: every column of the three tables against every field of the matched pairs."""
    q = lambda c: chr(34) + c + chr(34)
    own = [c for c in R.SOURCE_COLUMNS if c not in H["excluded_columns"]]
    cells = [(c, f"p.{q(c)}") for c in own] + [(f"poste_detail:{c}", f"h.{q(c)}") for c in _DETAIL] + [(f"motifs:{c}", f"m.{q(c)}") for c in _LOOKUP]
    forms = {"code": sql_code("v"), "date": f"strftime({sql_date('v')}, '%Y-%m-%d')", "number": sql_plain_number("v"), "bool": sql_bool("v"), "text": R.sql_clean("v"), "text_loose": f"replace(lower({R.sql_strip_accents(R.sql_clean('v'))}), 'ß', 'ss')"}
    kinds = ", ".join(f"('{f.target}', '{f.kind}')" for f in MAPPING.fields)
    mine = ", ".join(f"('{f.target}', '{c}')" for f in MAPPING.fields for c in f.sources)
    detail = ", ".join(f"strftime(eff, '%Y-%m-%d') {q(c)}" if c == "DateEffetAffectation" else q(c) for c in _DETAIL)
    return f"""{_MATCHED}, {_ALL_PAIRS},
 h as (select {sql_code('IdentifiantPoste')} poste, {detail} from (select *, {sql_effective('DateEffetAffectation')} eff from poste_detail) where {sql_code('IdentifiantPoste')} is not null and eff is not null qualify row_number() over (partition by {sql_code('IdentifiantPoste')} order by eff desc, detail_id desc) = 1),
 m as (select {sql_code(q('CodeCatégorieStatut'))} reason, * from motifs qualify row_number() over (partition by {sql_code(q('CodeCatégorieStatut'))} order by {q('CodeCatégorieStatut')} desc) = 1),
 cell as (select person_id, assignment_key, unnest(cs, recursive := true) from (select p.person_id, p.assignment_key, [{', '.join(f"{{'col': '{n}', 'v': {v}}}" for n, v in cells)}] cs from p left join h on h.poste = {sql_code('p.CodePoste')} left join m on m.reason = {sql_code('p.CodeRaisonStatut')})),
 forms as (select *, {', '.join(f'{v} f_{k}' for k, v in forms.items())} from cell where v is not null),
 fk(target_field, kind) as (values {kinds}), mine(target_field, col) as (values {mine}),
 found as (select ev.*, kind from ev join fk using (target_field) where active and target_norm is not null),
 per as (select target_field, count(*) population, count(*) filter (where verdict in ('CONFORME', 'JUSTIFIE')) agreeing, count(*) filter (where verdict in ('ANOMALIE', 'INDETERMINE')) bad from found group by 1),
 hit as (select f.person_id, f.assignment_key, f.target_field, c.col, f.verdict in ('ANOMALIE', 'INDETERMINE') wrong from found f join forms c using (person_id, assignment_key) where f.target_norm = case f.kind {' '.join(f"when '{k}' then f_{k}" for k in forms)} end),
 names as (select unnest([{', '.join(f"'{n}'" for n, _ in cells)}]) col),
 alt as (select per.target_field, names.col, count(hit.target_field) hits, count(hit.target_field) filter (where wrong) explains, any_value(population) population, round(count(hit.target_field) / any_value(population), 6) support, round(any_value(agreeing) / any_value(population), 6) mapped_support
  from per cross join names left join hit on hit.target_field = per.target_field and hit.col = names.col where bad > 0 and (per.target_field, names.col) not in (select target_field, col from mine) group by all)"""


SQL: dict[str, str] = {
    "alt_source_all": f"with {_sql_origins()} select * from alt",
    "hyp_alt_source": f"with {_sql_origins()}, rules as (select * from alt where population >= {H['alt_source_count']} and support >= {H['alt_source_support']} and support > mapped_support and explains >= 1) select hit.person_id || ':' || hit.assignment_key || ':' || hit.target_field finding_id, hit.target_field, hit.col detail, support from hit join rules using (target_field, col) where wrong",
    "verdict_counts_all": f"with {_MATCHED}, {_ALL_PAIRS} select v.verdict, count(ev.verdict) + case when v.verdict = 'ANOMALIE' then (select count(*) from mt where l is null or r is null) else 0 end n from (select unnest(['CONFORME', 'JUSTIFIE', 'ANOMALIE', 'INDETERMINE']) verdict) v left join ev on ev.verdict = v.verdict and ev.active group by 1",
    "p5_differences": f"with j as (select coalesce(a.person_id, b.person_id) person_id, coalesce(a.assignment_type, b.assignment_type) assignment_type, a.person_id is null no_a, b.person_id is null no_b, {', '.join(f'a.v{i} a{i}, b.v{i} b{i}' for i in range(len(COMPARED)))} from {_P5_SIDE['A']} a full join {_P5_SIDE['B']} b on a.person_id = b.person_id and a.assignment_type = b.assignment_type) select person_id, assignment_type, 'missing_in_target' fld, cast(null as varchar) expected, cast(null as varchar) target from j where no_b union all select person_id, assignment_type, 'missing_in_source', null, null from j where no_a union all "
    + " union all ".join(f"select person_id, assignment_type, '{f[0]}', a{i}, b{i} from j where not no_a and not no_b and a{i} is distinct from b{i}" for i, f in enumerate(COMPARED)),
    "p3_ledger": f"""with rec as (select * from (select {sql_code('IdentifiantPoste')} k, {sql_code('"CodeDirectionAffectée"')} u, {sql_effective('DateEffetAffectation')} d, saisi_le r, detail_id t from poste_detail) where k is not null and u is not null and d is not null and r is not null),
 ch as (select * from (select *, lag(u) over (partition by k, d order by r, t, u) before, row_number() over (partition by k, d order by r, t, u) n from rec) where n = 1 or u <> before),
 first_ as (select k, d, min(r) r0 from ch group by all),
 own as (select k, d, r, arg_max(u, (t, u)) u from ch group by all),
 tm as (select k, d, r from own union select a.k, a.d, b.r0 from first_ a join first_ b on b.k = a.k and b.d > a.d and b.r0 > a.r0),
 st as (select tm.k, tm.d, tm.r, arg_max(own.u, own.r) u, (select min(f.d) from first_ f where f.k = tm.k and f.d > tm.d and f.r0 <= tm.r) e from tm join own on own.k = tm.k and own.d = tm.d and own.r <= tm.r group by tm.k, tm.d, tm.r),
 moved as (select * from (select *, lag(u) over w pu, lag(e) over w pe, row_number() over w n from st window w as (partition by k, d order by r)) where n = 1 or u is distinct from pu or e is distinct from pe)
 select k code_poste, u unit, strftime(d, '%Y-%m-%d') valid_from, coalesce(strftime(e, '%Y-%m-%d'), '') valid_to, strftime(r, '%Y-%m-%d %H:%M:%S') recorded_from, coalesce(strftime(lead(r) over (partition by k, d order by r), '%Y-%m-%d %H:%M:%S'), '') recorded_to from moved""",
    "hyp_systemic": f"with {_F}, {_SYS}, s as (select target_field, subcategory, count(*) c from f where verdict = 'ANOMALIE' group by all) select target_field, k, n, round(k / n, 6) share, (select subcategory from s where s.target_field = sys.target_field order by c desc, subcategory limit 1) subcategory from sys",
    "hyp_bijection": f"with {_F}, {_BIJ} select * from bij",
    "hyp_permutation": f"with {_F}, {_SWAP} select * from swaps",
    "hyp_type_absent": f"with b as (select * from {R._SIDE['B']} where assignment_type <> 'A') select a.person_id || ':' || a.assignment_type || ':affectation' finding_id, a.assignment_type detail from {R._SIDE['A']} a left join b on a.person_id = b.person_id and a.assignment_type = b.assignment_type where b.person_id is null and a.assignment_type not in (select assignment_type from b)",
    "priority_breakdown": f"{_ALL} select finding_id, target_field, {_BREAK} priority_breakdown from scored where priority is not null",
    "pattern_findings": f"with {_F}, {_SYS}, {_BIJ}, {_SWAP}, {_VER} select distinct h hypothesis, target_field, '' detail, finding_id from ver",
    "persons_by_priority": f"{_ALL}, x as (select person_id, count(*) n, max(priority) max_priority from scored where verdict = 'ANOMALIE' group by 1) select person_id, n, max_priority, 'E' || row_number() over (order by -max_priority, person_id) ref from x",
    "field_examples": f"with {_F}, x as (select *, row_number() over (partition by target_field order by finding_id) k from f where verdict = 'ANOMALIE') select target_field, verdict, string_agg(coalesce(expected, '') || ' -> ' || coalesce(target_raw, ''), ' | ' order by k) examples from x where k <= 3 group by all",
    "field_order": f"with {_F}, x as (select target_field, max(criticality) criticality from f group by 1) select *, row_number() over (order by criticality desc, target_field) place from x",
    "finding_labels": f"{_ALL} select finding_id, '[' || regexp_replace(cast(cast(priority as double) as varchar), '[.]0$', '') || '] ' || person_id || ' · ' || target_field || ' · ' || verdict as label from scored where verdict = 'ANOMALIE' and target_field in ('unit', 'priority')",
    "agreement_percent": f"with {_F} select target_field, segment, cast(cast(round_even(100.0 * count(*) filter (where verdict = 'ANOMALIE') / count(*), 0) as integer) as varchar) || '%' as share from f group by all",
    "finding_problems": "select '' finding_id, '' problem where false",
    "feedback_status": f"{_ALL}, x as (select *, case when verdict <> 'ANOMALIE' then null when target_field = 'unit' and expected = '3' and target_norm = '4' then 'R-EXPERT-001' when target_field = 'segment' and contains(hypotheses, 'H-BIJECTION') then 'R-EXPERT-002' when target_field = 'priority' and subcategory = 'empty' then 'R-EXPERT-003' when target_field = 'rest' and target_norm = ninth then 'R-EXPERT-004' end rule_ from scored), {_CORR}, c as (select case when l % 3 = 0 then (expected = 'before') else true end ok from scored where verdict = 'ANOMALIE' and l % 11 = 0) select e entry, 'rule' kind, s state, (select count(*) from x where rule_ = e) n from (select unnest(['R-EXPERT-001', 'R-EXPERT-002', 'R-EXPERT-003', 'R-EXPERT-004', 'R-EXPERT-005']) e, unnest(['active', 'active', 'active', 'active', 'inactive']) s) union all select '', 'correction', case when ok then 'applied' else 'stale' end, count(*) from c group by ok union all select '', 'correction', 'missing', 1",
    "grounding_check": f"{_ALL} select finding_id, case when l % 7 = 0 then 1 else 0 end n_ungrounded from scored where verdict = 'ANOMALIE'",
    "answer_checks": f"{_ALL} select case when l % 11 = 3 then 'NOT_JSON' when l % 13 = 4 then 'SCHEMA' when l % 5 = 1 then 'CITATION' when l % 7 = 2 then 'UNGROUNDED' else 'OK' end status, count(*) n from scored where verdict = 'ANOMALIE' group by 1",
    "unexplained": f"{_ALL} select finding_id, target_field from scored where verdict = 'ANOMALIE' and hypotheses is null",
    "dossier_per_person": f"""{_ALL}, x as (select * from scored where priority >= 30 and not coalesce(contains(hypotheses, 'H-SYSTEMIC'), false)) select person_id, cast(count(*) as integer) n_findings, max(priority) max_priority, replace(replace(to_json({{'findings': list({{'target_field': target_field, 'expected': expected, 'target_raw': target_raw, 'verdict': verdict, 'priority': cast(priority as double), 'probable_cause': probable_cause}} order by target_field, expected nulls first, target_raw nulls first, verdict, priority, probable_cause nulls first)}})::varchar, '<', '\\u003c'), '>', '\\u003e') payload from x group by 1""",
    "mask_documents": f"select doc_id, {_LONG("regexp_replace(text, '" + privacy.EMAIL + "', '" + privacy.EMAIL_MASK + "', 'g')")} masked from documents where text is not null",
    "secret_tokens": f"with {_SECRETS} select k as key, tok as token from secrets",
    "known_leaks": f"with {_SECRETS} select doc_id, cast(n_secrets as integer) n_secrets from hits",
    "pseudonymize_documents": f"with {_SECRETS}, z as (select d.doc_id, list_reduce(coalesce(t, []), lambda acc, x: {_SUB.replace('regexp_replace(acc', 'regexp_replace(' + _SUB, 1)}, regexp_replace(text, '{privacy.EMAIL}', '{privacy.EMAIL_MASK}', 'g')) y from documents d left join hits using (doc_id) where text is not null) select doc_id, {_LONG('y')} as text from z",
    "repair_surnames": f"select row_id, surname, {R.sql_repair('surname')} repaired from temps_target where {R.sql_repair('surname')} <> surname",
    "file_integrity": "select 'motifs.csv' as name, 'INCHANGE' status, count(*) rows_read, 2 first_row from motifs",
    "candidate_rules": _CANDIDATES,
    "finding_json": f"with {_F} select finding_id, to_json({{'finding_id': finding_id, 'target_field': target_field, 'expected': expected, 'target_raw': target_raw, 'tags': [segment, nation]}})::varchar as json from f where verdict = 'ANOMALIE' and target_field = 'unit'",
    "clipped_documents": f"with x as (select doc_id, trim(regexp_replace(text, '{R._WS}', ' ', 'g')) t from documents where text is not null) select doc_id, case when length(t) > 80 then rtrim(left(t, 79)) || '…' else t end clipped from x",
    "normalize_text": "select row_id, " + ", ".join(f"""{R.sql_clean(chr(34) + c + chr(34))} "{c}_text", {R.sql_strip_accents(R.sql_clean(chr(34) + c + chr(34)))} "{c}_plain", replace(lower({R.sql_strip_accents(R.sql_clean(chr(34) + c + chr(34)))}), 'ß', 'ss') "{c}_loose" """ for c in ("NomFamille", "PrénomUsuel")) + " from rh_source",
    "padded_codes": f"select row_id, case when length(u) >= 4 then u else lpad(u, 4, '0') end unit from (select row_id, {sql_code('CodeDirection')} u from rh_source)",
    "usable_columns": "select * from (unpivot (select " + ", ".join(f"coalesce(bool_or({sql_date(chr(34) + c + chr(34))} is not null), false) as " + chr(34) + c + chr(34) for c in R.SOURCE_COLUMNS) + " from rh_source) on columns(*) into name col value usable)",
    "latest_position_record": f"""with r as (select {sql_code('IdentifiantPoste')} poste, {sql_effective('DateEffetAffectation')} eff, {sql_code('"CodeDirectionAffectée"')} unit, detail_id from poste_detail) select poste, strftime(eff, '%Y-%m-%d') effective, coalesce(unit, '') unit, detail_id from r where poste is not null and eff is not null qualify row_number() over (partition by poste order by eff desc, detail_id desc) = 1""",
    "pair_sheet": f"with {_MATCHED} select coalesce(ka.person_id, kb.person_id) person_id, coalesce(ka.k, kb.k) assignment_key, method, score, ka.assignment_type source_type, kb.assignment_type target_type, ka.CodePoste poste, ka.CodeEmploi emploi_source, kb.positionId emploi_target from mt left join ka on ka.row_id = mt.l left join kb on kb.row_id = mt.r",
    "missing_findings": f"with {_MATCHED} select concat_ws(':', coalesce(ka.person_id, kb.person_id), coalesce(ka.k, kb.k), 'affectation') finding_id, l, r, case when r is null then 5 else 4 end criticality, lower(method) subcategory, case when r is null then {R._sql_summary('ka', R.SHOWN_A)} else {R._sql_summary('kb', R.SHOWN_B)} end held from mt left join ka on ka.row_id = mt.l left join kb on kb.row_id = mt.r where l is null or r is null",
    "probable_cause": f"{_ALL} select target_field, probable_cause, hypotheses, count(*) n from scored where probable_cause is not null group by all",
    "priority_score": f"{_ALL} select finding_id, target_field, verdict, priority from scored",
    "priority_topk": f"{_ALL} select finding_id, priority, probable_cause from scored order by priority desc nulls last, criticality desc, confidence, person_id, assignment_key, target_field, l limit 10",
    "patterns": f"with {_F}, {_SYS}, {_BIJ}, {_SWAP}, {_VER} select h hypothesis, target_field, '' detail, n, {_DESC} || ': ' || n || ' findings' description from (select h, target_field, count(distinct finding_id) n from ver group by all)",
    "feedback_rules": f"{_ALL}, x as (select *, case when verdict <> 'ANOMALIE' then null when target_field = 'unit' and expected = '3' and target_norm = '4' then 'R-EXPERT-001' when target_field = 'segment' and contains(hypotheses, 'H-BIJECTION') then 'R-EXPERT-002' when target_field = 'priority' and subcategory = 'empty' then 'R-EXPERT-003' when target_field = 'rest' and target_norm = ninth then 'R-EXPERT-004' end rule from scored) select target_field, rule expert_rule, case when rule is not null then verdict end initial_verdict, case when rule is not null then 'JUSTIFIE' else verdict end verdict, count(*) n from x group by all",
    "feedback_preview": f"{_ALL}, a as (select target_field, count(*) n from scored where verdict = 'ANOMALIE' group by 1), m as (select 'R-EXPERT-001' as rule, 'unit' t, count(*) m from scored where verdict = 'ANOMALIE' and target_field = 'unit' and expected = '3' and target_norm = '4' union all select 'R-EXPERT-002', 'segment', count(*) from scored where verdict = 'ANOMALIE' and target_field = 'segment' and contains(hypotheses, 'H-BIJECTION') union all select 'R-EXPERT-003', 'priority', count(*) from scored where verdict = 'ANOMALIE' and target_field = 'priority' and subcategory = 'empty' union all select 'R-EXPERT-004', 'rest', count(*) from scored where verdict = 'ANOMALIE' and target_field = 'rest' and target_norm = ninth) select rule, m matched, coalesce(n, 0) anomalies, coalesce(n, 0) - m remaining from m left join a on a.target_field = m.t",
    "feedback_corrections": f"with {_F}, {_CORR} select target_field, case when ce is null then null when ce = expected then 'applied' else 'stale' end correction, case when ce = expected then 'JUSTIFIE' else verdict end verdict, count(*) n from f left join corr using (finding_id) group by all",
    "feedback_suggestions": f"{_ALL}, {_CORR}, x as (select scored.* from scored semi join corr using (finding_id)), u as (select x.target_field, 'accept_hypothesis' operation, ver.h as value from x join ver using (finding_id) union all select target_field, 'accept_subcategory', subcategory from x where subcategory is not null) select target_field, operation, value, count(*) n from u where not (target_field = 'priority' and operation = 'accept_subcategory' and value = 'empty') group by all having n >= 2",
    "report_records": f"""{_ALL} select finding_id, person_id, assignment_key, target_field, verdict, coalesce(subcategory, '') subcategory, cast(criticality as varchar) criticality, confidence, coalesce(expected, '') source_raw, coalesce(expected, '') expected, coalesce(target_raw, '') target_raw,
 'expected ' || {_SHOWN('expected')} || ', found ' || {_SHOWN('target_raw')} || coalesce('; ' || subcategory, '') justification, '' rule_id, '' rule_ref, 'segment=' || segment rule_params, '' source_fields, 'sou:' || l || '@source:' || l || ' | tar:' || r || '@target:' || r evidence, 'REGLE' decision_source,
 coalesce(cast(cast(priority as double) as varchar), '') priority, coalesce(probable_cause, '') probable_cause, coalesce(replace(replace(hypotheses, ',', ' | '), 'H-SYSTEMIC', 'H-SYSTEMIC*'), '') hypotheses, {_BREAK} priority_breakdown, {_TOLD} explanation, 'template' explanation_source from scored where verdict = 'ANOMALIE'""",
    "evidence_rows": f"with {_F}, x as (select finding_id, cast(person_id as bigint) row_id from f where verdict = 'ANOMALIE' and target_field = 'unit'), u as (select c_custkey k, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) col, unnest([c_name, c_mktsegment, cast(c_nationkey as varchar)]) val from customer) select finding_id, row_id, col, val from x join u on u.k = x.row_id where val is not null",
    "evidence_merge": "select cast(l_orderkey as varchar) finding_id, l_returnflag id, cast(arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)) as varchar) part, cast(arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)) as varchar) supp from lineitem group by l_orderkey, l_returnflag",
    "tokens_positions": f"with i as (select distinct {sql_code('CodePoste')} id from rh_source), r as (select id, cast(row_number() over (order by id) as varchar) n from i where id is not null) select id, 'POSTE-' || case when length(n) < 2 then '0' || n else n end token from r",
    "leak_scan_documents": f"select doc_id, {_LEAKS} n_leaks from documents where text is not null",
    "flow_decisions": f"with x as (select *, {_LEAKS} n_leaks from documents where text is not null) select case when source is null or source not in ('note_rh', 'courriel', 'billet', 'avis', 'procedure', 'releve', 'clavardage', 'proces_verbal', 'sondage', 'glossaire') then 'block: unclassified' when source in ('note_rh', 'proces_verbal', 'releve') then 'block: class' when n_leaks > 0 then 'block: leak' else 'allow' end decision, count(*) n from x group by 1",
    "excel_serial_dates": f"select detail_id, strftime({sql_effective('DateEffetAffectation')}, '%Y-%m-%d') effective from poste_detail",
    "normalize_code": "select row_id, " + ", ".join(f"{sql_code(c)} {c}" for c in ("personId", "divisionId", "positionId", "siteCode", "payGradeId")) + " from temps_target",
    "normalize_bool": "select row_id, " + ", ".join(f"{sql_bool(c)} {c}" for c in ("EstPermanent", "EstTempsPlein")) + " from rh_source",
    "normalize_number": f"select row_id, {sql_plain_number('HeuresNormeHebdo')} weekly, {sql_plain_number('HeuresNormeQuotidienne')} daily from rh_source",
    "normalize_date": "select row_id, " + ", ".join(f"strftime({sql_date(c)}, '%Y-%m-%d') {c}" for c in ("onboardDate", "assignmentStartDate")) + " from temps_target",
    "normalize_states": f"select case when {sql_code('DateEffetAffectation')} is null then 'empty' when {sql_effective('DateEffetAffectation')} is null then 'unreadable' else 'value' end state, count(*) n from poste_detail group by 1",
    "config_gaps": f"""with l as (select {sql_code('"CodeCatégorieStatut"')} code from motifs), u as (select {sql_code('CodeRaisonStatut')} code from rh_source) select 'not in lookup' gap, code, count(*) n from u where code is not null and code not in (select code from l) group by code union all select 'twice in lookup', code, count(*) from l group by code having count(*) > 1""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hyp_systemic, hyp_bijection, hyp_permutation, hyp_type_absent, probable_cause, priority_score, priority_topk, patterns, feedback_rules, feedback_preview, feedback_corrections, feedback_suggestions,
        pattern_findings, persons_by_priority, field_examples, field_order, finding_labels, agreement_percent, finding_problems, priority_breakdown, feedback_status, usable_columns, answer_checks, unexplained, secret_tokens, known_leaks,
        report_records, evidence_rows, evidence_merge, tokens_positions, leak_scan_documents, mask_documents, pseudonymize_documents, grounding_check, dossier_per_person, flow_decisions,
        finding_json, clipped_documents, normalize_text, padded_codes, latest_position_record, pair_sheet, missing_findings, candidate_rules,
        excel_serial_dates, normalize_code, normalize_bool, normalize_number, normalize_date, normalize_states, repair_surnames, config_gaps, file_integrity,
    )
}
