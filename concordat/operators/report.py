"""Sinks: flat records, sheets and files of a run."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.config import Mapping
from concordat.functions import kinds as K
from concordat.operators.hypotheses import report_order


def shown(c: Column, incalculable: Column | None = None) -> Column:
    """A value for readers: (vide), (incalculable), vrai/faux, else in quotation marks."""
    x = F.when(c.isNull(), "(vide)").when(c == "true", "vrai").when(c == "false", "faux").when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).otherwise(F.concat(F.lit("« "), c, F.lit(" »")))
    return x if incalculable is None else F.when(incalculable, "(incalculable)").otherwise(x)


def repair_note(raw: Column) -> Column:
    """Says that a text was repaired before it was compared; NULL otherwise."""
    x = K.clean_text(raw)
    fixed = K.let(x, K.repair_encoding)
    return F.when(fixed != x, F.concat(F.lit("encoding repaired: « "), x, F.lit(" » read as « "), fixed, F.lit(" »")))


def explained(findings: DataFrame, mapping: Mapping) -> DataFrame:
    """findings with what they rest on: source_fields, rule_id, rule_ref (of the field), decision_source, justification and
    evidence (the rows of both systems)."""
    spark = findings.sparkSession
    rows = [(f.target, list(f.sources), f.id, f.ref) for f in mapping.fields] + [("affectation", [], "R-MATCH", "")]
    per_field = spark.createDataFrame(rows, "target_field string, source_fields array<string>, rule_id string, rule_ref string")
    x = findings.join(F.broadcast(per_field), "target_field", "left")  # one row a field
    found = shown(F.col("target_raw"))
    said = (
        F.when(F.col("rule") == "missing", F.concat(F.when(F.col("r").isNull(), "held by the first system only: ").otherwise("held by the second system only: "), F.coalesce("source_raw", "target_raw", F.lit(""))))
        .when(F.col("verdict") == "CONFORME", F.concat(F.lit("equal to the source: "), found))
        .when(F.col("verdict") == "JUSTIFIE", F.concat(F.lit("as the rule expects: "), found))
        .when(F.col("verdict") == "ANOMALIE", F.concat(F.lit("expected "), shown(F.col("expected")), F.lit(", found "), found))
        .otherwise(F.concat(F.lit("can't be decided: expected "), shown(F.col("expected"), F.col("expected").isNull()), F.lit(", found "), found))
    )
    text = F.col("kind").isin("text", "text_loose")
    notes = [F.when(text, repair_note(F.col("target_raw"))), F.when(F.col("subcategory").isNotNull(), F.col("subcategory"))]
    cell = lambda t, c, v: F.when(F.col(c).isNotNull(), F.struct(F.concat(F.lit(f"{t[:3]}:"), F.col(c)).alias("id"), F.lit(t).alias("tbl"), F.col(c).alias("row_id"), F.create_map(F.lit("value"), F.col(v)).alias("vals"), F.lit(None).cast("string").alias("note")))
    evidence = F.array_compact(F.array(cell("source", "l", "source_raw"), cell("target", "r", "target_raw")))
    return x.withColumns({"decision_source": F.lit("REGLE"), "justification": F.concat_ws("; ", said, *notes), "evidence": evidence})


def told(findings: DataFrame) -> DataFrame:
    """findings with a deterministic explanation of those to investigate."""
    t = F.format_string("%s: expected %s, found %s (%s).", F.col("target_field"), F.coalesce("expected", F.lit("(empty)")), F.coalesce("target_raw", F.lit("(empty)")), F.coalesce("probable_cause", F.lit("no verified cause")))
    here = F.col("verdict").isin("ANOMALIE", "INDETERMINE")
    return findings.withColumns({"explanation": F.when(here, t), "explanation_source": F.when(here, "template")})


# The columns of the flat record, in their order.
RECORD = [
    "finding_id", "person_id", "assignment_key", "target_field", "verdict", "subcategory", "criticality", "confidence", "source_raw", "expected", "target_raw", "justification",
    "rule_id", "rule_ref", "rule_params", "source_fields", "evidence", "decision_source", "priority", "probable_cause", "hypotheses", "priority_breakdown", "explanation", "explanation_source",
]


def record(findings: DataFrame) -> DataFrame:
    """The 24 columns of the flat record, all text, nothing as ''. Columns that findings lack are empty."""
    as_text = {
        "source_fields": lambda c: F.array_join(c, ", "),
        "rule_params": lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "),
        "evidence": lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["id"], F.lit("@"), e["tbl"], F.lit(":"), e["row_id"])), " | "),
        "hypotheses": lambda c: F.array_join(F.transform(c, lambda h: F.when(h == "H-SYSTEMIC", F.concat(h, F.lit("*"))).otherwise(h)), " | "),
    }
    cells = [(as_text[c](F.col(c)) if c in as_text else F.col(c).cast("string")) if c in findings.columns else F.lit("") for c in RECORD]
    return findings.select(*[F.coalesce(x, F.lit("")).alias(c) for c, x in zip(RECORD, cells)])


def flat_record(findings: DataFrame) -> DataFrame:
    """Every column of the findings as text: hypotheses joined (a systemic one marked with *), alternatives as sorted
    key=value, other nested columns as JSON."""
    hyp = F.array_join(F.transform("hypotheses", lambda h: F.when(h == "H-SYSTEMIC", F.concat(h, F.lit("*"))).otherwise(h)), ", ")
    alt = F.array_join(F.transform(F.array_sort(F.map_entries("alternatives")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    drop = {"hypotheses", "alternatives"}

    def text(c: str, t: str) -> Column:
        x = F.date_format(c, "yyyy-MM-dd") if t == "date" else F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")
        return F.coalesce(x, F.lit(""))

    return findings.select(*[text(c, t).alias(c) for c, t in findings.dtypes if c not in drop], hyp.alias("hypotheses"), F.coalesce(alt, F.lit("")).alias("alternatives"))


def label(findings: DataFrame) -> Column:
    """`[priority] person · field · verdict`."""
    number = F.regexp_replace(F.col("priority").cast("string"), r"\.0$", "")
    return F.concat(F.lit("["), F.coalesce(number, F.lit("—")), F.lit("] "), F.concat_ws(" · ", "person_id", "target_field", "verdict"))


def selected(findings: DataFrame, verdicts: Sequence[str] = (), fields: Sequence[str] = (), persons: Sequence[str] = ()) -> DataFrame:
    """Findings of the given verdicts, fields and persons; an empty choice takes all."""
    out = findings
    for column, values in (("verdict", verdicts), ("target_field", fields), ("person_id", persons)):
        if values:
            out = out.where(F.col(column).isin(list(values)))
    return out


def field_order(findings: DataFrame) -> DataFrame:
    """(target_field, criticality, place): fields by highest criticality, then name. One row a field."""
    per = findings.groupBy("target_field").agg(F.max(F.coalesce("criticality", F.lit(0))).alias("criticality"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.col("criticality").desc(), "target_field")))


def pair_order() -> list[Column]:
    """Pairs by person, then source row, then target row, missing ones last."""
    return [F.col("person_id"), F.col("l").asc_nulls_last(), F.col("r").asc_nulls_last()]


def reading_order() -> list[Column]:
    """Readings by field, the active one first."""
    return [F.col("target_field"), F.col("active").desc(), F.col("reading")]


def problems(findings: DataFrame) -> DataFrame:
    """(finding_id, l, r, problem): what must never be in findings: an unknown decision source, a justified verdict without
    rule, no justification, evidence that stands twice."""
    ids = F.transform("evidence", lambda e: e["id"])
    checks = [
        (~F.col("decision_source").isin("REGLE", "EXPERT"), "unknown decision source"),
        ((F.col("verdict") == "JUSTIFIE") & F.coalesce(F.col("rule_id") == "", F.lit(True)), "justified without rule"),
        (F.coalesce(F.col("justification") == "", F.lit(True)), "no justification"),
        (F.size(F.array_except(ids, F.array_distinct(ids))) + F.size(ids) != F.size(F.array_distinct(ids)), "evidence stands twice"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    return findings.select("finding_id", "l", "r", F.explode(found).alias("problem"))


def nested_json(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.to_json(F.struct(*findings.columns)).alias("json"))


def evidence_rows(cited: DataFrame, tables: dict[str, DataFrame], id_column: str = "row_id") -> DataFrame:
    """(finding_id, tbl, row_id, vals): the original rows that findings cite, NULL cells dropped. cited: finding_id,
    tbl, row_id."""
    out = None
    for name, t in tables.items():
        cells = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in t.columns if c != id_column])), lambda k, v: v.isNotNull())
        x = cited.where(F.col("tbl") == name).join(t.select(F.col(id_column).alias("row_id"), cells.alias("vals")), "row_id", "left").select("finding_id", "tbl", "row_id", "vals")
        out = x if out is None else out.unionByName(x)
    return out


def _overlay(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def merge_evidence(evidence: DataFrame) -> DataFrame:
    """One row per finding and evidence id: maps merged (later rows win), the first note kept. evidence: finding_id, id,
    ord, vals, note."""
    g = evidence.groupBy("finding_id", "id").agg(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("vals").alias("vals"), "note"))).alias("x"))
    empty = F.expr("cast(map() as map<string,string>)")
    merged = F.aggregate("x", empty, lambda acc, e: _overlay(acc, F.map_from_entries(e["vals"])))
    return g.select("finding_id", "id", merged.alias("vals"), F.get(F.filter(F.transform("x", lambda e: e["note"]), lambda n: n.isNotNull()), F.lit(0)).alias("note"))


def export_csv(findings: DataFrame, path: str | Path) -> str:
    """One CSV file of the flat record in report order: `;`, UTF-8 with byte order mark, nothing as nothing. The rows are
    sorted by Spark and written by one task, since the product is one file; it is put together through Hadoop's file
    systems, so the path may lie on any of them."""
    spark = findings.sparkSession
    where = str(path) if re.match(r"[a-z][a-z0-9]+:", str(path)) else "file:" + os.path.abspath(path)
    part = where + ".parts"
    flat = record(findings.orderBy(*report_order()))
    flat.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(part)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, parts = jvm.org.apache.hadoop.fs.Path(where), jvm.org.apache.hadoop.fs.Path(part)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        for b in (0xEF, 0xBB, 0xBF):
            out.write(b)
        for f in sorted(str(x.getPath()) for x in fs.listStatus(parts)):
            if f.rsplit("/", 1)[-1].startswith("part-"):
                src = fs.open(jvm.org.apache.hadoop.fs.Path(f))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 20, False)
                src.close()
    finally:
        out.close()
    fs.delete(parts, True)
    return os.fspath(path)


def export_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Every sheet as a Parquet table of its own, written by all executors."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def audit_log(events: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    events.write.mode("append").json(path)
