"""Other origins of values, against brute force, and the size of their plans."""

import itertools
import random

from pyspark.sql.readwriter import DataFrameWriter

from concordat.operators import hypotheses as H
from concordat.operators import verdicts as V
from concordat.plans import reconciliation as R

NUMBERS = ["40", "40.0", "040", "35", None, "x"]
DATES = ["2001-02-03", "03/02/2001", "2002-01-01", None]
FIELDS = [f for f in R.MAPPING.fields if f.rule == "direct" and f.kind in ("number", "date")]
COLUMNS = ["HeuresNormeHebdo", "DateEmbaucheRécente", "DateEntréePoste", "DateEffetRaison", "HeuresNormeQuotidienne", "CodeQuart"]
READ = {"40": "40", "40.0": "40", "040": "40", "35": "35"}, {"2001-02-03": "2001-02-03", "03/02/2001": "2001-02-03", "2002-01-01": "2002-01-01"}


def small(spark, n=40):
    r = random.Random(4)
    cells = [{c: r.choice(DATES if c.startswith("Date") else NUMBERS) for c in COLUMNS} for _ in range(n)]
    found = []
    for i, f in itertools.product(range(n), FIELDS):
        norm = r.choice(["40", "35", None] if f.kind == "number" else ["2001-02-03", "2002-01-01", None])
        found.append((f"{i}:{f.target}", i, 100 + i, f.target, norm, r.choice(["CONFORME", "JUSTIFIE", "ANOMALIE", "INDETERMINE"])))
    pairs = spark.createDataFrame([(i, 100 + i, *x.values()) for i, x in enumerate(cells)], "l long, r long, " + ", ".join(f"`a_{c}` string" for c in COLUMNS))
    return cells, found, pairs, spark.createDataFrame(found, "finding_id string, l long, r long, target_field string, target_norm string, verdict string")


def brute(cells, found, field):
    mine = [x for x in found if x[3] == field.target and x[4] is not None]
    out = {}
    for c in COLUMNS:
        if c in field.sources:
            continue
        hits = [x for x in mine if READ[field.kind == "date"].get(cells[x[1]][c]) == x[4]]
        out[c] = (len(hits), sum(x[5] in ("ANOMALIE", "INDETERMINE") for x in hits), len(mine), round(sum(x[5] in ("CONFORME", "JUSTIFIE") for x in mine) / len(mine), 6))
    return out


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_other_origins_are_those_of_brute_force(spark):
    cells, found, pairs, df = small(spark)
    m = R.MAPPING.only(FIELDS)
    got = {}
    for x in H.alternative_sources(df, pairs, m, COLUMNS).collect():
        got.setdefault(x["target_field"], {})[x["col"]] = (x["hits"], x["explains"], x["population"], x["mapped_support"])
    assert got == {f.target: brute(cells, found, f) for f in FIELDS}
    rules = spark.createDataFrame([(f.target, c, 0.5) for f in FIELDS for c in COLUMNS], "target_field string, col string, support double")
    kinds = {f.target: f.kind for f in FIELDS}
    want = sorted((x[0], c) for x in found for c in COLUMNS if x[5] in ("ANOMALIE", "INDETERMINE") and x[4] is not None and READ[kinds[x[3]] == "date"].get(cells[x[1]][c]) == x[4])
    assert sorted((x["finding_id"], x["detail"]) for x in H.alternative_source(df, pairs, m, COLUMNS, rules).collect()) == want and want


def test_plans_dont_grow_with_kinds_and_columns(spark):
    _, _, pairs, df = small(spark, 2)
    alternatives = H.alternative_sources(df, pairs, R.MAPPING, COLUMNS)
    assert joins(alternatives) == 1  # one a kind before, with two counts a column
    rules = spark.createDataFrame([("onboardDate", "CodeQuart", 0.5)], "target_field string, col string, support double")
    assert joins(H.alternative_source(df, pairs, R.MAPPING, COLUMNS, rules)) == 2


def test_findings_of_other_origins_are_judged_a_family_at_a_time(spark, monkeypatch):
    """The verdicts are those of judge(); no plan holds more than one family of rules, as one of all families did before."""
    unfolded, plain = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        unfolded.append(self._df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode("))
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    found, pairs, _, _ = R._alt_all(spark, "/root/testdata/sf0.001")
    assert max(unfolded) == 1 and sum(unfolded) > 1
    rows = lambda df: sorted(map(tuple, df.select(*found.columns).collect()), key=repr)
    assert rows(found) == rows(V.judge(pairs, R.MAPPING))


def test_findings_that_rules_explain_dont_need_the_plan_of_all_families(spark, sf, monkeypatch):
    """hyp_alt_source, with rules let through, gives what the findings of judge() give; none of its plans holds more than
    one family of rules."""
    unfolded, kept, plain, inner = [], {}, DataFrameWriter.parquet, R._alt_all

    def parquet(self, *args, **kwargs):
        unfolded.append(self._df._jdf.queryExecution().optimizedPlan().toString().count("explode(array(named_struct(target_field"))
        return plain(self, *args, **kwargs)

    def rules(alternatives, mapping):
        return alternatives.where("explains >= 1")

    monkeypatch.setattr(H, "candidate_rules", rules)
    monkeypatch.setattr(R, "_alt_all", lambda *args: kept.setdefault("all", inner(*args)))
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    got = R.hyp_alt_source(spark, sf)
    assert max(unfolded) == 1
    _, pairs, columns, alternatives = kept["all"]
    want = H.alternative_source(V.judge(pairs, R.MAPPING), pairs, R.MAPPING, columns, rules(alternatives, R.MAPPING)).select(*got.columns)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got) == rows(want) and rows(got)
