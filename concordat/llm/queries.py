"""Queries of the problems tagged llm over the project's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import kinds as K
from concordat.llm import confusables, linkage, mixing, mojibake, packing, sentences, tokens
from concordat.session import materialize, spread, table

# ---------------------------------------------------------------- 2 and 4: text repair
GARBLED_FIELDS = {"rh_source": ["NomFamille"], "temps_target": ["givenName", "surname"], "reprise_source": ["NomFamille"], "reprise_target": ["givenName", "surname"]}
VARIANT_FIELDS = {"rh_source": ["PrénomUsuel"], "temps_target": ["givenName", "contactEmail"], "reprise_source": ["PrénomUsuel"], "reprise_target": ["givenName", "contactEmail"]}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled value with what can be restored of it."""
    return _union([mojibake.find_garbled(table(spark, d, t), "row_id", cols).select(F.lit(t).alias("tbl"), "row_id", "fld", "value", "restored") for t, cols in GARBLED_FIELDS.items()])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repairs(spark, d).select("tbl", "row_id", "fld")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value that differs from its one consistent form, with that form; garbled values aside."""
    parts = []
    for t, cols in VARIANT_FIELDS.items():
        found = confusables.find_variants(table(spark, d, t), "row_id", cols)
        checked = found.withColumn("g", mojibake.garbled(F.col("value"))).where(~(F.col("g.garbled") & F.col("fld").isin(GARBLED_FIELDS[t])))
        parts.append(checked.select(F.lit(t).alias("tbl"), "row_id", "fld", "value", "plain"))
    return _union(parts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_forms(spark, d).select("tbl", "row_id", "fld")


# ---------------------------------------------------------------- 1: linkage without keys
LINKED = [
    linkage.Attribute("surname", fuzzy=True, agree=0.9, swapped="given"),
    linkage.Attribute("given", fuzzy=True, agree=0.9, swapped="surname"),
    linkage.Attribute("names", scored=False),
    linkage.Attribute("onboard", agree=0.93),
    linkage.Attribute("start", agree=0.9),
    linkage.Attribute("position", agree=0.93),
    linkage.Attribute("division", agree=0.93),
    linkage.Attribute("cost", block=False, agree=0.93, implied_by="division"),
    linkage.Attribute("site", block=False, agree=0.93, implied_by="cost"),
    linkage.Attribute("grade", block=False, agree=0.93, implied_by="position"),
    linkage.Attribute("hours", block=False, agree=0.9),
    linkage.Attribute("kind", block=False, agree=0.97),
]
LEAST_LINK = 12.0


def name_form(c: Column) -> Column:
    """A name without encoding faults, look-alikes, accents, case and punctuation; NULL where empty."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else confusables.plain(mojibake.repair(t)[1]))

    x = F.regexp_replace(F.lower(K.strip_accents(run(K.present(c)))), r"[\s.\-'’�?]", "")
    return F.when(x != "", F.replace(F.replace(F.replace(x, F.lit("ø"), F.lit("o")), F.lit("þ"), F.lit("th")), F.lit("ß"), F.lit("ss")))


def takeover_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = table(spark, d, "reprise_source"), table(spark, d, "reprise_target")
    left = a.select(
        F.col("row_id").alias("id"),
        F.coalesce(K.code(F.col("Matricule")), F.concat(F.lit("#"), F.col("row_id"))).alias("entity"),
        name_form(F.col("NomFamille")).alias("surname"),
        name_form(F.col("PrénomUsuel")).alias("given"),
        K.canonical("date", F.col("DateEmbaucheRécente")).alias("onboard"),
        K.canonical("date", F.col("DateEntréePoste")).alias("start"),
        K.code(F.col("CodeEmploi")).alias("position"),
        K.code(F.col("CodeDirection")).alias("division"),
        K.code(F.col("CodeImputation")).alias("cost"),
        K.code(F.col("CodeSite")).alias("site"),
        K.code(F.col("ÉchelleSalariale")).alias("grade"),
        K.number(F.col("HeuresNormeHebdo")).alias("hours"),
        F.upper(K.present(F.col("TypeAffectation"))).alias("kind"),
    )
    right = b.select(
        F.col("row_id").alias("id"),
        F.coalesce(K.code(F.col("personId")), F.concat(F.lit("#"), F.col("row_id"))).alias("entity"),
        name_form(F.col("surname")).alias("surname"),
        name_form(F.col("givenName")).alias("given"),
        K.canonical("date", F.col("onboardDate")).alias("onboard"),
        K.canonical("date", F.col("assignmentStartDate")).alias("start"),
        K.code(F.col("positionId")).alias("position"),
        K.code(F.col("divisionId")).alias("division"),
        K.code(F.col("divisionCode")).alias("cost"),
        K.code(F.col("siteCode")).alias("site"),
        K.code(F.col("payGradeId")).alias("grade"),
        K.number(F.col("weeklyHoursOverride")).alias("hours"),
        F.when(K.boolean(F.col("isPrimaryAssignment")), "P").when(K.boolean(F.col("isTemporaryAssignment")), "A").when(~K.boolean(F.col("isPrimaryAssignment")) & ~K.boolean(F.col("isTemporaryAssignment")), "S").alias("kind"),
    )
    both = F.array_join(F.array_sort(F.array("surname", "given")), " ")  # the same whichever way round
    return tuple(x.withColumn("names", F.when(F.col("surname").isNotNull() & F.col("given").isNotNull(), both)) for x in (left, right))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the takeover's assignments with their confidence."""
    links = linkage.link(*takeover_records(spark, d), LINKED, LEAST_LINK)
    return links.select(F.col("l").alias("source_row_id"), F.col("r").alias("target_row_id"), F.round("score", 3).alias("score"), "confidence")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select("source_row_id", "target_row_id")


# ---------------------------------------------------------------- 9: sentence units
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(spread(table(spark, d, "documents")), "doc_id", "text")


# ---------------------------------------------------------------- 7: containers
def sizes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return materialize(tokens.measured(spread(table(spark, d, "documents").select("doc_id", "text", *keep)), "doc_id", "text", keep), "sizes")


def _packed(spark: SparkSession, d: str, sized: DataFrame) -> DataFrame:
    kinds = [(r["nom"], int(r["capacite"])) for r in table(spark, d, "contenant").orderBy("nom").collect()]  # a fixed table of 3 rows
    return packing.packed(sized, "doc_id", kinds, tokens.BITS * tokens.DIMS)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of each capacity."""
    return _packed(spark, d, sizes(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused space per capacity."""
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "contenant"))


def p7_nearness(spark: SparkSession, d: str) -> DataFrame:
    """How alike the documents of a container are, against documents drawn at random."""
    sized = sizes(spark, d)
    return packing.nearness(materialize(_packed(spark, d, sized), "packed"), sized, "doc_id")


# ---------------------------------------------------------------- 8: mix
# Language codes, by the two- and three-letter forms that stand for them.
LANGUAGES = {"fr": "fr", "fra": "fr", "fre": "fr", "en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es", "ru": "ru", "rus": "ru", "zh": "zh", "zho": "zh", "chi": "zh", "ja": "ja", "jpn": "ja", "ar": "ar", "ara": "ar", "hi": "hi", "hin": "hi", "el": "el", "gre": "el", "ell": "el", "th": "th", "tha": "th"}


def language(c: Column) -> Column:
    """One of the language codes, `und` for the rest."""
    base = F.lower(F.regexp_extract(F.trim(c), "^([A-Za-z]+)", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), base), F.lit("und"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix and all documents by source, language and topic."""
    sized = tokens.with_topics(sizes(spark, d, "source", "lang").withColumn("lang", language(F.col("lang"))))
    return mixing.mix(sized, "doc_id", table(spark, d, "melange_cible")), sized


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return _mixed(spark, d)[0].select("doc_id", "source", "n_tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, allowed and actual share of each source, and its shortfall."""
    mixed, docs = _mixed(spark, d)
    return mixing.share_report(materialize(mixed, "mix"), docs, table(spark, d, "melange_cible"))


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics in the corpus and in the mix."""
    mixed, docs = _mixed(spark, d)
    return mixing.marginal_report(materialize(mixed, "mix"), docs, table(spark, d, "melange_cible"))


QUERIES = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_repairs": p2_repairs,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_nearness": p7_nearness,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_marginals": p8_marginals,
    "p9_found": p9_found,
}
SQL: dict[str, str] = {}
