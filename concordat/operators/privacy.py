"""Data protection around text that leaves the engine: pseudonyms, leak scan, flow decision, grounding, dossiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.ranks import ranked
from concordat.session import materialize

# Patterns of e-mail addresses and of long numbers.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
LONG_NUMBER = r"(?<![\p{L}\p{N}_])[0-9]{7,}(?![\p{L}\p{N}_])"
EMAIL_MASK, NUMBER_MASK = "[COURRIEL]", "[NUMERO]"


def mask(c: Column) -> Column:
    """E-mail addresses, then numbers of seven digits and more, replaced by a mark. NULL stays NULL."""
    return F.regexp_replace(F.regexp_replace(c, EMAIL, EMAIL_MASK), LONG_NUMBER, NUMBER_MASK)


def leaks(c: Column) -> Column:
    """Number of addresses and long numbers in a text."""
    return F.regexp_count(c, F.lit(EMAIL)) + F.regexp_count(F.regexp_replace(c, EMAIL, " "), F.lit(LONG_NUMBER))


def tokens(ids: DataFrame, column: str, prefix: str = "EMP") -> DataFrame:
    """(column, token): EMP-01, EMP-02 ... by sorted distinct id; numbers above 99 take the digits they need. NULL has no
    token. Ranks come from per-range counts, so no single task sorts all ids."""
    d = ranked(ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_all", F.lit(0)), ["_all"], [column], "_n")
    rank = F.col("_n").cast("string")
    return d.select(column, F.concat(F.lit(prefix + "-"), F.when(F.length(rank) >= 2, rank).otherwise(F.lpad(rank, 2, "0"))).alias("token"))


#: A dictionary of at most so many entries is sent to all executors; a larger one is joined by shuffling.
BROADCAST_ENTRIES = 200_000
_WORD = r"[\p{L}\p{N}_]+"
HIDDEN = "[MASQUE]"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))


def _canonical(c: Column) -> Column:
    """A secret as its words, one blank between them; so `Marie-Ève` and `Marie Ève` are one."""
    return F.array_join(_words(c), " ")


def secrets(persons: DataFrame, named: dict[str, DataFrame], hidden: Sequence[DataFrame] = (), least: int = 3) -> DataFrame:
    """(key, token) of what texts must not show. persons: person; they get EMP-nn. named: label -> (person, value): such
    values get label-EMP-nn of their first person. hidden: (value): these are only masked. Values under `least` characters
    and persons that are NULL don't count; a value that is several things is the first of them."""
    people = tokens(persons.select(F.col("person").cast("string").alias("person")), "person")
    parts = [people.select(_canonical(F.col("person")).alias("key"), "token", F.lit(0).alias("place"))]
    for n, (label, values) in enumerate(named.items(), 1):
        own = values.select(F.col("person").cast("string").alias("person"), F.col("value").alias("v")).where(F.length("v") >= least).distinct().join(people, "person")
        parts.append(own.select(_canonical(F.col("v")).alias("key"), F.concat(F.lit(label + "-"), "token").alias("token"), F.lit(n).alias("place")))
    for values in hidden:
        parts.append(values.select(F.col(values.columns[0]).alias("v")).where(F.length("v") >= least).select(_canonical(F.col("v")).alias("key"), F.lit(HIDDEN).alias("token"), F.lit(1000).alias("place")))
    every = reduce(DataFrame.unionByName, parts).where("key <> ''")
    return every.groupBy("key").agg(F.min(F.struct("place", F.length("token").alias("n"), "token")).alias("x")).select("key", F.col("x.token").alias("token"))


def _found(texts: DataFrame, id_column: str, text_column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """(id, _t): the entries of the dictionary that stand in each text, longest first."""
    d = materialize(dictionary.select(_canonical(F.col(key).cast("string")).alias("w"), "token").where("w <> ''"), "dictionary")
    size = d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("w", " "))).alias("m")).first()
    longest = size["m"] or 1
    # every run of up to as many words as the longest entry has; where only single words are secret, the words alone
    words = texts.select(id_column, _words(F.col(text_column)).alias("ws"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))

    none = F.expr("cast(array() as array<string>)")
    runs = [F.when(F.size("ws") >= n, of(n)).otherwise(none) for n in range(1, longest + 1)]
    run = words.select(id_column, F.explode(F.array_distinct(F.concat(*runs) if longest > 1 else F.col("ws"))).alias("w"))
    hits = run.join(F.broadcast(d) if size["n"] <= BROADCAST_ENTRIES else d, "w")
    return hits.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct((-F.length("w")).alias("n"), "w", "token"))).alias("_t"))


def _quoted(c: Column) -> Column:
    """Text as a replacement that stands for itself."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def pseudonymize(texts: DataFrame, id_column: str, text_column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """Known secrets in texts become their tokens, what remains is masked. dictionary: `key`, `token`.

    Runs of words are taken from each text and joined to the dictionary, so it may be of any size and no text meets all
    secrets. Secrets of several words (`St-Onge`, `O'Neil`) are found whatever stands between their words; longer ones
    are replaced first, and only where no letter, digit or underscore touches them. NULL texts stay NULL.
    """
    j = texts.join(_found(texts, id_column, text_column, dictionary, key), id_column, "left")
    edge = r"[\p{L}\p{N}_]"
    pattern = lambda w: F.concat(F.lit(f"(?<!{edge})"), F.array_join(F.transform(F.split(w, " "), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), r"[^\p{L}\p{N}_]+"), F.lit(f"(?!{edge})"))
    none = F.expr("cast(array() as array<struct<n:int,w:string,token:string>>)")
    replaced = F.aggregate(F.coalesce("_t", none), F.regexp_replace(F.col(text_column), EMAIL, EMAIL_MASK), lambda acc, x: F.regexp_replace(acc, pattern(x["w"]), _quoted(x["token"])))
    return j.select(*[F.col(c) for c in texts.columns if c != text_column], F.regexp_replace(replaced, LONG_NUMBER, NUMBER_MASK).alias(text_column))


def known_leaks(texts: DataFrame, id_column: str, text_column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """(id, n_secrets): how many known secrets stand in each text; texts with none are left out."""
    return _found(texts, id_column, text_column, dictionary, key).select(id_column, F.size("_t").alias("n_secrets"))


def restore(texts: DataFrame, id_column: str, text_column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """Tokens back to ids, character by character; masks stay."""
    token = r"[A-Z]+(?:-[A-Z]+)*-\d{2,}"
    words = texts.select(id_column, F.explode(F.array_distinct(F.regexp_extract_all(text_column, F.lit(rf"\b{token}\b"), F.lit(0)))).alias("w"))
    found = words.join(dictionary.select(F.col("token").alias("w"), F.col(key).cast("string").alias("v")), "w").groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct((-F.length("w")).alias("n"), "w", "v"))).alias("_t"))
    j = texts.join(found, id_column, "left")
    none = F.expr("cast(array() as array<struct<n:int,w:string,v:string>>)")
    back = F.aggregate(F.coalesce("_t", none), F.col(text_column), lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"(?<![A-Z-])\b"), x["w"], F.lit(r"\b")), _quoted(x["v"])))
    return j.select(*[F.col(c) for c in texts.columns if c != text_column], back.alias(text_column))


def provider_class(endpoint: str | None) -> str:
    """LOCAL for no endpoint or one on this machine, else EXTERNE."""
    host = (urlsplit(endpoint).hostname or "") if endpoint else "localhost"
    return "LOCAL" if host in ("localhost", "127.0.0.1", "::1") else "EXTERNE"


def flow_decision(keys: Column, classes: dict[str, str], allowed: Sequence[str], n_leaks: Column, external: bool) -> Column:
    """allow, or why not: an unclassified key, a class that may not flow, or (outside) a leak."""
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    unclassified = F.exists(keys, lambda k: F.try_element_at(table, k).isNull())
    barred = F.exists(keys, lambda k: ~F.coalesce(F.try_element_at(table, k), F.lit("")).isin(list(allowed)))
    return F.when(unclassified, "block: unclassified").when(barred, "block: class").when(F.lit(external) & (n_leaks > 0), "block: leak").otherwise("allow")


def ungrounded(answer: Column, source: Column) -> Column:
    """What an answer cites (dates, numbers of two digits and more, tokens, quotations) that the source doesn't hold."""
    cited = F.array_distinct(
        F.concat(
            F.regexp_extract_all(answer, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)),
            F.regexp_extract_all(F.regexp_replace(answer, r"\b\d{4}-\d{2}-\d{2}\b", " "), F.lit(r"\b\d{2,}\b"), F.lit(0)),
            F.regexp_extract_all(answer, F.lit(r"\bEMP-\d{2,}\b"), F.lit(0)),
            F.regexp_extract_all(answer, F.lit("«[\\s ]*(.*?)[\\s ]*»"), F.lit(1)),
        )
    )
    return F.array_sort(F.filter(cited, lambda x: ~source.contains(x)))


# The keys of an answer, all needed, and the bounds of its text.
ANSWER_KEYS = ["preuves", "synthese"]
ANSWER_LENGTH = (20, 2000)


def checked_answers(answers: DataFrame, context: DataFrame, id_column: str) -> DataFrame:
    """(id, status): whether an answer may be used. answers: id, `answer` (JSON text). context: id, `payload` (what was
    sent), `evidence` (ids that may be cited). Statuses, the first that holds: NOT_JSON, SCHEMA (other keys, no list of
    texts, length), CITATION (a repeated or unknown evidence id), UNGROUNDED (dates, numbers, tokens or quotations that
    the payload lacks), OK. An answer without context is CITATION or UNGROUNDED like any other.
    """
    j = answers.join(context, id_column, "left")
    keys = F.json_object_keys("answer")
    x = F.from_json("answer", "synthese string, preuves array<string>")
    j = j.withColumns({"_keys": keys, "_x": x})
    length = F.length(F.trim("_x.synthese"))
    cited = F.coalesce("_x.preuves", F.expr("cast(array() as array<string>)"))
    known = F.coalesce("evidence", F.expr("cast(array() as array<string>)"))
    bad_schema = ~F.array_sort("_keys").eqNullSafe(F.array(*[F.lit(k) for k in ANSWER_KEYS])) | F.col("_x.preuves").isNull() | F.coalesce(~length.between(*ANSWER_LENGTH), F.lit(True))
    bad_cite = (F.size(F.array_except(cited, known)) > 0) | (F.size(F.array_distinct(cited)) < F.size(cited))
    status = F.when(F.col("_keys").isNull(), "NOT_JSON").when(bad_schema, "SCHEMA").when(bad_cite, "CITATION").when(F.size(ungrounded(F.col("_x.synthese"), F.coalesce("payload", F.lit("")))) > 0, "UNGROUNDED").otherwise("OK")
    return j.select(id_column, status.alias("status"))


def unexplained(findings: DataFrame) -> DataFrame:
    """Findings to investigate that no hypothesis explains: those to look at one by one."""
    return findings.where(F.col("verdict").isin("ANOMALIE", "INDETERMINE") & (F.size("hypotheses") == 0))


def clip(c: Column, n: int) -> Column:
    """White space collapsed; longer texts cut to n characters, the last being an ellipsis."""
    x = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.left(x, F.lit(n - 1))), F.lit("…"))).otherwise(x)


def dossiers(findings: DataFrame, least_priority: float = 30.0) -> DataFrame:
    """(person_id, n_findings, max_priority, payload): findings to investigate of each person as one JSON text with
    `<` and `>` escaped. Systemic findings and low priorities don't count."""
    x = findings.where((F.col("priority") >= least_priority) & ~F.array_contains("hypotheses", "H-SYSTEMIC"))
    x = x.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("target_field", "expected", "target_raw", "verdict", "priority", "probable_cause"))).alias("f"), F.max("priority").alias("max_priority"))
    payload = F.replace(F.replace(F.to_json(F.struct(F.col("f").alias("findings")), {"ignoreNullFields": "false"}), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    return x.select("person_id", F.size("f").alias("n_findings"), "max_priority", payload.alias("payload"))
