from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat.llm import mixing, packing, tokens
from concordat.llm import queries as Q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=200), st.integers(1, 150), st.integers(2, 40))
def test_pack_keeps_everything(sizes, capacity, window):
    out = packing.pack(sizes, capacity, window)
    per, fill = defaultdict(int), defaultdict(int)
    for item, _, container, n in out:
        per[item] += n
        fill[container] += n
    assert dict(per) == {i: s for i, s in enumerate(sizes) if s}
    assert all(0 < f <= capacity for f in fill.values())
    parts = defaultdict(int)
    for item, *_ in out:
        parts[item] += 1
    assert all(parts[i] == 1 for i, s in enumerate(sizes) if 0 < s <= capacity)
    assert all(parts[i] == -(-s // capacity) for i, s in enumerate(sizes) if s > capacity)


def test_hilbert_visits_every_cell_by_neighbours():
    pts = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    k = tokens.hilbert(pts, 3)
    assert sorted(k) == list(range(512))
    path = pts[np.argsort(k)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_measured(spark):
    rows = [(1, "Bonjour à tous."), (2, ""), (3, None), (4, "mot " * 150_000), (5, "Bonjour à tous.")]
    docs = spark.createDataFrame([(*r, f"s{r[0]}") for r in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in tokens.measured(docs, "doc_id", "text", ["source"]).collect()}
    enc = tokens.load(tokens.TOKENIZER)
    assert got[1]["n_tokens"] == len(enc.encode_ordinary(rows[0][1])) and got[2]["n_tokens"] == got[3]["n_tokens"] == 0
    assert got[4]["n_tokens"] == len(enc.encode_ordinary(rows[3][1])) and got[1]["curve"] == got[5]["curve"] and got[2]["source"] == "s2"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 2\n\t'.,é漢字ll’s\u00a0", max_size=60), st.integers(1, 9))
def test_pieces_give_the_tokens_of_the_whole_text(text, size):
    enc = tokens.load(tokens.TOKENIZER)
    parts = list(tokens.pieces(text, size))
    assert "".join(parts) == text and [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_ranges_don_t_depend_on_the_partitions_and_copies_are_dealt_out(spark):
    rows = [(i, 100, 5 if i % 3 else i * 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, curve long")
    a, b = (sorted(map(tuple, packing.packed(x, "doc_id", [("k", 250)], 30, 5000).collect())) for x in (df, df.orderBy(F.desc("doc_id")).repartition(7)))
    assert a == b and sum(r[4] for r in a) == 90_000
    sizes = {r["range"]: r["sum(n_tokens)"] for r in packing.ranges(df, "doc_id", 30, 5000).groupBy("range").sum("n_tokens").collect()}
    assert max(sizes.values()) <= 8000 and len(sizes) >= 18


def test_packing_query_is_whole(spark, sf):
    p = Q.p7_containers(spark, sf).cache()
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.measured(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text").collect()}
    for kind in ("court", "moyen", "grand"):
        per = {r[0]: r[1] for r in p.where(f"contenant = '{kind}'").groupBy("doc_id").sum("tokens").collect()}
        assert per == {k: v for k, v in sizes.items() if v}
    assert all(r["unused_share"] < 0.2 for r in packing.fill_report(p, spark.read.parquet(f"{sf}/contenant.parquet")).collect() if r["n_containers"] > 3)
    assert packing.packed(spark.createDataFrame([], "doc_id long, n_tokens int, curve long"), "doc_id", [("a", 10)], 30).count() == 0
    near = {r["contenant"]: r for r in Q.p7_nearness(spark, sf).collect()}
    assert near["court"]["within"] < near["court"]["at_random"]


def test_rake_meets_sources_and_caps():
    r = np.random.default_rng(1)
    cells, src, lang = r.integers(1, 1000, 60).astype(float), np.repeat(np.arange(3), 20), np.tile(np.arange(5), 12)
    shares, caps = np.array([0.5, 0.3, 0.2]), np.array([1.0, 2.0, 3.0])
    tokens_ = np.bincount(src, cells)
    goals = mixing.allowed_tokens(tokens_, shares, caps, tokens_.sum() * 0.5)
    w = mixing.rake(cells, src, [lang], goals, caps)
    assert (w <= caps[src] + 1e-9).all() and np.allclose(np.bincount(src, cells * w), goals, rtol=1e-9)
    natural = np.bincount(lang, cells) / cells.sum()
    assert np.allclose(np.bincount(lang, cells * w) / goals.sum(), natural, atol=1e-4)


def test_a_scarce_source_stops_at_its_repetitions_and_cuts_no_other():
    got = mixing.allowed_tokens(np.array([1000.0, 5.0, 0.0, 1000.0]), np.array([0.4, 0.2, 0.1, 0.3]), np.array([1.0, 3.0, 4.0, 2.0]), 1000.0)
    assert np.allclose(got, [985 * 4 / 7, 15, 0, 985 * 3 / 7])
    assert np.allclose(mixing.allowed_tokens(np.array([10.0]), np.array([1.0]), np.array([2.0]), 100.0), [20])
    assert mixing.allowed_tokens(np.zeros(2), np.ones(2), np.ones(2), 0.0).sum() == 0


def test_mix(spark):
    rows = [(i, "ab"[i % 2] if i else None, ["fr", "en"][i % 3 == 0], i % 4, 10 + i % 7) for i in range(4000)] + [(9000, "c", "fr", 0, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, n_tokens int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 3), ("none", 0.1, 2), ("c", 0.4, 2)], "source string, poids double, max_repetitions int")
    m = mixing.mix(docs, "doc_id", targets).cache()
    most = {"a": 1, "b": 3, "c": 2}
    assert all(r["max(copies)"] <= most[r["source"]] for r in m.groupBy("source").max("copies").collect())
    share = {r["source"]: r for r in mixing.share_report(m, docs, targets).collect()}
    assert abs(share["a"]["actual_share"] - 0.2) < 0.01 and abs(share["b"]["actual_share"] - 0.8) < 0.01 and share["none"]["tokens"] == 0
    assert share["c"]["tokens"] == 100 and share["c"]["shortfall"] > 0.3
    known = docs.where("source in ('a', 'b', 'c')").agg({"n_tokens": "sum"}).first()[0]
    assert abs(m.selectExpr("sum(n_tokens * copies)").first()[0] / known - mixing.SIZE) < 0.01
    langs = [r for r in mixing.marginal_report(m, docs, targets).collect() if r["marginal"] == "lang"]
    assert len(langs) == 2 and all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in langs)
    assert mixing.mix(docs.where("false"), "doc_id", targets).count() == 0
    assert mixing.share_report(m.where("false"), docs.where("false"), targets).count() == 4
