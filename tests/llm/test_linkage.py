import random

from concordat.llm import linkage as L

SCHEMA = "id long, entity string, a string, b string, c string, d string, score string"
ATTRS = [L.Attribute("a", fuzzy=True), L.Attribute("b"), L.Attribute("c"), L.Attribute("d")]


def world(n, seed=5):
    r = random.Random(seed)
    left, right = [], []
    for i in range(n):
        v = [f"name{r.randrange(n)}x{i}", f"d{r.randrange(40)}", f"p{r.randrange(60)}", f"u{r.randrange(30)}"]
        left.append((i, f"e{i}", *v, "clash"))
        w = [None if r.random() < 0.1 else f"z{r.randrange(99)}" if r.random() < 0.05 else x for x in v]
        right.append((1000 + i, f"f{i}", *w, None))
    return left, right


def test_finds_partners(spark):
    left, right = world(150)
    got = {(x["l"], x["r"]) for x in L.link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ATTRS, 8.0).collect()}
    true = {(i, 1000 + i) for i in range(150)}
    assert len(got & true) >= 0.9 * len(true) and len(got - true) <= 3
    assert len({x for x, _ in got}) == len(got) == len({y for _, y in got})


def test_hot_values_ties_nulls_and_empty(spark):
    left = [(i, f"e{i}", "same", "same", f"p{i}", f"q{i}", "") for i in range(60)] + [(900, "x", None, None, None, None, None)]
    right = [(1000 + i, f"f{i}", "same", "same", f"p{i}", f"q{i}", "") for i in range(60)] + [(1900, "y", None, None, None, None, None)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    graph = L.candidate_graph(a, b, ["a", "b", "c", "d"], block_pairs=10)
    assert graph.count() == 60  # not 3600: the hot combination is refined
    assert {(x["l"], x["r"]) for x in L.link(a, b, ATTRS, 8.0).collect()} == {(i, 1000 + i) for i in range(60)}
    assert L.link(a.where("false"), b, ATTRS, 8.0).count() == 0


def test_neighbours_decide_between_namesakes(spark):
    # two namesakes alike in every attribute of one record; their other records differ
    left = [(1, "A", "n", "1", "1", "1", ""), (2, "A", "n", "2", "2", "2", ""), (3, "B", "n", "1", "1", "1", ""), (4, "B", "n", "3", "3", "3", "")]
    right = [(11, "X", "n", "1", "1", "1", ""), (12, "X", "n", "3", "3", "3", ""), (13, "Y", "n", "1", "1", "1", ""), (14, "Y", "n", "2", "2", "2", "")]
    fill = [(100 + i, f"q{i}", f"o{i}", f"k{i}", f"m{i}", f"w{i}", "") for i in range(30)]
    got = {(x["l"], x["r"]) for x in L.link(spark.createDataFrame(left + fill, SCHEMA), spark.createDataFrame(right + [(x[0] + 1000, *x[1:]) for x in fill], SCHEMA), ATTRS, 3.0).collect()}
    assert {(1, 13), (2, 14), (3, 11), (4, 12)} <= got


def test_common_combinations_are_refined_by_other_attributes_and_equal_records_meet(spark):
    # a mass hire: b and c are everybody's; only the attribute that doesn't block, or a part of a, tells them apart
    attrs = [L.Attribute("a", fuzzy=True), L.Attribute("b"), L.Attribute("c"), L.Attribute("d", block=False)]
    left = [(i, f"e{i}", f"left{i}", "same", "same", f"p{i}", "") for i in range(30)] + [(100, "x", "Tremblay", "same", "same", None, "")]
    right = [(1000 + i, f"f{i}", f"{i}right", "same", "same", f"p{i}", "") for i in range(30)] + [(1100, "y", "Trembley", "same", "same", None, "")]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    (a, parts), (b, _) = L.with_parts(a, attrs), L.with_parts(b, attrs)
    got = {(x["l"], x["r"]) for x in L.candidate_graph(a, b, ["a", "b", "c"], 400, ["d", *parts], parts).collect()}
    assert got == {(i, 1000 + i) for i in range(30)} | {(100, 1100)}
    copies = [(i, f"e{i}", "n", "1", "2", "3", "") for i in range(21)]
    x = spark.createDataFrame(copies, SCHEMA)
    assert L.candidate_graph(x, x, ["a", "b", "c", "d"], 400).count() == 21 * 21
    assert L.link(x, x, ATTRS, 0.0).count() == 21


def test_large_groups_without_further_evidence_meet_rank_by_rank(spark):
    # two attributes are everybody's and there is nothing else: 30 x 30 all meet, 150 x 200 leave nobody without a candidate
    side = lambda base, n: spark.createDataFrame([(base + i, f"e{base + i}", None, "same", "same", f"own{base + i}", "") for i in range(n)], SCHEMA)
    assert L.candidate_graph(side(0, 30), side(1000, 30), ["b", "c", "d"]).count() == 900
    got = L.candidate_graph(side(0, 150), side(1000, 200), ["b", "c", "d"]).collect()
    assert len({x["l"] for x in got}) == 150 and len({x["r"] for x in got}) == 200 and len(got) == 200


def test_links_see_all_pairs_of_large_groups_without_further_evidence(spark, monkeypatch):
    # two attributes are everybody's: 110 x 120 pairs, more than candidate_graph's default lets meet
    side = lambda base, n: [(base + i, f"e{base + i}", None, "same", "same", f"own{base + i}", "") for i in range(n)]
    a, b = spark.createDataFrame(side(0, 110), SCHEMA), spark.createDataFrame(side(1000, 120), SCHEMA)
    for tasks in (1 << 20, 5_000):
        got = [(x["l"], x["r"]) for x in L.candidate_graph(a, b, ["b", "c", "d"], rest_pairs=None, task_edges=tasks).collect()]
        assert len(got) == len(set(got)) == 110 * 120
    seen, graph = [], L.candidate_graph
    monkeypatch.setattr(L, "candidate_graph", lambda *args, **more: seen.append(graph(*args, **more)) or seen[-1])
    L.link(a, b, ATTRS, 8.0)
    assert seen[0].count() == 110 * 120
    

def brute_gains(edges):
    return {(x[0], x[1]): max([y[5] for y in edges if y[5] > 0 and y[2:4] == x[2:4] and y[0] != x[0] and y[1] != x[1]], default=None) for x in edges}


def test_gains_are_those_of_all_neighbours(spark):
    r = random.Random(3)
    edges = [(l, 100 + k, f"e{l // 6}", f"f{k // 5}", 0.0, float(r.randrange(-2, 9))) for l in range(18) for k in range(15) if r.random() < 0.6]
    df = spark.createDataFrame(edges, "l long, r long, el string, er string, base double, score double")
    got = {(x["l"], x["r"]): x["gain"] for x in L._gains(df).collect() if x["gain"] is not None}
    assert got == {k: v for k, v in brute_gains(edges).items() if v is not None}


def test_assignment_is_the_same_in_one_task_and_in_rounds(spark):
    r = random.Random(8)
    edges = [(r.randrange(40), 100 + r.randrange(40), float(r.randrange(20))) for _ in range(300)]
    df = spark.createDataFrame(list({(a, b): (a, b, c) for a, b, c in edges}.values()), "l long, r long, score double")
    one, many = (sorted(map(tuple, L.assign(df, 3.0, n).collect())) for n in (1 << 20, 10))
    assert one == many and len({x[0] for x in one}) == len(one)
