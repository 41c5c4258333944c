import random

import numpy as np

from concordat.operators import setrec as S


def test_field_arithmetic():
    r = random.Random(1)
    a, b = (np.array([0, 1, S.P - 1, *(r.randrange(S.P) for _ in range(500))], np.uint64) for _ in range(2))
    assert all(int(x) * int(y) % S.P == int(z) for x, y, z in zip(a, b, S.mulmod(a, b)))


def test_decode_finds_differences_or_asks_for_more_points():
    r = random.Random(2)
    h = lambda n: [r.randrange(S.FIRST_HASH, S.P) for _ in range(n)]
    for _ in range(60):
        common, x, y = h(r.randrange(0, 40)), h(r.randrange(0, 9)), h(r.randrange(0, 9))
        left, right = (np.array(common + z, np.uint64) for z in (x, y))
        ea, eb = S.evaluate([left, right], 10)
        found = S.decode(ea, eb, len(left), len(right))
        if found is None:
            ea, eb = S.evaluate([left, right], 66)
            found = S.decode(ea, eb, len(left), len(right))
        assert set(S.roots(left, found[0]).tolist()) == set(x) and set(S.roots(right, found[1]).tolist()) == set(y)


SCHEMA = "person_id string, kind string, v string, w string"


def brute(a, b):
    da, db = {x[:2]: x[2:] for x in a}, {x[:2]: x[2:] for x in b}
    out = {(*k, "missing_in_target") for k in da.keys() - db.keys()} | {(*k, "missing_in_source") for k in db.keys() - da.keys()}
    return out | {(*k, f) for k in da.keys() & db.keys() for f, p, q in zip("vw", da[k], db[k]) if p != q}


def compare(spark, a, b, **o):
    x = S.field_differences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["person_id", "kind"], ["v", "w"], **o)
    return [(r["person_id"], r["kind"], r["fld"]) for r in x.collect()]


def test_against_brute_force(spark):
    r = random.Random(3)
    a = [(str(i), r.choice("PAS"), r.choice(["1", "2", None]), r.choice(["x", None])) for i in range(600)]
    b = [(p, k, v if r.random() < 0.97 else "9", w if r.random() < 0.97 else None) for p, k, v, w in a if r.random() < 0.97] + [(str(i), "P", None, None) for i in range(700, 715)]
    got = compare(spark, a, b)
    assert len(got) == len(set(got)) and set(got) == brute(a, b)


def test_all_rows_differ_needs_doubling(spark):
    a = [(str(i), "P", "1", None) for i in range(300)]
    b = [(str(i), "P", None, "1") for i in range(300)]
    assert set(compare(spark, a, b)) == brute(a, b)


def test_empty_sides(spark):
    a = [(str(i), "P", "1", None) for i in range(5)]
    assert set(compare(spark, a, [])) == brute(a, []) and set(compare(spark, [], a)) == brute([], a) and compare(spark, [], []) == []
    assert compare(spark, a, a) == []
