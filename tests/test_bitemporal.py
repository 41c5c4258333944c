import datetime as dt
import random

from pyspark.sql import functions as F

from concordat.operators import asof, bitemporal

SCHEMA = "k string, d date, r timestamp, u string, t long, value string"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def hour(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)


def brute(rows, k, d, at):
    """Unit in effect at day d as known at `at`."""
    own = [(x[1], x[2], x[4], x[3]) for x in rows if x[0] == k and None not in x[:4] and x[1] <= d and x[2] <= at]
    return max(own)[3] if own else None


def rows_of(seed, n=60):
    r = random.Random(seed)
    out = [(r.choice(["a", "b", "c"]), day(r.randrange(30)), hour(r.randrange(400)), r.choice("xyz"), i, "clash") for i in range(n)]
    return out + out[:5] + [(None, day(1), hour(1), "x", 900, ""), ("a", None, hour(1), "x", 901, ""), ("a", day(1), None, "x", 902, ""), ("a", day(1), hour(1), None, 903, "")]


def test_ledger_and_asof_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        ledger = bitemporal.bitemporal_ledger(df, "k", "d", "r", "u", "t").cache()
        found = ledger.collect()
        for k in "abc":
            for d in range(-1, 32, 3):
                for at in range(0, 420, 37):
                    hit = [x["value"] for x in found if x["k"] == k and x["valid_from"] <= day(d) and (x["valid_to"] is None or day(d) < x["valid_to"]) and x["recorded_from"] <= hour(at) and (x["recorded_to"] is None or hour(at) < x["recorded_to"])]
                    want = brute(rows, k, day(d), hour(at))
                    assert hit == ([] if want is None else [want])
        r = random.Random(seed + 9)
        ev = [(i, r.choice(["a", "b", "c", "q", None]), day(r.randrange(-2, 40)), hour(r.randrange(0, 420)), "same name") for i in range(200)] + [(999, "a", None, hour(3), ""), (998, "a", day(3), None, "")]
        events = spark.createDataFrame(ev, "id int, k string, day date, ts timestamp, note string")
        for levels in ((10, 13), (0, 1, 2, 3, 4, 5), (2, 4)):
            got = {x["id"]: x["value"] for x in asof.asof_join(events, ledger, "k", "day", "ts", levels).collect()}
            want = {e[0]: brute(rows, e[1], e[2], e[3]) for e in ev if e[1] and e[2] and e[3]}
            assert got == {k: v for k, v in want.items() if v is not None}


def test_hot_key_is_salted(spark):
    rows = [("h", day(i), hour(i), "xyz"[i % 3], i, "") for i in range(20)]
    ledger = bitemporal.bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), "k", "d", "r", "u", "t")
    ev = [(i, "h", day(i % 30), hour(1000 + i)) for i in range(300)]
    e = spark.createDataFrame(ev, "id int, k string, day date, ts timestamp")
    assert [tuple(r) for r in asof.hot_keys(e.groupBy("k").agg(F.count("id").alias("n")), "k", 300, 40).collect()] == [("h", 8)]
    got = {x["id"]: x["value"] for x in asof.asof_join(e, ledger, "k", "day", "ts", task_events=40).collect()}
    assert got == {i: brute(rows, "h", d, t) for i, _, d, t in ev}


def test_periods_and_order(spark):
    rows = [("a", day(0), hour(0), "x", 1, ""), ("a", day(5), hour(1), "x", 2, ""), ("a", day(9), hour(2), "y", 3, ""), ("a", day(9), hour(2), "z", 4, "")]
    shuffled = rows[::-1] + rows
    p = bitemporal.coalesce_periods(bitemporal.as_recorded(bitemporal.bitemporal_ledger(spark.createDataFrame(shuffled, SCHEMA), "k", "d", "r", "u", "t")), "k")
    assert sorted(map(tuple, p.collect())) == [("a", "x", day(0), day(9)), ("a", "z", day(9), None)]
    early = bitemporal.as_recorded(bitemporal.bitemporal_ledger(spark.createDataFrame(rows, SCHEMA), "k", "d", "r", "u", "t"), F.lit(hour(1)))
    assert early.count() == 2


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    ledger = bitemporal.bitemporal_ledger(e, "k", "d", "r", "u", "t")
    assert ledger.count() == 0 and bitemporal.coalesce_periods(ledger, "k").count() == 0
    events = spark.createDataFrame([], "id int, k string, day date, ts timestamp")
    assert asof.asof_join(events, ledger, "k", "day", "ts").count() == 0
