import random
from datetime import date, timedelta

import pytest

from docket_spark.operators import asof


def rows(seed, n):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.1 else date(2020, 1, 1) + timedelta(r.randrange(40))
    key = lambda: r.choice(["A", "B", "C", None])
    return [(i, key(), key(), day(), r.randrange(2)) for i in range(n)]


@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_prior_rate_equals_brute_force(spark, keys):
    schema = "id int, a string, b string, d date, y int"
    events, asks = rows(1, 150), rows(2, 120)
    out = asof.prior_rate(spark.createDataFrame(events, schema), spark.createDataFrame(asks, schema), keys, "d", "d", "y", "p")
    part = lambda r: tuple(r[1 + i] for i in range(len(keys)))
    dated = [e for e in events if e[3]]
    mean = sum(e[4] for e in dated) / len(dated)
    got = {r["id"]: (r["p_prior_rate"], r["p_prior_count"]) for r in out.collect()}
    for q in asks:
        early = [e for e in dated if q[3] and e[3] < q[3]]
        own = [e[4] for e in early if part(e) == part(q)]
        rate = sum(own) / len(own) if own else sum(e[4] for e in early) / len(early) if early else mean
        assert got[q[0]] == (pytest.approx(rate), len(own)), q


def test_frequency_and_null_keys(spark):
    df = spark.createDataFrame([(1, "A", date(2019, 1, 1)), (2, "A", date(2020, 1, 1)), (3, "A", date(2021, 1, 1)), (4, None, date(2022, 1, 1)), (5, None, date(2023, 1, 1)), (6, "A", None)], "id int, k string, d date")
    assert {r["id"]: r["k_frequency"] for r in asof.frequency(df, df, "k", "d", "d").collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}
    assert {r["id"]: r["k_frequency"] for r in asof.frequency(df, df, "k", "d", "d", null_key="group").collect()}[5] == 1


def test_strict_before_and_fallbacks(spark):
    train = spark.createDataFrame([("A", date(2020, 1, 1), 1), ("A", date(2020, 6, 1), 0), ("A", date(2021, 1, 1), 1), ("B", date(2020, 6, 1), 0), ("B", date(2021, 6, 1), 1), ("Z", None, 1)], "k string, d date, y int")
    asks = spark.createDataFrame([(1, "A", date(2020, 1, 1)), (2, "A", date(2020, 12, 1)), (3, "B", date(2021, 1, 1)), (4, "C", date(2021, 6, 1))], "id int, k string, d date")
    got = {r["id"]: (r["k_prior_rate"], r["k_prior_count"]) for r in asof.prior_rate(train, asks, ["k"], "d", "d", "y").collect()}
    assert got == {1: (0.6, 0), 2: (0.5, 2), 3: (0.0, 1), 4: (0.5, 0)}


def test_timestamps_and_empty_events(spark):
    asks = spark.sql("SELECT 1 AS id, 'A' AS k, timestamp'2020-01-01 00:00:01' AS d")
    events = spark.sql("SELECT 'A' AS k, timestamp'2020-01-01 00:00:00' AS d, 1 AS y")
    assert asof.prior_rate(events, asks, ["k"], "d", "d", "y").first()["k_prior_count"] == 1
    none = asof.prior_rate(events.where("false"), asks, ["k"], "d", "d", "y").first()
    assert none["k_prior_count"] == 0 and none["k_prior_rate"] is None
