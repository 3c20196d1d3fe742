"""Saved prior rates against one-shot ones, before and after late events."""

import datetime as dt
import random

import pytest
from checks import same_rows
from pyspark.sql import functions as F

from docket_spark.operators import asof
from docket_spark.operators.state import RollingState

EVENTS = "k string, j string, d date, y int"


def rows(seed, n, span=4000):
    r = random.Random(seed)
    day = lambda: r.choice([None, dt.date(2010, 1, 1) + dt.timedelta(days=r.randrange(span))]) if r.random() < 0.1 else dt.date(2010, 1, 1) + dt.timedelta(days=r.randrange(span))
    return [(r.choice(["a", "b", "c", None, "", "rare%d" % r.randrange(9)]), r.choice(["x", None]), day(), r.randrange(2)) for _ in range(n)]


def same(found, wanted):
    out = wanted.select(*[F.round(c, 9).alias(c) if c.endswith("_rate") else F.col(c) for c in wanted.columns])
    same_rows(found.select(*[F.round(c, 9).alias(c) if c.endswith("_rate") else F.col(c) for c in found.columns]), out.columns, [tuple(r) for r in out.collect()])


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_fit_add_transform_equals_one_shot(spark, keys):
    first, late, asked = (spark.createDataFrame(rows(s, n, span), EVENTS).repartition(3) for s, n, span in ((1, 150, 2000), (2, 60, 4500), (3, 200, 6000)))
    asked = asked.drop("y").withColumnRenamed("d", "q")
    state = RollingState.fit(first, keys, "d", "y", parts=5, buckets=3)
    same(state.transform(asked, "q", "p", smoothing=2.0), asof.prior_rate(first, asked, keys, "d", "q", "y", "p", smoothing=2.0))
    assert set(state.add(late)) <= {-1, 0, 1, 2, 3, 4}
    both = first.unionByName(late)
    same(state.transform(asked, "q", "p"), asof.prior_rate(both, asked, keys, "d", "q", "y", "p"))
    again = RollingState(spark, state.table, keys, "d", "y", 5, 3)  # another session would open it so
    same(again.transform(asked, "q", "p", null_key="zero"), asof.prior_rate(both, asked, keys, "d", "q", "y", "p", null_key="zero"))
    one_shot = RollingState.fit(both, keys, "d", "y", parts=5, buckets=3)
    plain = lambda s: sorted(map(str, spark.table(s.table).collect()))
    assert plain(state) == plain(one_shot)


def test_late_events_leave_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "state")
    state = RollingState.fit(spark.createDataFrame(rows(5, 200), EVENTS), ["k"], "d", "y", path=path, parts=8, buckets=2)
    files = lambda: {p: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "state").glob("part=*")}
    before = files()
    touched = state.add(spark.createDataFrame([("a", "x", dt.date(2015, 5, 5), 1)], EVENTS))
    after = files()
    assert len(touched) == 2 and -1 in touched
    assert {int(p.name.split("=")[1]) for p in after if after[p] != before.get(p)} == set(touched)


def test_queries_do_not_move_the_table(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        state = RollingState.fit(spark.createDataFrame(rows(6, 100), EVENTS), ["k"], "d", "y", parts=4, buckets=4)
        plan = state._before(spark.createDataFrame([("a", 17000)], "__k0 string, day int"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables_and_wrong_dates(spark):
    none, asked = spark.createDataFrame([], EVENTS), spark.createDataFrame([("a", None, dt.date(2020, 1, 1))], "k string, j string, q date")
    state = RollingState.fit(none, ["k"], "d", "y", parts=2, buckets=2)
    assert state.transform(asked, "q", "p").first()[-2:] == (None, 0) and state.add(none) == []
    state.add(spark.createDataFrame([("a", "x", dt.date(2019, 1, 1), 1)], EVENTS))
    assert state.transform(asked, "q", "p").first()[-2:] == (1.0, 1)
    with pytest.raises(ValueError):
        RollingState.fit(none.withColumn("d", F.col("d").cast("timestamp")), ["k"], "d", "y")
