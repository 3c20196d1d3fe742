import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from docket_spark.domain import values as V
from docket_spark.operators import encode, flatten, joins, metrics, modeling, sampling, splits
from docket_spark.sources import pages, tables
from docket_spark.streaming import ingest


def test_flatten_by_mapping(spark):
    raw = spark.createDataFrame([("T1", ("IPR", "Pending"), None)], "trialNumber string, trialMetaData struct<trialTypeCode string, trialStatusCategory string>, patentOwnerData struct<patentNumber string>")
    r = flatten.by_name(raw, V.PARSERS, "proceedings").first()
    assert list(r.asDict()) == list(V.PARSERS["proceedings"]) and (r["trial_number"], r["trial_type"], r["patent_number"], r["termination_date"]) == ("T1", "IPR", None, None)
    good, bad = flatten.validate(raw.select("trialNumber", F.lit(None).cast("string").alias("id")), ["trialNumber", "id"])
    assert good.count() == 0 and bad.first()["missing"] == "id"
    with pytest.raises(KeyError):
        flatten.by_name(raw, V.PARSERS, "nothing")


def test_polymorphic_lists(spark):
    cases = {'["a", " b ", ""]': ["a", "b"], '[{"x": "", "y": "c"}, {"x": "d"}]': ["c", "d"], '"e"': ["e"], "f": ["f"], None: [], "[]": [], "{broken": []}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    for r in df.select("raw", flatten.polymorphic_list(F.col("raw")).alias("a")).collect():
        assert r["a"] == cases[r["raw"]], r["raw"]


def test_unwrap_and_bags(spark):
    df = spark.createDataFrame([("1", [("9", [("US",), ("",), ("CN",)])], None), ("2", [], None), ("3", None, None)], "n string, bag array<struct<n string, people array<struct<c string>>>>, people array<struct<c string>>")
    got = {r["n"]: [x["c"] for x in r["people"] or []] for r in flatten.unwrapped(df, "bag").collect()}
    assert got == {"9": ["US", "", "CN"], "2": [], "3": []}
    codes = df.select(flatten.distinct_codes(F.col("bag"), "people", "c").alias("c"), flatten.bag_size(F.col("bag")).alias("n")).collect()
    assert [(r["c"], r["n"]) for r in codes] == [(["CN", "US"], 1), ([], 0), ([], 0)]


def test_join_all(spark):
    labelled = spark.createDataFrame([("a", date(2020, 1, 1), "p1", 1, 0), ("b", date(2020, 1, 2), "p2", 2, 1), ("c", date(2020, 1, 3), "p3", 3, 1), ("d", None, "p4", 4, 1)], "trial_number string, petition_filing_date date, patent_number string, application_number int, label int")
    petitions = spark.createDataFrame([("a", date(2020, 1, 1), "u"), ("b", date(2020, 2, 2), "u")], "trial_number string, petition_filing_date_doc date, petition_pdf_uri string")
    patents = spark.createDataFrame([("1", "x")], "application_number string, entity_size string")
    texts = spark.createDataFrame([("a", "long")], "trial_number string, petition_text string")
    out, report = joins.join_all(labelled, petitions, patents, texts)
    assert {r["trial_number"]: (r["wrapper_matched"], r["entity_size"], r["petition_text"]) for r in out.collect()} == {"a": (True, "x", "long"), "b": (False, None, None)}
    assert report.first().asDict() == {"n_labelled": 4, "n_ready": 3, "n_without_petition": 2, "n_joined": 2, "n_date_mismatch": 1}


def test_gaps(spark):
    wanted = spark.createDataFrame([("1", "u"), ("2", " "), ("3", None), ("4", "u")], "k string, uri string")
    assert [r["k"] for r in joins.missing_keys(joins.filled(wanted, ["uri"]), spark.createDataFrame([("4",), (None,)], "k string"), "k").collect()] == ["1"]


def test_folds_equal_the_positions_rule(spark):
    r = random.Random(3)
    for trial in range(3):
        days = sorted(date(2020, 1, 1) + timedelta(r.randrange(25)) for _ in range(60 + trial))
        n, folds = len(days), 4
        size = n // (folds + 1)
        snap = lambda i: max(k for k in range(n) if days[k] == days[i - 1]) + 1
        want = []
        for k in range(folds):
            a, b = snap(n - (folds - k) * size), snap(n - (folds - k - 1) * size)
            if a < b:
                want.append((days[a - 1], days[b - 1]))
        df = spark.createDataFrame([(d,) for d in days], "d date")
        assert splits.fold_dates(df, "d", folds) == want
    with pytest.raises(ValueError):
        splits.fold_dates(df.union(spark.sql("SELECT cast(null AS date)")), "d", 2)


def test_metrics_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(r.randrange(2), r.choice([0.0, 0.1, 0.3, 0.35, 0.5, 0.9, 1.0])) for _ in range(80)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "y", "p").first()["auc"] == pytest.approx(auc)
    bins = {x["bin"]: x["n"] for x in metrics.calibration(df, "y", "p").collect()}
    assert bins == {b: n for b in range(10) if (n := sum(min(int(p * 10), 9) == b for _, p in rows))}
    assert metrics.roc_auc(df.where("y = 1"), "y", "p").first()["auc"] is None
    assert metrics.class_report(df.where("false"), "y", "p").count() == 4


def test_encoders_learn_from_training_rows_only(spark):
    train = spark.createDataFrame([("2400", 10.0), ("3700", 20.0), (None, 30.0), ("2400", 40.0)], "tc string, n double")
    levels = encode.one_hot_levels(train, "tc")
    test = spark.createDataFrame([("9999", None)], "tc string, n double")
    r = encode.impute(encode.one_hot(test, "tc", levels), encode.medians(train, ["n"]), ["n"]).first()
    assert (r["tc_2400"], r["tc_3700"], r["tc___missing__"], r["n"]) == (0, 0, 0, 25.0)
    assert encode.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int"), "y") == {0: 4 / 6, 1: 2.0}


def test_grid_and_training(spark):
    assert modeling.combos({}) == [{}] and len(modeling.combos({"a": [1, 2], "b": [3]})) == 2
    r = random.Random(1)
    rows = [(i, date(2018, 1, 1) + timedelta(i), r.choice("xyz"), float(i % 7), int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, d date, c string, n double, y int")
    fitted, folds, report = modeling.run_training(df, "y", "d", ["c"], ["n"], lambda total: modeling.random_forest(5, 3), "2030-01-01", 10, "2018-04-10", 2)
    assert len(folds) == 2 and all(f["auc"] > 0.9 for f in folds) and report.where("class = '1'").first()["f1"] > 0.8
    assert modeling.importances(fitted, spark).first()["feature"] == "n"


def test_stratified_sample_takes_turns(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(100)], "id int, s string")
    rows = sampling.stratified(df, [F.col("s")], "id", 8).collect()
    assert sorted(r["stratum"] for r in rows) == ["a"] * 4 + ["b"] * 4
    assert rows == sampling.stratified(df.repartition(7), [F.col("s")], "id", 8).collect()


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "k1.json").write_text(json.dumps({"count": 2, "bag": [{"id": "a"}, {"id": "b"}]}))
    (tmp_path / "o" / "k2.json").write_text(json.dumps({"count": 2, "bag": []}))
    objects = tables.read_objects(spark, str(tmp_path / "o"), "count bigint, bag array<struct<id string>>")
    assert sorted(r["id"] for r in pages.records(objects, "bag").collect()) == ["a", "b"]
    assert {r["key"]: r["complete"] for r in pages.completeness(objects, "key", "count", "bag").collect()} == {"k1": True, "k2": False}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x1.txt").write_bytes(b"ok \xff")
    assert [(r["key"], r["text"]) for r in tables.read_texts(spark, str(tmp_path / "t")).collect()] == [("x1", "ok �")]
    assert [r["key"] for r in tables.blob_keys(spark, str(tmp_path / "t")).collect()] == ["x1"]
    df = spark.createDataFrame([(1, ["a", "b"], "2020-01-01"), (2, None, "bad")], "id int, a array<string>, d string")
    tables.export(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), "id int, a string, d string", ["d"])
    assert {r["id"]: (r["a"], r["d"]) for r in back.collect()} == {1: ('["a","b"]', date(2020, 1, 1)), 2: (None, None)}
    tables.write_table(df, str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p"), ["id"]).columns == ["id"]
    assert {r["id"]: r["d"] for r in tables.lookup(df, spark.createDataFrame([(1,), (9,)], "id int"), "id").collect()} == {1: "2020-01-01", 9: None}


def test_streams_add_new_files_only(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    write = lambda name, ids: (tmp_path / "in" / name).write_text(json.dumps({"bag": [{"id": i, "m": {"v": i * 2}} for i in ids]}))
    run = lambda: ingest.pages_to_table(spark, source, "bag array<struct<id bigint, m struct<v bigint>>>", "bag", {"id": "id", "v": "m.v"}, target, mark)
    count = lambda: spark.read.parquet(target).count()
    write("1.json", [1, 2])
    run()
    assert count() == 2
    run()
    assert count() == 2
    write("2.json", [3])
    run()
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_upsert_and_gap_refresh(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("\n".join(json.dumps({"k": k, "at": at, "v": v}) for k, at, v in rows))
    stream = lambda: spark.readStream.schema("k string, at bigint, v string").json(str(folder))
    put("1.json", [("a", 1, "old"), ("b", 1, "x")])
    ingest.upsert_latest(spark, stream(), "k", ["at", "v"], str(tmp_path / "v"), str(tmp_path / "c1"))
    put("2.json", [("a", 2, "new")])
    table = ingest.upsert_latest(spark, stream(), "k", ["at", "v"], str(tmp_path / "v"), str(tmp_path / "c1"))
    assert {r["k"]: r["v"] for r in table.collect()} == {"a": "new", "b": "x"}
    assert len(list((tmp_path / "v").glob("v=1/part=*"))) == 1  # the part that was touched
    for n in (3, 4):
        put(f"{n}.json", [("a", n, f"new{n}"), ("a", 1, "late"), (None, n, "none")])
        table = ingest.upsert_latest(spark, stream(), "k", ["at", "v"], str(tmp_path / "v"), str(tmp_path / "c1"))
        assert {r["k"]: r["v"] for r in table.collect()} == {"a": f"new{n}", "b": "x", None: "none"}
    parts = {}
    for x in (tmp_path / "v").glob("v=*/part=*"):
        parts.setdefault(x.name, []).append(x)
    assert all(len(v) <= 2 for v in parts.values())
    assert ingest.upsert_latest(spark, stream(), "k", ["at", "v"], str(tmp_path / "v"), str(tmp_path / "c1")) is None
    wanted = spark.createDataFrame([("a",), ("z",)], "k string")
    ingest.refresh_gaps(spark, str(folder), "k string", wanted, "k", str(tmp_path / "seen"), str(tmp_path / "gaps"), str(tmp_path / "c2"))
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "gaps")).collect()] == ["z"]


def test_search(spark):
    df = spark.createDataFrame([(1, "Alpha", 5), (2, "beta", 7), (3, "alphabet", 9)], "id int, name string, n int")
    assert [r["id"] for r in pages.search(df, "alpha", ["name"], ranges={"n": (6, None)}).collect()] == [3]
    assert [r["id"] for r in pages.search(df, sort=[("n", "desc")], offset=1, limit=1, fields=["id"]).collect()] == [2]


def test_contract_takes_aliases_and_rejects(spark):
    from docket_spark.operators import flatten

    df = spark.createDataFrame([("a", None, "5", "x"), (None, "b", "many", None), ("", "c", None, "y")], "trialNumber string, trial string, size string, extra string")
    good, bad = flatten.contract(df, {"trial": ("string", ["trialNumber"]), "size": ("int", []), "other": ("date", ["absent"])}, ["trial"])
    assert sorted(tuple(r) for r in good.collect()) == [("a", 5, None), ("b", None, None), ("c", None, None)] and bad.count() == 0
    good, bad = flatten.contract(df, {"trial": ("string", []), "size": ("int", [])}, ["trial", "size"])
    assert good.count() == 0 and sorted(r["missing"] for r in bad.collect()) == ["size", "size", "trial"]


def test_upsert_and_exists(spark):
    from docket_spark.sources.tables import exists, upsert

    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in upsert(old, new, "k").collect()) == [(0, "n"), (1, "a"), (2, "c"), (3, "d")]
    assert {r["k"]: r["found"] for r in exists(old, new, "k").collect()} == {2: True, 3: False}


def test_pending_counts_shapeless_rows_as_missing(spark):
    from docket_spark.operators import joins

    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k int")
    cached = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "k int, body string")
    assert sorted(r["k"] for r in joins.pending(wanted, cached, "k", ["body"]).collect()) == [2, 3]


def test_scores_far_apart_keep_their_order(spark):
    from docket_spark.operators import metrics

    rows = [(1, 1e300), (0, 5.0), (1, 5.0), (0, -2.5), (1, 0.0), (0, -1e9), (1, 1e-12), (0, 1e-13)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df, "y", "p").first()["auc"] - auc) < 1e-12
    last = max((r for r in metrics.roc_points(df, "y", "p").collect()), key=lambda r: r["fpr"])
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)
