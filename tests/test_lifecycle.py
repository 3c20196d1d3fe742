"""Provenance of features, gaps of pages, observed joins, quarantine, publishing, gaps of texts."""

import datetime as dt
import json
import random

import pytest
from checks import same_rows
from pyspark.sql import functions as F

from docket_spark.domain import values as V
from docket_spark.operators import features, joins, provenance
from docket_spark.sources import pages, publish, quarantine
from docket_spark.streaming.ingest import latest, text_gaps
from test_features import frame

FACTS = provenance.Facts([(["event_dates"], ["event_codes"]), (["assignment_received_dates", "assignment_recorded_dates"], ["assignees_per_assignment"])], ["outcome", "decided", "score"])


def trials(spark):
    d = dt.date
    rows = [{}, dict(trial_number="T2", petition_filing_date=d(2016, 6, 1)), dict(trial_number="T3", petition_filing_date=None), dict(trial_number="T4", event_codes=None, event_dates=None, assignment_received_dates=None), dict(trial_number="T5", event_dates=[d(2030, 1, 1)] * 9)]
    return frame(spark, *rows).withColumns({"outcome": F.lit("won"), "decided": F.lit(None).cast("date"), "score": F.lit(1.5)})


def test_features_do_not_know_the_future(spark):
    df = trials(spark)
    build = lambda x: features.build_features(x, V.FEATURE_SPEC)
    assert build(df).count() == 5
    assert provenance.leaks(df, build, "trial_number", "petition_filing_date", FACTS).count() == 0


LEAKS = {
    "length": "size(event_codes)", "last": "array_max(event_dates)", "outcome": "outcome", "decided": "decided is null", "score": "score", "names": "size(flatten(assignees_per_assignment))",
    "recorded": "array_max(assignment_recorded_dates)", "on the day": "size(filter(arrays_zip(event_codes, event_dates), e -> e.event_dates <= petition_filing_date))",
}


@pytest.mark.parametrize("name", list(LEAKS))
def test_planted_leaks_are_found(spark, name):
    build = lambda x: features.build_features(x, V.FEATURE_SPEC).join(x.select("trial_number", F.expr(LEAKS[name]).alias("planted")), "trial_number")
    found = provenance.leaks(trials(spark), build, "trial_number", "petition_filing_date", FACTS).collect()
    assert found and all(r["columns"] == ["planted"] for r in found)


def test_a_row_that_depends_on_the_future(spark):
    build = lambda x: x.where("outcome = 'won'").select("trial_number", "entity_size")
    assert provenance.leaks(trials(spark), build, "trial_number", "petition_filing_date", FACTS).count() == 5


def test_missing_ranges_equal_plain_sets(spark):
    r = random.Random(3)
    held, announced, want = [], [], []
    for b in range(12):
        n = r.randrange(0, 40)
        total = r.choice([n * 10, max(0, n * 10 - 3), 0 if b == 3 else n * 10 + 1])
        announced.append((b, total))
        have = {o for o in range(0, 500, 10) if r.random() < (0.0 if b == 5 else 0.6)}
        held += [(b, o) for o in have] + [(b, o) for o in list(have)[:3]] + [(b, 7), (b, -10)]
        missing = [o for o in range(0, total, 10) if o not in have]
        while missing:
            run = [missing.pop(0)]
            while missing and missing[0] == run[-1] + 10:
                run.append(missing.pop(0))
            want.append((b, run[0], run[-1], len(run)))
    held.append((99, 0))  # a bucket that nothing announces
    df, said = spark.createDataFrame(held, "b int, o bigint"), spark.createDataFrame(announced, "b int, n bigint")
    for block in (1, 3, 100_000):
        same_rows(pages.missing_ranges(df, "b", "o", 10, said, "n", block), ["b", "first", "last", "n_pages"], want)
    assert pages.missing_ranges(df.where("false"), "b", "o", 10, said.where("n = 0"), "n").count() == 0


def test_observed_join_equals_join_and_report(spark, tmp_path):
    d = dt.date
    labelled = spark.createDataFrame([("T1", d(2020, 1, 1), "P1", "5"), ("T2", d(2020, 1, 2), "P2", None), ("T3", None, "P3", "7"), ("T4", d(2020, 1, 4), "P4", "9"), ("T5", d(2020, 1, 4), None, "1")], "trial_number string, petition_filing_date date, patent_number string, application_number string")
    petitions = spark.createDataFrame([("T1", d(2020, 1, 9), "x"), ("T2", d(2020, 1, 2), "y"), ("T3", d(2020, 1, 2), "z"), ("T2", d(2020, 1, 3), "w")], "trial_number string, petition_filing_date_doc date, title string")
    patents = spark.createDataFrame([(5, "big")], "application_number int, entity_size string")
    texts = spark.createDataFrame([("T1", "text")], "trial_number string, petition_text string")
    rows, counted = joins.join_all(labelled, petitions, patents, texts)
    found, seen = joins.join_observed(labelled, petitions, patents, texts)
    found.write.parquet(str(tmp_path / "out"))
    same_rows(spark.read.parquet(str(tmp_path / "out")), rows.columns, [tuple(r) for r in rows.collect()])
    got = joins.report(seen)
    assert {k: got[k] for k in counted.columns} == counted.first().asDict()
    assert (got["n_wrapper_matched"], got["n_text"], got["n_joined"]) == (1, 1, 3)


CONTRACT = {"trial": ("string", ["trialNumber"], True), "filed": ("date", ["meta.filed", "filed"], True), "pages": ("int", [], False)}


def test_quarantine_at_the_scan(spark, tmp_path):
    good = [{"trialNumber": "a", "meta": {"filed": "2020-01-01"}, "more": 1}, {"trialNumber": "b", "filed": "2020-02-01", "pages": 3}]
    bad = [{"meta": {"filed": "2020-01-01"}}, {"trialNumber": "c", "filed": "soon", "pages": "many"}, {"trialNumber": None}]
    (tmp_path / "one.json").write_text("\n".join(map(json.dumps, good + bad)) + "\n\n{broken\n[1]\n")
    (tmp_path / "two.json").write_text(json.dumps(good[0]) + "\n")
    (tmp_path / "other.txt").write_text("{}")
    fine, rejected = quarantine.split(spark, str(tmp_path), CONTRACT)
    assert sorted((r["trial"], str(r["filed"]), r["pages"], r["source_file"].rsplit("/")[-1]) for r in fine.collect()) == [("a", "2020-01-01", None, "one.json"), ("a", "2020-01-01", None, "two.json"), ("b", "2020-02-01", 3, "one.json")]
    assert sorted((r["reason"], r["record"]) for r in rejected.collect()) == sorted([("missing: trial", json.dumps(bad[0])), ("bad value: filed, bad value: pages", json.dumps(bad[1])), ("missing: trial, missing: filed", json.dumps(bad[2])), ("unreadable", "{broken"), ("unreadable", "[1]")])
    fine, rejected = quarantine.split(spark, str(tmp_path), CONTRACT, multi_line=True)
    assert (fine.count(), rejected.count()) == (1, 1)  # several records are no one record


def test_publish_is_whole_and_safe_to_run_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    one = spark.range(100).withColumn("x", F.col("id") * 2)
    first = publish.publish(one, root)
    assert publish.read(spark, root).count() == 100 and first["rows"] == 100
    versions = lambda: {p.name for p in (tmp_path / "table" / "versions").iterdir()}
    again = publish.publish(one.repartition(7).select("x", "id"), root)  # equal content, other order
    assert again == first and versions() == {first["version"]}
    with monkeypatch.context() as m:  # between write and switch
        m.setattr(publish, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            publish.publish(one.limit(7), root)
    assert publish.read(spark, root).count() == 100
    held = publish.read(spark, root)
    for n in (7, 8, 9, 10):
        latest_one = publish.publish(one.limit(n), root)
    assert publish.read(spark, root).count() == 10 and len(latest_one["older"]) == 2
    assert not {first["version"]} & versions() and held is not None
    empty = publish.publish(one.limit(0), root)
    assert empty["rows"] == 0 and publish.read(spark, root).columns == ["id", "x"]
    with pytest.raises(FileNotFoundError):
        publish.read(spark, str(tmp_path / "none"))


def test_text_gaps_follow_arrivals(spark, tmp_path):
    folder, versions, mark = tmp_path / "texts", str(tmp_path / "v"), str(tmp_path / "m")
    folder.mkdir()
    (folder / "T1.txt").write_text("a")
    (folder / "stray.txt").write_text("a")
    wanted = spark.createDataFrame([(f"T{i}",) for i in range(40)] + [(None,), ("T1",)], "k string")
    gaps = lambda: {r["k"] for r in text_gaps(spark, str(folder), wanted, "k", versions, mark, parts=8).collect()}
    assert gaps() == {f"T{i}" for i in range(40)} - {"T1"}
    before = {p.name for p in (tmp_path / "v").iterdir()}
    assert gaps() == {f"T{i}" for i in range(40)} - {"T1"} and {p.name for p in (tmp_path / "v").iterdir()} == before
    (folder / "T2.txt").write_text("b")
    (folder / "T3.pdf").write_text("b")
    assert gaps() == {f"T{i}" for i in range(40)} - {"T1", "T2"}
    new = {p.name for p in (tmp_path / "v").iterdir()} - before
    assert len(new) == 1 and len(list((tmp_path / "v" / new.pop()).glob("part=*"))) == 1  # one part was written


def test_latest_passes_one_row_a_key_on(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (None, 1, "d"), (2, 0, "e")], "k int, t int, x string")
    same_rows(latest(df, "k", ["t"]), ["k", "t", "x"], [(1, 7, "b"), (2, 0, "e"), (None, 1, "d")])
