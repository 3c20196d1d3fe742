"""File wrappers from JSON text to flat rows."""

import datetime as dt
import json

from docket_spark.domain.values import WRAPPER
from docket_spark.operators.wrapper import wrapper_rows

FULL = {
    "applicationNumberText": "15000001",
    "applicationMetaData": {
        "filingDate": "2014-03-02", "effectiveFilingDate": "no date", "applicationTypeCode": "Utility", "entityStatusData": {"businessEntityStatusCategory": "Small"},
        "firstInventorToFileIndicator": " y", "nationalStageIndicator": "?", "uspcSymbolText": "700/1", "cpcClassificationBag": [" H01L 1/00 ", "", "G06F 3/01"],
        "inventorBag": [{"correspondenceAddressBag": [{"countryCode": "US"}, {"countryCode": "DE"}]}, {"correspondenceAddressBag": [{"countryCode": "US"}, {"countryCode": ""}, 3]}, "odd"],
    },
    "recordAttorney": {"attorneyBag": [{}, {}]},
    "patentTermAdjustmentData": {"aDelayQuantity": 4, "bDelayQuantity": 0, "adjustmentTotalQuantity": 4},
    "eventDataBag": [{"eventCode": "IEXX", "eventDate": "2014-03-05"}, {"eventCode": None, "eventDate": "x"}, {"eventDate": "2015-01-01"}],
    "assignmentBag": [{"assignmentReceivedDate": "2016-01-01", "assignmentRecordedDate": None, "assigneeBag": [{"assigneeNameText": "A Inc"}, {"assigneeNameText": ""}, {}]}, {}],
    "parentContinuityBag": [{"parentApplicationNumberText": "1"}, {"parentApplicationNumberText": None}, {"parentApplicationNumberText": "2"}],
}


def rows(spark, *records):
    df = spark.createDataFrame([(i, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, x in enumerate(records)], "id int, raw string")
    return wrapper_rows(df, "raw", ["id"]).orderBy("id").collect()


def test_full_record_and_envelope(spark):
    bare, wrapped = rows(spark, FULL, {"patentFileWrapperDataBag": [FULL], "count": 1})
    assert bare[1:] == wrapped[1:] and bare.asDict().keys() == {"id", *WRAPPER["columns"]}
    d = dt.date
    assert bare.asDict() == {
        "id": 0, "application_number": "15000001", "filing_date": d(2014, 3, 2), "effective_filing_date": None, "application_type": "Utility", "entity_size": "Small",
        "first_inventor_to_file": True, "national_stage": None, "n_inventors": 3, "inventor_country_codes": ["DE", "US"], "uspc_class_subclass": "700/1", "n_attorneys_of_record": 2,
        "pta_a_delay": 4, "pta_b_delay": 0, "pta_c_delay": None, "pta_total": 4, "pta_applicant_delay": None, "cpc_codes": ["H01L 1/00", "G06F 3/01"],
        "event_codes": ["IEXX", None, None], "event_dates": [d(2014, 3, 5), None, d(2015, 1, 1)], "assignment_received_dates": [d(2016, 1, 1), None],
        "assignment_recorded_dates": [None, None], "assignees_per_assignment": [["A Inc"], []], "parent_app_numbers": ["1", "2"],
    }


def test_absent_and_odd_parts(spark):
    empty = {**{c: None for c in WRAPPER["columns"]}, **{c: [] for c in WRAPPER["columns"] if c.endswith(("codes", "dates", "numbers", "assignment"))}, "n_inventors": 0, "n_attorneys_of_record": 0}
    bare, no_lists, null, broken, nothing, bag = rows(spark, {"applicationNumberText": "7"}, {"applicationNumberText": "7", "eventDataBag": "x", "assignmentBag": {}, "applicationMetaData": 5}, None, "{", "[]", {"patentFileWrapperDataBag": [], "applicationNumberText": "8"})
    for r, number in ((bare, "7"), (no_lists, "7"), (null, None), (broken, None), (nothing, None), (bag, "8")):
        assert {k: v for k, v in r.asDict().items() if k != "id"} == {**empty, "application_number": number}


def test_codes_of_all_shapes(spark):
    made = lambda bag: {"patentFileWrapperDataBag": [{"applicationMetaData": {"cpcClassificationBag": bag}}]}
    got = [r["cpc_codes"] for r in rows(spark, *(made(b) for b in (["a ", None, 5], [{"z": "", "b": "first", "a": "second"}, " c "], "single", None, [], [{}])))]
    assert got[0] in (["a", "5"], ["a", "null", "5"]) and got[1:] == [["first", "c"], ["single"], [], [], []]


def test_a_record_is_read_once(spark):
    df = wrapper_rows(spark.createDataFrame([("{}",)], "raw string"), "raw")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # in the envelope, or bare; a list's elements are not asked for their schema
    assert plan.count("variant_get(__v") == 2 and "schemaofvariant" not in plan.lower()


def test_odd_elements_of_all_bags(spark):
    odd = {"applicationNumberText": 5, "applicationMetaData": {"inventorBag": [None, {}, {"correspondenceAddressBag": {"countryCode": "US"}}, {"correspondenceAddressBag": [None, {"countryCode": 1}]}], "filingDate": ["x"]}, "recordAttorney": {"attorneyBag": [1, "x", None]},
           "patentTermAdjustmentData": {"aDelayQuantity": "12", "bDelayQuantity": "x"}, "eventDataBag": [3, {"eventCode": 7, "eventDate": {"a": 1}}, []], "assignmentBag": [{"assigneeBag": "x"}, "y"], "parentContinuityBag": {"parentApplicationNumberText": "1"}}
    r = rows(spark, {"patentFileWrapperDataBag": [odd]})[0]
    assert (r["application_number"], r["n_inventors"], r["inventor_country_codes"], r["n_attorneys_of_record"], r["pta_a_delay"], r["pta_b_delay"], r["filing_date"]) == ("5", 4, ["1"], 3, 12, None, None)
    assert (r["event_codes"], r["event_dates"], r["assignees_per_assignment"], r["assignment_received_dates"], r["parent_app_numbers"]) == (["7"], [None], [[]], [None], [])
    assert rows(spark, {"patentFileWrapperDataBag": ["x"], "applicationNumberText": "9"})[0]["application_number"] == "9"
