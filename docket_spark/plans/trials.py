"""Queries of whole jobs on trial-like records made of the given tables, each with the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..domain.values import FEATURE_SPEC, WRAPPER
from ..functions import scalars as X
from ..operators import arrays as A, features, joins, provenance, text as TX
from ..operators.state import RollingState
from ..operators.wrapper import wrapper_rows as flat_wrappers
from ..sources import pages, publish, quarantine
from ..sources.tables import blob_keys, exists, export, lookup, read_csv, read_table, read_texts, scratch
from ..streaming.ingest import text_gaps as stream_gaps


def _t(spark, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", list(columns) or None)


def _lines(spark, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate").withColumn("ship", F.to_date("l_shipdate")).drop("l_shipdate")


#: Lines of an order stand in this order; line numbers repeat.
ORDER = ["l_linenumber", "ship", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"]


def prior_rate_saved(spark, sf):
    """Prior rates of customers from a saved table, fitted on a part of the events and extended by the rest."""
    orders = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    events = _lines(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "ship", (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_linenumber")
    state = RollingState.fit(events.where("l_linenumber <= 2"), ["o_custkey"], "ship", "y", parts=8, buckets=8)
    state.add(events.where("l_linenumber > 2"))
    out = state.transform(orders.withColumn("day", F.to_date("o_orderdate")), "day", "customer")
    return out.select("o_orderkey", F.round("customer_prior_rate", 6).alias("rate"), F.col("customer_prior_count").alias("n"))


def _raw_wrappers(spark, sf: str) -> DataFrame:
    """A JSON text of each order, every second one in an envelope."""
    text = lambda c: c.cast("string")
    line = F.struct(
        *ORDER,
        F.struct(F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("C"), text(F.col("l_suppkey")))).alias("eventCode"), F.when(F.col("l_linenumber") % 4 > 0, text(F.col("ship"))).otherwise("none").alias("eventDate")).alias("event"),
        F.struct(text(F.col("ship")).alias("assignmentReceivedDate"), F.when(F.col("l_returnflag") != "N", text(F.date_add("ship", 5))).alias("assignmentRecordedDate"), F.array(F.struct(F.concat(F.lit("S"), text(F.col("l_suppkey"))).alias("assigneeNameText")), F.struct(F.lit("").alias("assigneeNameText"))).alias("assigneeBag")).alias("assigned"),
        F.struct(F.when(F.col("l_linenumber") == 2, "").otherwise(text(F.col("l_partkey"))).alias("parentApplicationNumberText")).alias("parent"),
        F.struct(F.array(F.struct(F.col("l_returnflag").alias("countryCode"))).alias("correspondenceAddressBag")).alias("inventor"),
        F.concat(F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus")).alias("code"), F.struct(F.col("l_linestatus").alias("name")).alias("attorney"),
    )
    own = _lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    df = _t(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus").join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda name: F.transform("x", lambda e: e[name])
    meta = F.struct(
        text(F.to_date("o_orderdate")).alias("filingDate"), F.col("o_orderpriority").alias("applicationTypeCode"), F.struct(F.col("o_orderstatus").alias("businessEntityStatusCategory")).alias("entityStatusData"),
        F.when(F.col("o_orderkey") % 3 == 0, " y").when(F.col("o_orderkey") % 3 == 1, "N").otherwise("?").alias("firstInventorToFileIndicator"), of("inventor").alias("inventorBag"), of("code").alias("cpcClassificationBag"),
    )
    record = F.struct(text(F.col("o_orderkey")).alias("applicationNumberText"), meta.alias("applicationMetaData"), F.struct(F.filter(of("attorney"), lambda a: a["name"] == "O").alias("attorneyBag")).alias("recordAttorney"), F.struct((F.col("o_orderkey") % 40).alias("aDelayQuantity")).alias("patentTermAdjustmentData"), of("event").alias("eventDataBag"), of("assigned").alias("assignmentBag"), of("parent").alias("parentContinuityBag"))
    return df.select(F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.array(record).alias(WRAPPER["envelope"])))).otherwise(F.to_json(record)).alias("raw"))


def wrapper_rows(spark, sf):
    """Flat rows of file wrappers in JSON, the arrays joined to texts."""
    flat = flat_wrappers(_raw_wrappers(spark, sf), "raw")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "|").alias(c)
    out = {c: told(c) for c in flat.columns if flat.schema[c].dataType.typeName() == "array"}
    out["assignees_per_assignment"] = F.array_join(F.transform("assignees_per_assignment", lambda x: F.array_join(x, "+")), "|").alias("assignees_per_assignment")
    return flat.select(*(out.get(c, F.col(c)) for c in flat.columns if c not in ("effective_filing_date", "national_stage", "uspc_class_subclass", "pta_b_delay", "pta_c_delay", "pta_total", "pta_applicant_delay")))


WRAPPER_SQL = """
WITH x AS (SELECT *, CAST(l_shipdate AS DATE) AS ship FROM lineitem)
SELECT CAST(o_orderkey AS VARCHAR) AS application_number, CAST(any_value(o_orderdate) AS DATE) AS filing_date, any_value(o_orderpriority) AS application_type, any_value(o_orderstatus) AS entity_size,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS first_inventor_to_file, count(*) AS n_inventors, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS inventor_country_codes,
  count(*) FILTER (l_linestatus = 'O') AS n_attorneys_of_record, o_orderkey % 40 AS pta_a_delay, string_agg(l_returnflag || l_linestatus, '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS cpc_codes,
  string_agg(CASE WHEN l_linenumber % 3 > 0 THEN 'C' || l_suppkey ELSE '-' END, '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS event_codes,
  string_agg(CASE WHEN l_linenumber % 4 > 0 THEN CAST(ship AS VARCHAR) ELSE '-' END, '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS event_dates,
  string_agg(CAST(ship AS VARCHAR), '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS assignment_received_dates,
  string_agg(CASE WHEN l_returnflag <> 'N' THEN CAST(ship + 5 AS VARCHAR) ELSE '-' END, '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS assignment_recorded_dates,
  string_agg('S' || l_suppkey, '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS assignees_per_assignment,
  coalesce(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, ship, l_suppkey, l_partkey, l_returnflag, l_linestatus) FILTER (l_linenumber <> 2), '') AS parent_app_numbers
FROM orders JOIN x ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


#: Event codes of a line by its number modulo five, and the category each has.
LINE_CODES = ["CTNF", "WIDS", "TRIALPET", "ZZZZ", "M2551"]


def _trials(spark, sf: str) -> DataFrame:
    """Orders as trials with dated events and assignments (their lines), and petition texts of known content."""
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, LINE_CODES)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    line = F.struct(*ORDER, code.alias("code"), F.col("ship").alias("date"), F.when(F.col("l_returnflag") != "N", F.date_add("ship", 9)).alias("recorded"), F.array(F.concat(F.lit("Firm "), (F.col("l_suppkey") % 3).cast("string"), F.lit(", Inc."))).alias("names"), F.concat(F.col("l_returnflag"), F.lit("01"), F.col("l_linestatus"), F.lit(" 1/00")).alias("cpc"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").cast("string").alias("part"))
    own = _lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    df = _t(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_custkey").join(own, k == F.col("l_orderkey"), "left")
    of = lambda name: F.transform("x", lambda e: e[name])
    # The texts are as long as a petition and are made where the lines are found: of the order's key alone, a filter on
    # their length would be inferred for the lines too, and make a text of each line.
    n = F.coalesce(F.col("l_orderkey"), k)
    grounds = F.array_join(F.transform(F.when(n % 4 > 0, F.sequence(F.lit(1), (n % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("Ground "), i.cast("string"), F.lit(": obvious. "))), "")
    said = F.concat(grounds, F.repeat(F.lit("under § 102 now. "), (n % 3).cast("int")), F.repeat(F.lit("under § 103 now. "), (n % 5).cast("int")), F.when(n % 7 == 0, "Petitioner will not pursue such a ground. ").otherwise(""), F.when(n % 6 == 0, "Factor 1: a. Factor 2: b. Factor 3: c. ").otherwise(""), F.repeat(F.lit("plain words. "), F.when(n % 10 == 0, 300).otherwise(400)))
    return df.select(
        k.cast("string").alias("trial_number"), F.date_add(F.to_date("o_orderdate"), 60).alias("petition_filing_date"), (k % 9000).cast("string").alias("group_art_unit"), (F.col("o_custkey") % 9).cast("string").alias("technology_center"),
        F.col("o_orderstatus").alias("entity_size"), F.lit("P").alias("petitioner_real_party"), F.col("o_custkey").cast("string").alias("owner_real_party"), F.to_date("o_orderdate").alias("grant_date"), F.to_date("o_orderdate").alias("filing_date"),
        of("cpc").alias("cpc_codes"), of("code").alias("event_codes"), of("date").alias("event_dates"), of("date").alias("assignment_received_dates"), of("recorded").alias("assignment_recorded_dates"), of("names").alias("assignees_per_assignment"),
        of("part").alias("parent_app_numbers"), of("flag").alias("inventor_country_codes"), said.alias("petition_text"), (k % 11 > 0).alias("wrapper_matched"), k.cast("string").alias("application_number"), F.col("o_orderstatus").alias("outcome"),
    )


TRIAL_COLUMNS = ["trial_number", "technology_center", "entity_size", "filing_year", "filing_month", "days_grant_to_petition", "n_ex", "n_aa", "n_maint", "n_other", "n_events", "prosecution_span_days", "n_assignments", "n_distinct_assignees", "days_since_last_assignment", "no_recorded_assignment", "n_cpc_codes", "n_cpc_subclasses", "cpc_section", "inventor_geo", "ptab_era", "n_parent_applications", "n_grounds", "n_grounds_102", "n_grounds_103", "has_sotera_stipulation", "mentions_fintiv_factors", "petition_text_length"]


def trial_features(spark, sf):
    """The feature table of trials with a usable text and a matched wrapper, as of their filing dates."""
    out = features.build_features(_trials(spark, sf), FEATURE_SPEC).select(TRIAL_COLUMNS)
    return out.select(*(F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in out.schema.fields))


_ERAS = " ".join(f"WHEN t0 >= DATE '{start}' THEN '{name}'" for name, start in sorted(FEATURE_SPEC["eras"].items(), key=lambda x: x[1], reverse=True))
TRIAL_SQL = f"""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderdate AS DATE) + 60 AS t0, o_orderkey AS k FROM orders WHERE o_orderkey % 11 > 0),
x AS (
  SELECT k, t0, l_linenumber AS no, l_suppkey AS supp, l_partkey AS part, CAST(l_shipdate AS DATE) AS ship, ['CTNF','WIDS','TRIALPET','ZZZZ','M2551'][CAST(l_linenumber % 5 + 1 AS INT)] AS code, 'firm ' || (l_suppkey % 3) || ' inc' AS firm,
    l_returnflag AS flag, l_returnflag || '01' || l_linestatus AS cpc FROM o JOIN lineitem ON k = l_orderkey),
e AS (
  SELECT k, count(*) FILTER (code = 'CTNF') AS ex, count(*) FILTER (code = 'WIDS') AS aa, count(*) FILTER (code = 'M2551') AS maint, count(*) FILTER (code = 'ZZZZ') AS other, count(*) AS n,
    CASE WHEN count(*) >= 2 THEN max(ship) - min(ship) END AS span FROM x WHERE ship < t0 AND code <> 'TRIALPET' GROUP BY k),
a AS (SELECT k, count(*) AS n, count(DISTINCT firm) AS firms, max(ship) AS last FROM x WHERE ship < t0 GROUP BY k),
c AS (SELECT k, count(*) AS n, count(DISTINCT substr(cpc, 1, 4)) AS subs, min_by(substr(cpc, 1, 1), (no, ship, supp, part, flag)) AS section, bool_and(flag = 'US') AS us FROM x GROUP BY k),
said AS (SELECT *, (k % 4) * length('Ground 1: obvious. ') + (k % 3) * length('under § 102 now. ') + (k % 5) * length('under § 103 now. ') + CASE WHEN k % 7 = 0 THEN length('Petitioner will not pursue such a ground. ') ELSE 0 END
  + CASE WHEN k % 6 = 0 THEN length('Factor 1: a. Factor 2: b. Factor 3: c. ') ELSE 0 END + CASE WHEN k % 10 = 0 THEN 300 ELSE 400 END * length('plain words. ') AS chars FROM o)
SELECT CAST(k AS VARCHAR) AS trial_number, CAST(o_custkey % 9 AS VARCHAR) AS technology_center, o_orderstatus AS entity_size, CAST(year(t0) AS BIGINT) AS filing_year, CAST(month(t0) AS BIGINT) AS filing_month, CAST(t0 - filed AS BIGINT) AS days_grant_to_petition,
  coalesce(ex, 0) AS n_ex, coalesce(aa, 0) AS n_aa, coalesce(maint, 0) AS n_maint, coalesce(other, 0) AS n_other, coalesce(e.n, 0) AS n_events, CAST(span AS BIGINT) AS prosecution_span_days,
  coalesce(a.n, 0) AS n_assignments, coalesce(firms, 0) AS n_distinct_assignees, CAST(t0 - last AS BIGINT) AS days_since_last_assignment, CAST(a.n IS NULL AS BIGINT) AS no_recorded_assignment,
  coalesce(c.n, 0) AS n_cpc_codes, coalesce(subs, 0) AS n_cpc_subclasses, section AS cpc_section, CASE WHEN us THEN 'us_only' WHEN us IS NOT NULL THEN 'any_foreign' END AS inventor_geo, CASE {_ERAS} END AS ptab_era, coalesce(c.n, 0) AS n_parent_applications,
  k % 4 AS n_grounds, k % 3 AS n_grounds_102, k % 5 AS n_grounds_103, CAST(k % 7 = 0 AS BIGINT) AS has_sotera_stipulation, CAST(k % 6 = 0 AS BIGINT) AS mentions_fintiv_factors, CAST(chars AS BIGINT) AS petition_text_length
FROM said LEFT JOIN e USING (k) LEFT JOIN a USING (k) LEFT JOIN c USING (k) WHERE chars >= 5000"""


def provenance_check(spark, sf):
    """Trials whose features would change with the future: of the feature table none, of one with planted leaks some."""
    facts = provenance.Facts([(["event_dates"], ["event_codes"]), (["assignment_received_dates", "assignment_recorded_dates"], ["assignees_per_assignment"])], ["outcome"])
    honest = lambda df: features.build_features(df, FEATURE_SPEC)
    planted = lambda df: df.select("trial_number", F.size(F.filter("event_codes", lambda c: c == "CTNF")).alias("n_ex"), F.size("event_codes").alias("n_codes"), "entity_size", A.count_category(A.events_before(F.col("event_codes"), F.col("event_dates"), F.col("petition_filing_date"), FEATURE_SPEC["categories"], [], []), "EX").alias("n_before"))
    # Texts are searched and lines brought to their orders once; all four builds read what is stored.
    folder = scratch(spark, "provenance")
    provenance.without_facts(_trials(spark, sf), lambda df: features.with_text_features(df, FEATURE_SPEC), facts).write.parquet(folder)
    df = spark.read.parquet(folder)
    found = [provenance.leaks(df, build, "trial_number", "petition_filing_date", facts).withColumn("builder", F.lit(name)) for name, build in (("honest", honest), ("planted", planted))]
    return found[0].unionByName(found[1]).select("builder", "trial_number", F.array_join("columns", ",").alias("columns"))


PROVENANCE_SQL = """
WITH x AS (SELECT o_orderkey, bool_or(l_linenumber % 5 = 0 AND CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) + 60) AS later FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT 'planted' AS builder, CAST(o_orderkey AS VARCHAR) AS trial_number, CASE WHEN later THEN 'n_ex,n_codes' ELSE 'n_codes' END AS columns FROM x"""


def page_gaps(spark, sf):
    """Missing runs of pages, of orders dealt to five buckets as pages of a hundred records, a third of them lost."""
    orders = _t(spark, sf, "orders", "o_orderkey", "o_custkey").select((F.col("o_orderkey") % 5).alias("bucket"), (F.floor(F.col("o_orderkey") / 5) * 100).alias("offset"), "o_custkey")
    announced = orders.groupBy("bucket").agg((F.max("offset") + 250).alias("count"))
    return pages.missing_ranges(orders.where("o_custkey % 3 > 0"), "bucket", "offset", 100, announced, "count", 1000)


PAGE_SQL = """
WITH p AS (SELECT o_orderkey % 5 AS bucket, o_orderkey // 5 AS page, o_custkey FROM orders), said AS (SELECT bucket, max(page) + 3 AS n FROM p GROUP BY 1),
whole AS (SELECT bucket, unnest(range(CAST(n AS BIGINT))) AS page FROM said),
gone AS (SELECT *, page - row_number() OVER (PARTITION BY bucket ORDER BY page) AS run FROM whole WHERE NOT EXISTS (FROM p WHERE p.bucket = whole.bucket AND p.page = whole.page AND o_custkey % 3 > 0))
SELECT bucket, min(page) * 100 AS first, max(page) * 100 AS last, count(*) AS n_pages FROM gone GROUP BY bucket, run"""


def quarantine_rows(spark, sf):
    """Documents as JSON lines, some of them broken, read by a contract: each line once, with its reason if it is rejected."""
    docs = _t(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    k = F.col("doc_id")
    record = F.to_json(F.struct(F.when(k % 7 > 0, k).alias("doc_id"), F.struct(F.when(k % 5 > 0, F.col("lang")).alias("lang")).alias("meta"), F.when(k % 6 == 0, "many").otherwise(F.col("n_chars").cast("string")).alias("size"), k.alias("check")))
    folder = scratch(spark, "records")
    docs.select(F.when(k % 11 == 0, F.concat(record, F.lit("{"))).otherwise(record).alias("value")).write.text(folder)
    good, bad = quarantine.split(spark, folder, {"trial": ("bigint", ["doc_id"], True), "kind": ("string", ["lang", "meta.lang"], True), "length": ("int", ["size"], False)}, glob="*.txt")
    own = F.regexp_extract("record", r'"check":([0-9]+)', 1).cast("bigint")
    told = bad.select(own.alias("doc_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("length"), "reason")
    return good.select(F.col("trial").alias("doc_id"), "kind", "length", F.lit("").alias("reason")).unionByName(told)


QUARANTINE_SQL = """
WITH d AS (SELECT doc_id, lang, CAST(n_chars AS INTEGER) AS n, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' ELSE concat_ws(', ', CASE WHEN doc_id % 7 = 0 THEN 'missing: trial' END, CASE WHEN doc_id % 5 = 0 OR lang IS NULL THEN 'missing: kind' END, CASE WHEN doc_id % 6 = 0 THEN 'bad value: length' END) END AS reason FROM documents)
SELECT doc_id, CASE WHEN reason = '' THEN lang END AS kind, CASE WHEN reason = '' THEN n END AS length, reason FROM d"""


def _trial_tables(spark, sf: str):
    """Labelled trials, petitions, patents and texts, with gaps in each."""
    orders = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("trial_number")
    labelled = orders.select(key, F.when(k % 13 > 0, F.col("day")).alias("petition_filing_date"), F.when(k % 17 > 0, F.col("o_custkey").cast("string")).alias("patent_number"), F.col("o_custkey").cast("string").alias("application_number"), F.col("o_orderstatus").alias("status"))
    petitions = orders.where(k % 5 > 0).select(key, F.when(k % 7 > 0, F.date_add("day", (k % 2).cast("int"))).alias("petition_filing_date_doc"))
    patents = _t(spark, sf, "customer", "c_custkey", "c_mktsegment").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("application_number"), F.col("c_mktsegment").alias("entity_size"))
    texts = _t(spark, sf, "documents", "doc_id", "lang").select(F.col("doc_id").cast("string").alias("trial_number"), F.col("lang").alias("petition_text"))
    return labelled, petitions, patents, texts


def trial_table(spark, sf):
    """The joined trials."""
    joined, _ = joins.join_observed(*_trial_tables(spark, sf))
    return joined.select("trial_number", "petition_filing_date", "petition_filing_date_doc", "patent_number", "status", "entity_size", "wrapper_matched", "petition_text")


def trial_report(spark, sf):
    """What the write of the joined trials has counted on its way."""
    joined, seen = joins.join_observed(*_trial_tables(spark, sf))
    joined.write.parquet(scratch(spark, "trials"))
    counts = joins.report(seen)
    return spark.range(1).select(*(F.lit(counts[c]).cast("bigint").alias(c) for names in joins.OBSERVED.values() for c in names))


_TRIALS = """l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END AS filed, CASE WHEN o_orderkey % 17 > 0 THEN CAST(o_custkey AS VARCHAR) END AS patent, o_custkey, o_orderstatus AS status,
  o_orderkey % 5 > 0 AS petition, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INTEGER) END AS doc FROM orders),
j AS (SELECT l.*, c_mktsegment, c_custkey IS NOT NULL AS matched, lang FROM l LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 > 0 LEFT JOIN documents ON doc_id = k WHERE petition AND filed IS NOT NULL AND patent IS NOT NULL)"""
TABLE_SQL = f"WITH {_TRIALS} SELECT CAST(k AS VARCHAR) AS trial_number, filed AS petition_filing_date, doc AS petition_filing_date_doc, patent AS patent_number, status, c_mktsegment AS entity_size, matched AS wrapper_matched, lang AS petition_text FROM j"
REPORT_SQL = f"""WITH {_TRIALS} SELECT (SELECT count(*) FROM l) AS n_labelled, (SELECT count(*) FROM l WHERE filed IS NOT NULL AND patent IS NOT NULL) AS n_ready, (SELECT count(*) FROM l WHERE NOT petition) AS n_without_petition,
  count(*) AS n_joined, count(*) FILTER (doc <> filed) AS n_date_mismatch, count(*) FILTER (matched) AS n_wrapper_matched, count(lang) AS n_text FROM j"""


def published_table(spark, sf):
    """Brands published, published again as they are, then with one more column; rows with the number of versions made."""
    root = scratch(spark, "published")
    brands = _t(spark, sf, "part", "p_brand", "p_retailprice").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("most"))
    made = {publish.publish(df, root)["version"] for df in (brands, brands.repartition(3), brands.withColumn("few", F.col("n") < 50))}
    return publish.read(spark, root).withColumn("versions", F.lit(len(made)).cast("bigint"))


def text_gaps(spark, sf):
    """Keys without a text file, by a stream of the files: keys from documents, files from their labels."""
    folder, state = scratch(spark, "texts"), scratch(spark, "gaps")
    _t(spark, sf, "labels", "doc_id", "quality").select(F.col("quality").cast("string").alias("value"), (F.col("doc_id") % 50).alias("k")).repartition("k").write.partitionBy("k").text(folder)
    wanted = _t(spark, sf, "documents", "doc_id").select((F.col("doc_id") % 60).cast("string").alias("k")).distinct()
    return stream_gaps(spark, folder, wanted, "k", f"{state}/versions", f"{state}/mark", parts=4, pattern=r"/k=([0-9]+)/[^/]+\.txt$")


GAPS_SQL = "SELECT DISTINCT CAST(doc_id % 60 AS VARCHAR) AS k FROM documents WHERE doc_id % 60 NOT IN (SELECT doc_id % 50 FROM labels)"

def stored_lookup(spark, sf):
    """Point look-ups of orders by keys some of which are not there, and whether they are: one join each."""
    orders = _t(spark, sf, "orders", "o_orderkey", "o_orderstatus").where("o_orderkey % 3 > 0")
    keys = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup(orders, keys, "o_orderkey").join(exists(orders, keys, "o_orderkey"), "o_orderkey")


def csv_table(spark, sf):
    """Orders exported as CSV with a nested column as JSON text, one status in ten no date, and read again by a schema."""
    folder = scratch(spark, "csv")
    day = F.when(F.col("o_orderkey") % 10 > 0, F.to_date("o_orderdate").cast("string")).otherwise("soon")
    export(_t(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus").select("o_orderkey", day.alias("day"), F.array("o_orderpriority", "o_orderstatus").alias("both")), folder)
    return read_csv(spark, folder, "o_orderkey bigint, day string, both string", ["day"]).select("o_orderkey", "day", F.array_join(F.from_json("both", "array<string>"), "/").alias("both"))


def text_files(spark, sf):
    """Texts written as one file a source, read again as whole files."""
    folder = scratch(spark, "blobs")
    _t(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(F.concat("o_orderstatus", F.lit(" é "), F.col("o_orderkey").cast("string")).alias("value"), F.substring("o_orderpriority", 1, 1).alias("k")).repartition(5, "k").write.partitionBy("k").text(folder)
    texts = read_texts(spark, folder)
    return texts.join(blob_keys(spark, folder).distinct(), "key", "left_semi").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.split("text", "é")) - 1).cast("bigint").alias("n_records"))


def more_scalars(spark, sf):
    """Ids as text, keys of several parts, the largest of counts, distinct numbers with number words."""
    k, text = F.col("o_orderkey"), F.concat(F.lit("Factor "), F.element_at(F.array(*map(F.lit, ["one", "two", "three"])), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit(" and Factor two"))
    part = F.when(k % 4 > 0, F.col("o_orderstatus"))
    return _t(spark, sf, "orders", "o_orderkey", "o_orderstatus").select(
        X.text_id(k).alias("id"), F.to_json(X.composite_key(k % 7, part)).alias("key"), X.enough([k % 5, k % 3], 4).cast("bigint").alias("enough"),
        TX.distinct_numbered(text, r"\bFactor\s+(one|two|three)\b", 1, {"one": "1", "two": "2", "three": "3"}).cast("bigint").alias("n_factors"), TX.how_many_of(text, ["factor one", "and", "four"]).cast("bigint").alias("n_said"),
    )


QUERIES = {f.__name__: f for f in (stored_lookup, csv_table, text_files, more_scalars, prior_rate_saved, wrapper_rows, trial_features, provenance_check, page_gaps, quarantine_rows, trial_table, trial_report, published_table, text_gaps)}
SQL = {
    "stored_lookup": "WITH k AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_linenumber = 2) SELECT k.o_orderkey, o_orderstatus, o.o_orderkey IS NOT NULL AS found FROM k LEFT JOIN orders o ON o.o_orderkey = k.o_orderkey AND o.o_orderkey % 3 > 0",
    "csv_table": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderpriority || '/' || o_orderstatus AS both FROM orders",
    "text_files": "SELECT count(DISTINCT substr(o_orderpriority, 1, 1)) AS n_files, CAST(sum(length(o_orderstatus || ' é ' || o_orderkey) + 1) AS BIGINT) AS n_chars, count(*) AS n_records FROM orders",
    "more_scalars": """SELECT CAST(o_orderkey AS VARCHAR) AS id, '{"k0":"' || (o_orderkey % 7) || '","k1":"' || CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus ELSE '__missing__' END || '"}' AS key, CAST(greatest(o_orderkey % 5, o_orderkey % 3) >= 4 AS BIGINT) AS enough,
      CAST(CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS n_factors, CAST(CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS n_said FROM orders""",
    "wrapper_rows": WRAPPER_SQL, "trial_features": TRIAL_SQL, "provenance_check": PROVENANCE_SQL, "page_gaps": PAGE_SQL, "quarantine_rows": QUARANTINE_SQL, "trial_table": TABLE_SQL, "trial_report": REPORT_SQL,
    "published_table": "SELECT p_brand, count(*) AS n, max(p_retailprice) AS most, count(*) < 50 AS few, CAST(2 AS BIGINT) AS versions FROM part GROUP BY 1", "text_gaps": GAPS_SQL,
}
