"""Registered queries over the given tables: one or more per operator."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import regex as R, scalars as X
from ..operators import arrays as A, asof, encode, features, flatten, joins, labels, metrics, modeling, sampling, select_one, splits, text as TX
from ..sources import pages
from ..sources.tables import read_table, scratch, upsert
from ..streaming.ingest import append_new, latest, upsert_latest as upsert_stream
from . import trials

ERAS = {"first": "1900-01-01", "second": "1996-03-01", "third": "1997-07-15", "fourth": "1999-01-01", "fifth": "2000-06-30"}
CATEGORIES = {"click": "EX", "view": "AA", "purchase": "ISS"}


def t(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", list(columns) or None)


def day(c: str):
    return F.to_date(c)


def shipped(spark, sf) -> DataFrame:
    """Line items as events: customer, part type, ship date, returned."""
    orders = t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    items = t(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_shipdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderpriority", day("l_shipdate").alias("ship"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def asked(spark, sf) -> DataFrame:
    return t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").withColumn("day", day("o_orderdate")).drop("o_orderdate")


def prior_rate_single(spark, sf):
    out = asof.prior_rate(shipped(spark, sf), asked(spark, sf), ["o_custkey"], "ship", "day", "returned", "customer")
    return out.select("o_orderkey", F.round("customer_prior_rate", 6).alias("rate"), F.col("customer_prior_count").alias("n"))


def prior_rate_pair(spark, sf):
    weak = lambda df: df.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))  # noqa: E731  null parts
    out = asof.prior_rate(weak(shipped(spark, sf)), weak(asked(spark, sf)), ["o_custkey", "o_orderpriority"], "ship", "day", "returned", "pair")
    return out.select("o_orderkey", F.round("pair_prior_rate", 6).alias("rate"), F.col("pair_prior_count").alias("n"))


def prior_frequency(spark, sf):
    orders = asked(spark, sf)
    return asof.frequency(orders, orders, "o_custkey", "day", "day").select("o_orderkey", F.col("o_custkey_frequency").alias("n"))


def rolling_all(spark, sf):
    """Rates by customer and by priority, and the customer's frequency, on one frame."""
    first = t(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_returnflag").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("resolved"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    frame = asked(spark, sf).join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    out = asof.rolling(frame, frame, [["o_custkey"], ["o_orderpriority"]], ["o_custkey"], "resolved", "day", "y")
    return out.select("o_orderkey", F.round("o_custkey_prior_rate", 6).alias("customer_rate"), F.col("o_custkey_prior_count").alias("customer_n"), F.round("o_orderpriority_prior_rate", 6).alias("priority_rate"), F.col("o_orderpriority_prior_count").alias("priority_n"), F.col("o_custkey_frequency").alias("frequency"))


#: Keys of rolling_full: six of rates (two of them of two parts) and two of frequencies.
FULL_RATES = [["o_custkey"], ["o_orderpriority"], ["o_orderstatus"], ["c_mktsegment"], ["c_nationkey", "o_orderpriority"], ["c_mktsegment", "o_orderstatus"]]
FULL_FREQUENCIES = ["o_custkey", "c_nationkey"]


def rolling_full(spark, sf):
    """Six prior rates and two frequencies of each order, as of its day."""
    first = t(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_returnflag").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("resolved"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    orders = t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate").withColumn("day", day("o_orderdate")).drop("o_orderdate")
    people = t(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    frame = orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey", "c_custkey")
    out = asof.rolling(frame, frame, FULL_RATES, FULL_FREQUENCIES, "resolved", "day", "y")
    rates = ["_".join(k) for k in FULL_RATES]
    return out.select("o_orderkey", *(F.round(f"{k}_prior_rate", 6).alias(f"{k}_rate") for k in rates), *(F.col(f"{k}_prior_count").alias(f"{k}_n") for k in rates), *(f"{k}_frequency" for k in FULL_FREQUENCIES))


def unmatched_parts(spark, sf):
    """Parts of which no line has a large quantity."""
    lines = t(spark, sf, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45")
    return joins.unmatched(t(spark, sf, "part", "p_partkey"), lines, "p_partkey", "l_partkey")


def earliest_per_key(spark, sf):
    return select_one.earliest_per_key(t(spark, sf, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def first_per_key(spark, sf):
    df = t(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return select_one.first_per_key(df, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


def pick_cascade(spark, sf):
    docs = t(spark, sf, "documents", "doc_id", "text", "lang", "source").withColumns({"number": F.col("doc_id") % 15, "title": F.substring("text", 1, 40)})
    out = select_one.pick_by_cascade(docs, "source", "number", "title", "text", "lang", "doc_id", r"the|der|que", r"with|und", ["es"])
    return out.select("source", "doc_id", "number")


def terminating_rows(spark, sf):
    orders = t(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate").withColumn("day", day("o_orderdate"))
    out = select_one.terminating_rows(orders, "o_custkey", "o_orderpriority", "o_orderstatus", "day", "o_orderkey", ["1-URGENT", "2-HIGH"], "2-HIGH", ["o"], {"o_orderkey": "first_order", "day": "first_day", "absent": "absent"})
    return out


def label_cascade(spark, sf):
    orders = t(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    said = t(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("flag "), "l_returnflag").alias("said"))
    out = labels.resolve(orders, "o_orderstatus", "o_orderpriority", ["F"], ["X"], ["P"], ("urgent", 1), said, "o_orderkey", "said", [("r", "flag R", 1), ("a", "flag A", 0)], [("n", "N$", 0)])
    return out.select("o_orderkey", "label", "label_source")


def text_verdict(spark, sf):
    docs = t(spark, sf, "documents", "doc_id", "text")
    found = labels.verdict(F.col("text"), [("a", r"the\s+and", 1), ("b", r"der\s+die", 0)], [("c", r"que\s+de", 0), ("d", r"of\s+the", 1)], 400, 1000)
    return docs.select("doc_id", found.alias("label"))


def verdict_agreement(spark, sf):
    docs = t(spark, sf, "documents", "doc_id", "text")
    both = docs.select(labels.by_rules(X.head_of(F.col("text"), 300), [("a", "the", 1), ("b", "die", 0)]).alias("a"), labels.by_rules(X.tail_of(F.col("text"), 300), [("a", "the", 1), ("b", "die", 0)]).alias("b"))
    return labels.agreement(both, "a", "b")


def join_audit(spark, sf):
    orders = t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    first = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("r")).distinct()
    joined = joins.left_with_flag(orders, first, "o_orderkey", "found")
    customers = t(spark, sf, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    joined = joins.left_with_flag(joined, customers.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "building")
    return joins.audited(joined, {"n_rows": F.lit(True), "n_found": F.col("found"), "n_building": F.col("building"), "n_both": F.col("found") & F.col("building"), "n_open": F.col("o_orderstatus") == "O"})


def date_mismatch(spark, sf):
    first = t(spark, sf, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.min(day("l_shipdate")).alias("ship"))
    orders = asked(spark, sf).join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joins.date_mismatches(orders, "day", "ship").select("o_orderkey", "day", "ship")


def gap_list(spark, sf):
    docs = t(spark, sf, "documents", "doc_id", "lang", "source").withColumnRenamed("source", "trial")
    trials = t(spark, sf, "documents", "source", "doc_id").groupBy("source").agg(F.max("doc_id").alias("last")).withColumnRenamed("source", "trial")
    there = t(spark, sf, "labels", "doc_id")
    out = joins.gap_list(docs, trials, there, "trial", ["doc_id", "lang"], (F.col("last") % 2 == 0) & (F.col("lang") != "en"), "doc_id", "doc_id")
    return out.select("doc_id", "trial", "lang")


def gap_texts(spark, sf):
    return joins.missing_keys(joins.filled(t(spark, sf, "documents", "doc_id", "source"), ["doc_id", "source"]), t(spark, sf, "labels", "doc_id"), "doc_id")


def unmatched_keys(spark, sf):
    return joins.unmatched(t(spark, sf, "customer", "c_custkey"), t(spark, sf, "orders", "o_custkey"), "c_custkey", "o_custkey")


def era_lookup(spark, sf):
    return asked(spark, sf).select("o_orderkey", features.era_of(F.col("day"), ERAS).alias("era"))


def era_join(spark, sf):
    """Eras from a table: a year begins with its first order day."""
    eras = asked(spark, sf).groupBy(F.year("day").cast("string").alias("era")).agg(F.min("day").alias("start"))
    return features.with_era(asked(spark, sf).select("o_orderkey", F.date_sub("day", 30).alias("d")), "d", eras).select("o_orderkey", "era")


def user_arrays(spark, sf) -> DataFrame:
    """Events of each user as parallel arrays, and a query date."""
    events = t(spark, sf, "events", "user_id", "ts", "event_type").select("user_id", F.struct("ts", "event_type").alias("e"))
    own = events.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return own.select("user_id", F.transform("e", lambda x: x["event_type"]).alias("codes"), F.transform("e", lambda x: x["ts"].cast("date")).alias("dates"), F.date_add(F.lit("2024-01-05").cast("date"), (F.col("user_id") % 20).cast("int")).alias("t0"))


def category_counts_t0(spark, sf):
    df = user_arrays(spark, sf).withColumn("kept", A.events_before(F.col("codes"), F.col("dates"), F.col("t0"), CATEGORIES, ["BAN"], ["err"]))
    return df.select("user_id", *(A.count_category(F.col("kept"), c).cast("bigint").alias(f"n_{c.lower()}") for c in ("EX", "AA", "ISS", "OTHER")), F.size("kept").cast("bigint").alias("n_events"), A.span_days(F.transform("kept", lambda e: e["date"])).cast("bigint").alias("span"))


def recency_t0(spark, sf):
    items = t(spark, sf, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.collect_list(day("l_shipdate")).alias("dates"))
    df = asked(spark, sf).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("t0", F.date_add("day", 60))
    kept = A.assignments_before(F.col("dates"), F.col("dates"), F.transform("dates", lambda x: F.array(x.cast("string"))), F.col("t0"))
    df = df.withColumn("kept", F.transform(kept, lambda a: a["date"]))
    return df.select("o_orderkey", A.recency_days(F.col("kept"), F.col("t0")).cast("bigint").alias("recency"), A.none_flag(F.col("kept")).cast("bigint").alias("none"), A.length_of(F.col("kept")).cast("bigint").alias("n"))


def distinct_names(spark, sf):
    items = t(spark, sf, "lineitem", "l_orderkey", "l_suppkey").join(t(spark, sf, "supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    own = items.groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("s_name"), F.upper(F.regexp_replace("s_name", "#", " ")))).alias("names"))
    return own.select("l_orderkey", A.distinct_names(F.col("names")).cast("bigint").alias("n"))


def array_profile(spark, sf):
    # counted first, so that a brand's array holds its types, not its parts
    counted = t(spark, sf, "part", "p_brand", "p_type").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    own = counted.groupBy("p_brand").agg(F.sort_array(F.collect_list("p_type")).alias("types"), F.sum("n").alias("n"))
    a = F.col("types")
    return own.select("p_brand", F.when(A.length_of(a) > 0, F.col("n")).alias("n"), A.distinct_prefixes(a).cast("bigint").alias("prefixes"), A.first_initial(a).alias("initial"), A.all_equal_bucket(a, "STANDARD", "one", "many").alias("bucket"))


def text_features(spark, sf):
    docs = t(spark, sf, "documents", "doc_id", "text")
    c = F.col("text")
    return docs.select("doc_id", R.distinct_captures(c, r"(th[a-z]+) of|of (th[a-z]+)", 2).cast("bigint").alias("n_distinct"), R.count_matches(c, r"[0-9]+\.[0-9]+").cast("bigint").alias("n_numbers"), TX.any_of(c, ["the.{0,20}and", "que.{0,20}de"]).cast("bigint").alias("has_any"), TX.gated(c, ["token", "Token"], R.count_matches(c, "[0-9a-f]{8,}")).cast("bigint").alias("n_gated"), F.length(c).cast("bigint").alias("n_chars"))


def usable_text(spark, sf):
    return TX.usable_report(t(spark, sf, "documents", "text"), "text", 1000)


def scalar_functions(spark, sf):
    s = t(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = F.col("s_name")
    return s.select("s_suppkey", X.normal_name(n).alias("normal"), X.normal_doctype(F.concat(F.lit("  A \t"), n)).alias("doctype"), X.leading_number(F.substring(n, -4, 4)).alias("lead"), X.first_filled(F.when(F.col("s_suppkey") % 2 == 0, n), F.lit("other")).alias("filled"), X.year_bucket(F.when(F.col("s_suppkey") % 3 > 0, F.lit("2021-05-04"))).alias("bucket"), X.yes_no(F.when(F.col("s_suppkey") % 2 == 0, " y").otherwise("N")).alias("flag"), X.has_prefix(n, ["Supplier#00000000"]).alias("low"), X.mapped(F.col("s_nationkey").cast("string"), {"1": "one", "2": "two"}, "many").alias("mapped"))


def time_split(spark, sf):
    train, test = splits.time_split(asked(spark, sf), "day", "1998-01-01")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return count(train, "train").unionByName(count(test, "test"))


def mature_filter(spark, sf):
    return splits.mature(asked(spark, sf), "day", "2000-01-01", 540).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def date_safe_folds(spark, sf):
    return splits.fold_table(asked(spark, sf), "day", 5)


def one_hot(spark, sf):
    customers = t(spark, sf, "customer", "c_custkey", "c_mktsegment")
    known = customers.where("c_mktsegment <> 'BUILDING'")
    return encode.one_hot(customers, "c_mktsegment", encode.one_hot_levels(known, "c_mktsegment")).drop("c_mktsegment")


def median_impute(spark, sf):
    parts = t(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").withColumn("p_size", F.when(F.col("p_partkey") % 5 > 0, F.col("p_size")))
    return encode.impute(parts, encode.medians(parts, ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"])


def balanced_weights(spark, sf):
    orders = t(spark, sf, "orders", "o_orderstatus").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    weights = encode.class_weights(orders, "y")
    return encode.weighted(orders, "y", weights).groupBy("y").agg(F.round(F.max("weight"), 6).alias("weight"), F.count("*").alias("n"))


def scored(spark, sf) -> DataFrame:
    """Labels with a score made of the text's length."""
    docs = t(spark, sf, "documents", "doc_id", "n_chars")
    return t(spark, sf, "labels", "doc_id", "quality").join(docs, "doc_id").select("quality", (F.floor(F.col("n_chars") / 50) * 50 / (F.floor(F.col("n_chars") / 50) * 50 + 2000.0)).alias("score")).withColumn("said", (F.col("score") >= 0.5).cast("int"))


def roc_auc(spark, sf):
    return metrics.roc_auc(scored(spark, sf), "quality", "score").select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


def avg_precision_f1(spark, sf):
    s = scored(spark, sf)
    return metrics.average_precision(s, "quality", "score").select(F.round("average_precision", 6).alias("average_precision")).crossJoin(metrics.class_report(s, "quality", "said").where("class = '1'").select(F.round("f1", 6).alias("f1")))


def class_report(spark, sf):
    return metrics.class_report(scored(spark, sf), "quality", "said").select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")), "support")


def calibration(spark, sf):
    return metrics.calibration(scored(spark, sf), "quality", "score").select("bin", F.round("mean_score", 6).alias("mean_score"), F.round("fraction_positive", 6).alias("fraction_positive"), "n")


def roc_points(spark, sf):
    return metrics.roc_points(scored(spark, sf), "quality", "score").select(F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def confusion(spark, sf):
    return metrics.confusion(scored(spark, sf), "quality", "said")


def stratified_sample(spark, sf):
    return sampling.stratified(t(spark, sf, "documents", "doc_id", "lang", "source"), [F.col("lang"), F.col("source")], "doc_id", 150, 7).select("doc_id", "stratum", "turn")


def sample_report(spark, sf):
    return sampling.sample_report(t(spark, sf, "documents", "text"), "text")


def upsert_latest(spark, sf):
    return latest(t(spark, sf, "events", "user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def flatten_paths(spark, sf):
    return flatten.json_paths(t(spark, sf, "events", "event_id", "props"), "props", {"k": "k", "none": "a.b"}, ["event_id"])


def flatten_structs(spark, sf):
    orders = t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(F.struct(F.col("o_orderkey").alias("number"), F.struct(F.col("o_orderstatus").alias("status")).alias("meta")).alias("order"), "o_custkey")
    return flatten.by_name(orders, {"orders": {"id": "order.number", "status": "order.meta.status", "customer": "o_custkey", "none": "order.meta.other.thing"}}, "orders")


def bag(spark, sf) -> DataFrame:
    """Line items of each order as a bag of structs."""
    items = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.array(F.struct(F.col("l_suppkey").cast("string").alias("name"))).alias("names")))).alias("bag"))


def polymorphic_bag(spark, sf):
    raw = t(spark, sf, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.to_json(F.array("p_brand", F.lit(" "), "p_type"))).when(F.col("p_partkey") % 4 == 1, F.to_json(F.array(F.struct(F.lit("").alias("a"), F.col("p_type").alias("b"))))).when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).alias("raw"))
    return raw.select("p_partkey", F.array_join(flatten.polymorphic_list(F.col("raw")), "|").alias("items"))


def parallel_bag(spark, sf):
    own = bag(spark, sf).select("l_orderkey", *flatten.parallel_arrays(F.col("bag"), {"lines": "l_linenumber", "flags": "l_returnflag"}), flatten.nested_names(F.col("bag"), "names", "name").alias("names"), flatten.distinct_codes(F.col("bag"), "names", "name").alias("codes"), flatten.bag_size(F.col("bag")).cast("bigint").alias("n"))
    return own.select("l_orderkey", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join("flags", ",").alias("flags"), F.array_join(F.flatten("names"), ",").alias("names"), F.array_join("codes", ",").alias("codes"), "n")


def packed(spark, sf) -> DataFrame:
    """Conversations packed in pages, with the count a page announces."""
    talks = t(spark, sf, "conversations", "conv_id", "turn", "role")
    return talks.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("bag"), (F.max("turn") + 1).alias("count"))


def explode_pages(spark, sf):
    return pages.records(packed(spark, sf), "bag", ["conv_id"])


def page_completeness(spark, sf):
    return pages.completeness(packed(spark, sf).withColumn("bucket", F.col("conv_id") % 7), "bucket", "count", "bag").select("bucket", "announced", "held", "complete")


def constant_filter(spark, sf):
    return pages.only(t(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), o_orderstatus="O", o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey")


def search_filters(spark, sf):
    return pages.search(t(spark, sf, "orders"), text="urg", text_columns=["o_orderpriority"], filters={"o_orderstatus": ["O", "F"]}, ranges={"o_totalprice": (1000.0, None)}, fields=["o_orderkey", "o_orderstatus"], sort=[("o_totalprice", "desc"), ("o_orderkey", "asc")], offset=20, limit=50)


def facet_counts(spark, sf):
    return pages.facets(t(spark, sf, "orders", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


def distinct_keys(spark, sf):
    return select_one.distinct_keys(t(spark, sf, "documents", "source"), "source")


def feature_matrix(spark, sf):
    """Scalar features of orders, admissible columns only."""
    o = t(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    first = t(spark, sf, "lineitem", "l_orderkey", "l_shipdate").where(F.col("l_shipdate") < "1998-01-01").groupBy("l_orderkey").agg(F.min(day("l_shipdate")).alias("ship"))
    df = o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("day", day("o_orderdate"))
    gap = X.days_between(F.col("ship"), F.col("day"))
    df = df.withColumns({"year": F.year("day"), "month": F.month("day"), "level": X.leading_number(F.col("o_orderpriority"), 1), "gap": gap, "gap_missing": X.missing_flag(gap), "era": features.era_of(F.col("day"), ERAS)})
    return features.admissible(df, ["o_orderkey", "year", "month", "level", "gap", "gap_missing", "era"])


def model_frame(spark, sf) -> DataFrame:
    docs = t(spark, sf, "documents", "doc_id", "lang", "n_chars", "source")
    return t(spark, sf, "labels", "doc_id", "quality").join(docs, "doc_id").select("doc_id", "quality", "lang", F.col("n_chars").cast("double").alias("n_chars"), (F.length("source") * 1.0).alias("source_len"), F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("day"))


SMALL_FOREST = lambda total=0.0: modeling.random_forest(10, 5)
SMALL_LOGISTIC = lambda total: modeling.logistic(1.0, 0.0, max(total, 1.0))


def _predicted(estimator, spark, sf):
    df = model_frame(spark, sf)
    train, test = splits.time_split(df, "day", "2020-01-01")
    fitted = modeling.fit(train, "quality", ["lang"], ["n_chars", "source_len"], estimator)
    return fitted.transform(test).select("doc_id", F.round("score", 6).alias("score"), F.col("prediction").cast("int").alias("prediction"))


train_rf = partial(_predicted, SMALL_FOREST)
train_lr = partial(_predicted, SMALL_LOGISTIC)


def forward_cv(spark, sf):
    rows = modeling.fold_scores(model_frame(spark, sf), "quality", "day", ["lang"], ["n_chars"], SMALL_LOGISTIC, 3)
    return spark.createDataFrame([(r["fold"], r["auc"], r["average_precision"], r["f1"]) for r in rows], "fold int, auc double, average_precision double, f1 double")


def grid_search(spark, sf):
    factory = lambda c: lambda total: modeling.logistic(c, 0.0, max(total, 1.0))
    return modeling.grid_search(model_frame(spark, sf), "quality", "day", ["lang"], ["n_chars"], factory, {"c": [0.1, 1.0]}, 2)


def importances(spark, sf):
    return modeling.importances(modeling.fit(model_frame(spark, sf), "quality", ["lang"], ["n_chars", "source_len"], SMALL_FOREST), spark)


def score_rows(spark, sf):
    df = model_frame(spark, sf)
    fitted = modeling.fit(df, "quality", ["lang"], ["n_chars"], SMALL_LOGISTIC)
    return modeling.score(df, fitted, "doc_id", "m1", "f1").drop("predicted_at")


def ablation(spark, sf):
    return modeling.without_suffix(model_frame(spark, sf).withColumn("x_prior_rate", F.lit(1.0)), ["_prior_rate", "_len"]).drop("day")


def compare_estimators(spark, sf):
    return modeling.compare(model_frame(spark, sf), "quality", "day", ["lang"], ["n_chars"], {"forest": SMALL_FOREST, "logistic": SMALL_LOGISTIC}, 2)


def candidate_scan(spark, sf):
    orders = t(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return select_one.candidates(orders, "o_orderpriority", "High", "o_orderstatus", "o_orderkey", "o_orderdate").groupBy("year").agg(F.count("*").alias("n"))


def typed_view(spark, sf):
    return flatten.typed(t(spark, sf, "events", "event_id", "props"), "props", "k bigint, other struct<x string>").select("event_id", "record.k", F.col("record.other.x").alias("x"))


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_ingest(spark, sf):
    """Events through the file stream into a table; equal to the batch read."""
    folder = scratch(spark, "ingest")
    flat = flatten.by_path(_event_stream(spark, sf), {"event_id": "event_id", "kind": "event_type", "none": "a.b"})
    append_new(flat, f"{folder}/table", f"{folder}/mark")
    return spark.read.parquet(f"{folder}/table")


def stream_upsert(spark, sf):
    """Newest event of each user, kept by the stream."""
    folder = scratch(spark, "upsert")
    last = upsert_stream(spark, _event_stream(spark, sf).select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], f"{folder}/versions", f"{folder}/mark")
    return last.select("user_id", "event_id", "event_type")


def contract_rows(spark, sf):
    """Documents as records of a contract: fields under other names, some without a required one."""
    docs = t(spark, sf, "documents", "doc_id", "lang", "source", "n_chars").withColumns({"language": F.when(F.col("doc_id") % 5 > 0, F.col("lang")), "size": F.when(F.col("doc_id") % 7 > 0, F.col("n_chars").cast("string")).otherwise("many")}).drop("lang", "n_chars")
    fields = {"trial": ("bigint", ["doc_id"]), "kind": ("string", ["lang", "language"]), "length": ("bigint", ["size"]), "origin": ("string", ["source"]), "remark": ("string", ["note"])}
    good, bad = flatten.contract(docs, fields, ["trial", "kind", "length"])
    return good.withColumn("missing", F.lit("")).unionByName(bad)


def features_labels(spark, sf):
    """Length features of the labelled documents with their labels."""
    docs = t(spark, sf, "documents", "doc_id", "lang", "n_chars", "source")
    return joins.features_with_labels(docs, t(spark, sf, "labels", "doc_id", "quality", "toxic"), "doc_id", ["quality", "toxic"])


def pending_keys(spark, sf):
    """Documents without a label, or with one that lacks its shape."""
    labels = t(spark, sf, "labels", "doc_id", "quality", "toxic").withColumn("toxic", F.when(F.col("doc_id") % 3 > 0, F.col("toxic")))
    return joins.pending(t(spark, sf, "documents", "doc_id"), labels, "doc_id", ["quality", "toxic"])


def numeric_totals(spark, sf):
    """Sums of the numeric columns, found by type."""
    part = t(spark, sf, "part")
    return part.agg(*(F.round(F.sum(F.col(c).cast("double")), 3).alias(c) for c in encode.numeric_columns(part, ["p_retailprice"])))


def resolved_dates(spark, sf):
    """The first date that can be read, of three texts."""
    items = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    texts = F.when(F.col("l_linenumber") == 1, F.lit("n/a")).when(F.col("l_linenumber") == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
    return items.select("l_orderkey", "l_linenumber", labels.resolution_date(texts, F.when(F.col("l_linenumber") < 4, F.date_format("l_shipdate", "yyyy-MM-dd")), F.lit("1999-12-31")).alias("resolved"))


def work_list(spark, sf):
    """The first hundred customers with an urgent order."""
    urgent = t(spark, sf, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority like '1%'").select("o_custkey").distinct()
    return select_one.work_list(urgent, "o_custkey", 100)


def filled_ids(spark, sf):
    """Texts of the turns of conversations, without the empty ones."""
    turns = t(spark, sf, "conversations", "conv_id", "turn", "role").select("conv_id", F.struct("turn", F.when(F.col("turn") % 3 > 0, F.col("role")).otherwise("").alias("id")).alias("x"))
    bags = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("bag"))
    return bags.select("conv_id", F.array_join(flatten.filled_ids(F.col("bag"), "id"), ",").alias("ids"), flatten.bag_size(F.col("bag")).cast("bigint").alias("n"))


def upsert_rows(spark, sf):
    """Customers, those of one segment replaced and some added."""
    people = t(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    rows = people.where("c_mktsegment = 'BUILDING'").withColumn("c_nationkey", F.lit(99)).unionByName(people.where("c_nationkey = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000))
    return upsert(people, rows, "c_custkey")


def ablation_refit(spark, sf):
    """Fold scores with and without the columns of a suffix."""
    rows = modeling.ablation(model_frame(spark, sf).withColumn("chars_prior_rate", F.col("n_chars") / 1000), "quality", "day", ["lang"], ["n_chars", "chars_prior_rate"], ["_prior_rate"], SMALL_LOGISTIC, 2)
    return spark.createDataFrame([(r["columns"], r["fold"], r["auc"]) for r in rows], "columns string, fold int, auc double")


NAMES = """contract_rows features_labels pending_keys numeric_totals resolved_dates work_list filled_ids upsert_rows ablation_refit prior_rate_single prior_rate_pair prior_frequency rolling_all rolling_full unmatched_parts earliest_per_key first_per_key pick_cascade terminating_rows label_cascade
text_verdict verdict_agreement join_audit date_mismatch gap_list gap_texts unmatched_keys era_lookup era_join category_counts_t0 recency_t0 distinct_names
array_profile text_features usable_text scalar_functions time_split mature_filter date_safe_folds one_hot median_impute balanced_weights roc_auc
avg_precision_f1 class_report calibration roc_points confusion stratified_sample sample_report upsert_latest flatten_paths flatten_structs polymorphic_bag
parallel_bag explode_pages page_completeness constant_filter search_filters facet_counts distinct_keys feature_matrix train_rf train_lr forward_cv
grid_search importances score_rows ablation compare_estimators candidate_scan typed_view stream_ingest stream_upsert""".split()
QUERIES = {name: globals()[name] for name in NAMES}
QUERIES |= trials.QUERIES
NAMES += list(trials.QUERIES)
