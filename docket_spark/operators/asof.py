"""Strict as-of aggregates: what was known before a row's query date, by key.

Events and query dates are brought to (key, date) grain first, so that a hot key weighs as many rows as it has dates;
a range window then sums what lies strictly before.  Times finer than days are summed in two levels, by hour and within
the hour, so that no task sorts all times of a hot key.  No inequality join and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import MISSING
from ..sources.tables import scratch


def _tick(df: DataFrame, column: str) -> Column:
    """Integer time of a date (days) or timestamp (microseconds)."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_date(column).cast("bigint") if kind == "date" else F.unix_micros(F.col(column).cast("timestamp"))


def _keyed(df: DataFrame, keys: list[str], sentinel: bool) -> list[Column]:
    return [(F.coalesce(F.col(k).cast("string"), F.lit(MISSING)) if sentinel else F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]


def before(events: DataFrame, queries: DataFrame, keys: list[str], event_date: str, query_date: str, value: str | None = None) -> DataFrame:
    """(__k0.., __t, __n, __s): events and the sum of ``value`` strictly before each query date of a key.

    Events without a date are left out.  With several keys, a null part is a value of its own.
    """
    many = len(keys) > 1
    e = events.select(*_keyed(events, keys, many), _tick(events, event_date).alias("__t"), F.lit(1).alias("__n"), (F.col(value).cast("double") if value else F.lit(0.0)).alias("__s"))
    q = queries.select(*_keyed(queries, keys, many), _tick(queries, query_date).alias("__t"), F.lit(0).alias("__n"), F.lit(0.0).alias("__s"))
    names = [f"__k{i}" for i in range(len(keys))]
    grain = e.unionByName(q).where("__t is not null").groupBy(*names, "__t").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s"))
    if queries.schema[query_date].dataType.typeName() == events.schema[event_date].dataType.typeName() == "date":
        return _summed(grain, names, "__t")
    grain = grain.withColumn("__hour", F.floor(F.col("__t") / 3_600_000_000).cast("bigint"))
    hours = _summed(grain.groupBy(*names, "__hour").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s")), names, "__hour")
    inner = _summed(grain, [*names, "__hour"], "__t")
    on = inner["__hour"] == hours["__hour"]
    for k in names:
        on = on & inner[k].eqNullSafe(hours[k])
    return inner.join(hours, on).select(*(inner[k] for k in [*names, "__t"]), (inner["__n"] + hours["__n"]).alias("__n"), (inner["__s"] + hours["__s"]).alias("__s"))


def _summed(grain: DataFrame, names: list[str], order: str) -> DataFrame:
    """__n and __s of what lies strictly before in the order, by names."""
    w = (Window.partitionBy(*names) if names else Window).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return grain.select(*names, order, F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("bigint").alias("__n"), F.coalesce(F.sum("__s").over(w), F.lit(0.0)).alias("__s"))


def _attach(queries: DataFrame, known: DataFrame, keys: list[str], query_date: str) -> DataFrame:
    """Queries with __n and __s of their (key, date); null where there is none."""
    own = queries.select("*", *[c.alias(f"__q{i}") for i, c in enumerate(_keyed(queries, keys, len(keys) > 1))], _tick(queries, query_date).alias("__qt"))
    on = own["__qt"] == known["__t"]
    for i in range(len(keys)):
        on = on & own[f"__q{i}"].eqNullSafe(known[f"__k{i}"])
    return own.join(known, on, "left").select(*queries.columns, "__n", "__s")


def _plain(keys: list[str]) -> str:
    return "_".join(keys)


def prior_rate(events: DataFrame, queries: DataFrame, keys: list[str], event_date: str, query_date: str, outcome: str, prefix: str | None = None, null_key: str = "group", smoothing: float = 0.0) -> DataFrame:
    """Adds <prefix>_prior_rate and <prefix>_prior_count.

    The rate is the mean outcome of the key's events strictly before the query date; where there are none, that of all
    events before it; where there are none either, or the query date is null, the mean of all dated events.  With
    ``smoothing`` a the rate is (sum + a * fallback) / (count + a).  ``null_key="zero"`` gives null keys no events.
    """
    dated = events.where(F.col(event_date).isNotNull())
    out = _with_fallback(dated, queries, event_date, query_date, outcome)
    return _with_rate(dated, queries, out, keys, event_date, query_date, outcome, prefix or _plain(keys), null_key, smoothing).drop("__fallback")


def _with_fallback(dated: DataFrame, queries: DataFrame, event_date: str, query_date: str, outcome: str) -> DataFrame:
    """Adds __fallback: the mean outcome of all events before the query date, or else of all events."""
    # Date grain: as many rows as there are dates, so the window without a key is small and may be broadcast.
    everywhere = before(dated, queries, [], event_date, query_date, outcome).where("__n > 0")
    mean = dated.agg(F.avg(F.col(outcome).cast("double")).alias("__mean"))
    out = _attach(queries, everywhere, [], query_date).crossJoin(F.broadcast(mean))
    return out.select(*queries.columns, F.coalesce(F.try_divide("__s", "__n"), F.col("__mean")).alias("__fallback"))


def _with_rate(dated, queries, out, keys, event_date, query_date, outcome, prefix, null_key="group", smoothing=0.0) -> DataFrame:
    """Adds rate and count of a key to ``out``, which holds the rows of ``queries`` and __fallback."""
    known = dated.where(F.col(keys[0]).isNotNull()) if null_key == "zero" and len(keys) == 1 else dated
    found = _attach(out, before(known, queries, keys, event_date, query_date, outcome), keys, query_date)
    n = F.coalesce("__n", F.lit(0))
    rate = F.when(n > 0, (F.col("__s") + smoothing * F.col("__fallback")) / (n + smoothing)).otherwise(F.col("__fallback"))
    return found.select(*out.columns, rate.alias(f"{prefix}_prior_rate"), n.cast("bigint").alias(f"{prefix}_prior_count"))


def frequency(events: DataFrame, queries: DataFrame, key: str, event_date: str, query_date: str, null_key: str = "zero", name: str | None = None) -> DataFrame:
    """Adds <key>_frequency: events of the key strictly before the query date; 0 for a null date, and for a null key if ``zero``."""
    return _with_frequency(events, queries, queries, key, event_date, query_date, null_key, name)


def _with_frequency(events, queries, out, key, event_date, query_date, null_key="zero", name=None) -> DataFrame:
    known = before(events.where(F.col(event_date).isNotNull()), queries, [key], event_date, query_date)
    n = F.coalesce("__n", F.lit(0))
    if null_key == "zero":
        n = F.when(F.col(key).isNull(), 0).otherwise(n)
    return _attach(out, known, [key], query_date).select(*out.columns, n.cast("bigint").alias(name or f"{key}_frequency"))


def rolling(events: DataFrame, queries: DataFrame, rate_keys: list[list[str]], frequency_keys: list[str], resolved: str, query_date: str, outcome: str) -> DataFrame:
    """All prior rates and frequencies: rates by resolution date, frequencies by query date of the events.

    With dates, all keys go together: the frames are brought to their narrow columns and stored once under
    ``spark.checkpoint.dir``, each row is laid out by (number of the key, key, date), and one aggregate, one window, one
    join and one regrouping serve every key.  Times finer than days go key by key.
    """
    kinds = {events.schema[resolved].dataType.typeName(), events.schema[query_date].dataType.typeName(), queries.schema[query_date].dataType.typeName()}
    if kinds != {"date"}:
        return _rolling_by_key(events, queries, rate_keys, frequency_keys, resolved, query_date, outcome)
    spark = queries.sparkSession
    folder = scratch(spark, "rolling")
    queries.write.parquet(f"{folder}/queries")
    asked = spark.read.schema(queries.schema).parquet(f"{folder}/queries").withColumn("__row", F.monotonically_increasing_id())
    if events is queries:
        given = spark.read.schema(queries.schema).parquet(f"{folder}/queries")
    else:
        given = events.select(*dict.fromkeys([*(k for keys in rate_keys for k in keys), *frequency_keys, resolved, query_date, outcome]))
    all_keys = [*rate_keys, *([k] for k in frequency_keys)]

    def laid(no: int, key: Column, t: Column, value: Column) -> Column:
        return F.struct(F.lit(no).alias("no"), key.alias("key"), t.alias("t"), value.alias("s"))

    def spread(of_events: bool) -> Column:
        """One struct for each key that the row has a date for; number 0 is the key of all."""
        value = F.col(outcome).cast("double") if of_events else F.lit(0.0)
        day = F.unix_date(resolved if of_events else query_date)
        out = [laid(0, F.lit(""), day, value), *(laid(i + 1, _told(keys), day, value) for i, keys in enumerate(rate_keys))]
        out += [laid(len(rate_keys) + 1 + i, _told([k]), F.unix_date(query_date), F.lit(0.0)) for i, k in enumerate(frequency_keys)]
        return F.inline(F.filter(F.array(*out), lambda x: x["t"].isNotNull()))

    places = asked.select("__row", spread(False)).select("__row", "no", "key", "t")
    grain = given.select(spread(True)).withColumn("n", F.lit(1)).unionByName(places.select("no", "key", "t", F.lit(0.0).alias("s"), F.lit(0).alias("n"))).groupBy("no", "key", "t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    group = Window.partitionBy("no", "key")
    w = group.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    all_rows = lambda c: F.when(F.col("no") == 0, F.sum(c).over(group))
    known = grain.select("no", "key", "t", F.sum("n").over(w).alias("bn"), F.sum("s").over(w).alias("bs"), all_rows("n").alias("all_n"), all_rows("s").alias("all_s"))
    known.write.parquet(f"{folder}/known")
    known = spark.read.parquet(f"{folder}/known")
    found = places.join(known, ["no", "key", "t"]).groupBy("__row").agg(*(F.max(F.when(F.col("no") == i, F.struct("bn", "bs"))).alias(f"__x{i}") for i in range(len(all_keys) + 1)))
    mean = known.where("no = 0").agg(F.try_divide(F.max("all_s"), F.max("all_n")).alias("__mean"))
    out = asked.join(found, "__row", "left").crossJoin(F.broadcast(mean))
    fallback = F.coalesce(F.try_divide("__x0.bs", F.when(F.col("__x0.bn") > 0, F.col("__x0.bn"))), F.col("__mean"))
    made = []
    for i, keys in enumerate(rate_keys):
        n = F.coalesce(F.col(f"__x{i + 1}.bn"), F.lit(0))
        made += [F.when(n > 0, F.col(f"__x{i + 1}.bs") / n).otherwise(fallback).alias(f"{_plain(keys)}_prior_rate"), n.cast("bigint").alias(f"{_plain(keys)}_prior_count")]
    for i, key in enumerate(frequency_keys):
        n = F.when(F.col(key).isNull(), 0).otherwise(F.coalesce(F.col(f"__x{len(rate_keys) + 1 + i}.bn"), F.lit(0)))
        made.append(n.cast("bigint").alias(f"{key}_frequency"))
    return out.select(*queries.columns, *made)


def _told(keys: list[str]) -> Column:
    """A text that tells keys apart, null from values too; of several parts a null one is a value of its own."""
    if len(keys) == 1:
        return F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit(""))
    parts = [F.coalesce(F.col(k).cast("string"), F.lit(MISSING)) for k in keys]
    return F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit("="), p)))


def _rolling_by_key(events: DataFrame, queries: DataFrame, rate_keys: list[list[str]], frequency_keys: list[str], resolved: str, query_date: str, outcome: str) -> DataFrame:
    """Each key's sums come from the given frames, never from the frame that grows, so the plan has two scans of each per key."""
    dated = events.where(F.col(resolved).isNotNull())
    out = _with_fallback(dated, queries, resolved, query_date, outcome)
    for keys in rate_keys:
        out = _with_rate(dated, queries, out, keys, resolved, query_date, outcome, _plain(keys))
    for key in frequency_keys:
        out = _with_frequency(events, queries, out, key, query_date, query_date)
    return out.drop("__fallback")
