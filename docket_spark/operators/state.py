"""Prior rates kept as a table: fitted once, extended by late events, joined with queries without moving the table.

A row holds a key's events of one year: how many there were before the year and their sum, and the totals of each day in
it.  Another row of the key (year OPEN) tells what there is in all, for queries after its last year.  The table is
partitioned by a hash of the key, so that late events rewrite the partitions of their keys alone, and bucketed by (key,
year), so that a join with query dates shuffles these only.  All events together are kept under a key of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import MISSING
from ..sources.tables import scratch
from .asof import _plain

OPEN = 9999
DAY = "struct<day:int,n:bigint,s:double>"


class RollingState:
    """Prior rates by ``keys``; ``table`` names a catalog table that fit() makes and add() extends."""

    def __init__(self, spark: SparkSession, table: str, keys: list[str], event_date: str, outcome: str, parts: int = 16, buckets: int = 16):
        self.spark, self.table, self.keys, self.event_date, self.outcome, self.parts, self.buckets = spark, table, keys, event_date, outcome, parts, buckets
        self.names = [f"__k{i}" for i in range(len(keys))]

    @classmethod
    def fit(cls, events: DataFrame, keys: list[str], event_date: str, outcome: str, table: str | None = None, path: str | None = None, parts: int = 16, buckets: int = 16) -> "RollingState":
        """Makes the table from events; those without a date are left out.  Null parts of a key are a value of their own."""
        state = cls(events.sparkSession, table or f"rolling_{uuid.uuid4().hex}", keys, event_date, outcome, parts, buckets)
        rows = state._rows(state._grain(events)).unionByName(state._rows(state._everything(events)))
        rows.write.partitionBy("part").bucketBy(buckets, *state.names, "year").sortBy(*state.names, "year").option("path", path or scratch(state.spark, state.table)).saveAsTable(state.table)
        return state

    def _dated(self, events: DataFrame) -> DataFrame:
        kind = events.schema[self.event_date].dataType.typeName()
        if kind != "date":
            raise ValueError(f"{self.event_date} must be a date, is {kind}")
        return events.where(F.col(self.event_date).isNotNull())

    def _keys(self) -> list[Column]:
        return [F.coalesce(F.col(k).cast("string"), F.lit(MISSING)).alias(n) for k, n in zip(self.keys, self.names)]

    def _part(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")

    def _totals(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.names, "part", "day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def _grain(self, events: DataFrame) -> DataFrame:
        """Events by key and day."""
        e = self._dated(events).select(*self._keys(), F.unix_date(self.event_date).alias("day"), F.lit(1).cast("bigint").alias("n"), F.col(self.outcome).cast("double").alias("s"))
        return self._totals(e.withColumn("part", self._part(*map(F.col, self.names))))

    def _everything(self, events: DataFrame) -> DataFrame:
        """Events by day, under the key of all."""
        e = self._dated(events).select(*(F.lit("").alias(n) for n in self.names), F.unix_date(self.event_date).alias("day"), F.lit(1).cast("bigint").alias("n"), F.col(self.outcome).cast("double").alias("s"))
        return self._totals(e.withColumn("part", F.lit(-1)))

    def _rows(self, grain: DataFrame) -> DataFrame:
        """Rows of the table: each year from a key's first to its last, and the open one.  A key has as many as years."""
        by = [*self.names, "part"]
        years = grain.withColumn("year", F.year(F.date_from_unix_date("day"))).groupBy(*by, "year").agg(F.array_sort(F.collect_list(F.struct("day", "n", "s"))).alias("days"), F.sum("n").alias("__n"), F.sum("s").alias("__s"))
        w = Window.partitionBy(*by).orderBy("year")
        # years without events stand between years with some
        spread = years.withColumn("__next", F.lead("year").over(w)).withColumn("__upto", F.coalesce(F.col("__next") - 1, F.col("year")))
        known = spread.withColumns({"__bn": F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")), "__bs": F.coalesce(F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
        last = F.col("__next").isNull()
        each = F.transform(F.sequence(F.col("year"), F.col("__upto")), lambda y: F.struct(
            y.alias("year"), F.when(y == F.col("year"), F.col("__bn")).otherwise(F.col("__bn") + F.col("__n")).alias("before_n"), F.when(y == F.col("year"), F.col("__bs")).otherwise(F.col("__bs") + F.col("__s")).alias("before_s"),
            F.when(y == F.col("year"), F.col("days")).otherwise(F.array().cast(f"array<{DAY}>")).alias("days"), F.lit(None).cast("int").alias("last")))
        end = F.array(F.struct(F.lit(OPEN).alias("year"), (F.col("__bn") + F.col("__n")).alias("before_n"), (F.col("__bs") + F.col("__s")).alias("before_s"), F.array().cast(f"array<{DAY}>").alias("days"), F.col("year").alias("last")))
        return known.select(*by, F.explode(F.when(last, F.concat(each, end)).otherwise(each)).alias("x")).select(*self.names, "x.*", "part")

    def add(self, events: DataFrame) -> list[int]:
        """Late events: rewrites the partitions of their keys, and there only rows of these keys; returns the partitions.

        Of a touched key, years before the first late one come out as they were.  What is rewritten is first stored, then
        put in place in one commit of the table's partitions.
        """
        late = self._grain(events).unionByName(self._everything(events))
        folder = scratch(self.spark, "late")
        late.write.parquet(f"{folder}/late")
        late = self.spark.read.parquet(f"{folder}/late")
        touched = sorted(r["part"] for r in late.select("part").distinct().collect())  # at most ``parts`` and one
        if not touched:
            return []
        held = self.spark.table(self.table).where(F.col("part").isin(touched))
        by = [*self.names, "part"]
        keys = late.select(*by).distinct()
        changed = held.join(keys, by, "left_semi")
        old = changed.select(*self.names, "part", F.explode("days").alias("d")).select(*self.names, "part", "d.*")
        whole = self._rows(self._totals(old.unionByName(late))).unionByName(held.join(keys, by, "left_anti"))
        whole.write.parquet(f"{folder}/rows")
        columns = self.spark.table(self.table).columns
        self.spark.read.parquet(f"{folder}/rows").select(*columns).write.option("partitionOverwriteMode", "dynamic").insertInto(self.table, overwrite=True)
        return touched

    def _before(self, dates: DataFrame, everything: bool = False) -> DataFrame:
        """(keys, day) distinct -> with n and s of the key's events strictly before the day; keys without any have no row."""
        both = dates.select("*", F.explode(F.array(F.year(F.date_from_unix_date("day")), F.lit(OPEN))).alias("year"))
        held = self.spark.table(self.table).where("part < 0" if everything else "part >= 0")
        found = both.join(held.drop("part"), [*self.names, "year"])
        inside = F.aggregate(F.filter("days", lambda d: d["day"] < F.col("day")), F.struct(F.col("before_n").alias("n"), F.col("before_s").alias("s")), lambda a, d: F.struct((a["n"] + d["n"]).alias("n"), (a["s"] + d["s"]).alias("s")))
        # the open row counts for days after the key's last year only
        use = (F.col("year") != OPEN) | (F.year(F.date_from_unix_date("day")) > F.col("last"))
        return found.where(use).select(*self.names, "day", inside.alias("x")).where("x.n > 0").select(*self.names, "day", F.col("x.n").alias("__n"), F.col("x.s").alias("__s"))

    def transform(self, queries: DataFrame, query_date: str, prefix: str | None = None, null_key: str = "group", smoothing: float = 0.0) -> DataFrame:
        """asof.prior_rate of the queries against all events that the table holds."""
        prefix = prefix or _plain(self.keys)
        own = queries.select("*", *self._keys(), F.unix_date(query_date).alias("__qt"))
        wanted = own.where("__qt is not null")
        known = self._before(wanted.select(*self.names, F.col("__qt").alias("day")).distinct())
        days = wanted.select(F.col("__qt").alias("day")).distinct().select(*(F.lit("").alias(n) for n in self.names), "day")
        everywhere = self._before(days, everything=True).select("day", F.col("__n").alias("__en"), F.col("__s").alias("__es"))  # a row a date
        mean = self.spark.table(self.table).where((F.col("part") == -1) & (F.col("year") == OPEN)).agg(F.try_divide(F.sum("before_s"), F.sum("before_n")).alias("__mean"))
        found = own.join(known.withColumnRenamed("day", "__qt"), [*self.names, "__qt"], "left").join(everywhere.withColumnRenamed("day", "__qt"), "__qt", "left").crossJoin(F.broadcast(mean))
        n = F.coalesce("__n", F.lit(0))
        if null_key == "zero" and len(self.keys) == 1:
            n = F.when(F.col(self.keys[0]).isNull(), 0).otherwise(n)
        fallback = F.coalesce(F.try_divide("__es", "__en"), F.col("__mean"))
        rate = F.when(n > 0, (F.col("__s") + smoothing * fallback) / (n + smoothing)).otherwise(fallback)
        return found.select(*queries.columns, rate.alias(f"{prefix}_prior_rate"), n.cast("bigint").alias(f"{prefix}_prior_count"))
