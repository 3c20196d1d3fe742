"""Pages of records: envelopes, completeness, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def records(pages: DataFrame, bag: str, keep: list[str] = ()) -> DataFrame:
    """One row per record of each page's bag; empty and null bags give none."""
    return pages.select(*keep, F.inline(bag))


def completeness(pages: DataFrame, bucket: str, count: str, bag: str) -> DataFrame:
    """By bucket: what the pages announce, what they hold, and whether that is the same."""
    sums = pages.groupBy(bucket).agg(F.max(count).alias("announced"), F.coalesce(F.sum(F.size(bag)), F.lit(0)).alias("held"))
    return sums.withColumn("complete", F.coalesce(F.col("announced") == F.col("held"), F.lit(False)))


def missing_ranges(pages: DataFrame, bucket: str, offset: str, size: int, announced: DataFrame, count: str, block: int = 100_000) -> DataFrame:
    """(bucket, first, last, n_pages): runs of page offsets that are not held, of 0, size, 2 size, ... below what is announced.

    ``announced`` has a row (bucket, count) for each bucket; buckets without any page miss all of theirs.  Runs of held
    pages are islands (page number less rank is equal inside); what lies between them is missing.  Numbers are ranked within
    blocks of ``block`` pages and the islands' ends joined up across blocks, so no task sorts a whole bucket.  Repeated
    pages count once; offsets that are no multiple of the size, negative or beyond the announced count are not looked at.
    """
    rest = F.col(offset) % size
    held = pages.where((rest == 0) & (F.col(offset) >= 0)).select(F.col(bucket).alias("bucket"), (F.col(offset) / size).cast("bigint").alias("page")).distinct()
    w = Window.partitionBy("bucket", "block").orderBy("page")
    ranked = held.withColumn("block", F.floor(F.col("page") / block)).withColumn("island", F.col("page") - F.row_number().over(w))
    islands = ranked.groupBy("bucket", "block", "island").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    total = announced.select(F.col(bucket).alias("bucket"), F.ceil(F.col(count) / size).cast("bigint").alias("pages"))
    # inside a block between islands; across blocks between a block's last page and the next block's first
    inner = islands.withColumn("next", F.lead("first").over(Window.partitionBy("bucket", "block").orderBy("first"))).where("next is not null").select("bucket", (F.col("last") + 1).alias("first"), (F.col("next") - 1).alias("last"))
    blocks = islands.groupBy("bucket", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ends = blocks.unionByName(total.select("bucket", F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("first"), F.lit(-1).cast("bigint").alias("last")))
    over = Window.partitionBy("bucket").orderBy("block")
    outer = ends.withColumn("next", F.lead("first").over(over)).join(total, "bucket").select("bucket", (F.col("last") + 1).alias("first"), (F.coalesce("next", "pages") - 1).alias("last"))
    found = inner.join(total, "bucket").select("bucket", "first", "last", "pages").unionByName(outer.join(total, "bucket").select("bucket", "first", "last", "pages"))
    cut = found.withColumn("last", F.least("last", F.col("pages") - 1)).where("first <= last")
    return cut.select(F.col("bucket").alias(bucket), (F.col("first") * size).alias("first"), (F.col("last") * size).alias("last"), (F.col("last") - F.col("first") + 1).alias("n_pages"))


def only(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns have constant values (a list: any of them); reaches the scan as a pushed filter."""
    for c, v in values.items():
        df = df.where(F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def _filters(text: str | None, text_columns: list[str], filters: dict, ranges: dict) -> list[Column]:
    out = [F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in filters.items()]
    for c, (low, high) in ranges.items():
        out += [F.col(c) >= F.lit(low)] if low is not None else []
        out += [F.col(c) <= F.lit(high)] if high is not None else []
    if text:
        out.append(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in text_columns)))
    return out


def search(df: DataFrame, text: str | None = None, text_columns: list[str] = (), filters: dict | None = None, ranges: dict | None = None, fields: list[str] | None = None, sort: list[tuple[str, str]] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Free text, equal values, ranges (low, high), fields, sort (column, asc or desc), offset and limit."""
    for c in _filters(text, text_columns, filters or {}, ranges or {}):
        df = df.where(c)
    if sort:
        df = df.orderBy(*(F.desc(c) if way == "desc" else F.asc(c) for c, way in sort))
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*fields) if fields else df


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n of every column, in one pass over grouping sets."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *map(F.col, columns)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    masks = {c: sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != i) for i, c in enumerate(columns)}
    name = F.coalesce(*(F.when(F.col("gid") == m, F.lit(c)) for c, m in masks.items()))
    value = F.coalesce(*(F.when(F.col("gid") == m, F.col(c).cast("string")) for c, m in masks.items()))
    return sets.select(name.alias("facet"), value.alias("value"), "n")
