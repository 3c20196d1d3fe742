"""Nested records to flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import as_list


def _step(schema, parts: list[str]) -> bool:
    for p in parts:
        if not isinstance(schema, T.StructType) or p not in schema.names:
            return False
        schema = schema[p].dataType
    return True


def by_path(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One column per entry {name: dotted path}, in that order; a missing or non-struct step gives null."""
    return df.select(*((F.col(".".join(f"`{p}`" for p in path.split("."))) if _step(df.schema, path.split(".")) else F.lit(None).cast("string")).alias(name) for name, path in mapping.items()))


def by_name(df: DataFrame, parsers: dict[str, dict[str, str]], parser: str) -> DataFrame:
    """by_path with a named mapping; an unknown name is an error."""
    return by_path(df, parsers[parser])


def json_paths(df: DataFrame, raw: str, mapping: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """by_path on a column of JSON text; broken JSON gives nulls."""
    return df.select(*keep, *(F.get_json_object(raw, "$." + path).alias(name) for name, path in mapping.items()))


def unwrapped(df: DataFrame, bag: str) -> DataFrame:
    """The first record of an optional one-element bag, else the bare columns themselves."""
    if bag not in df.columns:
        return df
    inner = df.schema[bag].dataType.elementType.names
    first = F.try_element_at(F.col(bag), F.lit(1))
    bare = [c for c in df.columns if c != bag]
    both = [F.coalesce(first[c], F.col(c)) if c in bare else first[c] for c in inner]
    return df.select(*(c.alias(n) for c, n in zip(both, inner)), *[c for c in bare if c not in inner])


def polymorphic_list(raw: Column) -> Column:
    """JSON text that is a list of strings, a list of objects or a scalar -> array of trimmed, non-empty strings.

    Of an object the first non-empty value counts.  Null and broken values give an empty array.
    """
    as_array = F.from_json(raw, "array<string>")
    scalar = F.when(raw.isNull() | raw.rlike(r"^\s*[\[{]"), F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(raw, r'^\s*"|"\s*$', "")))
    item = lambda e: F.when(e.rlike(r"^\s*\{"), F.try_element_at(F.filter(F.map_values(F.from_json(e, "map<string,string>")), lambda v: F.coalesce(F.trim(v) != "", F.lit(False))), F.lit(1))).otherwise(e)
    found = F.transform(F.when(raw.rlike(r"^\s*\["), as_array).otherwise(scalar), lambda e: F.trim(item(e)))
    return F.coalesce(F.filter(found, lambda x: F.coalesce(x != "", F.lit(False))), F.array().cast("array<string>"))


def parallel_arrays(bag: Column, fields: dict[str, str]) -> list[Column]:
    """Index-aligned arrays of a bag's fields; a null bag gives empty arrays."""
    return [F.coalesce(F.transform(bag, _field(field)), F.array()).alias(name) for name, field in fields.items()]


def _field(path: str):
    def of(x):
        for p in path.split("."):
            x = x[p]
        return x

    return of


def nested_names(bag: Column, inner: str, field: str) -> Column:
    """Array of arrays: of each element of the bag the non-empty values of its inner bag."""
    return F.coalesce(F.transform(bag, lambda x: F.filter(F.transform(as_list(x[inner]), lambda y: y[field]), lambda v: F.coalesce(v != "", F.lit(False)))), F.array().cast("array<array<string>>"))


def filled_ids(bag: Column, field: str) -> Column:
    return F.coalesce(F.filter(F.transform(bag, lambda x: x[field]), lambda v: F.coalesce(v != "", F.lit(False))), F.array().cast("array<string>"))


def bag_size(bag: Column) -> Column:
    return F.coalesce(F.size(bag), F.lit(0))


def distinct_codes(bag: Column, inner: str, field: str) -> Column:
    """Sorted distinct non-empty codes over two nested bags."""
    return F.array_sort(F.array_distinct(F.flatten(nested_names(bag, inner, field))))


def typed(df: DataFrame, raw: str, schema: str, name: str = "record") -> DataFrame:
    """A typed nested view of a column of JSON text: unknown fields are ignored, broken JSON gives null."""
    return df.withColumn(name, F.from_json(raw, schema))


def validate(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with a reason): required columns must be there and not null."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    reason = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in required))
    marked = df.withColumn("missing", reason)
    return marked.where("missing = ''").drop("missing"), marked.where("missing <> ''")


def contract(df: DataFrame, fields: dict[str, tuple[str, list[str]]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason) of a record type.

    ``fields`` gives by name a type and the names under which sources deliver it, the first that is there and filled counts;
    fields that no source has are null, columns that no field names are ignored.  A value that its type cannot hold is null.
    """
    def value(kind: str, aliases: list[str]) -> Column:
        there = [F.col(f"`{a}`").try_cast(kind) for a in aliases if a in df.columns]
        return F.coalesce(*there) if there else F.lit(None).cast(kind)

    return validate(df.select(*(value(kind, [name, *aliases]).alias(name) for name, (kind, aliases) in fields.items())), required)
