"""Raw file wrappers, one JSON text each, to flat rows.

The text is parsed once, to a variant, and the variant is read once, as a struct of all paths: what does not fit its type is
null there, elements and objects too, and takes nothing else along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..domain.values import WRAPPER
from ..functions.scalars import lenient_date, yes_no
from .flatten import polymorphic_list


def _tree() -> dict:
    """{field: type or {field: ...}} of all paths; a dict in a list is a list of objects."""
    inner, bags = WRAPPER["inner"], WRAPPER["bags"]
    paths = {p: "string" for part in ("texts", "dates", "flags") for p in WRAPPER[part].values()}
    paths |= {p: "bigint" for p in WRAPPER["numbers"].values()} | {WRAPPER["codes"]: "variant"}
    paths |= {p: "array<boolean>" for p in WRAPPER["counts"].values()}  # only their sizes count; bags follow below
    paths |= {
        bags["inventors"]: [{inner["addresses"]: [{inner["country"]: "string"}]}],
        bags["events"]: [{inner["event_code"]: "string", inner["event_date"]: "string"}],
        bags["assignments"]: [{inner["received"]: "string", inner["recorded"]: "string", inner["assignees"]: [{inner["assignee"]: "string"}]}],
        bags["parents"]: [{inner["parent"]: "string"}],
    }
    tree: dict = {}
    for path, kind in paths.items():
        *above, name = path.split(".")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        at[name] = kind
    return tree


def _type(kind) -> str:
    if isinstance(kind, list):
        return f"array<{_type(kind[0])}>"
    return "struct<" + ", ".join(f"`{k}`: {_type(v)}" for k, v in kind.items()) + ">" if isinstance(kind, dict) else kind


def _objects(c: Column) -> Column:
    """The elements that are objects; of what is no list none."""
    return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array())


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda x: F.coalesce(x != "", F.lit(False)))


def _codes(raw: Column, v: Column) -> Column:
    """A list of texts, of objects (the first non-empty value of each) or a single value; trimmed, empty ones dropped."""
    path = WRAPPER["codes"]
    told = lambda kind: F.try_variant_get(v, "$", kind)
    plain = F.filter(F.transform(told("array<string>"), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    # variants order the fields of an object by name, the text as they were written
    bag = F.coalesce(F.get_json_object(raw, f"$.{WRAPPER['envelope']}[0].{path}"), F.get_json_object(raw, f"$.{path}"))
    # a struct takes objects only
    of_objects = F.exists(told("array<struct<`_`: boolean>>"), lambda x: x.isNotNull())
    return F.when(of_objects, polymorphic_list(bag)).when(plain.isNotNull(), plain).otherwise(_filled(F.array(F.trim(told("string")))))


def wrapper_rows(df: DataFrame, raw: str, keep: list[str] = ()) -> DataFrame:
    """One flat row of each wrapper: ``keep`` and the columns named in domain.values.WRAPPER.

    ``raw`` holds the bare record or an envelope with it as the only element of a bag.  Absent bags, and those that are no
    lists, give empty arrays and counts of 0; absent scalars, and dates that are none, are null; elements that are no
    objects are left out.  Arrays of one bag are aligned by index.  Broken and null texts give a row of nulls and empty
    arrays.
    """
    parsed = df.select(*keep, F.col(raw).alias("__raw"), F.try_parse_json(raw).alias("__v"))
    kind = _type(_tree())
    record = F.coalesce(F.try_variant_get("__v", f"$.{WRAPPER['envelope']}[0]", kind), F.try_variant_get("__v", "$", kind))
    # through explode, so that the optimizer does not read the record anew for each column
    held = parsed.select(*keep, "__raw", F.explode(F.array(record)).alias("__r"))
    at = lambda path: F.col("__r." + ".".join(f"`{p}`" for p in path.split(".")))
    bags = {name: _objects(at(path)) for name, path in WRAPPER["bags"].items()}
    out = {name: at(path) for name, path in (WRAPPER["texts"] | WRAPPER["numbers"]).items()}
    out |= {name: lenient_date(at(path)) for name, path in WRAPPER["dates"].items()}
    out |= {name: yes_no(at(path)) for name, path in WRAPPER["flags"].items()}
    out |= {name: F.coalesce(F.size(at(path)), F.lit(0)).cast("bigint") for name, path in WRAPPER["counts"].items()}
    inner = WRAPPER["inner"]
    countries = F.flatten(F.transform(bags["inventors"], lambda i: F.transform(_objects(i[inner["addresses"]]), lambda a: a[inner["country"]])))
    out |= {
        "inventor_country_codes": F.array_sort(F.array_distinct(_filled(countries))),
        "cpc_codes": F.coalesce(_codes(F.col("__raw"), at(WRAPPER["codes"])), F.array().cast("array<string>")),
        "event_codes": F.transform(bags["events"], lambda e: e[inner["event_code"]]),
        "event_dates": F.transform(bags["events"], lambda e: lenient_date(e[inner["event_date"]])),
        "assignment_received_dates": F.transform(bags["assignments"], lambda a: lenient_date(a[inner["received"]])),
        "assignment_recorded_dates": F.transform(bags["assignments"], lambda a: lenient_date(a[inner["recorded"]])),
        "assignees_per_assignment": F.transform(bags["assignments"], lambda a: _filled(F.transform(_objects(a[inner["assignees"]]), lambda x: x[inner["assignee"]]))),
        "parent_app_numbers": _filled(F.transform(bags["parents"], lambda p: p[inner["parent"]])),
    }
    return held.select(*keep, *(out[c].alias(c) for c in WRAPPER["columns"]))
