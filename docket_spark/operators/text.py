"""Features of long texts by patterns; the text column can be dropped right after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import captures, count_matches, distinct_captures, matches
from ..functions.scalars import enough, mapped


def holds(text: Column, needs: list[list[str]]) -> Column:
    """Whether the text holds, as it is, one word of each of the lists."""
    out = F.lit(True)
    for words in needs:
        there = F.lit(False)
        for w in words:
            there = there | F.contains(text, F.lit(w))
        out = out & there
    return out


def gated(text: Column, words: list[str], value: Column) -> Column:
    """The value where the text holds one of the words as they are, else 0: dear patterns run on few rows only."""
    return F.when(holds(text, [words]), value).otherwise(F.lit(0)) if words else value


#: Characters kept around the words of a stretch, and the longest run of blanks or digits there.
REACH, RUN = 160, 12


def count_of(text: Column, word: str) -> Column:
    """How often the text holds the word as it is; no end of the word may be a beginning of it."""
    found = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())
    return F.when(F.contains(text, F.lit(word)), found.cast("int")).otherwise(0)


def stretch(df: DataFrame, text: str, words: list[str], name: str, every: Column | None = None) -> DataFrame:
    """Adds ``name``: the text from the first to the last of the words, with ``REACH`` characters on each side; empty without a word.

    A pattern whose matches hold one of the words, and go beyond it by few characters and by runs of blanks and digits
    only, matches there as in the text.  Where such a run beside the words is longer than ``RUN``, or ``every`` counts
    more words than are found, the text stays whole.  Every word is ASCII, and no end of it is a beginning of it.
    """
    t, at = F.col(text), {w: F.col(f"__{name}_{k}") for k, w in enumerate(words)}
    df = df.withColumns({f"__{name}_{k}": count_of(t, w) for k, w in enumerate(words)})
    upto = lambda w, n: F.when(at[w] > 0, F.octet_length(F.call_function("substring_index", t, F.lit(w), n)))
    first = F.least(*(upto(w, F.lit(1)) for w in words), F.octet_length(t))
    last = F.greatest(*(upto(w, at[w]) + len(w) for w in words), F.lit(0))
    found = sum(at.values(), F.lit(0))
    df = df.withColumns({f"__{name}_found": found, f"__{name}_first": first, f"__{name}_last": last}).drop(*(f"__{name}_{k}" for k in range(len(words))))
    found, first, last = (F.col(f"__{name}_{x}") for x in ("found", "first", "last"))
    part = lambda begin, n: F.substring(t.cast("binary"), begin + 1, n).cast("string")
    df = df.withColumns({f"__{name}_before": F.when(found > 0, F.right(part(F.greatest(first - 4 * REACH, F.lit(0)), F.least(first, F.lit(4 * REACH))), F.lit(REACH))), f"__{name}_after": F.when(found > 0, F.left(part(last, F.lit(4 * REACH)), F.lit(REACH)))})
    before, after = F.col(f"__{name}_before"), F.col(f"__{name}_after")
    own = F.when(found == 0, "").when(matches(F.concat(before, F.lit("|"), after), rf"[\s\d]{{{RUN + 1}}}"), t).otherwise(F.concat(before, part(first, last - first), after))
    cut = own if every is None else F.when(found != every, t).otherwise(own)
    return df.withColumn(name, cut).drop(*(f"__{name}_{x}" for x in ("found", "first", "last", "before", "after")))


def distinct_numbered(text: Column, pattern: str, groups: int, words: dict[str, str] | None = None, ignore_case: bool = True) -> Column:
    """Distinct numbers captured; with ``words``, captured number words are mapped first."""
    if words is None:
        return distinct_captures(text, pattern, groups, ignore_case)
    return F.size(F.array_distinct(F.transform(captures(text, pattern, groups, ignore_case), lambda x: mapped(F.lower(x), words))))


def any_of(text: Column, patterns: list[str], dotall: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p, True, dotall)
    return out.cast("int")


def how_many_of(text: Column, patterns: list[str]) -> Column:
    return sum((matches(text, p, True).cast("int") for p in patterns), F.lit(0))


def text_features(df: DataFrame, text: str, spec: dict) -> DataFrame:
    """Adds all features of ``spec`` (see domain.values.TEXT_SPEC); null texts count as empty.

    ``needs``, ``near``, ``first``, ``inner`` and ``without_lines`` of ``spec`` (each may be absent) say what a match of a pattern needs,
    which matches stay near that, how they begin, what their groups hold and which shorter pattern does without a form that the text lacks; they spare passes over the text and change no feature.
    """
    needs, first, n = spec.get("needs", {}), spec.get("first", {}), spec["numbered"]
    near = [name for name in spec.get("near", []) if name in needs]
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__low", F.lower("__text"))
    t, low, capitals = F.col("__text"), F.col("__low"), [n["gate"], n["gate"].upper(), n["gate"].capitalize()]
    for name in near:
        if name == "numbered":
            df = df.withColumn("__numbered_all", count_of(low, n["gate"])).withColumn("__numbered_text", F.when(F.col("__numbered_all") > 0, t).otherwise(""))
            df = stretch(df, "__numbered_text", capitals, "__numbered", F.col("__numbered_all")).drop("__numbered_all", "__numbered_text")
        else:
            df = stretch(df, "__text", needs[name], f"__{name}")
    within = lambda name: F.col(f"__{name}") if name in near else t

    def statute(name: str) -> Column:
        own = within(name)
        found = count_matches(own, spec[name], first=first.get(name))
        if name in spec.get("without_lines", {}):
            line, pattern, begins = spec["without_lines"][name]
            found = F.when(matches(own, line), found).otherwise(count_matches(own, pattern, first=begins))
        return gated(own, needs.get(name, []), found)

    stipulated = F.lit(False)
    for p, need in zip(spec["stipulation"], needs.get("stipulation", [[]] * len(spec["stipulation"])), strict=True):
        stipulated = stipulated | (holds(low, need) & matches(t, p, True, True))
    if "stipulations" in needs:
        stipulated = F.when(holds(low, needs["stipulations"]), stipulated).otherwise(F.lit(False))
    own = within("numbered")
    about = [how_many_of(own, n["keywords"]), distinct_numbered(own, n["colon"], 1), distinct_numbered(own, n["ordinal"], 1, n["words"]), gated(own, capitals, distinct_numbered(own, n["word"], 1, n["words"])), gated(own, capitals, distinct_numbered(own, n["line"], 1)), distinct_numbered(own, n["anchored"], 2)]
    # a heading is the first line or follows a line end, so two of them need one
    heading = gated(t, ["\n"] if n["least"] > 1 else [], distinct_numbered(t, n["heading"], 1))
    if "numbered" in near:
        mentions = F.when(own != "", enough(about, n["least"])).otherwise(F.lit(0))
    else:
        mentions = F.when(holds(low, needs["numbered"]), enough(about, n["least"])).otherwise(F.lit(0)) if "numbered" in needs else enough(about, n["least"])
    grounds = within("grounds")
    return df.withColumns({
        "n_grounds": gated(grounds, needs.get("grounds", []), distinct_captures(grounds, spec["grounds"][0], spec["grounds"][1], first=first.get("grounds"), inner=spec.get("inner"))),
        "n_grounds_102": statute("statute_102"),
        "n_grounds_103": statute("statute_103"),
        "has_sotera_stipulation": stipulated.cast("int"),
        "mentions_fintiv_factors": F.greatest(mentions, enough([heading], n["least"])),
        "petition_text_length": F.length(t),
    }).drop("__text", "__low", *(f"__{name}" for name in near))


def usable(df: DataFrame, text: str, least: int) -> DataFrame:
    """Rows whose text has at least ``least`` characters."""
    return df.where(F.length(text) >= least)


def usable_report(df: DataFrame, text: str, least: int) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.length(text) >= least, F.lit(False))).alias("n_usable"), F.count_if(F.col(text).isNull()).alias("n_null"))
