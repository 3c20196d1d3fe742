"""Chat formatting by grammar round trip: turns become one training text, a parser reads it again, and what it reads must equal the source.

A formatted conversation is a sequence of turns; a turn is OPENING blank text blank CLOSING.  Each role has its own pair
of control strings; roles without one share a pair and stand, URL-encoded, before the text (``name: ``).  The parser is
deterministic: it cuts at control strings and accepts nothing but openings followed by their own closings, so a control
string inside a text is always a conflict.  Texts that do not survive the round trip are escaped (a backslash after the
first sign of a control string; runs of backslashes there grow by one).  The first reading takes turn by turn and tells
which texts conflict, the second takes the formatted conversations and tells whether all that is read is what was given.
More readings are never needed: a template whose control strings could overlap, or arise where texts and control strings
meet, is refused.

All steps are DataFrame functions; the turns are shuffled once, by conversation.  A conversation becomes one text, so it
must fit in a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .common import running, settled


def _quoted(text: str) -> str:
    """A pattern for the text itself, in every dialect used here."""
    return re.sub(r"([^A-Za-z0-9<>/ _-])", r"\\\1", text)


@dataclass(frozen=True)
class Template:
    """Control strings: a pair for each named role, one pair for all others.  ``loss`` are the roles to learn from."""

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str]
    loss: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        controls = [c for pair in (*self.turns.values(), self.other) for c in pair]
        object.__setattr__(self, "controls", tuple(controls))
        if len(set(controls)) < len(controls):
            raise ValueError("each control string must be one role's opening or closing")
        for c in controls:
            if len(c) < 2 or re.search(r"[\s\\]", c):
                raise ValueError(f"control strings have two signs or more, no blank and no backslash: {c!r}")
        for a, b in product(controls, controls):
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    @property
    def control(self) -> str:
        """Control strings; most places of a text are passed after a look at one sign."""
        return f"(?=[{''.join(map(_quoted, self.rests))}])(?:{'|'.join(map(_quoted, self.controls))})"

    @property
    def rests(self) -> dict[str, list[str]]:
        """First sign -> what follows it in control strings."""
        found: dict[str, list[str]] = {}
        for c in self.controls:
            found.setdefault(c[0], []).append(c[1:])
        return found

    @property
    def conflict(self) -> str:
        """Control strings, escaped or not."""
        return "|".join(f"{_quoted(first)}\\\\*(?:{'|'.join(map(_quoted, rests))})" for first, rests in self.rests.items())


#: Instruction style; every turn has its own pair, so any order of roles can be told.
INST = Template({"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}, ("[ROLE]", "[/ROLE]"))


def escape(text: Column, template: Template = INST) -> Column:
    """Adds a backslash after the first sign of each control string, escaped or not."""
    places = "|".join(f"(?<={_quoted(first)})(?=\\\\*+(?:{'|'.join(map(_quoted, rests))}))" for first, rests in template.rests.items())
    return F.regexp_replace(text, F.lit(places), F.lit("\\\\"))


def unescape(text: Column, template: Template = INST) -> Column:
    """Takes away what escape() has added."""
    places = "|".join(f"(?<={_quoted(first)})\\\\(?=\\\\*+(?:{'|'.join(map(_quoted, rests))}))" for first, rests in template.rests.items())
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, F.lit(places), F.lit(""))).otherwise(text)


def _by_role(role: Column, template: Template, side: int) -> Column:
    out = None
    for name, pair in template.turns.items():
        out = F.when(role == name, F.lit(pair[side])) if out is None else out.when(role == name, F.lit(pair[side]))
    return out.otherwise(F.lit(template.other[side])) if out is not None else F.lit(template.other[side])


def _lead(role: Column, template: Template) -> Column:
    """What stands before the text."""
    named = F.when(role.isin(list(template.turns)), F.lit(" ")).otherwise(F.concat(F.lit(" "), F.url_encode(role), F.lit(": ")))
    return F.concat(_by_role(role, template, 0), named)


def _tail(role: Column, template: Template) -> Column:
    return F.concat(F.lit(" "), _by_role(role, template, 1))


def parsed(df: DataFrame, formatted: str, keep: list[str], template: Template = INST, out: str = "turns", spans: bool = True) -> DataFrame:
    """Adds ``out``: the turns that the parser reads in a text, array<struct<role, text, start, end>>; null if it is none of the grammar's.

    start and end (left out without ``spans``) delimit the text as it stands there, still escaped, in code points, end exclusive.
    """
    control = template.control
    held = [*keep, formatted, "__marks", "__parts"]
    df = settled(df, [*keep, formatted], {"__marks": F.regexp_extract_all(F.col(formatted), F.lit(f"({control})"), F.lit(1)), "__parts": F.split(F.col(formatted), control, -1)})
    if spans:  # where each part ends with the control string after it
        df = settled(df, held, {"__sizes": F.transform("__marks", lambda m, i: (F.length(m) + F.length(F.get(F.col("__parts"), i))).cast("bigint"))})
        df = settled(df, held, {"__ends": running(F.col("__sizes"))})
    marks, parts, ends = F.col("__marks"), F.col("__parts"), F.col("__ends")
    closing = F.create_map(*(F.lit(c) for pair in (*template.turns.values(), template.other) for c in pair))
    role_of = F.create_map(*(F.lit(x) for name, pair in template.turns.items() for x in (pair[0], name))) if template.turns else None
    pairs = F.when(F.size(marks) > 1, F.sequence(F.lit(0), F.floor(F.size(marks) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def turn(i):
        opening, body = F.get(marks, i * 2), F.get(parts, i * 2 + 1)
        named = F.try_element_at(role_of, opening) if role_of is not None else F.lit(None).cast("string")
        # after the blank: the text, or for other roles "name: text"
        inner = F.substring(body, F.lit(2), F.length(body) - 2)
        name = F.when(named.isNull(), F.substring_index(inner, ": ", 1))
        good = (
            F.coalesce(F.try_element_at(closing, opening) == F.get(marks, i * 2 + 1), F.lit(False)) & (F.get(parts, i * 2) == "") & (F.length(body) >= 2)
            & F.startswith(body, F.lit(" ")) & F.endswith(body, F.lit(" ")) & (named.isNotNull() | F.contains(inner, F.lit(": ")))
        )
        text = F.when(named.isNotNull(), inner).otherwise(F.substring(inner, F.length(name) + 3, F.length(inner)))
        place = [(F.get(ends, i * 2) + 1 + F.coalesce(F.length(name) + 2, F.lit(0))).alias("start"), (F.get(ends, i * 2) + F.length(body) - 1).alias("end")] if spans else []
        return F.when(good, F.struct(F.coalesce(named, F.try_url_decode(name)).alias("role"), unescape(text, template).alias("text"), *place))

    df = settled(df, held, {"__turns": F.transform(pairs, turn)})
    whole = (F.size(marks) % 2 == 0) & (F.element_at(parts, -1) == "") & ~F.exists("__turns", lambda t: t.isNull())
    return df.select(*keep, formatted, F.when(whole, F.col("__turns")).alias(out))


def _rendered(df: DataFrame, template: Template) -> DataFrame:
    """Adds formatted and loss_mask of __source (array<struct<role, text, conflict>>)."""

    def pieces(t):
        text = F.when(t["conflict"], escape(t["text"], template)).otherwise(t["text"])
        return F.struct(_lead(t["role"], template).alias("lead"), text.alias("text"), _tail(t["role"], template).alias("tail"), t["role"].isin(list(template.loss)).alias("loss"))

    df = settled(df, ["__id", "__source"], {"__pieces": F.transform("__source", pieces)})
    sizes = F.transform("__pieces", lambda p: (F.length(p["lead"]) + F.length(p["text"]) + F.length(p["tail"])).cast("bigint"))
    df = settled(df, ["__id", "__source", "__pieces"], {"__sizes": sizes})
    df = settled(df, ["__id", "__source", "__pieces"], {"__ends": running(F.col("__sizes"))})
    end = lambda p, i: F.get(F.col("__ends"), i) - F.length(p["tail"])
    spans = F.transform("__pieces", lambda p, i: F.when(p["loss"], F.struct((end(p, i) - F.length(p["text"])).alias("start"), end(p, i).alias("end"))))
    formatted = F.array_join(F.transform("__pieces", lambda p: F.concat(p["lead"], p["text"], p["tail"])), "")
    return settled(df, ["__id", "__source"], {"formatted": formatted, "loss_mask": F.array_compact(spans)})


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = INST) -> DataFrame:
    """One formatted text for each conversation.

    Returns ``conv_id``, formatted string, loss_mask array<struct<start, end>> (the texts of the roles to learn from, in
    code points of formatted, end exclusive), n_turns int, identical boolean (what the parser reads equals the source).
    Turns stand in the order of ``turn``, nulls first; ties by role, then text; repeated rows stay.  A null text or role is
    empty; a null conv_id is a conversation of its own; other columns are not read.  An empty table gives no rows.
    """
    given = turns.select(F.col(conv_id).alias("__id"), F.col(turn).alias("__turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("__role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    keep = ["__id", "__turn", "__role", "__text"]
    # first reading, turn by turn, before the shuffle: which texts conflict with the grammar
    one = given.withColumn("__segment", F.concat(_lead(F.col("__role"), template), F.col("__text"), _tail(F.col("__role"), template)))
    read = parsed(settled(one, keep, {"__segment": F.col("__segment")}), "__segment", keep, template, spans=False)
    same = (F.size("turns") == 1) & (F.get("turns", F.lit(0))["role"] == F.col("__role")) & (F.get("turns", F.lit(0))["text"] == F.col("__text"))
    checked = read.select(*keep, (~F.coalesce(same, F.lit(False))).alias("__conflict"))
    rows = F.array_sort(F.collect_list(F.struct("__turn", "__role", "__text", "__conflict")))
    grouped = checked.groupBy("__id").agg(rows.alias("__rows"))
    source = F.transform("__rows", lambda r: F.struct(r["__role"].alias("role"), r["__text"].alias("text"), r["__conflict"].alias("conflict")))
    whole = settled(grouped, ["__id"], {"__source": source})
    # second reading, whole conversations
    read = parsed(_rendered(whole, template), "formatted", ["__id", "__source", "loss_mask"], template, "__read", spans=False)
    said = F.transform("__source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.coalesce(F.col("__read") == said, F.lit(False))
    return read.select(F.col("__id").alias(conv_id), "formatted", "loss_mask", F.size("__source").alias("n_turns"), same.alias("identical"))


def read_back(formatted: DataFrame, conv_id: str = "conv_id", template: Template = INST) -> DataFrame:
    """The turns that formatted texts hold: adds turns array<struct<role, text, start, end>>, null where the grammar does not hold."""
    return parsed(formatted, "formatted", [c for c in formatted.columns if c != "formatted"], template)


def digests(formatted: DataFrame, conv_id: str = "conv_id", template: Template = INST) -> DataFrame:
    """What is read back from the formatted texts and their loss masks, as counts and digests."""
    read = read_back(formatted.select(F.col(conv_id).alias("conv_id"), "formatted", "loss_mask"), template=template)
    learned = F.filter("turns", lambda t: t["role"].isin(list(template.loss)))
    spans = F.transform(learned, lambda t: F.struct(t["start"].cast("bigint").alias("start"), t["end"].cast("bigint").alias("end")))
    # the parser's own spans are those of the mask; texts cut out by the mask alone serve if they were not
    cut = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")), template))
    under = F.when(spans == F.col("loss_mask"), F.transform(learned, lambda t: t["text"])).otherwise(cut)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = settled(read, ["conv_id"], {"__turns": F.size("turns"), "__said": said, "__loss": F.array_join(under, ""), "__chars": F.length("formatted")})
    return read.select(
        "conv_id", F.col("__turns").cast("bigint").alias("n_turns"), F.sha2(F.col("__said").cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"), F.col("__chars").cast("bigint").alias("formatted_chars"),
    )


#: A conversation whose texts look like the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """``conversations`` and the probe: a user's and an assistant's turn that say PROBE_TEXT."""
    given = turns.select("conv_id", "turn", "role", "text")
    probe = turns.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return given.unionByName(probe)


def oracle_sql(template: Template = INST) -> str:
    """The digests straight from the source, without formatting; sizes of the formatted text by the template's rules."""
    case = lambda value, other: "CASE role " + " ".join(f"WHEN '{name}' THEN {value(pair)}" for name, pair in template.turns.items()) + f" ELSE {other} END"
    around = case(lambda p: len(p[0]) + len(p[1]) + 2, f"{len(template.other[0]) + len(template.other[1]) + 4} + length(url_encode(role))")
    conflict = template.conflict.replace("'", "''")
    loss = ", ".join(f"'{r}'" for r in template.loss)
    return f"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
  sum(length(text) + {around} + len(regexp_extract_all(text, '{conflict}')))::BIGINT AS formatted_chars
FROM source GROUP BY conv_id"""
