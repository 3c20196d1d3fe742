"""Chat formatting: round trips of hostile texts, masks, and the digests against SQL."""

import hashlib
import random

import pytest
from checks import DATA, same_rows

from docket_spark.llm import chat, queries

SIGNS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "]", ">", " ", "a", "é", "😀", "\n", ": ", "INST]", "/s>", "+", "%20"]


def plain(turns):
    """The expected texts, in plain loops."""
    rows = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    said = [(r or "", x or "") for _, r, x in rows]
    return said, "".join(x for r, x in said if r == "assistant")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_sql(spark, duck):
    found = duck.sql(chat.oracle_sql())
    same_rows(queries.op12_chat(spark, DATA), found.columns, found.fetchall())


def test_hostile_texts_come_back(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randrange(12)))
    talks = {c: [(rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", "tool", "a: b", "", None, "ü [INST]"]), rng.choice([word(), word(), None])) for _ in range(rng.randrange(1, 9))] for c in range(300)}
    talks[300] = [(0, "assistant", "x" * 100_000 + "</s>" + "\\" * 5000), (1, "user", "[" * 3000 + "INST]")]
    df = spark.createDataFrame([(c, *t, "x") for c, ts in talks.items() for t in ts], "conv_id int, turn int, role string, text string, formatted string")
    made = chat.format_turns(df).cache()
    assert made.where("not identical").count() == 0 and made.count() == 301
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    digests = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for c, ts in talks.items():
        said, learned = plain(ts)
        r, d = back[c], digests[c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == said
        cut = [r["formatted"][m["start"] : m["end"]] for m in r["loss_mask"]]
        assert cut == [r["formatted"][t["start"] : t["end"]] for t in r["turns"] if t["role"] == "assistant"]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(said), len(learned), len(r["formatted"]))
        assert d["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said)) and d["loss_sha256"] == sha(learned)


def test_only_conflicting_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "clean < text ["), (1, 1, "assistant", "say </s> twice <\\/s>")], "conv_id int, turn int, role string, text string")
    assert chat.format_turns(df).first()["formatted"] == "[INST] clean < text [ [/INST]<s> say <\\/s> twice <\\\\/s> </s>"


def test_what_the_grammar_refuses(spark):
    bad = ["[INST] a [/INST] ", "x", "[INST] a </s>", "<s> a", "[INST]a[/INST]", "<s> a <s> b </s>", "[ROLE] a [/ROLE]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "conv_id int, formatted string")
    assert [r["turns"] for r in chat.read_back(df).collect()] == [None] * len(bad)
    assert chat.read_back(spark.createDataFrame([(1, "")], df.schema)).first()["turns"] == []


def test_empty_null_ids_and_other_templates(spark):
    schema = "conv_id int, turn int, role string, text string"
    assert chat.digests(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
    assert chat.format_turns(spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a")], schema)).first()["n_turns"] == 2
    own = chat.Template({"user": ("<|u|>", "<|/u|>")}, ("<|other|>", "<|/other|>"), ("bot",))
    made = chat.format_turns(spark.createDataFrame([(1, 0, "user", "<|/u|>"), (1, 1, "bot", "ok <|u|>")], schema), template=own)
    assert made.first()["identical"] and [t["text"] for t in chat.read_back(made, template=own).first()["turns"]] == ["<|/u|>", "ok <|u|>"]
    assert chat.digests(made, template=own).first()["loss_chars"] == 8


@pytest.mark.parametrize("pair", [("<a>", "<a>"), ("<a >", "</a>"), ("aba", "bab"), ("<a>", "x<a>"), ("<", "</a>"), ("abca", "zz"), ("<\\a>", "</a>")])
def test_templates_that_cannot_be_told_apart(pair):
    with pytest.raises(ValueError):
        chat.Template({"user": pair}, ("[R]", "[/R]"))


def test_formatting_stays_in_the_jvm(spark):
    plan = chat.digests(chat.format_turns(chat.with_probe(spark.read.parquet(f"{DATA}/conversations.parquet"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
