"""Texts are searched near the words that patterns need, with the features of the whole text."""

import random

from pyspark.sql import functions as F

from docket_spark.domain.values import TEXT_SPEC
from docket_spark.operators import text as TX

PARTS = [
    "Ground 1", "GROUND 12A", "Grounds 1 and 2", "GROUNDS 3  and\t4 U.S.C.", "Ground 5 U. S. C.", "Ground", "Challenge #7", "Challenge", "ground 9", "1", "12", " 102", "102(a)", "42.102(b)", "103(z)", "§102", "§§ 103", "35 U.S.C. § 102", "35 U. S. C. § 311 / 103",
    "35 U.S.C. § 7 & 103", "Section 102", "section 102 and 103 grounds", "section 103", " grounds ", "\n 3 102 5-102, 7", "\n12 103 9", "102103", "Factor 1: stay", "factor 2 of the trial\ndate", "FACTOR 3 investment", "fAcToR 4 overlap", "\nFactor 5", "\n\n   Factor 6",
    "Fintiv factors 1 and 2", "Fintiv factor 3", "first Fintiv factor", "Second  Fintiv  FACTOR", "Factor one", "factor Two", "\n1. Stay", "\n2. Trial Date", "\n3. Investment", "will not pursue this invalidity ground", "agree not to raise a ground", "stipulates that it will cease to assert invalidity", "İ", "ẞ", "漢字", "😀", "é",
]


def texts(n: int) -> list[str]:
    deal = random.Random(7)
    filler = [" ", "\n", ". ", " and ", "", " " * 13, "9" * 40, " \n" * 40, "\t", "x" * 300, "plain words. " * 40, "é 漢 " * 120, "\n" * 400, " 1, 2" * 200, "😀" * 200]
    return ["".join(deal.choice(PARTS) + deal.choice(filler[: deal.choice([5, len(filler)])]) for _ in range(deal.randrange(12))) for _ in range(n)]


def test_features_near_words_are_those_of_the_whole_text(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", *texts(1500)])], "id int, t string")
    whole = {k: v for k, v in TEXT_SPEC.items() if k not in ("near", "needs")} | {"needs": {k: v for k, v in TEXT_SPEC["needs"].items() if k != "stipulations"}}
    found, meant = ({r["id"]: r for r in TX.text_features(df, "t", spec).drop("t").collect()} for spec in (TEXT_SPEC, whole))
    assert found == meant
    for c in ("n_grounds", "n_grounds_102", "n_grounds_103", "has_sotera_stipulation", "mentions_fintiv_factors"):
        assert len({r[c] for r in found.values()}) > 1


def test_a_stretch_is_short_unless_runs_are_long(spark):
    word, fill = "§ 102 now", "plain words. é " * 500
    rows = [fill + word + fill, word + fill, fill + word, fill + "102" + " " * 100 + fill, fill, "", fill + "102" + fill + "102" + fill]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, t string")
    own = [r["s"] for r in TX.stretch(df, "t", ["102"], "s").orderBy("id").collect()]
    assert all(s in t for s, t in zip(own, rows)) and [word in s for s in own[:3]] == [True] * 3
    assert max(map(len, own[:3])) <= 2 * TX.REACH + 3 and own[3] == rows[3] and own[4:6] == ["", ""] and len(own[6]) == len(fill) + 6 + 2 * TX.REACH
