"""Personal data in whole texts, by DataFrame functions only.

Base spans come from four patterns with checks (addresses of mail and network, payment cards by Luhn, phone numbers).
Beyond them, every sequence of capitalised words and every group of digits that overlaps no base span is a candidate, for a
person or a personal number.  Six labelers vote for, against, or not at all: a regex on the form, a gazetteer, the words
before, the words after, checks that the text around allows (places in sentences, checksums), and base spans near by.
Expectation-maximisation over the counts of vote patterns, of which there are 3^6 a kind at most, estimates how reliable
each labeler is.  A logistic regression fitted to the posteriors of at most ``sample`` candidates a kind is the final span
classifier; its features describe the candidate and what touches it, not the votes.

Java runs the patterns with possessive repeats, which match the same texts here and neither back-track nor recurse on
very long runs.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .common import running, settled, stored

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ["email", "ip", "card", "phone", "person", "number"]
#: Common given names and forms of address (a gazetteer; any list can be given).
GIVEN_NAMES = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Maria Hans Peter Klaus Sophie Jean Pierre Marie Claire Luc Carlos Jose Carmen Juan Pedro".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Sr Sra".split()
#: Capitalised words that name no person.
NOT_NAMES = "The This That These Those And But For From With Without About After Before When Where Which What Who Why How All Any Some Each January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Street Road Avenue City County State University College School Company Corporation Inc Ltd Limited License Licence Version Software Foundation Public General Terms Copyright Chapter Section Figure Table Page North South East West New Der Die Das Und Ein Eine Le La Les Un Une El Los Las Una".split()
FIRST_DIGITS = "1 4 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
BEFORE_FOR = {"person": r"(?i)\b(?:name|contact|patient|dear|signed|sincerely|regards|by|author|born|mother|father|naam|nom|nombre|nome)\W{0,3}$", "number": r"(?i)\b(?:ssn|social security|passport|tel|phone|mobile|cell|call|fax|account|iban|card|dob|born|id|telefon|number|no)\b[^0-9]{0,15}$"}
BEFORE_AGAINST = {"person": r"(?i)\b(?:the|of|in|at|der|die|das|le|la|les|el|los|las)\W{0,2}$", "number": r"(?i)(?:\b(?:isbn|issn|version|order|invoice|part|serial|model|page|figure|section|commit|build|year|in|since|v)\b[^0-9]{0,8}|[$€£#=*/])$"}
AFTER_FOR = {"person": r"(?i)^\W{0,3}(?:said|says|wrote|was born|who|phone|lives|jr|sr|phd|md)\b", "number": r"(?i)^\W{0,3}(?:ext|mobile|home|work|fax|call)\b"}
AFTER_AGAINST = {"person": r"(?i)^\W{0,2}(?:street|road|avenue|university|inc|ltd|license|licence|version)\b", "number": r"(?i)^\s?(?:%|°|[a-z]{1,2}\b|usd|eur|percent|million|billion|years|days|pages|items|bytes|px)"}
LABELERS = ["form", "gazetteer", "before", "after", "check", "near"]
PERSON_PATTERN = r"(?<![\p{L}0-9_])(?!(?:Dear|Hello|Hi|Liebe|Lieber|Cher|Chère|Querido|Querida) )\p{Lu}[\p{L}'-]*+(?:\.? \p{Lu}[\p{L}'-]*+)++"
NUMBER_PATTERN = r"(?<![\p{L}0-9.,@_%+(-])\(?[0-9]++(?:[ ().,:/-]{1,2}[0-9]++)*+(?![\p{L}@_%])"
FEATURES = 12
#: Characters between a candidate and a base span that counts as near.
NEAR = 60


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    each = F.transform(F.regexp_extract_all(F.reverse(c), F.lit("[0-9]"), F.lit(0)), lambda d, i: d.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def small_byte(c: Column) -> Column:
    bare = F.regexp_replace(c, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (bare.try_cast("int") <= 255)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), small_byte),
    "card": lambda m: F.when(F.length(digits(m)).between(12, 19), luhn(digits(m))).otherwise(False),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def with_places(df: DataFrame, keep: list[str], patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, by name of a pattern, array<struct<start, end, found, before, after>> of its matches in __text, in order.

    ``before`` and ``after`` are up to 60 and 30 characters of the text between it and the next matches.  The gate must hold wherever the
    pattern matches; texts that fail it are not searched.
    """
    none = F.array().cast("array<string>")
    raw = {}
    for k, (pattern, gate) in patterns.items():
        raw[f"__found_{k}"] = F.when(gate, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none)
        raw[f"__gap_{k}"] = F.when(gate, F.split("__text", pattern, -1)).otherwise(none)
    df = settled(df, keep, raw)
    lengths = {f"__len_{k}": F.zip_with(F.col(f"__found_{k}"), F.slice(f"__gap_{k}", 1, F.size(f"__found_{k}")), lambda x, g: (F.length(x) + F.length(g)).cast("bigint")) for k in patterns}
    df = settled(df, [*keep, *raw], lengths)
    df = settled(df, [*keep, *raw], {f"__end_{k}": running(F.col(f"__len_{k}")) for k in patterns})
    made = {}
    for k in patterns:
        parts = F.arrays_zip(F.col(f"__found_{k}").alias("found"), F.col(f"__end_{k}").alias("end"), F.slice(f"__gap_{k}", 1, F.size(f"__found_{k}")).alias("gap"), F.slice(f"__gap_{k}", 2, F.size(f"__found_{k}")).alias("next"))
        made[f"__{k}"] = F.transform(parts, lambda z: F.struct((z["end"] - F.length(z["found"])).alias("start"), z["end"].alias("end"), z["found"].alias("found"), F.right(z["gap"], F.lit(60)).alias("before"), F.left(z["next"], F.lit(30)).alias("after")))
    return settled(df, keep, made)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds __email, __ip, __card and __phone: arrays of the spans that pass their check."""
    body = F.coalesce(df[text], F.lit(""))
    digit = F.col("__text").rlike("[0-9]")
    gates = {"email": F.contains("__text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("__text", F.lit("+"))}
    rest = df.columns
    df = df.withColumn("__text", body)
    passing = lambda k: lambda x: CHECKS[k](x["found"])
    found = with_places(df, [*rest, "__text"], {k: (p, gates[k]) for k, p in BASE.items()})
    return settled(found, [*rest, "__text"], {f"__{k}": F.filter(f"__{k}", passing(k)) for k in BASE})


def voted(*rules: tuple[Column, int]) -> Column:
    """The vote of the first rule that holds, else 0."""
    out = F.lit(0)
    for holds, vote in reversed(rules):
        out = F.when(holds, F.lit(vote)).otherwise(out)
    return out


def _described(kind: str, names: list[str], titles: list[str]):
    """What a candidate is to labelers (votes: text of one sign each) and to the classifier (features)."""
    listed = lambda words: rf"(?:^|[ .])(?:{'|'.join(words)})(?:[ .]|$)"

    def of(candidate):
        x, near = candidate["x"], candidate["near"]
        found = x["found"]
        if kind == "person":
            words = F.size(F.split(found, " "))
            votes = [
                voted((found.rlike(rf"^(?:{'|'.join(titles)})\b"), 1), (found.rlike(r"^\p{Lu}[\p{Lu}' -]+$") | (words > 4), -1)),
                voted((found.rlike(listed(NOT_NAMES)), -1), (found.rlike(listed(names)), 1)),
                voted((x["before"].rlike(BEFORE_FOR[kind]), 1), (x["before"].rlike(BEFORE_AGAINST[kind]), -1)),
                voted((x["after"].rlike(AFTER_FOR[kind]), 1), (x["after"].rlike(AFTER_AGAINST[kind]), -1)),
                voted((x["before"].rlike(r"(?:^|[.!?:\n]\s*)$"), -1)),
            ]
        else:
            bare = digits(found)
            n = F.length(bare)
            votes = [
                voted((found.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{4}(?:[ -][0-9]{4}){2,4})$"), 1), (found.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+[.,][0-9]{1,2}|(?:19|20)[0-9]{2}|[0-9]{1,3})$"), -1)),
                voted((n < 5, 0), (bare.rlike("^(?:0{3}|666|123456|0+$)"), -1), (bare.rlike(rf"^(?:{'|'.join(FIRST_DIGITS)})") & (n >= 10), 1)),
                voted((x["before"].rlike(BEFORE_FOR[kind]), 1), (x["before"].rlike(BEFORE_AGAINST[kind]), -1)),
                voted((x["after"].rlike(AFTER_FOR[kind]), 1), (x["after"].rlike(AFTER_AGAINST[kind]), -1)),
                voted((n < 12, 0), (n > 19, -1), (luhn(bare), 1), (F.lit(True), -1)),
            ]
        votes.append(voted((near, 1)))
        n, share = F.length(found).cast("double"), lambda signs: F.length(F.regexp_replace(found, signs, "")) / F.length(found)  # what is left
        yes = lambda c: c.cast("double")
        features = [F.least(n / 20, F.lit(3.0)), F.least(F.size(F.split(found, "[ ().,:/-]+")) / F.lit(3.0), F.lit(3.0)), share("[^0-9]"), share(r"[^\p{Lu}]"), share("[^aeiouAEIOU]"), share("[^ -]"), share("[^.,:/]"), F.size(F.array_distinct(F.split(found, ""))) / n, yes(x["before"].rlike(r"[\p{L}] ?$")), yes(x["before"].rlike(r"[:=] ?$")), yes(x["before"].rlike(r"(?:^|\n)$")), yes(x["after"].rlike(r"^[.,;!?\n]"))]
        assert len(votes) == len(LABELERS) and len(features) == FEATURES
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.concat(*(F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in votes)).alias("votes"), F.array(*features).alias("features"))

    return of


def _candidates(df: DataFrame, names: list[str], titles: list[str]) -> DataFrame:
    """Adds __more: the candidates that overlap no base span, with votes and features."""
    rest = df.columns
    df = with_places(df, rest, {"person": (PERSON_PATTERN, F.lit(True)), "number": (NUMBER_PATTERN, F.col("__text").rlike("[0-9]"))})
    # What overlaps is told by the largest end of base spans that begin before, and the smallest begin of those after.
    base = F.concat(*(F.transform(f"__{k}", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(-1).alias("no"), F.lit("").alias("kind"))) for k in BASE))
    own = F.concat(*(F.transform(f"__{k}", lambda b, i: F.struct(b["start"].alias("start"), b["end"].alias("end"), i.alias("no"), F.lit(k).alias("kind"))) for k in ("person", "number")))
    events = F.when((F.size("__person") + F.size("__number") > 0), F.array_sort(F.concat(base, own))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,no:int,kind:string>>"))
    df = settled(df, [*rest, "__person", "__number"], {"__events": events})
    far = F.lit(1 << 60).cast("bigint")
    df = settled(df, [*rest, "__person", "__number", "__events"], {"__ends": F.transform("__events", lambda e: F.when(e["no"] < 0, e["end"]).otherwise(F.lit(-1).cast("bigint"))), "__starts": F.reverse(F.transform("__events", lambda e: F.when(e["no"] < 0, e["start"]).otherwise(far)))})
    df = settled(df, [*rest, "__person", "__number", "__events"], {"__ends": running(F.col("__ends"), F.greatest), "__starts": F.reverse(running(F.col("__starts"), F.least))})
    free = F.filter(F.arrays_zip(F.col("__events").alias("e"), F.col("__ends").alias("upto"), F.col("__starts").alias("next")), lambda z: (z["e"]["no"] >= 0) & (z["upto"] <= z["e"]["start"]) & (z["next"] >= z["e"]["end"]))
    df = settled(df, [*rest, "__person", "__number"], {"__free": free})
    near = lambda z: ((z["upto"] >= 0) & (z["e"]["start"] - z["upto"] <= NEAR)) | (z["next"] - z["e"]["end"] <= NEAR)
    of_kind = lambda k: F.transform(F.filter("__free", lambda z: z["e"]["kind"] == k), lambda z: F.struct(near(z).alias("near"), F.element_at(f"__{k}", z["e"]["no"] + 1).alias("x")))
    df = settled(df, rest, {f"__free_{k}": of_kind(k) for k in ("person", "number")})
    return settled(df, rest, {"__more": F.concat(*(F.transform(f"__free_{k}", _described(k, names, titles)) for k in ("person", "number")))})


#: What is held of a labeler before any vote is seen: right in so many of so many votes.
PRIOR_RIGHT, PRIOR_VOTES = 19.0, 20.0


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns and their counts.

    A labeler is right in a share of its votes, for or against alike, and silent regardless of the truth; that share is
    what is estimated, from how its votes agree with the posteriors.  It is a half at least: a labeler may prove useless,
    but never to mean the opposite.  Before votes both classes are as likely: labelers that only vote for, or only
    against, would leave a share of true candidates undetermined.

    Returns the share of true candidates among those with a vote, by labeler and vote (P(vote | true), P(vote | false)) of
    the votes cast, and the posterior by pattern; that of candidates without a vote is a half, which is no label.
    """
    voted_for = [(v, n) for v, n in patterns if any(v)]
    right = [PRIOR_RIGHT / PRIOR_VOTES] * len(patterns[0][0])
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        weights = [math.log(r / (1 - r)) for r in right]
        post = {v: 1 / (1 + math.exp(-min(60.0, max(-60.0, sum(vote * w for vote, w in zip(v, weights)))))) for v, _ in patterns}
        for j in range(len(right)):
            cast = sum(n for v, n in voted_for if v[j])
            agreed = sum(n * (post[v] if v[j] > 0 else 1 - post[v]) for v, n in voted_for if v[j])
            right[j] = min(0.999, max(0.5, (agreed + PRIOR_RIGHT) / (cast + PRIOR_VOTES)))
    total = sum(n for _, n in voted_for)
    share = sum(n * post[v] for v, n in voted_for) / total if total else 0.5
    return share, [{1: (r, 1 - r), 0: (1.0, 1.0), -1: (1 - r, r)} for r in right], post


def train(candidates: DataFrame, sample: int = 50_000) -> dict[str, tuple[float, list[float]]]:
    """By kind (intercept, weights) of the span classifier; kinds without candidates are left out.

    ``candidates`` holds the __more column.  The counts of vote patterns cover all candidates; the regression takes about
    ``sample`` of them, chosen by a hash, none without a vote.  A kind of which no candidate is likely has no classifier.
    """
    spark = candidates.sparkSession
    each = stored(candidates.select(F.explode("__more").alias("c")).select("c.kind", "c.votes", "c.features").groupBy("kind", "votes", "features").count())
    counted = each.groupBy("kind", "votes").agg(F.sum("count").alias("n"), F.count("*").alias("rows")).collect()
    models = {}
    for kind in sorted({r["kind"] for r in counted}):
        own = sorted((tuple({"+": 1, "-": -1, "0": 0}[s] for s in r["votes"]), r["votes"], r["n"], r["rows"]) for r in counted if r["kind"] == kind)
        _, _, post = reliabilities([(v, n) for v, _, n, _ in own])
        own = [x for x in own if any(x[0])]
        if not any(post[v] > 0.5 for v, *_ in own):
            continue
        known = spark.createDataFrame([(text, float(post[v])) for v, text, _, _ in own], "votes string, p double")
        share = min(1.0, sample / sum(rows for *_, rows in own))
        chosen = each.where((F.col("kind") == kind) & (F.pmod(F.xxhash64("features", "votes"), F.lit(1 << 20)) < share * (1 << 20))).join(F.broadcast(known), "votes")
        both = chosen.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("count")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("count")).alias("weight")))).alias("x")).select("features", "x.label", "x.weight").where("weight > 1e-9")
        data = stored(both).coalesce(1).sortWithinPartitions("label", "features", "weight")
        fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=25, featuresCol="v").fit(data.withColumn("v", array_to_vector("features")))
        models[kind] = (float(fitted.intercept), [float(w) for w in fitted.coefficients])
    return models


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: list[str] = GIVEN_NAMES, titles: list[str] = TITLES, least: float = 0.5) -> DataFrame:
    """Per input row the ``keep`` columns, ``base`` and ``spans``: arrays of struct<start, kind_no, end, kind>.

    Offsets count code points; ``end`` is exclusive; order is by start, then by KINDS.  ``spans`` has the base spans and
    the candidates that the trained classifier gives at least ``least``.  Null and empty texts have no spans.  Repeated
    rows stay; other columns are dropped; ``keep`` must not hold the new names.
    """
    if clash := set(keep) & {"base", "spans", "__text", "__more", *(f"__{k}" for k in BASE)}:
        raise ValueError(f"clashing names: {sorted(clash)}")
    work = _candidates(with_base(df.select(*keep, df[text].alias("__body")), "__body"), names, titles)
    # the spans are wanted twice, the texts are searched once
    work = stored(work.select(*keep, *(f"__{k}" for k in BASE), "__more"))
    models = train(work)
    row = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.concat(*(F.transform(f"__{k}", row(k)) for k in BASE))

    def chosen(kind):
        intercept, weights = models[kind]
        score = lambda c: F.lit(intercept) + sum((c["features"][i] * w for i, w in enumerate(weights)), F.lit(0.0))
        return F.transform(F.filter("__more", lambda c: (c["kind"] == kind) & (score(c) >= math.log(least / (1 - least)))), row(kind))

    more = [chosen(k) for k in models]
    return work.select(*keep, F.array_sort(base).alias("base"), F.array_sort(F.concat(base, *more)).alias("spans"))


def shown(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The columns of the contract."""
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(doc_id, *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
