"""Secret scans with a random forest that removes false positives, by DataFrame functions only.

A candidate is a value of six or more signs assigned to a secret's name, the password of a connection string, a key in an
issuer's format, or a run of 16 or more key characters with a digit.  A random forest decides which are secrets by their
length, character transitions, shares of kinds of characters, dictionary coverage, path and neighbouring words.

It is trained on labelled findings.  Without a table of them, ``labelled`` makes one by evidence that the forest does not
see: issuers' formats, the syntax of assignments and connection strings, check digits of cards, forms of identifiers,
placeholders, calls and references of code, and words that name checksums right before a value.  Candidates without such
evidence have no label; the forest decides them by what they share with the others.

The trained trees become one column expression, so scanning is a projection: whole texts, no shuffle, no driver data.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .common import running, settled, stored

SECRET_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: The password's place in a connection string.
CONNECTION = r"://[^\s:/@\"']{0,64}:"
ASSIGNED = r"(?:" + SECRET_WORDS + r"[\w-]*[\"']?\s*(?:[:=]{1,2}>?)\s*[\"'`]?|" + CONNECTION + ")$"
HARMLESS_WORDS = r"(?i)(?:sha-?1|sha-?256|md5|checksum|digest|commit|revision|etag|uuid|isbn|order|invoice|ticket)[\w-]*\W{0,4}$"
#: Formats that issuers publish for their keys.
FORMATS = r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
ISSUED = f"^{FORMATS}$"
#: Lookbehinds go from cheap to dear: most places are ruled out by the sign before them.
CANDIDATE = "|".join([
    # a value assigned to a secret's name: to the closing quote, or to a blank or a sign that ends values
    r"(?<=[:=>\s\"'`])(?<=[:=]>?[ \t]{0,3}[\"'`]?)(?<=(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or))[\w-]{0,24}[\"']?[ \t]{0,3}[:=]{1,2}>?[ \t]{0,3}[\"'`]?)"
    r"(?:(?<=[\"'`])[^\s\"'`]{6,}+(?=[\"'`])|[^\s\"'`,;&)}\]<>=:][^\s\"'`,;&)}\]<>]{5,}+)",
    # the password of a connection string
    r"(?<=:)(?=[^\s/@\"']{1,256}@)(?<=" + CONNECTION + r")[^\s/@\"']+",
    r"(?<![A-Za-z0-9+/_-])" + FORMATS + r"(?![A-Za-z0-9+/_-])",
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
])
#: A text without any of these holds no candidate.
GATE = r"[0-9:=]|AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza"
#: Names and calls of code, references and plain words: not the secret itself.
PLAIN = r"^(?:[A-Za-z_]+(?:(?:[._:-]|->)+[A-Za-z_]*)*(?:[(\[].*)?|[$%<{(@].*|[A-Za-z+]+://[^@]*)$"
PLACEHOLDER = r"(?i)(?:example|sample|dummy|changeme|your|xxxx|placeholder|test|foobar|0123456|abcdef0|1234567890)|(.)\1{5}"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:test|tests|spec|example|examples|sample|fixture|fixtures|doc|docs|mock)(?:[/_.-]|$)"
DICTIONARY = "the|and|ing|ion|for|with|user|name|data|file|image|http|https|www|com|org|html|static|assets|version|release|build|index|page|title|default|config|server|client|public|module|package|component|service|request|response|content|style|color|width|height|function|return|value|number|string|example|sample|dummy|changeme|your|placeholder|test|foobar|here|insert|todo|null|none"
#: What the forest sees.
FEATURES = ["length", "transitions", "digit_share", "lower_share", "upper_share", "vowel_share", "distinct_share", "sign_share", "longest_word", "dictionary", "path_depth", "test_path", "code_path", "secret_near", "harmless_near", "words_before", "ends_before", "quoted"]
#: What labels are made of; none of it is a feature.
EVIDENCE = ["issued", "assigned", "connection", "harmless_word", "placeholder", "card", "identifier", "plain", "words"]
NEAR_HARMLESS = r"(?i)\b(?:sha|md5|crc|checksum|digest|hash|commit|revision|rev|etag|uuid|guid|isbn|order|invoice|ticket|version|build|card|image|file)"
CODE_PATH = r"(?i)\.(?:py|js|ts|java|go|rb|php|c|cc|cpp|cs|rs|sh|ya?ml|json|toml|ini|env|cfg|conf|properties)$"
IDENTIFIER = r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9-]+|[A-Za-z+/_-]+(?:/[A-Za-z0-9+_-]+){2,})$"
MASK = "<SECRET>"


def features(value: Column, before: Column, path: Column) -> Column:
    n = F.length(value).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n  # noqa: E731  what is left
    yes = lambda c: c.cast("double")
    made = {
        "length": n,
        "transitions": F.length(F.regexp_replace(value, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / n,
        "digit_share": share("[^0-9]"),
        "lower_share": share("[^a-z]"),
        "upper_share": share("[^A-Z]"),
        "vowel_share": share("[^aeiouAEIOU]"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
        "sign_share": share("[A-Za-z0-9]"),
        "longest_word": F.coalesce(F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda w: F.length(w))), F.lit(0)) / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n,
        "path_depth": F.length(F.regexp_replace(path, "[^/]", "")).cast("double"),
        "test_path": yes(path.rlike(TEST_PATH)),
        "code_path": yes(path.rlike(CODE_PATH)),
        "secret_near": yes(before.rlike(SECRET_WORDS)),
        "harmless_near": yes(before.rlike(NEAR_HARMLESS)),
        "words_before": F.size(F.split(F.trim(before), "[^A-Za-z]+")).cast("double"),
        "ends_before": yes(before.rlike("[.!?,;] *$")),
        "quoted": yes(before.rlike("[\"'`]$")),
    }
    return F.array(*(made[k] for k in FEATURES))


def evidence(value: Column, before: Column) -> Column:
    digits = F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(digits, lambda d, i: d.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0))
    made = {
        "issued": value.rlike(ISSUED),
        "assigned": before.rlike(ASSIGNED),
        "connection": before.rlike(CONNECTION + "$"),
        "harmless_word": before.rlike(HARMLESS_WORDS),
        "placeholder": value.rlike(PLACEHOLDER),
        "card": value.rlike("^[0-9]{12,19}$") & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0),
        "identifier": value.rlike(IDENTIFIER),
        "plain": value.rlike(PLAIN) & ~(before.rlike("[\"'`]$") & value.rlike("[0-9]")),
        "words": F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) < 0.4 * F.length(value),
    }
    return F.array(*(F.coalesce(made[k], F.lit(False)) for k in EVIDENCE))


def rule_label(e: Column) -> Column:
    """1.0 for a secret, 0.0 for a harmless value, null where the evidence does not tell."""
    at = lambda name: e[EVIDENCE.index(name)]
    harmless = at("placeholder") | at("harmless_word") | at("card") | at("words") | (at("identifier") & ~at("assigned") & ~at("connection")) | (at("plain") & ~at("connection") & ~at("issued"))
    return F.when(harmless, 0.0).when(at("issued") | at("connection") | (at("assigned") & ~at("identifier")), 1.0)


def candidates(df: DataFrame, text: str, keep: list[str], path: str | None, with_evidence: bool) -> DataFrame:
    """Adds __gaps, __found (texts between and of the candidates), __f (features of each) and __e (evidence of each)."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    gate = body.rlike(GATE)
    cut = settled(df, keep, {"__found": F.when(gate, F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0))).otherwise(none), "__gaps": F.when(gate, F.split(body, CANDIDATE, -1)).otherwise(F.array(body)), "__path": F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")})
    near = F.transform("__gaps", lambda g: F.regexp_replace(F.right(g, F.lit(60)), r"\s+", " "))
    cut = settled(cut, [*keep, "__found", "__gaps", "__path"], {"__near": near})
    made = {"__f": F.zip_with("__found", F.slice("__near", 1, F.size("__found")), lambda x, b: features(x, b, F.col("__path")))}
    if with_evidence:
        made["__e"] = F.zip_with("__found", F.slice("__near", 1, F.size("__found")), evidence)
    return settled(cut, [*keep, "__found", "__gaps"], made)


def variants(value: Column, before: Column, label: Column) -> Column:
    """A labelled finding and what it would be with another value: array<struct<value, before, label>>.

    In a secret's place (label 1) a placeholder, an identifier, a name made of words and a reference of code are harmless;
    in a harmless place (label 0) a key in an issuer's format is a secret, and so is a random value once it is assigned to a
    secret's name.  So neither the place alone nor the value alone tells the label.
    """
    m, h = F.md5(value.cast("binary")), F.sha2(value.cast("binary"), 256)
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (F.conv(F.substring(m, at, 2), 16, 10).cast("int") % len(words) + 1))
    one = lambda v, b, y: F.struct(v.alias("value"), b.alias("before"), F.lit(y).alias("label"))
    uuid = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    placeholder = F.concat(pick(["changeme", "example", "your_", "placeholder", "dummy-", "test", "sample_"], 1), pick(["", "123", "_here", "-value", "1234", "key", "_1"], 3))
    words = F.concat_ws("-", pick(["default", "client", "service", "public", "server"], 5), pick(["config", "request", "module", "name"], 7), pick(["value", "string", "version", "data"], 9), F.conv(F.substring(m, 11, 1), 16, 10))
    code = F.concat(pick(["os.environ", "config.get", "settings", "process.env", "getToken"], 13), pick([".SECRET_KEY", "('token')", "[\"password\"]", ".api_key", ".value"], 15))
    random = F.regexp_replace(F.base64(F.unhex(F.substring(h, 1, 48))), "[+/=]", "x")
    issued = F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(h, "0189", "QZRT"), 1, 16)))
    github = F.concat(F.lit("ghp_"), F.substring(F.concat(random, random), 1, 36))
    assigned = F.concat(before, pick([" api_key = ", " token: ", " password=\"", " secret = '", " \"auth_token\": \""], 17))
    own = F.array(F.struct(value.alias("value"), before.alias("before"), label.alias("label")))
    harmless = F.array(*(one(v, before, 0.0) for v in (placeholder, uuid, words, code)))
    secret = F.array(one(issued, before, 1.0), one(github, before, 1.0), one(random, assigned, 1.0), one(h, assigned, 1.0))
    return F.concat(own, F.when(label == 1.0, harmless).otherwise(secret))


def labelled(df: DataFrame, text: str = "text", path: str | None = None, hard: bool = True) -> DataFrame:
    """(features, label) of the candidates that the evidence labels; a table of this form trains the forest.

    With ``hard`` each labelled finding also gives its variants (see there), so that the forest learns what the evidence
    cannot tell it: the tables hold secrets only where a secret's name stands before them.
    """
    df = df.select(text, *([path] if path and path != text else []))
    body, where = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    cut = settled(df.where(body.rlike(GATE)), [], {"__found": F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)), "__gaps": F.split(body, CANDIDATE, -1), "__path": where})
    near = F.transform("__gaps", lambda g: F.regexp_replace(F.right(g, F.lit(60)), r"\s+", " "))
    each = cut.select("__path", F.explode(F.arrays_zip(F.col("__found").alias("value"), near.alias("before"))).alias("x")).where("x.value is not null").select("__path", "x.value", "x.before")
    known = settled(each, ["__path", "value", "before"], {"label": rule_label(evidence(F.col("value"), F.col("before")))}).where("label is not null")
    if hard:
        known = known.select("__path", F.explode(variants(F.col("value"), F.col("before"), F.col("label"))).alias("v")).select("__path", "v.*")
    return known.select(features(F.col("value"), F.right("before", F.lit(60)), F.col("__path")).alias("features"), "label")


def precision_and_recall(findings: DataFrame, least: float = 0.5, **options) -> tuple[float, float, int]:
    """Of a forest trained on four fifths of the labelled findings, measured on the others (by a hash of the features)."""
    findings = stored(findings)
    apart = F.pmod(F.xxhash64("features", F.lit(5)), F.lit(5)) == 0
    forest = train(findings.where(~apart), **options)
    said = probability(forest, F.col("features")) >= least
    r = findings.where(apart).agg(F.count_if(said & (F.col("label") == 1)).alias("both"), F.count_if(said).alias("said"), F.count_if(F.col("label") == 1).alias("true"), F.count("*").alias("n")).first()
    return r["both"] / max(1, r["said"]), r["both"] / max(1, r["true"]), r["n"]


def train(findings: DataFrame, sample: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 7) -> list | None:
    """The forest as nested tuples (feature, threshold, left, right) with P(secret) at the leaves; None without both classes.

    At most about ``sample`` findings of a class are used, chosen by a hash; equal features count together.
    """
    findings = stored(findings.groupBy("features", "label").agg(F.count("*").alias("n")))
    sizes = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("label") == 1.0, min(1.0, sample / sizes[1.0])).otherwise(min(1.0, sample / sizes[0.0]))
    chosen = findings.where(F.pmod(F.xxhash64("features"), F.lit(1 << 20)) < share * (1 << 20))
    totals = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        return None
    weight = F.when(F.col("label") == 1.0, F.col("n") / float(totals[1.0])).otherwise(F.col("n") / float(totals[0.0]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featuresCol="v", featureSubsetStrategy="sqrt")
    data = stored(chosen.select("features", "label", (weight * 1000).alias("weight"))).coalesce(1).sortWithinPartitions("label", "features")
    model = forest.fit(data.withColumn("v", array_to_vector("features")))
    return [_tree(t._call_java("rootNode")) for t in model.trees]


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def probability(forest: list, f: Column) -> Column:
    def of(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        k, at, left, right = node
        return F.when(f[k] <= at, of(left)).otherwise(of(right))

    return sum((of(t) for t in forest[1:]), of(forest[0])) / len(forest)


def scan(df: DataFrame, forest: list | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, least: float = 0.5, masked: str | None = None) -> DataFrame:
    """Per input row the ``keep`` columns, n_candidates and findings: array<struct<start, end, probability>>, in code points.

    Without a forest the labelling evidence decides.  With ``masked``, a column of that name has the text with each secret replaced.
    Null and empty texts have no findings (and stay as they are).  Repeated rows stay; other columns are dropped;
    ``keep`` must not hold the new names.
    """
    new = {"n_candidates", "findings", "__body", "__found", "__gaps", "__near", "__f", "__e", "__p", "__len", "__end", "__path"} | ({masked} if masked else set())
    if clash := set(keep) & new:
        raise ValueError(f"clashing names: {sorted(clash)}")
    extra = [F.col(path).alias("__path_in")] if path else []
    work = candidates(df.select(*keep, F.col(text).alias("__body"), *extra), "__body", [*keep, "__body"], "__path_in" if path else None, not forest)
    judged = F.transform("__f", lambda f: probability(forest, f)) if forest else F.transform("__e", lambda e: F.coalesce(rule_label(e), F.lit(0.0)))
    lengths = F.zip_with("__found", F.slice("__gaps", 1, F.size("__found")), lambda x, g: (F.length(x) + F.length(g)).cast("bigint"))
    work = settled(work, [*keep, "__body", "__found", "__gaps"], {"__p": judged, "__len": lengths})
    work = settled(work, [*keep, "__body", "__found", "__gaps", "__p"], {"__end": running(F.col("__len"))})
    pairs = F.arrays_zip("__found", F.slice("__gaps", 1, F.size("__found")), "__p")
    places = F.filter(F.arrays_zip("__found", "__end", "__p"), lambda z: z["__p"] >= least)
    findings = F.transform(places, lambda z: F.struct((z["__end"] - F.length(z["__found"])).alias("start"), z["__end"].alias("end"), z["__p"].alias("probability")))
    columns = [F.size("__found").cast("bigint").alias("n_candidates"), findings.alias("findings")]
    if masked:
        rebuilt = F.concat(F.array_join(F.transform(pairs, lambda z: F.concat(z["1"], F.when(z["__p"] >= least, F.lit(MASK)).otherwise(z["__found"]))), ""), F.element_at("__gaps", -1))
        columns.append(F.when(F.exists("__p", lambda p: p >= least), rebuilt).otherwise(F.col("__body")).alias(masked))
    return work.select(*keep, *columns)


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    places = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(doc_id, "n_candidates", F.size("findings").cast("bigint").alias("n_secrets"), places.alias("spans"))
