"""Phrase collocations by Toivonen's method: a sample proposes, full passes count exactly, failures of the border are followed up.

Phrases are runs of words inside a piece of text (between stops and line ends), counted for each language.  A phrase can
only be frequent if what is left without its first and without its last word is.  The sample's frequent phrases are the
proposal; a full pass counts every word, and every longer phrase whose two shorter parts are proposed: those are the
proposed phrases and their negative border.  Frequent ones of the border that were not proposed are its failures: they
join the proposal, and another pass counts the phrases that thereby come into reach, until there are no failures.  The
counts are then complete, whatever the sample held; ``longest`` passes are enough.

A pass knows proposals from bit sets of fixed size, the only thing that is broadcast.  A bit set too full lets phrases
through that need not be counted, never the reverse, so results do not depend on its size.  Tasks cut, look up and count
words as arrays, a few megabytes at a time; counts are summed by Spark before and after the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, stored, sub_batches

CHUNK = 2_000_000  # bytes of text at once
BITS = 26  # a bit set holds 2 ** BITS bits
MASK = np.uint64((1 << BITS) - 1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2

COUNTS = "lang string, size int, phrase string, n bigint"


def _hashes(words) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    x, y = h & MASK, (h >> np.uint64(32)) & MASK
    return ((bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & (bits[y >> np.uint64(6)] >> (y & np.uint64(63))) & one).astype(bool)


def _words(data: np.ndarray):
    """Codes of the words, their dictionary, and the piece each stands in."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.pad(inside.view(np.int8), 1))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else starts
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    coded = text.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, piece


def _chunks(texts: list[str], overlap: int):
    """Pieces of the joined texts as bytes, cut at blanks or stops, and how many words at each one's start were in the one before."""
    whole = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)
    at, ahead = 0, b""
    while at < len(whole):
        end = min(at + CHUNK, len(whole))
        while end < len(whole):  # on to the end of the word
            stop = np.flatnonzero(_KIND[whole[end : end + CHUNK]])
            end = end + int(stop[0]) if len(stop) else min(end + CHUNK, len(whole))
            if len(stop):
                break
        now = ahead + whole[at:end].tobytes()
        yield np.frombuffer(now, dtype=np.uint8), len(ahead.split())
        open_piece = now[max((now.rfind(x) for x in b".,;:!?\n\v\f\r"), default=-1) + 1 :].replace(b"\t", b" ").split(b" ")
        last = [w for w in open_piece if w][-overlap:] if overlap else []
        ahead = b" ".join([*last, b""]) if last else b""
        at = end


def _distinct(key: np.ndarray):
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def _counted(lang: str, texts: list[str], longest: int, before, now, first_pass: bool):
    """(size, phrases, counts) of the phrases of these texts that this pass counts; size 0 stands for all words."""
    seed = _hashes([lang])
    total = 0
    for data, known in _chunks(texts, longest - 1):
        codes, dictionary, piece = _words(data)
        if not len(codes):
            continue
        v = len(dictionary)
        total += len(codes) - known
        h = _mix(_hashes(dictionary.to_pylist()), np.repeat(seed, v))
        if first_pass:
            n = np.bincount(codes[known:], minlength=v)
            used = np.flatnonzero(n)
            yield 1, dictionary.take(pa.array(used)), n[used]
        level, fits = h[codes], np.ones(len(codes), dtype=bool)
        for size in range(2, longest + 1):
            m = len(codes) - size + 1
            if m <= 0:
                break
            fits = fits[:m] & (piece[size - 1 :] == piece[:m])
            use = fits.copy()
            if now is not None:  # both parts are proposed, and were not yet when the last pass ran
                inside = _holds(now[size - 1], level)
                use &= inside[:m] & inside[1 : m + 1]
                if before is not None:
                    inside = _holds(before[size - 1], level)
                    use &= ~(inside[:m] & inside[1 : m + 1])
            use[: max(0, known - size + 1)] = False  # ended in the chunk before
            at = np.flatnonzero(use)
            if len(at):
                key = codes[at]
                for j in range(1, size):
                    if j > 1:
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * v + codes[at + j]
                first, n = _distinct(key)
                parts = [dictionary.take(pa.array(codes[at[first] + j])) for j in range(size)]
                yield size, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), n
            level = _mix(level[:m], h[codes[size - 1 :]])
    if first_pass:
        yield 0, pa.array([""], pa.large_string()), np.array([total])


def _passed(docs: DataFrame, longest: int, before=None, now=None, first_pass: bool = True) -> DataFrame:
    """Counts of one pass over ``docs`` (lang, text).  before, now: broadcast bit sets by size of phrase."""

    def run(batches):
        old, new = before and before.value, now and now.value
        for batch in batches:
            for part in sub_batches(batch, 1, CHUNK):
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                texts = part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    own = [texts[i] for i in np.flatnonzero(langs == lang)]
                    for size, phrases, n in _counted(lang, own, longest, old, new, first_pass):
                        for a in range(0, len(n), 100_000):
                            some = phrases.slice(a, 100_000).cast(pa.string())
                            yield pa.record_batch([pa.array([lang] * len(some)), pa.array(np.full(len(some), size, np.int32)), some, pa.array(n[a : a + 100_000].astype(np.int64))], names=["lang", "size", "phrase", "n"])

    return map_batches(docs, run, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _bits_of(found: DataFrame, longest: int, known=None) -> dict[int, np.ndarray] | None:
    """Bit sets by size of the phrases in ``found`` (lang, size, phrase) shorter than ``longest`` that ``known`` does not hold; None if there are none."""

    def run(batches):
        held = known and known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = _hashes(batch.column(0).to_pylist())
            sizes = batch.column(1).to_numpy()
            words = [p.split(" ") for p in batch.column(2).to_pylist()]
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                level = _mix(_hashes([words[i][0] for i in own]), langs[own])
                for j in range(1, size):
                    level = _mix(level, _mix(_hashes([words[i][j] for i in own]), langs[own]))
                if held:
                    level = level[~_holds(held[size], level)]
                places = np.concatenate([level & MASK, (level >> np.uint64(32)) & MASK])
                block, mask = (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63))
                order = np.argsort(block, kind="stable")
                block, mask = block[order], mask[order]
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                if len(cuts):
                    yield pa.record_batch([pa.array(np.full(len(cuts), size, np.int32)), pa.array(block[cuts]), pa.array(np.bitwise_or.reduceat(mask, cuts).view(np.int64))], names=["size", "block", "mask"])

    # at most (longest - 1) * 2 ** BITS / 64 rows
    rows = map_batches(found.where(F.col("size").between(1, longest - 1)).select("lang", "size", "phrase"), run, "size int, block bigint, mask bigint").groupBy("size", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    if not rows.num_rows:
        return None
    sizes, blocks, masks = (rows.column(i).to_numpy() for i in range(3))
    out = {}
    for size in range(1, longest):
        bits = np.zeros(1 << (BITS - 6), dtype=np.uint64)
        own = sizes == size
        bits[blocks[own]] = masks[own].view(np.uint64)
        out[size] = bits
    return out


def counts(documents: DataFrame, least: int = 10, longest: int = 3, sample: float = 1 / 16, sample_least: int = 2, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times or more in their language, with exact counts, and the number of full passes.

    Returns rows (lang, size, phrase, n); those of size 0 hold the number of all words of a language.  The sample takes
    texts by hash, a share of ``sample``, and proposes what occurs ``sample_least`` times in it; both parameters decide
    how many passes there are and how much they count, not the result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(sample * (1 << 20)))
    empty = {size: np.zeros(1 << (BITS - 6), dtype=np.uint64) for size in range(1, longest)}
    bits = _bits_of(_passed(drawn, longest).where(F.col("n") >= sample_least), longest) or empty
    before, now, passes, parts = None, spark.sparkContext.broadcast(bits), 0, []
    while True:
        found = stored(_passed(docs, longest, before, now, first_pass=not passes).where((F.col("n") >= least) | (F.col("size") == 0)))
        parts.append(found)
        passes += 1
        failed = _bits_of(found, longest, now)
        if before is not None:
            before.unpersist()
        if failed is None:
            break
        before = now
        now = spark.sparkContext.broadcast({size: now.value[size] | failed[size] for size in failed})
    now.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, passes


def collocations(found: DataFrame, covered: int = 50, best: int = 2000) -> DataFrame:
    """The best phrases of two words or more of each language, from counts().

    A phrase of count a, cut into parts of counts l and r, scores floor(1000000 a a / (l r)); the lowest-scoring cut
    counts, of equal ones that with the shortest first part.  Phrases inside a longer one that has ``covered`` percent of
    their count or more are dropped, whether or not the longer one is.  Returns lang, rank (from 1), phrase, a, l, r, n,
    score: the first ``best`` of a language by score, then a, both falling, then phrase by bytes.  Exact up to counts of
    10 ** 16.
    """
    phrases = found.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    parts = found.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    cut = phrases.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cut = cut.join(parts.select("lang", F.col("part").alias("head"), F.col("count").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(18,0))"
    scored = cut.withColumn("score", F.expr(f"{wide('a')} * {wide('a')} * 1000000BD div ({wide('l')} * {wide('r')})"))
    lowest = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = phrases.where("size > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    cover = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = lowest.join(cover, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # the best of each share of a language first, so that no task sorts a whole language
    shares = flat.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    totals = found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(documents: DataFrame, least: int = 10, longest: int = 3, covered: int = 50, best: int = 2000, sample: float = 1 / 16, sample_least: int = 2, text: str = "text", lang: str = "lang") -> DataFrame:
    """Collocations of whole texts (see counts and collocations).

    A null text is empty, a null language ``und``; repeated rows count each time; an empty table gives no rows; other
    columns are not read.
    """
    found, _ = counts(documents, least, longest, sample, sample_least, text, lang)
    return collocations(found, covered, best)


def oracle_sql() -> str:
    """The registered query's rows by plain counting of all phrases."""
    stops = r"[.,;:!?\x0A-\x0D]"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{stops}')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM cut
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM cut),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS c, string_split(phrase, ' ') AS w FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT p.lang, p.phrase, p.size, p.c AS a, k, array_to_string(p.w[1:k], ' ') AS head, array_to_string(p.w[k + 1:], ' ') AS rest
  FROM f p, (VALUES (1), (2)) ks(k) WHERE p.size >= 2 AND k < p.size AND p.c >= 10),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, l.c AS l, r.c AS r, (1000000 * c.a * c.a) // (l.c * r.c) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, c FROM f WHERE size = 3 AND c >= 10),
covered AS (
  SELECT lang, phrase FROM (SELECT lang, phrase, max(c) AS most FROM inner_pairs GROUP BY ALL) JOIN f p USING (lang, phrase) WHERE 100 * most >= 50 * p.c)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM lowest JOIN totals USING (lang) WHERE NOT EXISTS (FROM covered c WHERE c.lang = lowest.lang AND c.phrase = lowest.phrase)
QUALIFY rank <= 2000"""
