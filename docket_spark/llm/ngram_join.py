"""Jaccard self-join of documents on word shingles, with Bayesian pruning of candidate pairs.

1. A document is the set of its five-word shingles, as 64-bit hashes.  Documents with the same set are one class.
2. Each class has MinHash values; bands of them put classes into buckets.  A pair with the least similarity asked for
   misses all buckets with probability (1 - t^rows)^bands, 3e-6 at t = 0.8 with 4 rows and 24 bands.
3. Pairs in a bucket compare their MinHash values a few at a time and drop out as soon as the posterior probability of
   reaching the threshold (uniform prior) is below ``tolerance``.  What survives joins classes to clusters.
4. Within a cluster, pairs are pruned once more and the rest verified on the whole sets.

Large buckets and clusters are dealt out as pairs of chunks, so that no task holds a whole group, and tasks return
counts of links and a spanning forest, never all pairs.  Copies are counted, not expanded.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, ship, stored, sub_batches, worker_state
from .decontaminate import words_of
from .graph import Forest, components

ROWS, BANDS = 4, 24
HASHES = ROWS * BANDS
STEP = 16
_random = np.random.default_rng(20240229)
FACTORS = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
MIX = (_random.integers(0, 1 << 62, 64, dtype=np.uint64) * 2 + 1).astype(np.uint64)
#: Rows of a chunk in a bucket; bytes of sets of a chunk in a cluster.
BUCKET_CHUNK = 1024
CLUSTER_CHUNK_BYTES = 8_000_000
#: Pairs that are compared at a time, and rows of buckets that a call handles.
PAIRS = 100_000
CALL_ROWS = 8192


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text that has words is one shingle."""
    words = [words_of(x) for x in texts]
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in words for w in x), np.uint64, sum(map(len, words)))
    m = max(len(flat) - n + 1, 0)
    full = np.zeros(m, np.uint64)
    for k in range(n):
        full += flat[k : k + m] * MIX[k]
    full = mixed(full)
    out, at = [], 0
    for x in words:
        if len(x) >= n:
            out.append(np.unique(full[at : at + len(x) - n + 1]))
        elif x:
            out.append(mixed(np.array([(flat[at : at + len(x)] * MIX[: len(x)]).sum(dtype=np.uint64) + np.uint64(len(x))])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(x)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of sets that are not empty, 16 bits each, one row per set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * FACTORS[k] + SHIFTS[k], begin) & np.uint32(0xFFFF)
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def fewest_matches(threshold: float, tolerance: float, seen: int) -> int:
    """The fewest equal values among ``seen`` with which a pair stays.

    Values of 16 bits are equal by chance as well, so similarity s shows as q = s + (1 - s) / 65536; after m equal of n
    values and a uniform prior, P(q >= t) is the probability of at most m successes among n + 1 at rate t.
    """
    t = threshold + (1 - threshold) / 65536
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of ``others`` are not dropped when compared with ``one`` step by step."""
    live, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (others[live, part] == one[part]).sum(1)
        stay = equal >= m
        live, equal = live[stay], equal[stay]
        if not len(live):
            break
    return live


def _bucket_links(least: list[int]):
    """Forest of the surviving pairs of many pairs of chunks; a pair is looked at in the first band that it shares only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        worker_state("", lambda: None)
        rows = rows.sort_values(["band", "key", "low", "high", "part", "node"], ignore_index=True)
        node, band = rows["node"].to_numpy(), rows["band"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES)
        keys = [rows[c].to_numpy() for c in ("band", "key", "low", "high")]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], 0)])
        bucket = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(rows))
        low, inside = rows["part"].to_numpy() == rows["low"].to_numpy(), rows["inside"].to_numpy()
        # Row i meets the rows after it in its bucket; across chunks, a row of the low one meets all of the high one.
        ahead = ends[bucket] - np.arange(len(rows)) - 1
        highs = np.bincount(bucket[~low], minlength=len(ends))[bucket]
        meets = np.where(inside, ahead, np.where(low, highs, 0))
        begin = np.where(inside, np.arange(len(rows)) + 1, ends[bucket] - highs)
        forest = Forest(len(rows))
        order = np.flatnonzero(meets)
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(meets[order]) // PAIRS)) + 1) if len(order) else []:
            left = np.repeat(part, meets[part])
            upto = np.cumsum(meets[part])
            right = np.arange(int(upto[-1])) + np.repeat(begin[part] - (upto - meets[part]), meets[part])
            equal, live = np.zeros(len(left), np.int64), np.arange(len(left))
            for k, m in enumerate(least):
                step = slice(k * STEP, (k + 1) * STEP)
                equal = equal[: len(live)] + (sig[left[live], step] == sig[right[live], step]).sum(1)
                stay = equal >= m
                live, equal = live[stay], equal[stay]
            left, right = left[live], right[live]
            same = (sig[left] == sig[right]).reshape(len(left), BANDS, ROWS).all(2)
            first = same.argmax(1) == band[left]
            for i, j in zip(left[first].tolist(), right[first].tolist()):
                forest.link(i, [j])
        return pd.DataFrame({"a": [node[i] for i, _ in forest.kept], "b": [node[j] for _, j in forest.kept]})

    return run


def _cluster_links(threshold: float, least: list[int]):
    """Links of a pair of chunks, verified on the sets: (node, null, count) rows and (node, node, 0) of a forest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        worker_state("", lambda: None)
        rows = rows.drop_duplicates("node")
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES)
        part, node, copies = rows["part"].to_numpy(), rows["node"].to_numpy(), rows["copies"].to_numpy()
        inside = bool(rows["inside"].iloc[0])
        heads = np.arange(len(rows)) if inside else np.flatnonzero(part == part.min())
        tails = np.arange(len(rows)) if inside else np.flatnonzero(part != part.min())
        size = np.array([len(s) for s in sets])
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        begin = ends - size
        flag = np.zeros(len(known), bool)
        count = np.zeros(len(rows), np.int64)
        forest = Forest(len(rows))
        for i in heads.tolist():
            right = tails[tails > i] if inside else tails
            right = right[survivors(sig[i], sig[right], least)]
            if not len(right):
                continue
            own = ids[begin[i] : ends[i]]
            flag[own] = True
            n = size[right]
            inner = np.cumsum(n) - n
            place = np.arange(int(n.sum())) + np.repeat(begin[right] - inner, n)
            both = np.add.reduceat(flag[ids[place]], inner, dtype=np.int64)
            flag[own] = False
            right = right[both >= threshold * (size[i] + n - both) - 1e-9]
            count[i] += copies[right].sum()
            count[right] += copies[i]
            forest.link(i, right)
        linked = np.flatnonzero(count)
        return pd.DataFrame({"a": [node[i] for i in linked] + [node[i] for i, _ in forest.kept], "b": [None] * len(linked) + [node[j] for _, j in forest.kept], "links": [*count[linked].tolist(), *[0] * len(forest.kept)]}, columns=["a", "b", "links"])

    return run


def _chunk_pairs(df: DataFrame, group: str, part, parts) -> DataFrame:
    """Each row once for each pair of chunks (low, high) of its group that its chunk is in."""
    df = df.withColumn("part", part.cast("int")).withColumn("parts", parts.cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    df = df.withColumn("other", other)
    return df.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).withColumn("inside", F.col("low") == F.col("high")).drop("other", "parts")


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, n: int = 5, tolerance: float = 1e-7) -> DataFrame:
    """One row per input row: doc_id, copy_id, class_id, n_links.

    copy_id is the smallest doc_id with the same set of shingles, class_id the smallest reachable over links (similarity
    of at least ``threshold``), n_links the number of other rows linked directly, copies among them.  Rows without words
    (null or empty texts) link with nothing and are their own class.  Repeated rows are copies of each other.  Rows with
    a null doc_id take part; an id is null only if no row of its group has one.
    """
    spark = df.sparkSession
    ship(spark)
    least = [fewest_matches(threshold, tolerance, k * STEP) for k in range(1, HASHES // STEP + 1)]

    def sketch(batches):
        worker_state("", lambda: None)  # models of earlier steps go
        for whole in batches:
            for batch in sub_batches(whole, 1):
                sets = shingle_sets(batch.column(1).to_pylist(), n)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = dict(zip(full, signatures([sets[k] for k in full]))) if full else {}
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sig[k].tobytes() if k in sig else None for k in range(len(sets))], pa.binary()), batch.column(2)], names=["doc_id", "node", "size", "sig", "text_hash"])

    kind = dict(df.dtypes)[doc_id]
    base = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"), F.xxhash64(df[text]).alias("text_hash"))
    rows = stored(map_batches(base, sketch, f"doc_id {kind}, node binary, size bigint, sig binary, text_hash bigint"))
    # The row whose text stands for the class: with the hash, rows that share the doc_id or have none don't all meet.
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    grouped = rows.where("node is not null").groupBy("node").agg(head.alias("head"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = stored(grouped.select("node", F.col("head.doc_id").alias("copy_id"), F.col("head.text_hash").alias("text_hash"), "copies", "size", "sig"))

    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS)).alias("key")) for b in range(BANDS)]))
    keyed = classes.select("node", bands.alias("x")).select("node", "x.band", "x.key")
    # Counting first and joining back lets Spark split a bucket that holds a large part of the rows.
    members = keyed.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = keyed.join(members, ["band", "key"])
    parts = F.ceil(F.col("members") / BUCKET_CHUNK)
    shared = stored(_chunk_pairs(shared, "key", F.pmod(F.xxhash64("node"), parts), parts))
    calls = max(1, -(-shared.count() // CALL_ROWS))  # many small buckets go in one call
    placed = shared.join(classes.select("node", "sig"), "node").withColumn("call", F.pmod(F.xxhash64("band", "key", "low", "high"), F.lit(calls)))
    close = placed.groupBy("call").applyInPandas(_bucket_links(least), "a binary, b binary")
    clusters = components(close)

    in_cluster = classes.join(clusters, "node")
    parts_of = in_cluster.groupBy("component").agg(F.ceil(F.sum(F.col("size") * 8) / CLUSTER_CHUNK_BYTES).alias("part_count"))
    dealt = in_cluster.join(parts_of, "component").withColumn("part_no", F.pmod(F.xxhash64("node"), F.col("part_count")))
    dealt = stored(dealt.select("node", "component", "copy_id", "text_hash", "copies", "sig", "part_no", "part_count"))

    def sets_of(batches):
        for whole in batches:
            for batch in sub_batches(whole, 1):
                sets = shingle_sets(batch.column(1).to_pylist(), n)
                nodes = batch.column(0).to_pylist()
                right = [k for k, s in enumerate(sets) if digest(s) == nodes[k]]  # rows that share the doc_id only are left out
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), pa.array([sets[k].tobytes() for k in right], pa.binary())], names=["node", "shingles"])

    wanted = dealt.select("node", F.col("copy_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    texts = base.join(wanted, base["doc_id"].eqNullSafe(wanted["wanted_id"]) & (base["text_hash"] == wanted["wanted_hash"])).select("node", "text")
    sets = map_batches(texts, sets_of, "node binary, shingles binary")
    full = dealt.join(sets, "node")
    pairs = _chunk_pairs(full, "component", F.col("part_no"), F.col("part_count"))
    found = stored(pairs.groupBy("component", "low", "high").applyInPandas(_cluster_links(threshold, least), "a binary, b binary, links bigint"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null"))
    named = groups.join(classes.select("node", "copy_id"), "node")
    names = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    of_node = named.select("node", "component").join(names, "component").select("node", "class_id")
    known = classes.select("node", "copy_id", "copies").join(links, "node", "left").join(of_node, "node", "left")
    known = known.select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # Stored, so that Spark can split the join at a text with many copies.
    own = rows.select("doc_id", "node").join(stored(known), "node", "left")
    alone = F.col("node").isNull()
    return own.select("doc_id", *(F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("copy_id", "class_id")), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
