"""Language-model scores by a hierarchical Pitman-Yor process.

Each previous token has a restaurant of its own; all of them share a parent, the restaurant of words, whose base is the
spelling: a word's base probability is the product of its bytes' probabilities, each in the restaurant of the two bytes
before it, whose parent is that of the one byte before, whose parent is the one without context, whose base is uniform.
Customers of a parent are the tables of its children.  A text begins in the context of the end token.

Seating is sampled by Gibbs: the number of tables of a dish is drawn given its customers, the other tables of its
restaurant and the parent's probability (generalised Stirling numbers; for many customers by their saddle
points).  Draws of a sweep see the seating of the sweep before; each depends on the dish, its context and the sweep only,
so a task that runs again, or other partitions, give the same.  The predictive probabilities are averaged over the
samples after ``burn_in``.

1. Tasks cut texts into windows of some million tokens and number their words.  Words are counted by one shuffle.
2. Windows send their distinct pairs of tokens, counted, to buckets by hash; a bucket adds them up.  Pairs seen once have
   one table; the others are seated sweep by sweep.  Sums of tables go to the words, whose seating gives the next sweep's
   probabilities.
3. Buckets answer the windows with what each pair adds; windows sum up their texts.

What is broadcast is bounded: the spelling table has a row of 256 values per context, of which there are 256^2, and at
most ``frequent`` words have their values sent along.  All other words find theirs by joins.  No key is hot: pairs are
spread by the hash of both words.  Words are told apart by 64-bit hashes (two of a billion clash with probability 0.03).
"""

from __future__ import annotations

import gc
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, map_batches, ship, stored, sub_batches
from .piece_codec import WordTable

#: A-Z to a-z; the blanks of the contract separate tokens.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
END = b""  # the token that ends a text
PAD = 32  # stands before a word and ends it
#: Customers up to which the numbers of tables are drawn by exact weights; tables that are weighed beyond.
SMALL = 256
GRID = 64
#: Random numbers by place and byte, of which a word's hash is made; longer words are hashed as a whole.
PLACES = 64
NUMBERS = np.random.default_rng(20240301).integers(0, 1 << 64, PLACES * 256, np.uint64)
#: Hashes are above all numbers of frequent words.
LEAST_KEY = np.uint64(1 << 24)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


END_KEY = np.uint64(0xE4D0000000000001)


def word_keys(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    n = np.minimum(size, PLACES)
    upto = np.cumsum(n)
    place = np.arange(int(upto[-1])) - np.repeat(upto - n, n)
    keys = np.add.reduceat(NUMBERS[place * 256 + raw[place + np.repeat(begin, n)]], upto - n)
    for k in np.flatnonzero(size > PLACES).tolist():
        keys[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    keys = mixed(keys)
    return np.where(keys < LEAST_KEY, keys | np.uint64(1 << 63), keys)


def tokens_of(texts: list[bytes | None]):
    """(key of each token, tokens by text, bytes of all texts, begin and end of their words)."""
    texts = [x or b"" for x in texts]
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(LOWER), np.uint8)
    blank = BLANK[raw]
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_of = np.searchsorted(np.cumsum(sizes + 1) - sizes - 1, begin, "right") - 1
    own = word_keys(raw, begin, end)
    keys = np.full(len(own) + len(texts), END_KEY)
    keys[np.arange(len(own)) + text_of] = own
    return keys, np.bincount(text_of, minlength=len(texts)) + 1, raw, begin, end


def slices(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of the words as an Arrow array."""
    n = end - begin
    ends = np.cumsum(n)
    flat = raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - n), n)]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])


def packed(a: np.ndarray) -> bytes:
    """An array as bytes: first all lowest bytes, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def uniform(keys: np.ndarray, *numbers: int) -> np.ndarray:
    """A number in (0, 1) for each key and these numbers."""
    for k in numbers:
        keys = mixed(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((keys >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


@lru_cache(64)
def log_stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t), c and t to SMALL."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, SMALL):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            stay = np.where(t <= n, np.log(np.maximum(n - d * t, 1e-300)) + out[n, t], -np.inf)
        out[n + 1, t] = np.logaddexp(stay, out[n, t - 1])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1 or more."""
    below = np.where(x < 9, np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7), 0.0)
    x = np.where(x < 9, x + 8, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - below


class Saddle:
    """S_d(c, t) is c! / (t! d^t) times the coefficient of x^c in f(x)^t, f(x) = 1 - (1-x)^d; its saddle point is where
    g = x f'/f is c / t.  With y = 1 - x, in logarithms, so that y may be tiny."""

    def __init__(self, log_y: np.ndarray, d: float):
        self.log_y, self.y = log_y, np.exp(log_y)
        self.x = -np.expm1(log_y)
        self.f = -np.expm1(d * log_y)
        self.g = d * self.x * np.exp((d - 1) * log_y) / self.f
        self.slope = np.maximum(self.g * (1 + self.x * (1 - d) / self.y - self.g), 1e-12)  # x g'


def bisected(wants_more, n: int, rounds: int = 50) -> np.ndarray:
    """log y of n points; wants_more tells for a trial where y must be larger."""
    low, high = np.full(n, -300.0), np.full(n, -1e-9)
    for _ in range(rounds):
        middle = (low + high) / 2
        up = wants_more(middle)
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def log_stirling_of_many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """By the saddle point; up to a factor that hardly depends on t."""
    s = Saddle(bisected(lambda at: Saddle(at, d).g > c / t, len(c)), d)
    return log_gamma(c + 1.0) - log_gamma(t + 1.0) - t * np.log(d) + t * np.log(s.f) - c * np.log(s.x) - 0.5 * np.log(t * s.slope)


@lru_cache(64)
def saddle_error(d: float) -> np.ndarray:
    """What the saddle point lacks for t = 1, 2, ... GRID, at c = SMALL."""
    t = np.arange(1.0, GRID + 1)
    return log_stirling(d)[SMALL, 1 : GRID + 1] - log_stirling_of_many(np.full(GRID, float(SMALL)), t, d)


def draw_many(c: np.ndarray, others: np.ndarray, log_p: np.ndarray, d: float, strength: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables of dishes with more than SMALL customers: where few are likely by their weights, else by the normal
    distribution at the weights' mode."""
    a = others + strength / d
    p = np.exp(np.maximum(log_p, -600))

    def beyond(at):  # is the weight still growing at the t of this point?
        s = Saddle(at, d)
        t = c / s.g
        return s.f * (t + a - 0.5) * p > t + 0.5

    s = Saddle(bisected(beyond, len(c)), d)
    mode = np.clip(c / s.g, 1.0, c)
    spread = 1 / np.maximum(s.g**2 / (mode * s.slope) + 1 / (mode + 0.5) - 1 / (mode + np.maximum(a, 0.6) - 0.5), 1e-9)
    t = np.clip(np.rint(mode + np.sqrt(spread) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)), 1, c).astype(np.int64)
    few = np.flatnonzero(mode < GRID / 4)
    for at in np.array_split(few, len(few) * GRID // 1_000_000 + 1):
        if len(at):
            k = np.tile(np.arange(1.0, GRID + 1), len(at))
            weight = (log_stirling_of_many(np.repeat(c[at].astype(float), GRID), k, d)).reshape(len(at), GRID) + saddle_error(d)
            weight += np.cumsum(np.log(strength + d * (others[at][:, None] + np.arange(GRID))) + log_p[at][:, None], 1)
            t[at] = 1 + picked(weight, u[at])
    return t


def picked(weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column of each row, drawn by its log weight with a uniform number."""
    upto = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
    return (u[:, None] * upto[:, -1:] > upto[:, :-1]).sum(1)


def draw_tables(c: np.ndarray, others: np.ndarray, log_p: np.ndarray, d: float, strength: float, stirling: np.ndarray, keys: np.ndarray, number: int) -> np.ndarray:
    """Tables of dishes with c customers, where ``others`` counts the tables of the restaurant's other dishes and log_p is
    the parent's log probability of the dish: P(t) is in proportion to S_d(c, t) times the chances that t tables open."""
    t = np.minimum(c, 1).astype(np.int64)
    u = uniform(keys, number)
    order = np.argsort(c, kind="stable")
    kinds, begin = np.unique(c[order], return_index=True)
    for n, whole in zip(kinds.tolist(), np.split(order, begin[1:])):
        if 1 < n <= SMALL:
            for at in np.array_split(whole, len(whole) * n // 1_000_000 + 1):
                if len(at):
                    opened = np.cumsum(np.log(strength + d * (others[at][:, None] + np.arange(n))) + log_p[at][:, None], 1)
                    t[at] = 1 + picked(stirling[n, 1 : n + 1] + opened, u[at])
    at = np.flatnonzero(c > SMALL)
    if len(at):
        t[at] = draw_many(c[at], others[at], log_p[at], d, strength, u[at], uniform(keys[at], number, 1))
    return t


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all words with their blanks, and where each word begins."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    own = np.diff(at)
    n = own + 3
    first = np.cumsum(n) - n
    flat = np.full(int(n.sum()), PAD, np.int64)
    flat[np.arange(len(data)) + np.repeat(first + 2 - (at[:-1] - at[0]), own)] = data
    code = np.zeros(len(flat), np.int64)
    code[2:] = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    keep = np.ones(len(flat), bool)
    keep[first] = keep[first + 1] = False
    return code[keep], np.cumsum(n - 2) - (n - 2)


class Spelling:
    """log P(byte | two bytes): a row of 256 values for each context seen; the others share the row of their last byte."""

    def __init__(self, root: np.ndarray):
        self.rows = [np.log(root).astype(np.float32)]
        self.slot = np.zeros(1 << 16, np.int32)

    def add(self, last: int, first: np.ndarray, p: np.ndarray) -> None:
        """p: the row of the last byte, then one for each first byte."""
        at = len(self.rows)
        self.rows += list(np.log(p))
        self.slot[last::256] = at
        self.slot[first.astype(np.int64) << 8 | last] = at + 1 + np.arange(len(first))

    def packed(self) -> "Spelling":
        self.rows = np.stack(self.rows)
        return self

    def log_p(self, code: np.ndarray) -> np.ndarray:
        return self.rows[self.slot[code >> 8], code & 255]


def _spelling(root: np.ndarray, number: int, burn_in: int = 3, rounds: int = 8, strength: float = 1.0):
    """Gibbs over the restaurants whose context ends in one byte; returns P(byte | context) and the tables for the root."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("code")
        last = int(rows["last"].iloc[0])
        code = rows["code"].to_numpy()
        seen, a = np.unique(code >> 16, return_inverse=True)
        s, c = code & 255, rows["c"].to_numpy()
        keys, keys1 = mixed(code.astype(np.uint64)), mixed((np.arange(256) << 8 | last).astype(np.uint64) + np.uint64(1 << 32))
        d2 = discount((c == 1).sum(), (c == 2).sum())
        s2 = log_stirling(d2)
        total2 = np.bincount(a, c, len(seen))
        t2 = np.minimum(c, 1).astype(np.int64)
        c1 = np.bincount(s, t2, 256).astype(np.int64)
        d1 = discount((c1 == 1).sum(), (c1 == 2).sum())
        s1 = log_stirling(d1)
        t1 = np.minimum(c1, 1)
        mean = np.zeros((1 + len(seen), 256))
        for k in range(rounds):
            p1 = (c1 - d1 * t1 + (strength + d1 * t1.sum()) * root) / (strength + c1.sum())
            tables = np.bincount(a, t2, len(seen))
            t2 = draw_tables(c, tables[a] - t2, np.log(p1[s]), d2, strength, s2, keys, number * 100 + k)
            c1 = np.bincount(s, t2, 256).astype(np.int64)
            t1 = draw_tables(c1, t1.sum() - t1, np.log(root), d1, strength, s1, keys1, number * 100 + k)
            if k >= burn_in:
                tables = np.bincount(a, t2, len(seen))
                p1 = (c1 - d1 * t1 + (strength + d1 * t1.sum()) * root) / (strength + c1.sum())
                p2 = (strength + d2 * tables)[:, None] * p1[None]
                np.add.at(p2, (a, s), c - d2 * t2)
                mean += np.concatenate([p1[None], p2 / (strength + total2)[:, None]])
        mean /= rounds - burn_in
        return pd.DataFrame({"last": [last], "first": [seen.astype(np.uint8).tobytes()], "p": [mean.astype(np.float32).tobytes()], "tables": [t1.astype(np.int64).tobytes()]})

    return run


def spelling_table(trigrams: DataFrame, root: np.ndarray, number: int) -> tuple[Spelling, np.ndarray]:
    """(probabilities, next root) from (code, c) counts; at most 256^2 rows of 256 values come to the driver."""
    grouped = trigrams.withColumn("last", F.shiftright("code", 8).bitwiseAND(255)).repartition(32, "last").groupBy("last").applyInPandas(_spelling(root, number), "last int, first binary, p binary, tables binary")
    table = Spelling(root)
    customers = np.zeros(256, np.int64)
    for r in sorted(grouped.collect(), key=lambda r: r["last"]):
        table.add(r["last"], np.frombuffer(r["first"], np.uint8), np.frombuffer(r["p"], np.float32).reshape(-1, 256))
        customers += np.frombuffer(r["tables"], np.int64)
    d = 0.5
    others = np.count_nonzero(customers) - np.minimum(customers, 1)
    t = draw_tables(customers, others, np.full(256, np.log(1 / 256)), d, 1.0, log_stirling(d), mixed(np.arange(256, dtype=np.uint64)), number)
    root = (customers - d * t + (1.0 + d * t.sum()) / 256) / (1.0 + customers.sum())
    return table.packed(), root


WINDOW_FIELDS = "held array<boolean>, sizes array<int>, tokens binary, keys array<bigint>, words array<binary>, c array<int>, n array<int>"


def windows(df: DataFrame, doc_id: str, text: str, held: Column, size: int) -> DataFrame:
    """Texts as numbers of words: rows of about ``size`` tokens with the documents' ids and the window's words, counted in
    training texts (c) and in all (n).  Words are numbered by frequency."""
    kind = dict(df.dtypes)[doc_id]

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held_rows = []

        def row():
            nonlocal number
            ids, out, keys, sizes, seen, words = zip(*held_rows)
            out, keys, sizes = np.concatenate(out), np.concatenate(keys), np.concatenate(sizes)
            known, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            c = np.bincount(at, np.repeat(~out, sizes), len(known)).astype(np.int64)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            every, first = np.unique(np.concatenate([[END_KEY], *seen]), return_index=True)
            bytes_of = pa.concat_arrays([pa.array([END], pa.binary()), *words]).take(pa.array(first[np.searchsorted(every, known[order])]))
            id_ = pa.array([part << 24 | number], pa.int64())
            number += 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            made = [id_, one(pa.concat_arrays(ids)), one(pa.array(out)), one(pa.array(sizes.astype(np.int32))), pa.array([packed(place[at])], pa.binary()), one(pa.array(known[order].view(np.int64))), one(bytes_of), one(pa.array(c[order].astype(np.int32))), one(pa.array(n[order].astype(np.int32)))]
            return pa.RecordBatch.from_arrays(made, names=["window", "ids", *(x.split()[0] for x in WINDOW_FIELDS.split(", "))])

        total = 0
        for whole in batches:
            for batch in sub_batches(whole, 2):
                keys, sizes, raw, begin, end = tokens_of(batch.column(2).cast(pa.binary()).to_pylist())
                own = np.delete(np.arange(len(keys)), np.cumsum(sizes) - 1)  # without the ends
                seen, first = np.unique(keys[own], return_index=True)
                ids = pa.concat_arrays([batch.column(0)])
                held_rows.append((ids, batch.column(1).to_numpy(zero_copy_only=False).astype(bool), keys, sizes, seen, slices(raw, begin[first], end[first])))
                total += len(keys)
                if total >= size:
                    yield row()
                    held_rows.clear()
                    total = 0
        if held_rows:
            yield row()

    base = df.select(df[doc_id].alias("doc_id"), held.alias("held_out"), df[text].alias("text"))
    return map_batches(base, run, f"window bigint, ids array<{kind}>, {WINDOW_FIELDS}")


def flat_lists(df: DataFrame, columns: list[str], names: list[str], schema: str) -> DataFrame:
    """A row for each place of list columns of equal lengths; the first ``len(names) - len(columns)`` columns are repeated."""
    heads = names[: len(names) - len(columns)]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lists = [batch.column(len(heads) + j).slice(k, 1).flatten() for j in range(len(columns))]
                own = [pa.repeat(batch.column(j)[k], len(lists[0])) for j in range(len(heads))]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=names)

    return map_batches(df.select(*heads, *columns), run, schema)


class Dictionary:
    """Numbers of frequent words; a word's code is its number, or its key where it has none."""

    def __init__(self, keys: np.ndarray):
        self.n, self.table = len(keys), WordTable()
        self.table.add(keys)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        found = self.table.find(keys)
        return np.where(found < 0, keys, found.astype(np.uint64))


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(u * np.uint64(0x9E3779B97F4A7C15)) + w * np.uint64(0xC2B2AE3D27D4EB4F))


class WindowPairs:
    """The distinct pairs of a window, dealt out to buckets; the order is the same each time."""

    def __init__(self, tokens: np.ndarray, codes: np.ndarray, buckets: int):
        self.codes = codes
        n = np.int64(len(codes))
        before = np.concatenate([tokens[-1:], tokens[:-1]]).astype(np.int64)  # the last token is an end, too
        self.pairs, self.at = np.unique(before * n + tokens, return_inverse=True)
        self.u, self.w = self.pairs // n, self.pairs % n
        key = pair_keys(self.codes[self.u], self.codes[self.w])
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def window_rows(batches, lists: tuple[str, ...]):
    """Rows as dicts; the columns ``lists`` as Arrow arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c).slice(k, 1).flatten() if c in lists else batch.column(c)[k].as_py() for c in batch.schema.names}


def _with_codes(dictionary):
    """Puts codes in place of keys and leaves the words."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = {c: batch.column(c).slice(k, 1) for c in ("window", "ids", "held", "sizes", "tokens")}
                codes = dictionary.value.codes(batch.column("keys").slice(k, 1).flatten().to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array([packed(codes)], pa.binary())], names=[*own, "codes"])

    return run


def _send_pairs(buckets: int):
    def run(batches):
        for batch in batches:
            for r in window_rows([batch], ("held", "sizes")):
                w = WindowPairs(unpacked(r["tokens"], np.uint32), unpacked(r["codes"], np.uint64), buckets)
                learn = np.repeat(~r["held"].to_numpy(zero_copy_only=False), r["sizes"].to_numpy())
                c = np.bincount(w.at, learn, len(w.pairs)).astype(np.uint32)
                full = np.flatnonzero(np.diff(w.cuts)).tolist()
                parts = [w.order[w.cuts[b] : w.cuts[b + 1]] for b in full]
                made = [pa.array([packed(x[p]) for p in parts], pa.binary()) for x in (w.codes[w.u], w.codes[w.w], c)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([r["window"]] * len(full), pa.int64()), *made], names=["bucket", "window", "u", "w", "c"])

    return run


SEATS = "bucket int, u binary, w binary, c binary, t binary, kept binary"
MERGED = SEATS + ", windows array<bigint>, slots array<binary>, codes array<bigint>, tu array<int>, tw array<int>, ones bigint, twos bigint, rare array<bigint>"


def sums_by_code(u: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, tables in the code's restaurant, tables of the code as a dish)."""
    codes, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    return codes, np.bincount(at[: len(u)], t, len(codes)).astype(np.int32), np.bincount(at[len(u) :], t, len(codes)).astype(np.int32)


def _list(values: np.ndarray, kind) -> pa.Array:
    values = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _merge(frequent: int):
    """Adds up the pairs of a bucket.  Pairs of one customer have one table for good; the others begin with one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("window").to_pylist()
        u, w, c = (np.concatenate([unpacked(r[k], kind) for r in rows]) for k, kind in (("u", np.uint64), ("w", np.uint64), ("c", np.uint32)))
        _, first, at = np.unique(pair_keys(u, w), return_index=True, return_inverse=True)
        total = np.bincount(at, c, len(first)).astype(np.int64)
        many = np.flatnonzero(total > 1)
        slot = np.minimum(total, 1).astype(np.uint32)
        slot[many] = 2 + np.arange(len(many), dtype=np.uint32)
        slot = slot[at]
        cuts = np.cumsum([0, *(int.from_bytes(r["c"][:8], "little") for r in rows)]).tolist()
        seated = first[total > 0]
        codes, tu, tw = sums_by_code(u[seated], w[seated], np.ones(len(seated)))
        u, w, c = u[first[many]], w[first[many]], total[many].astype(np.uint32)
        rare = np.unique(np.concatenate([u, w]))
        one = lambda x: pa.array([packed(x)], pa.binary())
        t = np.ones(len(c), np.uint32)
        made = [pa.array([rows[0]["bucket"]], pa.int32()), one(u), one(w), one(c), one(t), one(t * np.uint32(0)), _list(np.array([r["window"] for r in rows], np.int64), pa.int64())]
        slots = pa.array([packed(slot[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
        made += [pa.ListArray.from_arrays(pa.array([0, len(slots)], pa.int32()), slots), _list(codes, pa.int64()), _list(tu, pa.int32()), _list(tw, pa.int32()), pa.array([int((total == 1).sum())], pa.int64()), pa.array([int((total == 2).sum())], pa.int64()), _list(rare[rare >= frequent], pa.int64())]
        return pa.Table.from_arrays(made, names=[x.split()[0] for x in MERGED.split(", ")])

    return run


class Values:
    """log probability and tables of words by code: of the frequent ones by number, of the others by their sorted keys."""

    def __init__(self, log_p, tables, codes, rare_log_p, rare_tables):
        order = np.argsort(codes)
        self.frequent, self.log_p, self.tables = len(log_p), np.concatenate([log_p, rare_log_p[order]]), np.concatenate([tables, rare_tables[order]])
        self.codes = codes[order]

    def places(self, codes: np.ndarray) -> np.ndarray:
        rare = codes >= np.uint64(self.frequent)
        out = np.where(rare, np.uint64(0), codes).astype(np.int64)
        out[rare] = self.frequent + np.searchsorted(self.codes, codes[rare])
        return out


def _seat_pairs(sent, number: int, d: float, strength: float, keep: bool):
    """One sweep over the pairs of a bucket, given the values of frequent words and those of its rare ones."""

    def run(seats: pa.Table, rare: pa.Table) -> pa.Table:
        log_p, tables = sent.value
        column = lambda k: rare.column(k).to_numpy()
        values = Values(log_p, tables, column("code").view(np.uint64), column("log_p"), column("tables"))
        out = []
        for r in seats.to_pylist():
            u, w, c, t, kept = (unpacked(r[k], kind) for k, kind in zip("u w c t kept".split(), (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32)))
            t = draw_tables(c.astype(np.int64), values.tables[values.places(u)] - t, values.log_p[values.places(w)], d, strength, log_stirling(d), pair_keys(u, w), number).astype(np.uint32)
            one = lambda x: pa.array([packed(x)], pa.binary())
            codes, tu, tw = sums_by_code(u, w, t.astype(np.int64) - 1)  # beyond the first tables
            more = (tu > 0) | (tw > 0)
            made = [pa.array([r["bucket"]], pa.int32()), one(u), one(w), one(c), one(t), one(kept + t if keep else kept), _list(codes[more], pa.int64()), _list(tu[more], pa.int32()), _list(tw[more], pa.int32())]
            out.append(pa.Table.from_arrays(made, names=[x.split()[0] for x in (SEATS + ", codes c, tu c, tw c").split(", ")]))
        return pa.concat_tables(out) if out else pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in "u w c t kept".split()), ("codes", pa.list_(pa.int64())), ("tu", pa.list_(pa.int32())), ("tw", pa.list_(pa.int32()))]).empty_table()

    return run


def _base_logs(words: pa.Array, table: Spelling) -> np.ndarray:
    code, first = codes_of(words)
    return np.add.reduceat(table.log_p(code), first, dtype=np.float64)


class WordLevel:
    """The restaurant of words: discount, strength, and how its dishes are seated under a spelling table."""

    def __init__(self, d: float, strength: float, tables: int, customers: int):
        self.d, self.strength, self.tables, self.customers = d, strength, tables, customers

    def seat(self, codes: np.ndarray, words: pa.Array, c: np.ndarray, table: Spelling, number: int) -> np.ndarray:
        """Tables; the draw depends on the word and the sweep only."""
        return draw_tables(c, np.maximum(self.tables - 1, 0) + 0 * c, _base_logs(words, table), self.d, self.strength, log_stirling(self.d), mixed(codes.view(np.uint64)), number)


def _count_trigrams(level: WordLevel, table, number: int):
    """Seats the words and counts the trigrams of their tables."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, words, c = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            t = level.seat(codes, words, c, table.value, number)
            code, first = codes_of(words)
            n = np.diff(np.append(first, len(code)))
            found, at = np.unique(code, return_inverse=True)
            sums = np.bincount(at, np.repeat(t, n))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums.astype(np.int64))], names=["code", "c"])

    return run


def _rate(level: WordLevel, old, new, tables: int, number: int):
    """(code, log_p, tables): the words' probabilities with the seating of _count_trigrams and the spelling that follows it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, words, c = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            t = level.seat(codes, words, c, old.value, number) if tables else 0 * c
            own = np.log(np.maximum(c - level.d * t, 1e-300))
            base = np.log(level.strength + level.d * tables) + _base_logs(words, new.value)
            log_p = np.where(c > 0, np.logaddexp(own, base), base) - np.log(level.strength + level.customers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_p, pa.float64()), batch.column(3)], names=["code", "log_p", "tables"])

    return run


def _answer(d: float, samples: int):
    """What each pair of a window adds: customers less the discount of its tables, mean over the samples."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                c, kept = unpacked(r["c"], np.uint32), unpacked(r["kept"], np.uint32)
                value = np.concatenate([[0.0, 1 - d], c - d * kept / samples]).astype(np.float32)
                n = len(r["windows"])
                yield pa.RecordBatch.from_arrays([pa.array(r["windows"], pa.int64()), pa.array([r["bucket"]] * n, pa.int32()), pa.array([packed(value[unpacked(x, np.uint32)]) for x in r["slots"]], pa.binary())], names=["window", "bucket", "added"])

    return run


def _score(sent, buckets: int, d: float, strength: float, samples: int, total: int, kinds: int, id_kind: pa.DataType):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(window: pa.Table, rare: pa.Table) -> pa.Table:
        out = []
        for r in window_rows(window.to_batches(), ("ids", "held", "sizes")):
            tokens = unpacked(r["tokens"], np.uint32)
            pairs = WindowPairs(tokens, unpacked(r["codes"], np.uint64), buckets)
            added = np.zeros(len(pairs.pairs))
            for x in r["answers"]:
                added[pairs.order[pairs.cuts[x["bucket"]] : pairs.cuts[x["bucket"] + 1]]] = unpacked(x["added"], np.float32)
            c, log_p, tables = sent.value
            column = lambda k: rare.column(k).to_numpy()
            codes = column("code").view(np.uint64)
            predicted = None
            for s in range(samples):
                values = Values(log_p[s], tables[s], codes, column(f"log_p_{s}"), column(f"tables_{s}"))
                at = values.places(pairs.codes)
                if not s:
                    count = Values(c, c, codes, column("c"), column("c")).log_p[at]
                    below = strength + count[pairs.u]
                rest = np.log((strength + d * values.tables[at][pairs.u]) / below) + values.log_p[at][pairs.w]
                with np.errstate(divide="ignore"):
                    p = np.logaddexp(np.log(added / below), rest)
                predicted = p if predicted is None else np.logaddexp(predicted, p)
            predicted = (predicted - np.log(samples)) / np.log(10)
            sizes = r["sizes"].to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            known = count[tokens]
            made = [np.add.reduceat(known > 0, first, dtype=np.int64), np.full(len(sizes), total), np.add.reduceat(np.log10((known + 1) / (total + kinds + 1)), first), np.add.reduceat(predicted[pairs.at], first)]
            out.append(pa.Table.from_arrays([r["ids"].cast(id_kind), r["held"], pa.array(sizes), *(pa.array(x) for x in made)], names=names))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", id_kind), ("held_out", pa.bool_()), *((k, pa.int64()) for k in names[2:5]), *((k, pa.float64()) for k in names[5:])]).empty_table()

    return run


def _let_go(spark) -> None:
    """Shuffle files of finished steps go when nothing on the driver refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(df: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", sweeps: int = 3, burn_in: int = 1, strength: float = 1.0, frequent: int = 500_000, window: int = 2_000_000, bucket_tokens: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that are not held out.  Null and empty texts hold the end only.  ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)), ``score`` the model's log10 probability of the lower-cased tokens and the end, and
    ``perplexity`` is by token.  Words that training texts lack are spelled by the model.  Without training texts every
    byte is equally likely.  Repeated rows stay and count each; other columns are dropped.
    """
    spark = df.sparkSession
    ship(spark)
    sc = spark.sparkContext
    held = F.coalesce(held_out, F.lit(False))
    kind = dict(df.dtypes)[doc_id]
    whole = stored(windows(df, doc_id, text, held, window), large_rows=True)

    # Words and the dictionary of the frequent ones.
    counted = flat_lists(whole, ["keys", "words", "c", "n"], ["key", "word", "c", "n"], "key bigint, word binary, c int, n int")
    words = stored(counted.groupBy("key").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n")))
    sums = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("n")).first()
    total, kinds, tokens = (int(x or 0) for x in sums)
    level, least, so_far = F.floor(F.log2("n") * 8).cast("int"), 1 << 30, 0
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        so_far += r["count"]
        if so_far > frequent:
            break
        least = r["level"]
    common = words.where(level >= least).select("key", "n").toArrow()
    keys, n = common.column("key").to_numpy().view(np.uint64), common.column("n").to_numpy()
    dictionary = sc.broadcast(Dictionary(keys[np.lexsort((keys, -n))]))
    size = dictionary.value.n
    coded = map_batches(words, _with_code(dictionary), "code bigint, word binary, c bigint")
    texts = stored(map_batches(whole, _with_codes(dictionary), f"window bigint, ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, codes binary"), large_rows=True)
    discard(whole)

    # Pairs.
    buckets = max(1, -(-tokens // bucket_tokens))
    merged = map_batches(texts.select("window", "held", "sizes", "tokens", "codes"), _send_pairs(buckets), "bucket int, window bigint, u binary, w binary, c binary").groupBy("bucket").applyInArrow(_merge(size), MERGED)
    merged = stored(merged, large_rows=True)
    counts = merged.agg(F.sum("ones"), F.sum("twos")).first()
    d = discount(counts[0] or 0, counts[1] or 0)
    fields = "code bigint, tu int, tw int"
    first = flat_lists(merged, ["codes", "tu", "tw"], ["code", "tu", "tw"], fields).groupBy("code").agg(F.sum("tu").alias("tu"), F.sum("tw").alias("tw"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    static = stored(coded.join(first, "code", "left").select("code", "word", "c", zero("tu").alias("tables"), zero("tw").alias("customers")))
    asks = stored(flat_lists(merged, ["rare"], ["bucket", "code"], "bucket int, code bigint"))
    names = [x.split()[0] for x in SEATS.split(", ")]
    seats, slots = stored(merged.select(names), large_rows=True), stored(merged.select("bucket", "windows", "slots"), large_rows=True)
    discard(words, merged)
    del counted, words, coded, first, merged
    _let_go(spark)

    spread = static.agg(F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2), F.count_if(F.col("customers") > 0)).first()
    word_d, tables = discount(spread[0] or 0, spread[1] or 0), int(spread[2] or 0)
    root = np.full(256, 1 / 256)
    spelling = sc.broadcast(Spelling(root).packed())

    def rated(now: DataFrame, number: int) -> DataFrame:
        """Seats the words, then spells them; (code, log_p, tables)."""
        nonlocal root, spelling, tables
        customers = int(now.agg(F.sum("customers")).first()[0] or 0)
        own = WordLevel(word_d, strength, tables, customers)
        old = spelling
        if total:
            trigrams = stored(map_batches(now.where("customers > 0").select("code", "word", "customers"), _count_trigrams(own, old, number), "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c")))
            tables = int(trigrams.where(F.col("code").bitwiseAND(255) == PAD).agg(F.sum("c")).first()[0])  # a word ends once
            table, root = spelling_table(trigrams, root, number)
            discard(trigrams)
            spelling = sc.broadcast(table)
        return stored(map_batches(now.select("code", "word", "customers", "tables"), _rate(own, old, spelling, tables, number), "code bigint, log_p double, tables bigint"))

    def of_frequent(values: DataFrame, columns: list[str]) -> list[np.ndarray]:
        """Columns of the frequent words in the order of their numbers."""
        found = values.where(F.col("code").between(0, size - 1)).select("code", *columns).toArrow()
        order = np.argsort(found.column("code").to_numpy())
        return [found.column(c).to_numpy()[order] for c in columns]

    values, done, samples = rated(static, 0), seats, []
    for number in range(1, sweeps + 1 if total else 1):
        sent = sc.broadcast(of_frequent(values, ["log_p", "tables"]))
        rare = asks.join(values, "code")
        seat = _seat_pairs(sent, number, d, strength, number > burn_in)
        before, done = [values, done], stored(done.select(names).groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(seat, SEATS + ", codes array<bigint>, tu array<int>, tw array<int>"), large_rows=True)
        more = flat_lists(done, ["codes", "tu", "tw"], ["code", "tu", "tw"], fields).groupBy("code").agg(F.sum("tu").alias("tu"), F.sum("tw").alias("tw"))
        now = stored(static.join(more, "code", "left").select("code", "word", (F.col("tables") + zero("tu")).alias("tables"), (F.col("customers") + zero("tw")).alias("customers")))
        values = rated(now, number)
        discard(now, *(x for x in before if x not in samples))
        if number > burn_in:
            samples.append(values)
        del rare, more, now, before
        _let_go(spark)
    samples = samples or [values]

    # Scores.
    final = static.select("code", "c")
    for k, v in enumerate(samples):
        final = final.join(v.select("code", F.col("log_p").cast("float").alias(f"log_p_{k}"), F.col("tables").cast("int").alias(f"tables_{k}")), "code")
    final = stored(final)
    discard(static, asks, *samples)
    del asks, static, values
    _let_go(spark)
    columns = of_frequent(final, ["c", *(f"{x}_{k}" for x in ("log_p", "tables") for k in range(len(samples)))])
    sent = sc.broadcast((columns[0], columns[1 : 1 + len(samples)], columns[1 + len(samples) :]))
    wanted = map_batches(texts.select("window", "codes"), _rare_of(size), "window bigint, code bigint")
    rare = wanted.join(final, "code")
    slots = slots.join(done.select("bucket", "c", "kept"), "bucket")
    answers = map_batches(slots, _answer(d, max(1, sweeps - burn_in)), "window bigint, bucket int, added binary").groupBy("window").agg(F.collect_list(F.struct("bucket", "added")).alias("answers"))
    full = texts.join(answers, "window")
    id_kind = texts.select(F.col("ids")[0].alias("x")).limit(0).toArrow().schema.field("x").type
    run = _score(sent, buckets, d, strength, len(samples), total, kinds, id_kind)
    scored = full.groupBy("window").cogroup(rare.groupBy("window")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _with_code(dictionary):
    def run(batches):
        for batch in batches:
            codes = dictionary.value.codes(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(1), batch.column(2)], names=["code", "word", "c"])

    return run


def _rare_of(frequent: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                codes = unpacked(batch.column(1)[k].as_py(), np.uint64)
                codes = codes[codes >= np.uint64(frequent)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(codes)), pa.array(codes)], names=["window", "code"])

    return run
