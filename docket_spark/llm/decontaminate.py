"""Benchmark decontamination with an FM-index over each shard of training text.

A shard is what a task holds at a time (about 1 MB of text).  Its words are numbered by the vocabulary of the benchmark.
Stretches whose neighbouring words stand side by side in no benchmark item cannot hold a window, so only the others
("runs") are indexed, each distinct run once.  The index is a suffix array by prefix doubling, its Burrows-Wheeler
transform in a wavelet matrix, and sampled suffix positions.  All windows are searched backwards at once; occurrences
are located by walking to a sampled position, and overlapping ones are merged to removal spans.

The benchmark is read in blocks of at most ``block_bytes`` of text.  Blocks are broadcast and handled one after another,
so a benchmark of any size fits, and documents are never shuffled.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, sub_batches

#: A-Z to a-z; 0-9, a-z and all bytes of non-ASCII characters stay; the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
FILTER_BITS = 1 << 22
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA77) % FILTER_BITS


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        self.adjacent = np.zeros(FILTER_BITS, bool)
        windows: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + n]), set()).add(number[name])
            a = np.array(ids, np.int64)
            self.adjacent[pair_slot(a[:-1], a[1:])] = True
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in windows:
            by_length.setdefault(len(w), []).append(w)
        #: By length: the windows as rows, and their items as (row offsets, items).
        self.windows = {m: (np.array(ws, np.int64), np.concatenate([[0], np.cumsum([len(windows[w]) for w in ws])]), np.array([i for w in ws for i in sorted(windows[w])], np.int64)) for m, ws in by_length.items()}
        self.shortest = min(by_length, default=0)


class FMIndex:
    """Of runs of symbols from 1 on; a separator follows each run."""

    def __init__(self, runs: list[np.ndarray], symbols: int):
        self.run_at = np.cumsum([0, *(len(r) + 1 for r in runs)])
        n = int(self.run_at[-1])
        text = np.zeros(n, np.int64)
        separators = self.run_at[1:] - 1
        keep = np.ones(n, bool)
        keep[separators] = False
        text[keep] = np.concatenate(runs)
        rank = text + len(runs) - 1  # the separators differ and come first
        rank[separators] = np.arange(len(runs))
        key, step = rank, 0
        while True:
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            if rank[order[-1]] == n - 1:
                break
            step = step * 2 or 1
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
        last = text[order - 1]
        self.last = last
        self.first_of = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = []
        x = last
        for level in range(max(1, symbols.bit_length()) - 1, -1, -1):
            bit = (x >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((level, ones, n - int(ones[-1])))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled = sampled
        self.sample_no = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i of the transform."""
        low = np.zeros_like(i)
        for level, ones, zeros in self.levels:
            bit = (c >> level) & 1
            a, b = ones[low], ones[i]
            low, i = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, i - b)
        return i - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``phrases`` that occur, and the bounds of their suffixes."""
        live = np.arange(len(phrases))
        c = phrases[:, -1]
        low, high = self.first_of[c], self.first_of[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            there = low < high
            live, low, high = live[there], low[there], high[there]
            if not len(live):
                break
            c = phrases[live, k]
            both = self.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.first_of[c] + both[: len(c)], self.first_of[c] + both[len(c) :]
        there = low < high
        return live[there], low[there], high[there]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            c = self.last[at[todo]]
            at[todo] = self.first_of[c] + self.rank(c, at[todo])
            walked[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.samples[self.sample_no[at]] + walked


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... n[0] of them, then those of begin[1]."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - n), n)


def occurrences(p: Phrases, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, item) of each window found; words are counted over all texts."""
    none = np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    get = p.vocabulary.get
    ids = np.concatenate([none, *(np.fromiter(map(get, x, repeat(0)), np.int64, len(x)) for x in texts)])
    if not len(ids) or not p.shortest:
        return none, none, none
    ends = np.cumsum(sizes)
    chained = np.zeros(len(ids), bool)  # with the word before
    chained[1:] = (ids[1:] > 0) & (ids[:-1] > 0)
    chained[ends[:-1][ends[:-1] < len(ids)]] = False
    at = np.flatnonzero(chained)
    chained[at] = p.adjacent[pair_slot(ids[at - 1], ids[at])]
    begin = np.flatnonzero((ids > 0) & ~chained)
    stop = np.flatnonzero((ids > 0) & ~np.append(chained[1:], False)) + 1
    long = stop - begin >= p.shortest
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return none, none, none
    number: dict[bytes, int] = {}
    run_of = np.array([number.setdefault(ids[a:b].tobytes(), len(number)) for a, b in zip(begin.tolist(), stop.tolist())])
    runs = [np.frombuffer(x, np.int64) for x in number]
    by_run = np.argsort(run_of, kind="stable")
    copies = np.bincount(run_of, minlength=len(runs))
    copy_at = np.cumsum(copies) - copies
    index = FMIndex(runs, len(p.vocabulary))
    found = []
    for m, (windows, item_at, items) in p.windows.items():
        rows, low, high = index.search(windows)
        place = index.locate(spread(low, high - low))
        which = np.repeat(rows, high - low)
        run = np.searchsorted(index.run_at, place, "right") - 1
        inside = place - index.run_at[run]
        n = copies[run]
        first = np.repeat(inside, n) + begin[by_run[spread(copy_at[run], n)]]
        which = np.repeat(which, n)
        n = item_at[which + 1] - item_at[which]
        found.append((np.repeat(first, n), np.full(int(n.sum()), m), items[spread(item_at[which], n)]))
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(first: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a span."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def hit_spans(hit: np.ndarray) -> np.ndarray:
    """Spans (start, end) of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def find(df: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", clean_text: bool = False, block_bytes: int = 32_000_000) -> DataFrame:
    """Per input row the ``keep`` columns and n_words, spans (array of word [start, end), merged), items (ids as text).

    With ``clean_text``, a column of that name has the text without the spans; a line break stands for each.  Words are
    those of whole texts, A-Z lower-cased.  A window is ``n`` words of an item, or a whole shorter item.  Null and empty
    texts have no words and no spans; items without words match nothing; a null item_id counts as "null".  Repeated rows
    stay.  Other columns are dropped; ``keep`` must not hold one of the new names.
    """
    new = ["n_words", "spans", "items", *(["clean_text"] if clean_text else [])]
    if clash := set(keep) & {*new, "__text", "__hits"}:
        raise ValueError(f"clashing names: {sorted(clash)}")
    sc = df.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("null")).alias("name"), benchmark[item_text].alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keep)
    work = df.select(*keep, df[text].alias("__text"), F.lit(None).cast("binary").alias("__hits"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == k)
        phrases = sc.broadcast(Phrases([(r.name, r.body) for r in part.collect()], n))
        run = _scan(phrases, len(keep), list(keep), last=k == blocks - 1, clean_text=clean_text)
        tail = "`__text` string, `__hits` binary, items array<string>" if k < blocks - 1 else "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>" + ", clean_text string" * clean_text
        work = map_batches(work, run, f"{head}, {tail}")
    return work


def _scan(phrases, text_at: int, keep: list[str], last: bool, clean_text: bool):
    def run(batches):
        p = phrases.value
        for whole in batches:
            for batch in sub_batches(whole, text_at):
                raw, before, known = (batch.column(text_at + i).to_pylist() for i in range(3))
                texts = [words_of(x) for x in raw]
                ends = np.cumsum([0, *map(len, texts)])
                first, size, item = occurrences(p, texts)
                hit = merged(first, size, int(ends[-1]))
                doc = np.searchsorted(ends, first, "right") - 1
                pairs = np.unique(doc * max(1, len(p.names)) + item)
                found: dict[int, set[str]] = {}
                for x in pairs.tolist():
                    d, i = divmod(x, max(1, len(p.names)))
                    found.setdefault(d, set()).add(p.names[i])
                hits = []
                for k in range(len(raw)):
                    own = hit[ends[k] : ends[k + 1]]
                    if before[k] is not None:
                        own = own | np.unpackbits(np.frombuffer(before[k], np.uint8), count=len(own)).astype(bool)
                    hits.append(own)
                names = [sorted(found.get(k, set()) | set(known[k])) for k in range(len(raw))]
                columns = [*batch.columns[:text_at]]
                if not last:
                    packed = [np.packbits(h).tobytes() for h in hits]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(text_at), pa.array(packed, pa.binary()), pa.array(names, pa.list_(pa.string()))], names=[*keep, "__text", "__hits", "items"])
                    continue
                spans = [hit_spans(h) if h.any() else () for h in hits]
                columns += [pa.array(np.diff(ends), pa.int64()), pa.array([[{"start": int(a), "end": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))]
                if clean_text:
                    columns.append(pa.array([cut(x, s) if len(s) else x for x, s in zip(raw, spans)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "spans", "items", *(["clean_text"] if clean_text else [])])

    return run


def cut(text: str, spans) -> str:
    """The text without the word spans; each leaves a line break."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.translate(LETTERS))]
    out, at = [], 0
    for a, b in spans:
        out += [raw[at : places[a][0]], b"\n"]
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The columns of the contract."""
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]), F.lit(0))
    return found.select(doc_id, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))

