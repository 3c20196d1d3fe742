"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a batch lie in one flat array of symbols.  A round finds the best-ranked adjacent pair of every word by a
segmented minimum, merges its occurrences from the left, and closes the gaps; rounds go on until no pair is left.

A merge can create a pair that ranks before the one just merged.  The library takes that new pair first, so a round
merges the occurrences of a word only as far as the first one that creates such a pair.

Words are what merges cannot cross: in this family of models U+2581 stands at the start of pieces only, and characters
that are in no longer piece separate as well.  Equal words have equal ids, so a worker encodes each distinct word of
its cache once.  Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, sub_batches, worker_state

SPACE = "▁"
#: Symbols from here on are characters without a piece of their own.
RAW = 1 << 16
SHIFT = 22
SPACE_BYTES = SPACE.encode()
#: Distinct words and ids that a worker keeps, and how many of the words stay when it is full (those met most).
CACHE_WORDS = 250_000
CACHE_IDS = 4_000_000
CACHE_KEPT = 120_000
#: Bytes of a word that have a factor of their own in its key; longer words are hashed one by one.
PLACES = 4096


class PieceTables:
    """What encoding and decoding need of a BPE ``.model`` file, as plain arrays that can be broadcast."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation and escaped blanks are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.key = hashlib.sha256(model).hexdigest()
        self.dummy_prefix = norm.add_dummy_prefix
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds a blank after its start")
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.byte_fallback = train.byte_fallback
        order = {s: k for k, s in enumerate(sorted({proto.pieces[i].score for i in ids.values()}, reverse=True))}
        rank = {p: order[proto.pieces[i].score] for p, i in ids.items()}
        code = lambda p: ids[p] if p in ids else RAW + ord(p)
        pairs = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (a in ids or len(a) == 1) and (b in ids or len(b) == 1):
                    pairs.append((code(a) << SHIFT | code(b), rank[p], i))
        pairs.sort(key=lambda x: (x[1], x[0]))
        keys, ranks, to = zip(*pairs)
        self.pairs = WordTable()
        self.pairs.add(np.array(keys, np.uint64))
        #: By number of a pair, in the order of ranks: its rank and the piece it makes; the last number stands for no pair.
        self.ranks, self.to = np.array([*ranks, max(ranks) + 1], np.int32), np.array(to, np.int32)
        #: Pieces that can be part of a pair that ranks no later than they do.
        own = np.full(RAW + 1, -1, np.int64)
        for p, i in ids.items():
            own[i] = rank[p]
        self.unsafe = np.zeros(RAW, bool)
        whole = np.array(keys, np.int64)
        for side in (whole >> SHIFT, whole & ((1 << SHIFT) - 1)):
            made = side < RAW
            bad = side[made][self.ranks[:-1][made] <= own[side[made]]]
            self.unsafe[bad] = True
        longer = {c for p in ids if len(p) > 1 for c in p}
        self.code_of = np.arange(RAW, RAW + 0x110000, dtype=np.int32)
        for c, i in ids.items():
            if len(c) == 1:
                self.code_of[ord(c)] = i
        blanks = [p for p in ids if not p.strip(SPACE)]
        most = max(map(len, blanks))
        self.alone = "".join(c for c in "\n\t\r" if c not in longer)
        #: Where runs of blanks all rank last and alike, a long run falls apart into the longest such pieces from the left.
        even = most > 1 and {rank[p] for p in blanks if len(p) > 1} == {max(rank.values())} and len(encode_words(self, [SPACE * most])[0]) == 1
        self.longest_run = most if even else 0
        texts = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            texts[i] = p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else train.unk_surface.encode() if p.type == 2 else b""
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        shown = [f"{i}," for i in range(len(texts))]
        self.decimals = np.frombuffer("".join(shown).encode(), np.uint8)
        self.decimal_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int64)


    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair of symbols."""
        found = self.pairs.find(a.astype(np.uint64) << np.uint64(SHIFT) | b.astype(np.uint64))
        return np.where(found < 0, len(self.to), found).astype(np.int32)


@lru_cache(4)
def tables_of(path: str) -> PieceTables:
    with open(path, "rb") as f:
        return PieceTables(f.read())


def encode_words(t: PieceTables, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, offsets)."""
    return encode_points(t, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, words), np.int64, len(words)))


def encode_points(t: PieceTables, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for words given as code points."""
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(lengths) + 1, np.int64)
    sym, word = t.code_of[points], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    none, last_rank = len(t.to), t.ranks[-1]  # of symbols that are no pair
    pair = np.full(len(sym), none, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    pair[inner] = t.look(sym[inner], sym[inner + 1])
    done_sym, done_word = [], []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(sym)))
        least = t.ranks[np.minimum.reduceat(pair, first)]  # pairs are numbered in the order of their ranks
        over = least == last_rank
        if 4 * size[over].sum() >= len(sym):  # finished words leave when they are many
            out = np.repeat(over, size)
            done_sym.append(sym[out])
            done_word.append(word[out])
            sym, word, pair = sym[~out], word[~out], pair[~out]
            least, size = least[~over], size[~over]
            if not len(sym):
                break
        at = np.flatnonzero((t.ranks[pair] == np.repeat(least, size)) & (pair != none))
        chained = np.concatenate([[False], at[1:] == at[:-1] + 1])
        if chained.any():  # from the left, each second one of those that touch
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
        w = word[at]
        again = np.concatenate([[False], w[1:] == w[:-1]])
        if again.any():
            shared = again | np.append(again[1:], False)
            doubt = np.flatnonzero(shared & t.unsafe[t.to[pair[at]]])
            if len(doubt):
                i = at[doubt]
                m = t.to[pair[i]]
                two, before, after = np.maximum(i - 2, 0), np.maximum(i - 1, 0), np.minimum(i + 2, len(sym) - 1)
                left_taken = (doubt > 0) & (at[np.maximum(doubt - 1, 0)] == i - 2) & (word[two] == word[i])
                left = np.where(left_taken, t.to[np.minimum(pair[two], none - 1)], sym[before])
                made = [np.where((i >= 1) & (word[before] == word[i]), t.ranks[t.look(left, m)], last_rank), np.where((i + 2 < len(sym)) & (word[after] == word[i]), t.ranks[t.look(m, sym[after])], last_rank)]
                stop = i[np.minimum(*made) <= t.ranks[pair[i]]]
                if len(stop):
                    ws, k = np.unique(word[stop], return_index=True)
                    where = np.minimum(np.searchsorted(ws, w), len(ws) - 1)
                    at = at[(ws[where] != w) | (at <= stop[k][where])]
        sym[at] = t.to[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word, pair = sym[keep], word[keep], pair[keep]
        place = at - np.arange(len(at))
        pair[place] = none
        right = place[(place + 1 < len(sym)) & (word[np.minimum(place + 1, len(sym) - 1)] == word[place])]
        left = place[(place > 0) & (word[place - 1] == word[place])] - 1
        fresh = np.concatenate([right, left])
        pair[fresh] = t.look(sym[fresh], sym[fresh + 1])
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    by_word = np.argsort(word, kind="stable")
    sym, word = sym[by_word], word[by_word]
    raw = np.flatnonzero(sym >= RAW)
    if len(raw):
        spelled = {int(c): t.byte_ids[list(chr(c - RAW).encode("utf-8", "surrogatepass"))] if t.byte_fallback else np.array([t.unk], np.int32) for c in np.unique(sym[raw])}
        n = np.ones(len(sym), np.int64)
        n[raw] = [len(spelled[int(c)]) for c in sym[raw]]
        word, out = np.repeat(word, n), np.repeat(sym, n)
        start = np.cumsum(n) - n
        for i in raw:
            out[start[i] : start[i] + n[i]] = spelled[int(sym[i])]
        sym = out
    return sym.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(lengths)))])


def decode_flat(t: PieceTables, ids: np.ndarray, offsets: np.ndarray, start_of_text: bool = True) -> list[bytes]:
    """Bytes of each id sequence; the blank put before a text is taken away again if ``start_of_text``."""
    begin, n = t.piece_at[ids], t.piece_at[ids + 1] - t.piece_at[ids]
    if start_of_text and t.dummy_prefix:
        first = offsets[:-1][np.diff(offsets) > 0]
        blank = first[(n[first] > 0) & (t.piece_bytes[np.minimum(begin[first], len(t.piece_bytes) - 1)] == 32)]
        begin, n = begin.copy(), n.copy()
        begin[blank] += 1
        n[blank] -= 1
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    flat = t.piece_bytes[np.arange(total) + np.repeat(begin - (ends - n), n)].tobytes()
    cut = np.concatenate([[0], ends])[offsets]
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


class WordTable:
    """Numbers 64-bit keys from 0 on, in arrays: an open hash table without Python objects."""

    def __init__(self):
        self.n = 0
        self._clear(1 << 12)

    def _clear(self, slots: int) -> None:
        self.keys, self.numbers = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        slot = self._slot(keys)
        out = self.numbers[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            out[todo] = self.numbers[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.numbers >= 0
            keys, numbers = np.concatenate([self.keys[old], keys]), np.concatenate([self.numbers[old], numbers])
            self._clear(1 << (4 * len(keys)).bit_length())
        self.n = int(numbers.max(initial=self.n - 1)) + 1
        slot = self._slot(keys)
        while len(keys):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]], self.keys[slot[free]] = numbers[free], keys[free]  # of several for one slot the last stays
            out = self.numbers[slot] != numbers
            keys, numbers, slot = keys[out], numbers[out], (slot[out] + 1) & (len(self.keys) - 1)


class Pool:
    """Arrays one after another, by number; they can be put together in any order."""

    def __init__(self, kind):
        self.n, self.flat, self.ends = 0, np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used, n = int(self.ends[self.n]), self.n + len(sizes)
        self.flat, self.ends = _room(self.flat, used + len(flat)), _room(self.ends, n + 1)
        self.flat[used : used + len(flat)] = flat
        self.ends[self.n + 1 : n + 1] = used + np.cumsum(sizes)
        self.n = n

    def put_together(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arrays of these numbers one after another, where each ends)."""
        begin = self.ends[at]
        n = self.ends[at + 1] - begin
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - n), n)], ends


class Words:
    """The words of some texts: the bytes of all texts, each word's begin, end and key, and how many words each text has."""

    def __init__(self, raw, begin, end, keys, counts):
        self.raw, self.begin, self.end, self.keys, self.counts = raw, begin, end, keys, counts


class Codec:
    """Encodes texts with a cache of words; lives in a Python worker.

    Words are told apart by 64-bit keys, sums of their bytes times random factors by place; the factors are new in each
    worker, so no text can be made to clash (two of a million words do with probability 1e-5 at most).
    """

    def __init__(self, tables: PieceTables):
        self.t, self.random = tables, np.random.default_rng()
        self.factors = self.random.integers(0, 1 << 64, PLACES, np.uint64)
        self.alone = np.zeros(256, bool)
        self.alone[list(tables.alone.encode())] = True
        self.reset()

    def reset(self):
        self.table, self.ids, self.seen = WordTable(), Pool(np.int32), np.zeros(1 << 10, np.int32)
        self.decimals, self.decoded = Pool(np.uint8), Pool(np.uint8)

    def words(self, texts: list[bytes | None]) -> Words:
        """Cut texts into words: a run of blanks and what follows up to the next blank, or a sign that stands alone."""
        texts = [x or b"" for x in texts]
        if any(SPACE_BYTES in x for x in texts):
            texts = [x.replace(SPACE_BYTES, b" ") for x in texts]  # the model knows the blank as this sign
        raw = np.frombuffer(b" " + b" ".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes + 1) - sizes - 1  # the blank before each text
        blank, alone = raw == 32, self.alone[raw]
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start |= alone
        start[1:] |= alone[:-1]
        if self.t.dummy_prefix:
            start[first] = True
        else:
            start[first] = False
            start[(first + 1)[first + 1 < len(raw)]] = True
        if self.t.longest_run:
            self._cut_runs(start, blank, first)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(raw))
        text_of = np.searchsorted(first, begin, "right") - 1
        if not self.t.dummy_prefix:  # the blank before a text is not part of the word before it
            end = np.minimum(end, np.append(first[1:], len(raw))[text_of])
        real = (end > begin) & (sizes[text_of] > 0)
        begin, end = begin[real], end[real]
        return Words(raw, begin, end, self._keys(raw, begin, end), np.bincount(text_of[real], minlength=len(texts)))

    def _cut_runs(self, start, blank, first) -> None:
        """Very long runs of blanks are cut into the longest pieces of blanks from the left."""
        most = self.t.longest_run
        edge = np.flatnonzero(np.diff(np.concatenate([[0], blank.view(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2)[(edge[1::2] - edge[::2]) > most].tolist():
            cuts = [a, *first[(first > a) & (first < b)].tolist(), b]  # texts of blanks only touch
            for x, y in zip(cuts[:-1], cuts[1:]):
                x += not self.t.dummy_prefix and x in first
                start[x + most : y : most] = True

    def _keys(self, raw, begin, end) -> np.ndarray:
        size = end - begin
        if not len(size):
            return np.zeros(0, np.uint64)
        n, total = np.minimum(size, PLACES), int(size.sum())
        if total == int(n.sum()) and total == len(raw) - int(begin[0]):
            place, value = np.arange(total) - np.repeat(begin - begin[0], size), raw[int(begin[0]) :]
        else:
            at = np.cumsum(n)
            place = np.arange(int(at[-1])) - np.repeat(at - n, n)
            value = raw[place + np.repeat(begin, n)]
        keys = np.add.reduceat((value.astype(np.uint64) + np.uint64(1)) * self.factors[place], np.cumsum(n) - n)
        for k in np.flatnonzero(size > PLACES).tolist():
            keys[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        keys ^= keys >> np.uint64(29)
        return np.maximum(keys * np.uint64(0xBF58476D1CE4E5B9), np.uint64(1))

    def numbers(self, w: Words) -> np.ndarray:
        """The cache's number of each word; words that are new are encoded."""
        if self.table.n > CACHE_WORDS or int(self.ids.ends[self.ids.n]) > CACHE_IDS:
            self._shrink()
        at = self.table.find(w.keys)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            keys, one = np.unique(w.keys[miss], return_index=True)
            one = miss[one]
            self.table.add(keys)
            n = w.end[one] - w.begin[one]
            ends = np.cumsum(n)
            flat = w.raw[np.arange(int(ends[-1])) + np.repeat(w.begin[one] - (ends - n), n)]
            ids, offsets = encode_points(self.t, *_points(flat, ends))
            self.ids.add(ids, np.diff(offsets))
            self.seen = _room(self.seen, self.table.n)
            at[miss] = self.table.find(w.keys[miss])
        self.seen[: self.table.n] += np.bincount(at, minlength=self.table.n).astype(np.int32)
        return at

    def _shrink(self) -> None:
        """Keeps the short words that were met most since the last time."""
        n = self.table.n
        sizes = np.diff(self.ids.ends[: n + 1])
        order = np.argsort(-np.where(sizes <= 64, self.seen[:n], 0), kind="stable")[:CACHE_KEPT]
        kept = np.sort(order[(sizes[order] <= 64) & (self.seen[order] > 1)])
        keys = np.zeros(n, np.uint64)
        live = self.table.numbers >= 0
        keys[self.table.numbers[live]] = self.table.keys[live]
        old, seen = self.ids, self.seen[kept]
        self.reset()
        self.table.add(keys[kept])
        self.ids.add(old.put_together(kept)[0], sizes[kept])
        self.seen = _room(seen // 2, 1 << 10)

    def encode(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets by text)."""
        ids, ends = self.ids.put_together(at)
        return ids, by_text(ends, w.counts)

    def shown(self) -> tuple[Pool, Pool]:
        """By cached word: its ids as decimals with a comma after each, and the bytes it decodes to."""
        k, n = self.decimals.n, self.ids.n
        if k < n:
            a = int(self.ids.ends[k])
            ids, ends = self.ids.flat[a : int(self.ids.ends[n])], self.ids.ends[k + 1 : n + 1] - a
            for pool, flat, cut in ((self.decimals, *put_together(self.t.decimals, self.t.decimal_at, ids)), (self.decoded, *put_together(self.t.piece_bytes, self.t.piece_at, ids))):
                pool.add(flat, np.diff(np.concatenate([[0], cut])[np.concatenate([[0], ends])]))
        return self.decimals, self.decoded


def put_together(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts of ``flat`` one after another, where each ends)."""
    begin, n = offsets[at], offsets[at + 1] - offsets[at]
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - n), n)], ends


def by_text(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Offsets by text, from where each of its words ends and how many words each text has."""
    return np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def _points(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 words (where bytes are none, U+FFFD), and how many each has."""
    raw = flat.tobytes()
    try:
        points, size = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), None
    except UnicodeDecodeError:
        cuts = [0, *ends.tolist()]
        words = [raw[a:b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:])]
        points, size = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64)
    if size is None:
        size = np.diff(np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[np.concatenate([[0], ends])])
    return np.where(points == 32, np.uint32(ord(SPACE)), points), size


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def codec_of(tables) -> Codec:
    """The worker's codec for a broadcast of tables."""
    return worker_state(f"codec {tables.value.key}", lambda: Codec(tables.value))


def _valid(raw: bytes) -> bytes:
    """Bytes that are no UTF-8 become U+FFFD, as decode() of the library gives text."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()


def texts_of(pool: Pool, at: np.ndarray, counts: np.ndarray):
    """The bytes of each text, put together from those of its words."""
    flat, ends = pool.put_together(at)
    cut = by_text(ends, counts).tolist()
    whole = flat.tobytes()
    return [whole[a:b] for a, b in zip(cut[:-1], cut[1:])]


#: What encode() can return of a text.
OUTPUTS = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode the ``text`` column; return the ``keep`` columns and the ``outputs`` (see OUTPUTS), one row per input row.

    Null and empty texts have no ids.  Repeated rows stay.  Columns other than ``keep`` are dropped, so their names
    cannot clash; ``keep`` must not hold a name of ``outputs``.  The model file is read on the driver only.
    """
    if clash := set(keep) & set(outputs):
        raise ValueError(f"clashing names: {sorted(clash)}")
    tables = df.sparkSession.sparkContext.broadcast(tables_of(model_path))
    names = [*keep, "__text"]

    def run(batches):
        codec = codec_of(tables)
        for whole in batches:
            for batch in sub_batches(whole, len(names) - 1):
                words = codec.words(batch.column(len(names) - 1).cast(pa.binary()).to_pylist())
                at = codec.numbers(words)
                made = {}
                if {"ids", "n_tokens"} & set(outputs):
                    ids, offsets = codec.encode(words, at)
                    made["n_tokens"] = np.diff(offsets)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                if {"ids_sha256", "decoded", "decoded_sha256"} & set(outputs):
                    decimals, decoded = codec.shown()
                    made["ids_sha256"] = [hashlib.sha256(x[:-1]).hexdigest() for x in texts_of(decimals, at, words.counts)]
                    raw = [_valid(x[codec.t.dummy_prefix and x[:1] == b" " :]) for x in texts_of(decoded, at, words.counts)]
                    made["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in raw]
                    made["decoded"] = [x.decode() for x in raw] if "decoded" in outputs else None
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(made[k] if k == "ids" else pa.array(made[k], OUTPUTS[k][1]) for k in outputs)], names=[*keep, *outputs])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"`{k}` {OUTPUTS[k][0]}" for k in outputs)])
    return map_batches(df.select(*keep, df[text].alias("__text")), run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), output: str = "decoded") -> DataFrame:
    """Decode an ``array<int>`` column to text.  A null or empty array gives the empty text; null ids and ids out of range are an error."""
    tables = df.sparkSession.sparkContext.broadcast(tables_of(model_path))

    def run(batches):
        for batch in batches:
            rows = [x or [] for x in batch.column(len(keep)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            flat = np.array([i for x in rows for i in x], np.int64)
            texts = [_valid(x).decode() for x in decode_flat(tables.value, flat, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, output])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"`{output}` string"])
    return map_batches(df.select(*keep, df[ids].alias("__ids")), run, schema)
