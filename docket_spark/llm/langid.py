"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text.  A text is cut from the left into the longest phrases that
the automaton knows, across words; phrases times the bits that name a place in the automaton's text, a character, estimate
the cross entropy, and the language with the least wins.  Texts are lower-cased, and all between two words is one blank.

Stretches of ``STRETCH`` characters are parsed side by side, one character of all of them at a step.  Where a stretch
ends, its last phrase goes on into the next one and is parsed there until both parses begin a phrase at the same place,
from where they are the same; so the phrases are those of the whole text, however it is cut.  Transitions of all automata
lie in one hash table of arrays.

The automata are fitted on a bounded sample: of each language the first distinct labelled texts in the order of a hash, of
each at most ``text_chars`` characters, up to ``model_chars`` characters; at most ``max_languages`` languages, those with
the most labelled rows.  Every text is predicted whole, without any shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, sub_batches, worker_state
from .piece_codec import WordTable

UNKNOWN = "und"
STRETCH = 512  # for speed only
SIDE_BY_SIDE = 1024  # steps that open phrases take together; the few that go on are followed one by one
#: Bytes of texts that a worker cuts up at a time, times languages; in bounds.
SLICE, SLICES = 3_200_000, (50_000, 800_000)
BLANK = 32


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normal(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, lower-cased and with single blanks around words; how many each text has).

    A text without a letter has none."""
    lowered = [x.lower() if x else "" for x in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = is_letter[points]
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)  # each with the blank after it
    # A blank stands before each word and after the last one of a text: the sign before a word's first letter, and the text's end.
    before = np.concatenate([[False], word[:-1]])
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    closing = last[np.append(text_of[last[1:]] != text_of[last[:-1]], True)] if len(last) else last
    place = np.sort(np.concatenate([first, np.flatnonzero(word) + 0.5, closing + 0.6])) if len(first) else np.zeros(0)
    at = place.astype(np.int64)
    out = np.where(place - at == 0.5, points[np.minimum(at, len(points) - 1)], BLANK)
    return out, np.bincount(text_of[at], minlength=len(texts))


class SuffixAutomaton:
    """Of one string: a dictionary of transitions for each state; 0 is the start."""

    def __init__(self, text: str):
        nexts: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.to = nexts


def sample(df: DataFrame, text: str = "text", lang: str = "lang", model_chars: int = 60_000, text_chars: int = 4_000, max_languages: int = 256) -> dict[str, str]:
    """The text to learn of each language.  Rows without text or language are left out; copies count once.

    Each language with a letter in its texts has some text."""
    place = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    # Steps of the place, so that a language's first texts are found by counts of characters at each step.
    rows = df.select(df[lang].alias("lang"), df[text].alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("place", place)
    rows = rows.select("lang", "text", "place", F.floor(F.log2("place") * 8).cast("int").alias("step"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    ranked = [r["lang"] for r in common.collect()]
    if not ranked:
        return {}
    distinct = rows.select("lang", "step", F.xxhash64("text").alias("hash"), F.least(F.length("text"), F.lit(text_chars)).alias("n")).distinct()
    upto: dict[str, int] = {}
    total: Counter = Counter()
    for r in distinct.where(F.col("lang").isin(ranked)).groupBy("lang", "step").agg(F.sum("n").alias("n")).orderBy("lang", "step").collect():
        if total[r["lang"]] < 2 * model_chars:
            total[r["lang"]] += r["n"]
            upto[r["lang"]] = r["step"]
    last = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])
    # The cut begins at a place given by the hash, so that beginnings of texts do not weigh more than their other parts.
    begin = F.pmod(F.xxhash64("text", F.lit(3)), F.greatest(F.length("text") - text_chars, F.lit(0)) + 1) + 1
    drawn = rows.where(F.col("step") <= F.try_element_at(last, "lang")).select("lang", "place", F.expr("text").alias("whole"), begin.cast("int").alias("begin")).dropDuplicates(["lang", "whole"]).withColumn("text", F.substr("whole", F.col("begin"), F.lit(text_chars))).drop("whole")
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1))
    picked = drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * model_chars).orderBy("lang", "place", "text").select("lang", "text").collect()
    is_letter, parts = letters(), {}
    for r in picked:
        points, _ = normal([r["text"]], is_letter)
        parts.setdefault(r["lang"], []).append(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")[1:])
    return {k: (" " + "".join(x))[:model_chars] for k, x in sorted(parts.items()) if any(x)}


class Parser:
    """The automata of all languages; lives in a Python worker."""

    def __init__(self, texts: dict[str, str]):
        self.langs, self.is_letter = sorted(texts), letters()
        known = sorted({c for x in texts.values() for c in x})
        self.letter_of = np.zeros(0x110000, np.int32)  # 0: in no automaton
        self.letter_of[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        self.first = np.full((len(self.langs), self.width), -1, np.int32)  # from the start
        self.start, keys, to, states = np.zeros(len(self.langs), np.int64), [], [], 0
        number = {c: i for i, c in enumerate(known, 1)}
        for k, lang in enumerate(self.langs):
            edges = SuffixAutomaton(texts[lang]).to
            keys.append(np.fromiter(((states + s) * self.width + number[c] for s, own in enumerate(edges) for c in own), np.int64))
            to.append(np.fromiter((states + x for own in edges for x in own.values()), np.int32))
            self.start[k] = states
            for c, x in edges[0].items():
                self.first[k, number[c]] = states + x
            states += len(edges)
            del edges
        self.table, self.to = WordTable(), np.concatenate([*to, [0]]).astype(np.int32)
        if keys:
            self.table.add(np.concatenate(keys).astype(np.uint64))
        self.bits = np.log2([max(2, len(texts[k])) for k in self.langs])

    def _step(self, state: np.ndarray, fresh: np.ndarray, start: np.ndarray, first: np.ndarray, c: np.ndarray):
        """One character of each lane: (states, whether no phrase is open, whether the character begins a phrase)."""
        found = self.table.find((state * self.width + c).astype(np.uint64))
        lost = found < 0
        to = self.to[found]
        again = first[lost]
        alone = again < 0  # known nowhere: a phrase of its own
        to[lost] = np.where(alone, start[lost], again)
        closed = np.zeros(len(state), bool)
        closed[np.flatnonzero(lost)[alone]] = True
        return to, closed, fresh | lost

    def phrases(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases by text and language."""
        m = len(self.langs)
        letter = self.letter_of[points]
        text_end = np.cumsum(sizes)
        pieces = -(-sizes // STRETCH)
        text_of = np.repeat(np.arange(len(sizes)), pieces)
        inner = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (text_end - sizes)[text_of] + inner * STRETCH
        size = np.minimum(sizes[text_of] - inner * STRETCH, STRETCH)
        n = len(begin)
        # one parse from the beginning of each stretch, as if a text began there
        order = np.argsort(-size, kind="stable")
        sorted_size, sorted_begin = size[order], begin[order]
        state, fresh = np.repeat(self.start[:, None], n, 1), np.ones((m, n), bool)
        steps = int(sorted_size[0]) if n else 0
        begun = np.zeros((steps, m, n), bool)
        live = n
        for step in range(steps):
            while live and sorted_size[live - 1] <= step:
                live -= 1
            c = letter[sorted_begin[:live] + step]
            found = self.table.find((state[:, :live] * self.width + c).ravel().astype(np.uint64)).reshape(m, live)
            lost = found < 0
            to = self.to[found]
            np.logical_or(fresh[:, :live], lost, out=begun[step, :, :live])
            i, j = np.nonzero(lost)
            again = self.first[i, c[j]]
            alone = again < 0  # known nowhere: a phrase of its own
            to[i, j] = np.where(alone, self.start[i], again)
            state[:, :live] = to
            fresh[:, :live] = False
            fresh[i[alone], j[alone]] = True
        begins = np.zeros((m, len(points) + 1), bool)  # where a phrase does
        step_of, lane_of = np.nonzero(np.arange(steps)[:, None] < sorted_size[None])
        begins[:, sorted_begin[lane_of] + step_of] = begun[step_of, :, lane_of].T
        del begun
        out = np.zeros((len(sizes), m), np.int64)
        if not n:
            return out
        # the last phrase of a stretch goes on into the next ones, until both parses begin a phrase at one place
        last = np.append(text_of[1:] != text_of[:-1], True)
        open_ = np.flatnonzero(~last)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        lane_k, lane_s = np.repeat(np.arange(m), len(open_)), np.tile(open_, m)
        state, fresh = state[lane_k, back[lane_s]], fresh[lane_k, back[lane_s]]
        at, stop = (begin + size)[lane_s], text_end[text_of[lane_s]]
        more, met = np.zeros(len(lane_s), np.int64), stop.copy()
        live = np.arange(len(lane_s))
        for _ in range(SIDE_BY_SIDE):
            if not len(live):
                break
            k, c = lane_k[live], letter[at[live]]
            to, closed, begun = self._step(state[live], fresh[live], self.start[k], self.first[k, c], c)
            same = begun & begins[k, at[live]]
            met[live[same]] = at[live[same]]
            more[live] += begun & ~same
            state[live], fresh[live] = to, closed
            at[live] += 1
            live = live[~same & (at[live] < stop[live])]
        unmet = np.zeros(len(lane_s), bool)
        unmet[live] = True
        # whole texts: the first stretch's phrases, then at each border those of the open phrase's parse and of the next one's rest
        ends = begin + size
        first_of = inner == 0
        for k in range(m):
            upto = np.concatenate([[0], np.cumsum(begins[k], dtype=np.int64)])
            np.add.at(out[:, k], text_of[first_of], (upto[ends] - upto[begin])[first_of])
            lanes = slice(k * len(open_), (k + 1) * len(open_))
            there = met[lanes]
            near = (there < ends[open_ + 1]) & ~unmet[lanes]
            far = np.zeros(len(sizes), bool)
            far[text_of[open_[~near]]] = True
            simple = ~far[text_of[open_]]
            np.add.at(out[:, k], text_of[open_[simple]], (more[lanes] + upto[ends[open_ + 1]] - upto[there])[simple])
            for text in np.flatnonzero(far).tolist():  # a parse that passed a whole stretch by: border after border
                out[text, k] += self._along(text, k, text_of, begin, ends, open_, lanes, more, met, unmet, state, fresh, at, letter, begins, upto, int(text_end[text]))
        return out

    def _along(self, text, k, text_of, begin, ends, open_, lanes, more, met, unmet, state, fresh, at, letter, begins, upto, stop) -> int:
        """Phrases of one text after its first stretch."""
        s, total = int(np.searchsorted(text_of, text)), 0
        while ends[s] < stop:
            lane = lanes.start + int(np.searchsorted(open_, s))
            total += int(more[lane])
            place = int(met[lane])
            if unmet[lane]:
                place, extra = self._slowly(k, int(state[lane]), bool(fresh[lane]), int(at[lane]), letter, begins, stop)
                total += extra
            if place >= stop:
                break
            s = int(np.searchsorted(begin, place, side="right")) - 1
            total += int(upto[ends[s]] - upto[place])
        return total

    def _slowly(self, k, state, fresh, at, letter, begins, stop) -> tuple[int, int]:
        """(where the parses meet, phrases before), one character after the other."""
        extra, start = 0, self.start[k : k + 1]
        while at < stop:
            c = letter[at : at + 1]
            to, closed, begun = self._step(np.array([state]), np.array([fresh]), start, self.first[k, c], c)
            if begun[0] and begins[k, at]:
                return at, extra
            extra += int(begun[0])
            state, fresh, at = int(to[0]), bool(closed[0]), at + 1
        return stop, extra


def parser_of(model) -> Parser:
    key, texts = model.value
    return worker_state(f"parser {key}", lambda: Parser(texts))


def predict(df: DataFrame, texts: dict[str, str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per input row the ``keep`` columns, lang_pred and score.

    Ties go to the first language in order of name.  ``score`` is one minus the entropy of the winner over that of the
    next, so 0 for a tie and 1 where there is one language only.  Null texts, texts without a letter, and all texts if
    nothing was learned, are "und" with score 0.  Repeated rows stay; other columns are dropped.
    """
    if clash := set(keep) & {"lang_pred", "score", "__text"}:
        raise ValueError(f"clashing names: {sorted(clash)}")
    key = hashlib.sha256(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).hexdigest()
    model = df.sparkSession.sparkContext.broadcast((key, texts))

    def run(batches):
        parser = parser_of(model)
        langs = [*parser.langs, UNKNOWN]
        for whole in batches:
            for batch in sub_batches(whole, len(keep), min(SLICES[1], max(SLICES[0], SLICE // max(1, len(parser.langs))))):
                points, sizes = normal(batch.column(len(keep)).to_pylist(), parser.is_letter)
                known = (sizes > 0) & bool(parser.langs)
                best, score = np.full(len(sizes), len(parser.langs)), np.zeros(len(sizes))
                if parser.langs:
                    bits = parser.phrases(points, sizes) * parser.bits
                    best = np.where(known, bits.argmin(1), best)
                    two = np.sort(bits, 1)[:, :2]
                    score = np.where(known, 1 - two[:, 0] / np.maximum(two[:, 1], 1) if len(parser.langs) > 1 else 1.0, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([langs[k] for k in best], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    types = dict(df.dtypes)
    return map_batches(df.select(*keep, df[text].alias("__text")), run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "lang_pred string, score double"]))
