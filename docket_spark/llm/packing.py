"""Token-id output: documents are packed into rows of one length for training.

Texts are encoded by the SentencePiece codec of this package.  A document longer than a row is split into full rows and
a rest; nothing is lost.  Rests and short documents are packed by best-fit decreasing: the longest first, each into the
open row with the least room that still holds it, found in a segment tree over free capacities.

Packing needs no order across documents, so each scan task packs what it has read, in windows of ``window`` token ids
that bound its memory.  No text and no id is shuffled, and a hot source or key does not matter.  A window is a function
of the input split, so a task that is run again writes the same rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, sub_batches
from .piece_codec import codec_of, tables_of


class CapacityTree:
    """Counts of open rows by free capacity, 0 to ``size``; ``least(n)`` is the smallest capacity from n on that is there."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, n: int) -> int:
        """-1 if there is none."""
        k = n + self.leaves
        if self.count[k]:
            return n
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k *= 2
                    if not self.count[k]:
                        k += 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers.  Pieces of equal length go in input order; of equal rows the one opened last is taken."""
    tree, rows, free = CapacityTree(size), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            room, row = size, len(rows)
            rows.append([])
        else:
            row = free[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        free.setdefault(room - lengths[i], []).append(row)
        tree.add(room - lengths[i], 1)
    return rows


def pack_window(pieces: list[tuple[int, int, np.ndarray]], size: int, pad: int):
    """(matrix of ids, segments) of one window; pieces are (document, first token, ids)."""
    rows = best_fit_decreasing([len(x[2]) for x in pieces], size)
    ids = np.full((len(rows), size), pad, np.int32)
    for k, row in enumerate(rows):
        flat = np.concatenate([pieces[i][2] for i in row])
        ids[k, : len(flat)] = flat
    return ids, rows


SCHEMA = "part int, window_no int, row_no int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"


def pack(df: DataFrame, model_path: str, size: int = 2048, text: str = "text", doc_id: str = "doc_id", pad: int = 0, window: int = 4_000_000, digest: bool = False) -> DataFrame:
    """Rows of ``size`` token ids.

    part, window_no and row_no name a row.  ``doc_ids`` and ``starts`` give the document and the first token of each
    segment, ``cu_seqlens`` the cumulative lengths from 0, ``ids`` and ``position_ids`` little-endian int32 of length
    ``size``; positions begin at 0 in each segment and in the padding.  With ``digest`` the two binaries are replaced by
    the hex SHA-256 of their bytes, which keeps results small.  Null and empty texts give no segment.  Repeated rows are
    packed each; a null doc_id stays null.  Other columns are dropped.
    """
    tables = df.sparkSession.sparkContext.broadcast(tables_of(model_path))
    fields = SCHEMA.replace("binary", "string") if digest else SCHEMA
    kind = pa.string() if digest else pa.binary()
    show = (lambda b: hashlib.sha256(b).hexdigest()) if digest else bytes

    def rows_of(pieces, part, number):
        matrix, rows = pack_window(pieces, size, pad)
        out = {k: [] for k in ("doc_ids", "starts", "cu", "n", "ids", "pos")}
        for k, row in enumerate(rows):
            lengths = [len(pieces[i][2]) for i in row]
            cu = np.concatenate([[0], np.cumsum(lengths)])
            edges = np.append(cu, size) if cu[-1] < size else cu
            pos = np.arange(size, dtype=np.int32) - np.repeat(edges[:-1], np.diff(edges)).astype(np.int32)
            out["doc_ids"].append([pieces[i][0] for i in row])
            out["starts"].append([pieces[i][1] for i in row])
            out["cu"].append(cu.tolist())
            out["n"].append(int(cu[-1]))
            out["ids"].append(show(matrix[k].astype("<i4").tobytes()))
            out["pos"].append(show(pos.astype("<i4").tobytes()))
        n = len(rows)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), kind, kind)
        values = ([part] * n, [number] * n, list(range(n)), *out.values())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches):
        codec, part = codec_of(tables), TaskContext.get().partitionId()
        pieces, held, number = [], 0, 0
        for whole in batches:
            for batch in sub_batches(whole, 1):
                words = codec.words(batch.column(1).cast(pa.binary()).to_pylist())
                flat, offsets = codec.encode(words, codec.numbers(words))
                for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = flat[a:b]
                    for at in range(0, len(ids), size):
                        pieces.append((doc, at, ids[at : at + size]))
                    held += len(ids)
                    if held >= window:
                        yield rows_of(pieces, part, number)
                        pieces, held, number = [], 0, number + 1
        if pieces:
            yield rows_of(pieces, part, number)

    return map_batches(df.select(df[doc_id].cast("bigint"), df[text].alias("__text")), run, fields)


def write_packed(df: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet files, one id matrix row per record."""
    pack(df, **options).write.mode("overwrite").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """Packed rows with their lists as text, for comparison by value."""
    lists = {c: F.array_join(packed[c].cast("array<string>"), ",", "null") for c in ("doc_ids", "starts", "cu_seqlens")}
    return packed.select("part", "window_no", "row_no", *(v.alias(k) for k, v in lists.items()), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("position_ids").alias("positions_sha256"))
