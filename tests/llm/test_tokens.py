import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from docket_spark.llm import packing, piece_codec as pc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hard_texts():
    r = random.Random(3)
    letters = " \n\t▁aabbccooffthe  éß漢字語😀'\"123<0x0A>АБвгд"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    out += ["a" * 1000, "ab" * 700, " " * 1000, " " * 33 + "x", "\n\n\n", "of" * 300, "ofof of" * 50, "".join(r.choice("aeioustrnl") for _ in range(20000)), "漢字" * 500, "", "\x00x"]
    return out + [" " * k + y + " " * j for k in range(40) for j in (0, 1, 17, 34) for y in ("the", "x", "", "\n", "▁")]


def test_encode_and_decode_equal_the_library(library):
    codec = pc.Codec(pc.tables_of(MODEL))
    texts = hard_texts()
    words = codec.words([x.encode() for x in texts])
    ids, offsets = codec.encode(words, codec.numbers(words))
    want = library.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert [x.decode() for x in pc.decode_flat(codec.t, ids, offsets)] == library.decode(want)


def test_full_caches_keep_the_words_met_most(library, monkeypatch):
    monkeypatch.setattr(pc, "CACHE_WORDS", 300)
    monkeypatch.setattr(pc, "CACHE_KEPT", 100)
    codec, texts = pc.Codec(pc.tables_of(MODEL)), hard_texts()
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        words = codec.words([x.encode() for x in part])
        numbers = codec.numbers(words)
        ids, offsets = codec.encode(words, numbers)
        want = library.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
        decimals, decoded = codec.shown()
        assert [[int(i) for i in x.decode().split(",")[:-1]] for x in pc.texts_of(decimals, numbers, words.counts)] == want
        assert [x.decode(errors="replace")[x[:1] == b" " :] for x in pc.texts_of(decoded, numbers, words.counts)] == library.decode(want)


def test_word_table_finds_what_it_holds():
    r, table, known = np.random.default_rng(1), pc.WordTable(), {}
    for _ in range(30):
        new = np.setdiff1d(r.integers(1, 1 << 62, 700, np.uint64) << np.uint64(2), np.array(list(known), np.uint64))
        table.add(new)
        known |= {int(k): len(known) + i for i, k in enumerate(new.tolist())}
    keys = np.array(list(known), np.uint64)
    assert table.find(keys).tolist() == list(known.values()) and (table.find(keys + np.uint64(1)) < 0).all()


def test_operator_round_trip(spark, library, odd_texts):
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id bigint, text string").selectExpr("*", "text AS ids", "1 AS n_tokens")
    rows = pc.encode(df, MODEL, outputs=("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")).orderBy("doc_id").collect()
    for r, text in zip(rows, odd_texts):
        want = library.encode(text or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want)
    back = pc.decode(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in rows] + [(99, None)], "doc_id bigint, ids array<int>"), MODEL).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [r["decoded"] for r in rows] + [""]
    with pytest.raises(ValueError):
        pc.encode(df, MODEL, keep=("doc_id", "ids"))
    assert pc.encode(df.where("false"), MODEL).count() == 0


def brute_best_fit(lengths, size):
    free, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [k for k in range(len(rows)) if free[k] >= lengths[i]]
        if fits:
            k = min(fits, key=lambda k: free[k])
        else:
            k = len(rows)
            rows.append([])
            free.append(size)
        rows[k].append(i)
        free[k] -= lengths[i]
    return sorted(free)


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(200):
        size = r.randint(1, 40)
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 40))]
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in row) for row in rows) == brute_best_fit(lengths, size)


def test_packed_rows_hold_all_tokens(spark, library, odd_texts):
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id bigint, text string").repartition(2)
    parts, size = {}, 512
    for r in packing.pack(df, MODEL, size=size, window=30_000).collect():
        ids, pos = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["position_ids"], "<i4")
        assert len(ids) == len(pos) == size and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:]):
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
            assert pos[a:b].tolist() == list(range(b - a))
    for k, text in enumerate(odd_texts):
        assert [i for _, x in sorted(parts.get(k, [])) for i in x] == library.encode(text or "")


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    packing.write_packed(df, str(tmp_path / "p"), model_path=MODEL, size=16)
    r = spark.read.parquet(str(tmp_path / "p")).first()
    assert len(r["ids"]) == 64 and r["doc_ids"] == [1]


def test_packing_of_nothing_of_ties_and_of_null_ids(spark, library):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, MODEL).count() == 0
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "text AS ids", "1 AS part").coalesce(1)
    n = len(library.encode("same words"))
    packed = packing.pack(df, MODEL, size=2 * n).collect()
    assert [(r["doc_ids"], r["starts"], r["n_tokens"]) for r in packed] == [([1, 1], [0, 0], 2 * n), ([None], [0], n)]
    assert packing.digests(packing.pack(df, MODEL, size=n, digest=True)).count() == 3
