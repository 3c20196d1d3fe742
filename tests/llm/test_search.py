"""Decontamination, near-duplicates and embeddings against brute force."""

import random
import re

import numpy as np
import pytest

from docket_spark.llm import decontaminate as D, embedding_dedup as V, graph, ngram_join as J


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(texts, items, n):
    windows = {}
    for name, body in items:
        w = plain_words(body)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name) if name is not None else "null")
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if names := windows.get(tuple(w[k : k + m])):
                    found |= names
                    hit.update(range(k, k + m))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [32_000_000, 60])
def test_decontamination(spark, odd_texts, block):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("ab Cd é ef. gh7 I".split()) for _ in range(n))
    items = [(k, text(r.randint(1, 9))) for k in range(25)] + [(None, "ab Cd é"), (90, None), (91, ""), (3, "ef gh7 zz")]
    texts = [text(r.randint(0, 60)) for _ in range(150)] + odd_texts
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS items", "2 AS n_words")
    found = D.digests(D.find(docs, bench, n=4, block_bytes=block)).orderBy("doc_id").collect()
    plain = D.find(docs, bench, n=4, clean_text=True, block_bytes=block).orderBy("doc_id").collect()
    for x, p, want in zip(found, plain, brute_hits(texts, items, 4)):
        assert (x["n_words"], x["n_hit"], p["items"]) == want and x["contaminated"] == (want[1] > 0)
        if not want[1]:
            assert p["clean_text"] == texts[x["doc_id"]]
        else:
            assert len(plain_words(p["clean_text"])) == want[0] - want[1]
    assert D.find(docs, bench.where("false")).where("size(items) > 0").count() == 0


def test_index_finds_every_occurrence():
    r = random.Random(9)
    runs = [np.array([r.randint(1, 4) for _ in range(r.randint(1, 30))]) for _ in range(20)]
    index = D.FMIndex(runs, 4)
    for m in (1, 2, 3, 5):
        phrases = np.array(sorted({tuple(x[i : i + m]) for x in runs for i in range(len(x) - m + 1)} | {(1,) * m}))
        rows, low, high = index.search(phrases)
        got = {}
        for k, a, b in zip(rows.tolist(), low.tolist(), high.tolist()):
            got[tuple(phrases[k])] = sorted(index.locate(np.arange(a, b)).tolist())
        want = {}
        for at, x in zip(index.run_at, runs):
            for i in range(len(x) - m + 1):
                want.setdefault(tuple(x[i : i + m]), []).append(int(at) + i)
        assert got == {k: sorted(v) for k, v in want.items()}


def near_copies():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    big = [word() for _ in range(120)]
    for _ in range(60):  # one large group
        own = list(big)
        own[r.randrange(len(own))] = word()
        out.append(" ".join(own))
    return out


def brute_join(texts, least):
    sets = [frozenset(x.tolist()) for x in J.shingle_sets(texts, 5)]
    n = len(sets)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    return [len(x) for x in linked], root


def test_ngram_join(spark, odd_texts, monkeypatch):
    texts = near_copies() + odd_texts
    monkeypatch.setattr(J, "BUCKET_CHUNK", 16)
    monkeypatch.setattr(J, "CLUSTER_CHUNK_BYTES", 8_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "text AS node", "1 AS size").repartition(3)
    rows = J.join(df).orderBy("doc_id").collect()
    links, root = brute_join(texts, 0.8)
    assert [r["n_links"] for r in rows] == links
    assert [r["class_id"] for r in rows] == root
    assert max(links) > 50


def test_ngram_join_of_nothing_and_of_null_ids(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert J.join(none).count() == 0
    long = "one two three four five six seven"
    df = spark.createDataFrame([(None, long), (5, long), (5, long), (6, "other words are here to be read"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in J.join(df).collect())
    assert got == [("5", "5", 2), ("5", "5", 2), ("6", "6", 0), ("None", "5", 2), ("None", "None", 0)]


def test_posterior_bound():
    least = J.fewest_matches(0.8, 1e-7, 96)
    assert 40 < least < 70 and J.fewest_matches(0.8, 1e-7, 16) < 8


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, None)]
    root = {x: x for e in links for x in e if x is not None}
    for _ in range(200):
        for a, b in links:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def brute_vectors(rows, least):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, links = len(rows), []
    for i, (_, a, la) in enumerate(rows):
        own = []
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least - 1e-12:
                own.append(j)
        links.append(own)
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    return [len(x) for x in links], root


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 16)
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + random_.normal(size=16) * (0.02 if k % 3 else 0.4)).astype(np.float32).tolist(), k % 2) for k in range(240)]
    k = len(rows)
    rows += [(k, rows[0][1], 0), (k + 1, [2 * x for x in rows[0][1]], 0), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] + [1.0] * 15, 0), (k + 5, rows[0][1], None), (k + 6, [1.0, 2.0], 0), (k + 7, [1.0, 2.0], 0), (k + 8, [None] + [1.0] * 15, 0), (k + 9, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS key", "2 AS node")
    got = V.find(df, list_size=20, certainty=float("inf")).orderBy("vec_id").collect()
    links, root = brute_vectors(rows, 0.98)
    assert sum(links) > 200
    assert [r["n_links"] for r in got] == links
    assert [r["component_id"] for r in got] == root and [r["kept"] for r in got] == [x == i for i, x in enumerate(root)]
    assert V.find(df.where("false")).count() == 0


def test_recall_of_the_probed_lists(spark):
    random_ = np.random.default_rng(4)
    base = random_.normal(size=(1500, 64))
    x = np.concatenate([base, base[:700] + random_.normal(size=(700, 64)) * 0.18]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in V.find(df, list_size=20).collect()}
    assert links.sum() > 800 and sum(got.values()) >= 0.99 * links.sum() and all(got[k] <= links[k] for k in got)


@pytest.mark.parametrize("certainty", [4.0, 1.0])
def test_links_count_at_both_ends(spark, monkeypatch, certainty):
    """Neighbours planted at the borders of lists: some moved straight towards the next centroid, some anywhere."""
    monkeypatch.setattr(V, "CHUNK", 300)
    random_ = np.random.default_rng(12)
    base = random_.normal(size=(1200, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    q = V.Quantiser(base, 40)
    own, d = q.assign(base)
    next_ = np.argsort(d, 1)[:, 1]
    ahead = q.coarse[next_] - q.coarse[own]
    ahead /= np.linalg.norm(ahead, axis=1, keepdims=True)
    anywhere = random_.normal(size=(600, 32))
    anywhere /= np.linalg.norm(anywhere, axis=1, keepdims=True)
    x = np.concatenate([base, base[:500] + 0.19 * ahead[:500], base[500:1100] + 0.19 * anywhere, base[:30]]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: r for r in V.find(df, list_size=30, certainty=certainty).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    n_links = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (n_links <= near.sum(1)).all() and n_links.sum() % 2 == 0
    members = {}
    for k in range(len(x)):
        members.setdefault(got[k]["component_id"], []).append(k)
        assert got[k]["kept"] == (got[k]["component_id"] == k)
    for name, own_rows in members.items():
        assert name == min(own_rows) and (len(own_rows) == 1 or all(n_links[k] for k in own_rows))
        assert sum(n_links[own_rows]) >= 2 * (len(own_rows) - 1)
    pairs = near.sum() / 2
    assert pairs > 1000 and (certainty < 4 or n_links.sum() / 2 >= 0.99 * pairs)
