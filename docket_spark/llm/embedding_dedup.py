"""Near-duplicate embeddings by product quantisation over inverted lists.

1. Equal vectors of a label are one class; only classes are compared.
2. A coarse quantiser (spherical k-means on a bounded sample) deals all classes to inverted lists.  Residuals are coded by
   subspace: sub-centroids are fitted on the sample as well.
3. A vector probes the lists that can hold a neighbour: for a list's centroid c and the own one c0, a neighbour at
   distance e lies beyond their bisecting plane only if (|x-c|^2 - |x-c0|^2) / (2 |c-c0|) is at most the part of e along
   c-c0.  That part is e at most; for a displacement in no special direction of n dimensions it is above
   e * certainty / sqrt(n-1) with the chance that a normal number exceeds ``certainty`` (4: 3 in 100,000), so lists
   beyond that are not probed.  With certainty = infinity, or up to 17 dimensions, the bound is safe and the recall 1.
4. In a list, table look-ups give the asymmetric distance to each code; with the code's known error it bounds the true
   distance, so pairs beyond the bound go and the exact cosine in double precision is computed for the rest.

Lists are dealt out in pairs of chunks; a task returns counts of links by vector and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, ship, stored
from .graph import Forest, components

CHUNK = 2048


class Quantiser:
    """Coarse centroids, and sub-centroids of the residuals in ``parts`` subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = 8, codes: int = 32, rounds: int = 8, seed: int = 5):
        random = np.random.default_rng(seed)
        self.coarse = _means(sample, lists, rounds, random)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [_means(rest[:, a:b], codes, rounds, random) for a, b in zip(self.edges[:-1], self.edges[1:])]
        self.gaps = np.sqrt(_squares(self.coarse, self.coarse))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own list, squared distances to all centroids)."""
        d = _squares(x, self.coarse)
        return d.argmin(1), d

    def probes(self, own: np.ndarray, d: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that can hold a vector within ``reach``."""
        ahead = d - d[np.arange(len(own)), own][:, None]
        return np.nonzero(ahead <= 2 * self.gaps[own] * (reach + 1e-7) + 1e-9)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error of each residual's reconstruction)."""
        codes = np.stack([_nearest(rest[:, a:b], k) for (a, b), k in zip(zip(self.edges[:-1], self.edges[1:]), self.books)], 1).astype(np.uint8)
        again = np.concatenate([k[codes[:, j]] for j, k in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - again) ** 2).sum(1))

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of a residual's parts to all sub-centroids: row, part, code."""
        width = max(len(k) for k in self.books)
        out = np.zeros((len(rest), len(self.books), width))
        for j, k in enumerate(self.books):
            out[:, j, : len(k)] = _squares(rest[:, self.edges[j] : self.edges[j + 1]], k)
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _squares(x, y).argmin(1)


def _means(x: np.ndarray, k: int, rounds: int, random) -> np.ndarray:
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centres


def _in_list(quantiser, least: float, reach: float, kind):
    """Links between the probing rows and the listed rows of a pair of chunks of one inverted list."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q = quantiser.value
        x = _unit(np.frombuffer(b"".join(rows["raw"]), kind).astype(np.float64).reshape(len(rows), -1))
        node, copies, listed = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["listed"].to_numpy()
        own, probed = rows["own"].to_numpy(), rows["probed"].to_numpy()
        number = pd.factorize(rows["node"])[0]
        base, asks = np.flatnonzero(listed), np.flatnonzero(~listed)
        if not len(base) or not len(asks):
            return pd.DataFrame({"a": [], "b": [], "links": pd.array([], "Int64")})
        rest = x - q.coarse[int(rows["list"].iloc[0])]
        codes, error = q.encode(rest[base])
        count, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
        asks_back: dict[int, np.ndarray] = {}  # of a list: which rows of this one probe it themselves
        for start in range(0, len(asks), 256):
            part = asks[start : start + 256]
            tables = q.tables(rest[part])
            far = np.zeros((len(part), len(base)))
            for j in range(codes.shape[1]):
                far += tables[:, j, codes[:, j]]
            near = np.sqrt(far) - error <= reach + 1e-6
            for i, row in enumerate(part.tolist()):
                right = base[near[i]]
                right = right[number[right] != number[row]]
                right = right[(x[right] * x[row]).sum(1) >= least]
                count[row] += copies[right].sum()
                if len(right):
                    if own[row] not in asks_back:
                        asks_back[own[row]] = np.zeros(len(rows), bool)
                        asks_back[own[row]][base] = [own[row] in p for p in probed[base]]
                    # a row that does not probe the asking one's list gets the link here, any other by asking itself
                    count[right[~asks_back[own[row]][right]]] += copies[row]
                forest.link(row, right)
        hit = np.flatnonzero(count > 0)
        a = node[hit].tolist() + [node[i] for i, _ in forest.kept]
        b = [None] * len(hit) + [node[j] for _, j in forest.kept]
        return pd.DataFrame({"a": a, "b": b, "links": count[hit].tolist() + [0] * len(forest.kept)})

    return run


def find(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, sample: int = 20_000, list_size: int = 256, most_lists: int = 4096, certainty: float = 4.0) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows of equal, non-null label link if their cosine in double precision is at least ``least``.  n_links counts other
    rows linked directly (a link that either row finds counts for both), component_id is the smallest vec_id reachable, kept says whether that is the row's own.  Null
    labels, null or zero vectors, and vectors with null, NaN or infinite components link with nothing.  Vectors of other
    lengths are compared with their like only.  Repeated rows link with each other.  A null vec_id stays null.
    The quantiser is fitted on about ``sample`` vectors chosen by a hash, with a list for each ``list_size`` vectors and
    ``most_lists`` at most; every vector is indexed.
    """
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[vec_id]
    rows = df.select(df[vec_id].alias("vec_id"), df[label].cast("string").alias("label"), df[embedding].cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    # An equal vector of a label is one class; its number is a hash of what it holds.
    rows = rows.withColumn("key", F.when(usable, F.unhex(F.sha2(F.concat_ws("|", F.length("label"), "label", F.concat_ws(",", F.transform("v", lambda c: c.cast("string")))), 256))))
    rows = stored(rows)
    classes = rows.where("key is not null").groupBy("key", "label").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = stored(classes.withColumnRenamed("key", "node").withColumn("width", F.size("v")))
    single = df.schema[embedding].dataType.elementType.typeName() == "float"
    links = spark.createDataFrame([], "a binary, b binary, links bigint")
    for width, total in sorted((r["width"], r["count"]) for r in classes.groupBy("width").count().collect()):
        links = links.unionAll(_links(classes.where(F.col("width") == width), int(total), least, sample, list_size, most_lists, certainty, np.dtype("<f4" if single else "<f8")))
    links = stored(links)
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = components(links.where("b is not null")).join(classes.select("node", "first_id"), "node")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(names, "component").select("node", "component_id")
    known = classes.select("node", "first_id", "copies").join(counts, "node", "left").join(of_node, "node", "left")
    known = known.select(F.col("node").alias("key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    # Stored, so that Spark can split the join at a vector with many copies.
    out = rows.select("vec_id", "key").join(stored(known), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast(kind)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, total: int, least: float, sample: int, list_size: int, most_lists: int, certainty: float, kind) -> DataFrame:
    """(a, null, links) and (a, b, 0) rows for classes of vectors of one length."""
    spark = classes.sparkSession
    chosen = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < min(1.0, sample / total) * (1 << 20)).select("v").limit(2 * sample).collect() or classes.select("v").limit(1).collect()
    x = np.array(sorted(tuple(r["v"]) for r in chosen), dtype=np.float64)
    quantiser = spark.sparkContext.broadcast(Quantiser(_unit(x), max(1, min(most_lists, total // list_size, len(x)))))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    across = reach * min(1.0, certainty / max(1, x.shape[1] - 1) ** 0.5)

    def deal(batches):
        q = quantiser.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                x = np.array(batch.column(3).to_pylist(), np.float64).reshape(batch.num_rows, -1)
                own, d = q.assign(_unit(x))
                row, to = q.probes(own, d, across)
                at = np.concatenate([np.arange(len(own)), row])
                lists = np.concatenate([own, to])
                listed = np.concatenate([np.ones(len(own), bool), np.zeros(len(row), bool)])
                raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                cuts = np.searchsorted(row, np.arange(1, len(own)))
                probed = pa.array([p.tolist() for p in np.split(to, cuts)] + [None] * len(row), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:3]), pa.array(lists, pa.int32()), pa.array(listed, pa.bool_()), raw.take(pa.array(at)), pa.array(own[at], pa.int32()), probed], names=["node", "label", "copies", "list", "listed", "raw", "own", "probed"])

    dealt = stored(map_batches(classes.select("node", "label", "copies", "v"), deal, "node binary, label string, copies bigint, list int, listed boolean, raw binary, own int, probed array<int>"))
    group = ["label", "list"]
    sizes = dealt.groupBy(*group).agg(F.ceil(F.count_if("listed") / CHUNK).cast("int").alias("bases"), F.ceil(F.count_if(~F.col("listed")) / CHUNK).cast("int").alias("asks"))
    spread = dealt.join(sizes, group)
    hash_part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    # A listed row goes to every chunk of probing rows, and the other way round.
    pairs = F.when(F.col("listed"), F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda i: F.struct(hash_part("bases").alias("base"), i.alias("ask")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("bases") - 1), lambda i: F.struct(i.alias("base"), hash_part("asks").alias("ask"))))
    placed = spread.where("bases > 0 and asks > 0").withColumn("pair", F.explode(pairs)).select(*group, "pair.base", "pair.ask", "node", "copies", "listed", "raw", "own", "probed")
    # Dealt out anew: else all pairs of chunks of a list stay in the task that its rows were joined in.
    return placed.repartition(*group, "base", "ask").groupBy(*group, "base", "ask").applyInPandas(_in_list(quantiser, least, reach, kind), "a binary, b binary, links bigint")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
