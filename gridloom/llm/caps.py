"""Near-duplicate vectors by spherical-cap filters: structured random product codes, list decoding, join on filters, verify, the rest exactly.

A filter is a direction built from one codeword of each of PARTS random codes on PARTS slices of a (randomly rotated) vector, so
its inner product with a vector is a sum of PARTS table entries.  List decoding finds all filters whose sum reaches
the bound without listing all: the codewords of each slice are sorted, and sums are found best first until they fall below.  The
bound is fixed for a length: random unit vectors have FILTERS filters on average.  A vector with fewer than LEAST of them has its
LEAST best ones, so every vector has filters; none is dropped.  Vectors shorter than SHORT have too few different sums for
caps; they all have one filter, so those of a label are compared in blocks, without a loss.

Some linking pairs share no cap.  So all longer vectors have one more filter, WHOLE, the last: it stands for the whole sphere, and
its blocks find the links that no cap gave.  Their cost grows with the square of a label's different vectors.

Vectors that are equal bit for bit are one node with a weight, so a very common vector costs one row.  Nodes meet in
blocks of (label, filter); a large block is cut into parts that meet pairwise, so no block holds more than two parts.  A pair
that shares several filters is counted in the smallest shared one only.  Cosines are computed in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
have 0 links and are their own component; vectors of different lengths don't link; repeated rows link.
Results are tested against brute force; the caps' own recall is too (at least 0.95, for lengths from SHORT on; 1 below).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions

# Parameters: cosine, slices and codewords of each, filters of a random vector and the fewest of any, the shortest vector with caps,
# vectors of a block's part, seed.
COSINE, PARTS, WORDS_EACH, FILTERS, LEAST, SHORT, PART, SEED = 0.98, 4, 32, 8, 32, 16, 1024, 5
# The filter of all vectors, after all caps, and vectors of a part of its blocks.
WHOLE, WHOLE_PART = WORDS_EACH**PARTS, 4096


@lru_cache(8)
def codes(dim: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, int]]]:
    """The rotation, and for each slice its codewords (unit length) and bounds."""
    rng = np.random.default_rng(SEED + dim)
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    edges = np.linspace(0, dim, PARTS + 1).astype(int)
    words = [rng.standard_normal((WORDS_EACH, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return turn, [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) for w in words], list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def decode(tables: np.ndarray, bound: float, least: int) -> list[int]:
    """Numbers of all product codewords whose sum reaches the bound, and of the `least` largest (ties: smaller place in the sorted codes); tables: PARTS x codewords.

    Best first over the sorted codewords of each slice: a state's successors move one slice at or after its last moved one a place
    down, so each product is reached once and never before a larger sum.
    """
    order = np.argsort(-tables, axis=1, kind="stable")
    value = np.take_along_axis(tables, order, 1)
    parts, n = tables.shape
    drop, order = (value[:, :-1] - value[:, 1:]).tolist(), order.tolist()
    heap = [(-float(value[:, 0].sum()), (0,) * parts, 0)]
    out: list[int] = []
    while heap:
        s, at, last = heapq.heappop(heap)
        if -s < bound and len(out) >= least:
            break
        code = 0
        for p in range(parts):
            code = code * n + order[p][at[p]]
        out.append(code)
        for p in range(last, parts):
            if at[p] + 1 < n:
                heapq.heappush(heap, (s + drop[p][at[p]], (*at[:p], at[p] + 1, *at[p + 1 :]), p))
    return out


def sums(unit: np.ndarray) -> np.ndarray:
    """n x PARTS x codewords: what each codeword adds to a vector's sum."""
    turn, words, edges = codes(unit.shape[1])
    turned = unit @ turn
    return np.stack([turned[:, a:b] @ w.T for w, (a, b) in zip(words, edges, strict=True)], 1)


@lru_cache(8)
def bound_of(dim: int) -> float:
    """The sum that random unit vectors of this length reach with FILTERS codewords on average."""
    v = np.random.default_rng(SEED).standard_normal((64, dim))
    tables = sums(v / np.linalg.norm(v, axis=1, keepdims=True))
    a, b = ((t[:, :, None] + u[:, None, :]).reshape(len(v), -1) for t, u in ((tables[:, 0], tables[:, 1]), (tables[:, 2], tables[:, 3])))
    a, b = np.sort(a, 1), np.sort(b, 1)
    low, high = 0.0, 2.0
    for _ in range(30):
        mid = (low + high) / 2
        many = np.mean([(len(y) - np.searchsorted(y, mid - x)).sum() for x, y in zip(a, b, strict=True)])
        low, high = (mid, high) if many > FILTERS else (low, mid)
    return high


def filters(unit: np.ndarray) -> list[np.ndarray]:
    """The numbers of each row's filters, sorted."""
    dim = unit.shape[1]
    if dim < SHORT:
        return [np.zeros(1, np.int64)] * len(unit)
    bound = bound_of(dim)
    return [np.sort(np.array(decode(t, bound, LEAST), np.int64)) for t in sums(unit)]


NODES = "vec_id long, label long, node binary"


def _clean(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, node: the vector's bytes as doubles, null if it can't link; -0.0 counts as 0.0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, l in zip(b.column("v").to_pylist(), b.column("label").to_pylist(), strict=True):
                x = np.array(v, np.float64) + 0.0 if v and l is not None and None not in v else np.zeros(0)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "node"])

    return vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), vectors[vector].cast("array<double>").alias("v")).mapInArrow(run, NODES)


def _units(blobs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.float64) for b in blobs])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


LINKS = "vec long, n_links long, root long"


def _share(own: np.ndarray, here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows have a filter below `here` in common."""
    some = np.zeros(len(own), bool)
    some[a] = some[b] = True
    at, own = np.cumsum(some) - 1, own[some]
    # a bit for each smaller filter that several of these vectors have
    less = (own >= 0) & (own < here)
    _, kind, many = np.unique(own[less], return_inverse=True, return_counts=True)
    use = many[kind] > 1
    row, kind = np.nonzero(less)[0][use], (np.cumsum(many > 1) - 1)[kind[use]]
    bits = np.zeros((len(own), int((many > 1).sum()) // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (row, kind >> 3), np.left_shift(1, kind & 7).astype(np.uint8))
    out, step = np.zeros(len(a), bool), (1 << 24) // bits.shape[1] + 1
    for s in range(0, len(a), step):
        out[s : s + step] = (bits[at[a[s : s + step]]] & bits[at[b[s : s + step]]]).any(1)
    return out


def _block(unit: np.ndarray, own: np.ndarray, here: int, part: np.ndarray, same: bool, vec: np.ndarray, weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a block (one part with itself, or two parts with each other): rows linked with it in pairs that this
    filter counts, and the least node linked in it (itself if none is less)."""
    n, root = np.zeros(len(vec), np.int64), vec.copy()
    first = len(vec) if same else int((part == part[0]).sum())
    for i in range(0, first, 256):
        stop = min(i + 256, first)
        skip = i if same else first
        a, b = np.nonzero(unit[i:stop] @ unit[skip:].T >= cosine - 1e-9)
        a, b = a + i, b + skip
        a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        a, b = a[exact], b[exact]
        np.minimum.at(root, a, vec[b])
        np.minimum.at(root, b, vec[a])
        # a pair counts in the smallest filter that both have
        earlier = _share(own, here, a, b)
        a, b = a[~earlier], b[~earlier]
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
    return n, root


def _padded(blobs: list[bytes]) -> np.ndarray:
    """A row of filters for each vector, filled up with -1."""
    size = np.array([len(x) for x in blobs]) // 8
    out = np.full((len(blobs), size.max()), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(blobs), np.int64)
    return out


def _meet(cosine: float):
    def run(t: pa.Table) -> pa.Table:
        label, dim, here, a, b, part, vec, weight = (t.column(c).to_numpy() for c in ("label", "dim", "filter", "a", "b", "part", "vec", "weight"))
        order = np.lexsort((vec, part, b, a, here, dim, label))
        nodes, filts = t.column("node").to_pylist(), t.column("filters").to_pylist()
        key = np.stack([label, dim, here, a, b])[:, order]
        out: list[list[np.ndarray]] = [[], [], []]
        for at in np.split(order, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1):
            if len(at) < 2:
                continue
            n, root = _block(_units([nodes[i] for i in at]), _padded([filts[i] for i in at]), int(here[at[0]]), part[at], bool(a[at[0]] == b[at[0]]), vec[at], weight[at], cosine)
            keep = (n > 0) | (root < vec[at])
            for c, v in zip(out, (vec[at][keep], n[keep], root[keep]), strict=True):
                c.append(v)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], ["vec", "n_links", "root"])

    return run


def near(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    rows = cut(_clean(vectors, key, vector, label).withColumn("vec", F.when(F.col("node").isNotNull(), F.xxhash64("label", "node"))), "caps-rows")
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.first("label").alias("label"), F.first("node").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("node").to_pylist()
            sizes = np.array([len(x) for x in blobs])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                own = filters(_units([blobs[i] for i in at]))
                own = [np.append(x, WHOLE) for x in own] if d // 8 >= SHORT else own
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec", "label", "node", "least", "weight")), pa.array(np.full(len(at), d // 8)), pa.array(own, pa.list_(pa.int64()))], ["vec", "label", "node", "least", "weight", "dim", "own"])

    coded = nodes.repartition(4 * partitions(spark), "vec").mapInArrow(send, "vec long, label long, node binary, least long, weight long, dim long, own array<long>")
    coded = cut(coded, "caps-nodes")
    at = coded.select("label", "dim", "vec", F.explode("own").alias("filter"))
    many = at.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.when(F.col("filter") == WHOLE, WHOLE_PART).otherwise(PART)))
    met = at.join(many, ["label", "dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("vec"), "parts"))
    met = met.select("label", "dim", "filter", "vec", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    met = met.select("label", "dim", "filter", "vec", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    met = met.withColumn("task", F.pmod(F.xxhash64("label", "dim", "filter", "a", "b"), F.lit(8 * partitions(spark))))
    full = met.join(coded.select("vec", "weight", "node", F.col("own").alias("filters")), "vec")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("filters")
            yield b.set_column(i, "filters", pa.array([np.array(x, np.int64).tobytes() for x in b.column(i).to_pylist()], pa.binary()))

    full = full.mapInArrow(packed, "vec long, label long, dim long, filter long, part long, a long, b long, task long, weight long, node binary, filters binary")
    links = cut(full.groupBy("task").applyInArrow(_meet(cosine), LINKS).groupBy("vec", "root").agg(F.sum("n_links").alias("n_links")), "caps-links")
    counted = links.groupBy("vec").agg(F.sum("n_links").alias("n_links"))
    comps = components(links.where("root < vec").select(F.col("vec").alias("a"), F.col("root").alias("b")), "caps-star")
    classes = coded.select("vec", "least", "weight").join(counted, "vec", "left").join(comps.withColumnRenamed("node", "vec"), "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.join(classes, "vec", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
