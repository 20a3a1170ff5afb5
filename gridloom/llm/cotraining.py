"""Quality scores by co-training two views of a document: its text and its metadata.

The text view sees dense rates of the whole text (characters, words, repetition, lines); the metadata view sees lang,
source and n_chars (hashed one-hot and logarithm) and never the text.  Each view has its own boosted trees.  Texts are read
once, into a table of both views' features.  In each round both views are fitted, each scores all unlabelled rows of that
table, and the GIVEN different ones of which it is most certain join the other view's rows.  Each view is calibrated on
out-of-fold scores of the labelled rows, and a logistic model of both calibrated scores, fitted on the same rows, gives
the result.

Fitting uses at most SAMPLE labelled rows (crc32(doc_id as text) mod 5 not 0, the smallest hashes); the pool of unlabelled rows
is all of them but held-out ones.  Scoring covers every row.  Defined results: null text is an empty text, null lang,
source and n_chars are values of their own; without usable labels all scores are 0.5; repeated rows get equal scores; a
score doesn't depend on the rows beside it, nor on partitions.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bytes_hash, cut, mix, text_chunks, words
from .toxicity import Lexicon, features, held_out
from .trees import Boosted, calibrated, isotonic

# Parameters: labelled rows, rounds, rows that a view gives in a round, the certainty it needs, hashed places.
SAMPLE, ROUNDS, GIVEN, CERTAIN, PLACES = 12_000, 3, 400, 0.95, 24
NOTHING = Lexicon(np.zeros(0, np.uint64), np.zeros(0))


def text_view(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    low = LOWER[data]
    starts, ends, counts = words(low, offs)
    h, k = bytes_hash(low, starts, ends), np.maximum(np.diff(counts), 1)
    rows = np.repeat(np.arange(n), np.diff(counts))
    order = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][new], minlength=n)
    line = np.zeros(256, bool)
    line[[10, 13]] = True
    ls, le, lc = words(low, offs, line)
    lh, lrows = bytes_hash(low, ls, le), np.repeat(np.arange(n), np.diff(lc))
    lorder = np.lexsort((lh, lrows))
    lnew = np.ones(len(lh), bool)
    lnew[1:] = (lh[lorder][1:] != lh[lorder][:-1]) | (lrows[lorder][1:] != lrows[lorder][:-1])
    lines = np.maximum(np.diff(lc), 1)
    length = np.bincount(rows, ends - starts, n) / k
    tail = np.bincount(rows, ~((low[ends - 1] >= 97) & (low[ends - 1] <= 122) | (low[ends - 1] >= 128)), n) / k if len(ends) else np.zeros(n)
    more = [length, distinct / k, np.bincount(lrows[lorder][lnew], minlength=n) / lines, np.diff(offs) / lines, k / lines, tail, np.log1p(lines)]
    return np.concatenate([features(data, offs, NOTHING), np.stack(more, 1)], 1)


@lru_cache(100_000)
def _place(value: str | None) -> int:
    return zlib.crc32((value or "\0").encode()) % PLACES


def meta_row(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Places of lang and source, logarithm of n_chars, whether that is missing."""
    x = np.zeros((len(lang), 4), np.float32)
    x[:, 0] = [_place(v) for v in lang]
    x[:, 1] = [_place(v) for v in source]
    x[:, 2] = [np.log1p(max(v, 0)) if v is not None else -1 for v in n_chars]
    x[:, 3] = [v is None for v in n_chars]
    return x


def meta_view(rows: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), 2 * PLACES + 2))
    at = np.arange(len(rows))
    x[at, rows[:, 0].astype(int)] = 1
    x[at, PLACES + rows[:, 1].astype(int)] = 1
    x[:, -2:] = rows[:, 2:]
    return x


def _trees() -> Boosted:
    return Boosted(rounds=60, depth=3)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Model:
    views: tuple[Boosted, Boosted] | None
    knots: tuple | None
    weights: np.ndarray | None

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            half = np.full(len(views[0]), 0.5)
            return half, half, half
        p = [calibrated(k, v.raw(x)) for k, v, x in zip(self.knots, self.views, views, strict=True)]
        z = self.weights[0] + self.weights[1] * _logit(p[0]) + self.weights[2] * _logit(p[1])
        return 1 / (1 + np.exp(-z)), p[0], p[1]


VIEWS = "doc_id long, held_out boolean, h long, a array<float>, b array<float>"


def views(docs: DataFrame) -> DataFrame:
    """The written features of every row: doc_id, held_out, h (a name of the row's content), a (text view), b (metadata)."""
    meta = [docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["n_chars"].cast("double").alias("n_chars")]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), F.coalesce(docs["text"], F.lit("")).alias("text"), *meta)
    rows = rows.select("*", F.xxhash64("text", F.struct("lang", "source", "n_chars")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                a, m = text_view(data, offs).astype(np.float32), meta_row(*(b.column(c)[i:j].to_pylist() for c in ("lang", "source", "n_chars")))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel())) for v in (a, m)]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in ("doc_id", "held_out", "h")), *lists], ["doc_id", "held_out", "h", "a", "b"])

    return cut(rows.mapInArrow(run, VIEWS), "quality-views")


def _matrices(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.array(rows.column(c).flatten() if isinstance(rows, pa.RecordBatch) else rows.column(c).combine_chunks().flatten(), np.float32).reshape(len(rows), -1) for c in ("a", "b"))
    return a.astype(float), meta_view(b)


def _sure(free: DataFrame, trees: tuple[Boosted, Boosted], taken: set[int]) -> list[pa.Table]:
    """For each view the GIVEN different rows of all unlabelled ones of which it is most certain, with its label for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None, None]
        for b in batches:
            x, h = _matrices(b), b.column("h").to_numpy()
            new = ~np.isin(h, np.array(sorted(taken), np.int64))
            for v in range(2):
                p = 1 / (1 + np.exp(-trees[v].raw(x[v])))
                sure = np.maximum(p, 1 - p)
                at = np.flatnonzero(new & (sure >= CERTAIN))
                some = pa.table({"view": pa.array(np.full(len(at), v, np.int32)), "sure": sure[at], "h": h[at], "label": (p[at] >= 0.5).astype(float), "a": b.column("a").take(pa.array(at)), "b": b.column("b").take(pa.array(at))})
                both = some if held[v] is None else pa.concat_tables([held[v], some])
                key, certain = both.column("h").to_numpy(), both.column("sure").to_numpy()
                order = np.lexsort((key, -certain))
                order = order[np.sort(np.unique(key[order], return_index=True)[1])][:GIVEN]
                held[v] = both.take(pa.array(order)).combine_chunks()
        for t in held:
            if t is not None:
                yield from t.to_batches()

    best = cut(free.select("h", "a", "b").mapInArrow(run, "view int, sure double, h long, label double, a array<float>, b array<float>"), "quality-sure")
    return [best.where(F.col("view") == v).dropDuplicates(["h"]).orderBy(F.col("sure").desc(), "h").limit(GIVEN).toArrow().sort_by("h") for v in range(2)]


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """A model from views() and labels (doc_id, label)."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(most)
    rows = features.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "h"]).orderBy(F.xxhash64("doc_id", "h", F.lit(13)), "doc_id", "h").limit(most).toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    y = rows.column("label").to_numpy().astype(float)
    if len(y) < 20 or y.min() == y.max():
        return Model(None, None, None)
    own = _matrices(rows)
    free = cut(features.where(~F.col("held_out")).join(labels.select(labels["doc_id"].cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti"), "quality-free")
    grown, taken = [(x, y) for x in own], set()
    for _ in range(ROUNDS):
        sure = _sure(free, tuple(_trees().fit(*g) for g in grown), taken)
        for v in range(2):  # each view's rows go to the other one
            given = sure[1 - v]
            if len(given):
                grown[v] = np.concatenate([grown[v][0], _matrices(given)[v]]), np.concatenate([grown[v][1], given.column("label").to_numpy()])
        taken |= {h for t in sure for h in t.column("h").to_pylist()}
    fold = mix(rows.column("h").to_numpy().astype(np.uint64)) % np.uint64(4)
    raw = np.zeros((2, len(y)))
    for k in range(4):
        for v in range(2):  # the other folds and the rows that the rounds gave
            use = np.concatenate([fold != k, np.ones(len(grown[v][1]) - len(y), bool)])
            raw[v, fold == k] = _trees().fit(grown[v][0][use], grown[v][1][use]).raw(own[v][fold == k])
    knots = tuple(isotonic(raw[v], y) for v in range(2))
    z = np.stack([np.ones(len(y)), *(_logit(calibrated(knots[v], raw[v])) for v in range(2))], 1)
    w = np.array([0.0, 1.0, 0.0])
    for _ in range(25):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(3), z.T @ (y - p) - w)
    return Model(tuple(_trees().fit(*g) for g in grown), knots, w)


def score(features: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, p_text, p_meta, predicted for every row of views()."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, a, m = shared.value.score(_matrices(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(both), pa.array(a), pa.array(m), pa.array((both >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "p_text", "p_meta", "predicted"])

    return features.mapInArrow(run, "doc_id long, held_out boolean, score double, p_text double, p_meta double, predicted int")
