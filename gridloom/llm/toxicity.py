"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (all of it): densities of hand-written lexicons and of a learned one, insults near second-person words,
capitals, punctuation, obfuscation (symbols or digits inside words, hits that appear only after undoing look-alike
characters, spelled-out letters, stretched letters) and length.  The learned lexicon has words and word beginnings whose
share of toxic texts in the sample is far above the rest's; a text's features for fitting use the lexicon of the
other half of the sample, so the trees see it as it will be on new texts.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0, at most SAMPLE of them (those with the smallest
hashes; each text once).  labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are scored (all densities 0); without usable labels every score is 0; repeated rows
get equal scores; labels with null or other values are left out, and a doc_id with several labels has the largest.
A text's features and score don't depend on the rows beside it, nor on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, bytes_hash, cut, mix, text_chunks, words
from .trees import Boosted, calibrated, isotonic

# Parameters: labelled texts of the sample, entries of the learned lexicon, different texts that an entry needs.
SAMPLE, LEXICON, LEAST = 20_000, 20_000, 4

# Hand-written lexicons.
INSULTS = "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage pathetic worthless disgusting clown clowns fool fools imbecile cretin halfwit dimwit jerk creep vermin filth filthy ugly coward liar lunatic psycho retard retarded freak parasite pig swine rat useless brainless spineless idiota imbecil estupido estupida tonto basura asco payaso idioten dummkopf trottel abschaum arschloch widerlich nutzlos versager imbecile abruti crétin ordure nul clown dégoûtant salaud connard pathétique".split()
PROFANITY = "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard asshole ass crap damn hell piss prick dick cunt whore slut scheisse scheiße merde putain mierda puta joder cabron".split()
THREATS = "kill die death hurt destroy burn hang shoot murder beat smash choke drown rot suffer töten sterben tuer mourir matar morir".split()
SECOND = "you your yours yourself youre u ur ya du dich dir dein deine ihr euch tu te toi ton ta vous votre tú tu ti usted ustedes vosotros".split()
LISTS = (INSULTS, PROFANITY, THREATS, SECOND)

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "*@$#%&+=_|.-0123456789"]] = True
# Look-alike characters.
LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("0134578@$!|+", "oieastbasilt", strict=True):
    LEET[ord(_a)] = ord(_b)
#: Lengths in bytes of the word beginnings that the learned lexicon knows.
HEADS = (4, 5, 6)


def _hashes(ws: list[str]) -> np.ndarray:
    out = []
    for w in ws:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(bytes_hash(b, np.zeros(1, np.int64), np.full(1, len(b)))[0])
    return np.unique(np.array(out, np.uint64))


HAND = tuple(map(_hashes, LISTS))


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)


def terms(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of letters (starts, ends, counts, hashes) and the hashes of their beginnings (0 where a word is no longer)."""
    starts, ends, counts = words(low, offs, ~LETTER)
    heads = [np.where(ends - starts > k, mix(bytes_hash(low, starts, np.minimum(starts + k, ends)) + np.uint64(k)), np.uint64(0)) for k in HEADS]
    return starts, ends, counts, bytes_hash(low, starts, ends), heads


@dataclass
class Lexicon:
    """Sorted hashes of learned entries and their log odds."""

    keys: np.ndarray
    odds: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.odds[at], 0.0)


def features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    low = LOWER[data]
    n = len(offs) - 1
    starts, ends, counts, h, heads = terms(low, offs)

    def per(flags: np.ndarray, at: np.ndarray) -> np.ndarray:  # whole numbers: exact
        sums = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]]

    def total(weights: np.ndarray) -> np.ndarray:  # of a row's words in their order, whatever stands beside the row
        return np.bincount(rows, weights, n)

    n_words, n_bytes = np.maximum(np.diff(counts), 1), np.maximum(np.diff(offs), 1)
    hits = [among(h, t) for t in HAND]
    bad = hits[0] | hits[1]
    rows = np.repeat(np.arange(n), np.diff(counts))
    before = np.concatenate([[0], np.cumsum(hits[3])])
    near = before[np.minimum(np.arange(len(h)) + 6, counts[rows + 1])] > before[np.maximum(np.arange(len(h)) - 5, counts[rows])]
    word_odds = lexicon.of(h)
    head_odds = np.maximum.reduce([lexicon.of(x) for x in heads]) if len(h) else np.zeros(0)
    best = np.maximum(word_odds, head_odds)

    # look-alike characters undone, everything that isn't a letter then dropped inside words
    plain = LEET[low]
    keep = LETTER[plain] | SPACE[low]
    part, sub = plain[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
    s2, e2, c2 = words(part, sub)
    h2 = bytes_hash(part, s2, e2)
    undone = among(h2, HAND[0]) | among(h2, HAND[1])
    single = (e2 - s2) == 1
    begins = np.zeros(len(single) + 1, bool)
    begins[c2] = True
    spelled = single & ~begins[:-1]
    spelled[1:] &= single[:-1]

    caps = (data >= 65) & (data <= 90)
    letter = LETTER[low]
    inside = np.zeros(len(low), bool)
    stretched = np.zeros(len(low), bool)
    doubled = np.zeros(len(low), bool)
    first = np.zeros(len(low) + 1, bool)  # neighbours are of the same text
    first[offs] = True
    inside[1:-1] = SYMBOL[low[1:-1]] & letter[:-2] & letter[2:] & ~first[1:-2] & ~first[2:-1]
    stretched[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & ~first[2:-1] & ~first[1:-2]
    doubled[1:] = PUNCT[low[1:]] & (low[1:] == low[:-1]) & ~first[1:-1]
    caps_before = np.concatenate([[0], np.cumsum(caps)])
    shouted = ((caps_before[ends] - caps_before[starts]) == ends - starts) & (ends - starts > 2)
    count_bad, count_best = per(bad, counts), per(best > 0, counts)
    most = np.zeros(n)
    np.maximum.at(most, rows, best)
    columns = [
        np.log1p(np.diff(counts)), np.log1p(np.diff(offs)), per(hits[0], counts) / n_words, np.minimum(per(hits[0], counts), 20), per(hits[1], counts) / n_words, per(hits[2], counts) / n_words,
        per(hits[3], counts) / n_words, per(bad & near, counts) / n_words, np.minimum(count_bad, 20), total(word_odds) / n_words, total(head_odds) / n_words, total(best), most,
        np.minimum(count_best, 50), count_best / n_words, per(best > 2, counts), per(best > 2, counts) / n_words, per(caps, offs) / n_bytes, per(shouted, counts) / n_words, per(low == 33, offs) / n_bytes, per(low == 63, offs) / n_bytes,
        per(PUNCT[low], offs) / n_bytes, per(doubled, offs) / n_bytes, per(inside, offs) / n_bytes, per(stretched, offs) / n_bytes, np.maximum(per(undone, c2) - count_bad, 0), per(spelled, c2) / n_words, per(data >= 128, offs) / n_bytes,
    ]
    return np.stack(columns, 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(offs) - 1)
        return calibrated(self.knots, self.trees.raw(features(data, offs, self.lexicon)))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled rows (h, doc_id, text, label, half), none held out, each text once with its smallest doc_id's label; the rows are bounded, so is the broadcast."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "label", "text")).alias("r"))
    return one.select("h", "r.doc_id", "r.text", "r.label", F.pmod("h", F.lit(2)).cast("int").alias("half"))


def _lexicons(rows: DataFrame, most: int, least: int) -> list[Lexicon]:
    """Entries of the first half, the second half and of both; only those that stand out come to the driver, at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                _, _, counts, h, heads = terms(LOWER[data], offs)
                doc = np.repeat(np.arange(j - i), np.diff(counts))
                key, doc = np.concatenate([h, *heads]), np.tile(doc, 1 + len(heads))
                key, doc = key[key != 0], doc[key != 0]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                kind = np.array(b.column("label")[i:j].to_pylist(), np.int64) + 2 * np.array(b.column("half")[i:j].to_pylist(), np.int64)
                code, n = np.unique(np.stack([key[new], kind[doc[new]].astype(np.uint64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code[0].view(np.int64)), pa.array(code[1].astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "kind", "n"])

    each = rows.select("label", "half", "text").mapInArrow(run, "key long, kind int, n int")
    at = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    table = each.groupBy("key").agg(*(at(k).alias(f"n{k}") for k in range(4))).where((F.col("n1") + F.col("n3") >= least) & ((F.col("n1") + F.col("n3")) * 4 >= F.col("n0") + F.col("n2")))
    table = table.orderBy((F.col("n1") + F.col("n3")).desc(), "key").limit(most).toArrow()
    totals = {(r["label"], r["half"]): r["n"] for r in rows.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    key, n = table.column("key").to_numpy().view(np.uint64), np.stack([table.column(f"n{k}").to_numpy() for k in range(4)]).astype(float)
    out = []
    for halves in ((0,), (1,), (0, 1)):
        tox, rest = sum(n[1 + 2 * f] for f in halves), sum(n[2 * f] for f in halves)
        all_tox, all_rest = (sum(totals.get((k, f), 0) for f in halves) + 1.0 for k in (1, 0))
        odds = np.log((tox + 0.3) / all_tox) - np.log((rest + 0.3) / all_rest)
        pick = (tox >= max(2, least * len(halves) / 2)) & (odds > 1.0)
        order = np.argsort(key[pick])
        out.append(Lexicon(key[pick][order], np.minimum(odds[pick][order], 6.0)))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    rows = cut(sample(docs, labels, label, most), "toxicity-sample")
    first, second, both = _lexicons(rows, LEXICON, LEAST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                half = np.array(b.column("half")[i:j].to_pylist(), np.int64)
                x = np.where((half == 0)[:, None], features(data, offs, second), features(data, offs, first))
                yield pa.RecordBatch.from_arrays([b.column("h")[i:j], b.column("label")[i:j].cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["h", "label", "x"])

    got = rows.select("h", "label", "half", "text").mapInArrow(run, "h long, label int, x array<double>").toArrow().sort_by("h")
    y = got.column("label").to_numpy().astype(float)
    if len(y) < 20 or y.min() == y.max():
        return Model(both, None, None)
    x = np.array(got.column("x").to_pylist())
    # four fifths (by the text's hash) for the trees that are calibrated on the rest; then the same trees on all
    fold = mix(got.column("h").to_numpy().astype(np.uint64)) % np.uint64(5)
    raw = np.zeros(len(y))
    for k in range(5):
        raw[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(both, Boosted().fit(x, y), isotonic(raw, y))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                s = shared.value.score(data, offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("held_out")[i:j], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key]).alias("held_out"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def flagged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `predicted` (in place of a column of that name), without moving them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    # a column of that name gives way
    others = [k for k, c in enumerate(docs.columns) if c != "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.RecordBatch.from_arrays([b.column(at)], ["text"])
            s = [shared.value.score(d, o) for _, _, d, o in text_chunks(data)]
            yield b.select(others).append_column("predicted", pa.array((np.concatenate([np.zeros(0), *s]) >= 0.5).astype(np.int32)))

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in others), T.StructField("predicted", T.IntegerType())]))
