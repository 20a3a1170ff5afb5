"""Substring dedup by recompression: every word covered by a window of 35 words that also starts elsewhere is removed.

Naming.  A word's symbol is its hash.  In each round a seeded bit of its symbol puts a symbol left or right, and each left
one followed by a right one becomes one symbol, the hash of the pair.  Names are hashes, so the same pair has the same
name in every task and document.  A symbol's neighbours decide only about itself: a round can change at most the first
and the last symbol of two equal stretches.  After ROUNDS rounds a symbol spans at most 2**ROUNDS words, and in equal
windows all symbols that start from EDGE = 2**ROUNDS - 1 words inside agree.  Equal neighbours (runs) fall on one side and
keep their length: a name for a whole run would depend on words outside of the window.

Search.  1. Of the symbols that start in a window's interior, the one with the least name (leftmost if equal) is the
window's anchor, about one in 14 words; its key is the hash of the ten words around it that every window of this
anchor holds.  2. Keys that occur once in the corpus can't belong to a repeated window.  3. Windows whose anchor's key is
shared are hashed whole (64 bits of 35 words) and those hashes are counted.  4. Windows with a hash that occurs again
cover the words to be removed.

Each chunk of rows sends a key or a hash once, however often it occurs there, in one blob a bucket; repeats within the
chunk are settled at once.  So a passage that a third of all documents hold costs each reducer at most an entry a chunk.
Texts move once (by document, an exchange that both later steps share).

Defined results: null and empty texts have no words; a text shorter than a window loses none; the same window twice in one
text counts as a repeat; repeated rows repeat each other.  Rows with one doc_id and different texts are told apart by
the text's hash; rows with a null doc_id count and are returned like others.  Windows are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob, bytes_hash, cut, mix, partitions, reps, text_chunks, trim, windows_hash, words

# Words of a window, naming rounds.
WINDOW, ROUNDS = 35, 2


def symbols(names: np.ndarray, firsts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and start places of the symbols after all rounds; firsts: places where a row begins (pairs don't cross)."""
    at = np.arange(len(names))
    begins = np.zeros(len(names) + 1, bool)
    begins[firsts] = True
    for r in range(rounds):
        left = (mix(names ^ np.uint64(0x632BE59BD9B4E019 * (r + 1) % 2**64)) & np.uint64(1)) == 1
        head = np.zeros(len(names), bool)
        if len(names) > 1:
            head[:-1] = left[:-1] & ~left[1:] & ~begins[at[1:]]
        tail = np.zeros(len(names), bool)
        tail[1:] = head[:-1]
        nxt = np.roll(names, -1)
        names = np.where(head, mix(names * np.uint64(0x9FB21C651E98DF25) + mix(nxt + np.uint64(r + 1))), names)[~tail]
        at = at[~tail]
    return names, at


def anchors(names: np.ndarray, counts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows (places in `names`, the words of all rows one after another), each one's anchor, and each anchor's key; counts: words before each row."""
    n, edge, span = len(names), 2**rounds - 1, 2**rounds
    rows = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    starts = np.flatnonzero(np.arange(n) + window <= counts[rows + 1]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    sym, at = symbols(names, counts[:-1], rounds)
    bits = max(21, int(n).bit_length())
    value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    value[at] = (sym >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    width, least, have = window - 2 * edge - span + 1, value, 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:]) if len(least) > have else least
        have *= 2
    first = starts + edge
    least = np.minimum(least[first], least[first + width - have])
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    # inside every window of an anchor: from `edge` words before it to window - (edge + width) words after it
    return starts, anchor, windows_hash(names, window - width + 1)[anchor - edge]


def word_names(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, counts = words(data, offs)
    return bytes_hash(data, starts, ends), counts, starts, ends


def dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x1B873593)) % np.uint64(buckets)).astype(np.int64)


def probes(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple]]:
    """(which entries repeat within this chunk, rows (bucket, hashes, owners, places) with one entry of each hash)."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1 if len(h) else np.zeros(0, bool)
    repeated = np.zeros(len(h), bool)
    repeated[order] = many[group] if len(h) else False
    once = order[new]
    b = dealt(hashes[once], buckets)
    once, b = once[np.argsort(b, kind="stable")], np.sort(b)
    edges = np.searchsorted(b, np.arange(buckets + 1))
    return repeated, [(k, hashes[once[s:e]], owner[once[s:e]], place[once[s:e]], repeated[once[s:e]]) for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if e > s]


PROBES = "bucket int, hashes binary, ids binary, keys binary, rows binary, places binary"
BACK = "target int, found binary, ids binary, keys binary, counts binary"
KEPT = "doc_id long, h long, places binary"


def _probe_batch(rows: list[tuple], ids: np.ndarray, hs: np.ndarray) -> pa.RecordBatch:
    """Rows of one chunk: the documents of a row are listed once and entries point to them."""
    cols: list[list] = [[], [], [], [], [], []]
    for bucket, hashes, owner, place, settled in rows:
        docs, back = np.unique(owner, return_inverse=True)
        # the sign bit of a place tells that the chunk itself holds a repeat, so that others count it and this one returns nothing
        for c, v in zip(cols, (bucket, hashes.tobytes(), ids[docs].tobytes(), hs[docs].tobytes(), back.astype(np.uint32).tobytes(), np.where(settled, -1 - place, place).astype(np.int32).tobytes()), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "hashes", "ids", "keys", "rows", "places"])


def _back(owner: np.ndarray, value: np.ndarray, ids: np.ndarray, hs: np.ndarray, targets: int) -> list[tuple]:
    """Rows (target, values, ids, keys, counts): what documents get back, bundled by where they are gathered, so that their
    number follows tasks and not documents times buckets."""
    docs, back, counts = np.unique(owner, return_inverse=True, return_counts=True)
    target = (mix(ids[docs].astype(np.uint64) ^ mix(hs[docs].astype(np.uint64))) % np.uint64(targets)).astype(np.int64)
    by, order = np.argsort(target, kind="stable"), np.lexsort((back, target[back]))
    edges, value = np.searchsorted(target[by], np.arange(targets + 1)), value[order]
    upto = np.concatenate([[0], np.cumsum(counts[by])])
    return [(k, value[upto[s] : upto[e]].tobytes(), ids[docs[by[s:e]]].tobytes(), hs[docs[by[s:e]]].tobytes(), counts[by[s:e]].astype(np.uint32).tobytes()) for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if e > s]


def _back_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["target", "found", "ids", "keys", "counts"])


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    """Bundles that a chunk settles itself, among probes: bucket = -1 - target."""
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([-1 - t for t in cols[0]], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:]), pa.nulls(len(rows), pa.binary())], ["bucket", "hashes", "ids", "keys", "rows", "places"])


def _meet(targets: int, as_hash: bool):
    """Of a bucket: the entries whose hash more than one chunk sent, as bundles of hashes or places; settled bundles pass."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table([pa.array(np.full(len(t), -1 - bucket, np.int32)), *(t.column(c) for c in ("hashes", "ids", "keys", "rows"))], ["target", "found", "ids", "keys", "counts"])
        got = {c: [np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("hashes", np.uint64), ("ids", np.int64), ("keys", np.int64), ("rows", np.uint32), ("places", np.int32))}
        base = np.concatenate([[0], np.cumsum([len(x) for x in got["ids"]])])
        hashes, ids, keys = np.concatenate(got["hashes"]), np.concatenate(got["ids"]), np.concatenate(got["keys"])
        owner = np.concatenate([r.astype(np.int64) + b for r, b in zip(got["rows"], base[:-1], strict=True)])
        place = np.concatenate(got["places"])
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        shared = order[same[1:] | same[:-1]]
        shared = np.sort(shared[place[shared] >= 0])
        return _back_table(_back(owner[shared], hashes[shared] if as_hash else place[shared], ids, keys, targets))

    return run


def _gathered(back: DataFrame, kind: type) -> DataFrame:
    """One row for each document that got something back."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        got = {c: np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in (("found", kind), ("ids", np.int64), ("keys", np.int64), ("counts", np.uint32))}
        order = np.lexsort((got["keys"], got["ids"]))
        ids, keys, counts = got["ids"][order], got["keys"][order], got["counts"].astype(np.int64)
        begin = (np.cumsum(counts) - counts)[order]
        value = got["found"][np.repeat(begin, counts[order]) + reps(counts[order])]
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
        upto = np.concatenate([[0], np.cumsum(counts[order])])
        edges = np.append(upto[new], upto[-1])
        return pa.table([pa.array(ids[new]), pa.array(keys[new]), blob(value, edges[:-1], edges[1:])], ["doc_id", "h", "places"])

    return back.groupBy("target").applyInArrow(run, KEPT)


def _keyed(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array(batch.column("doc_id")[i:j].to_pylist(), np.int64), np.array(batch.column("h")[i:j].to_pylist(), np.int64)


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id and h that tell documents apart, never null (a row without id has 0 and the complement of its text's hash), the row's id, and its text."""
    own, h = docs[key].cast("long"), F.xxhash64(docs[text])
    return docs.select(F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"), F.when(own.isNull(), F.bitwise_not(h)).otherwise(h).alias("h"), own.alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, h, n_words, n_removed and kept (the words that stay, one space between them) for every row."""
    tasks = partitions(docs.sparkSession)
    buckets = 2 * tasks
    docs = _named(docs, text, key)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                names, counts, _, _ = word_names(data, offs)
                _, anchor, found = anchors(names, counts, window, rounds)
                if not len(anchor):
                    continue
                anchor, at = np.unique(anchor, return_index=True)
                found, (ids, hs) = found[at], _keyed(b, i, j)
                owner = np.searchsorted(counts, anchor, "right") - 1
                repeated, rows = probes(found, owner, np.zeros(len(found), np.int64), buckets)
                yield _probe_batch(rows, ids, hs)
                if repeated.any():
                    yield _settled(_back(owner[repeated], found[repeated], ids, hs, tasks))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                shared = np.unique(np.frombuffer(b"".join(b.column("places")[i:j].to_pylist()), np.uint64))
                names, counts, _, _ = word_names(data, offs)
                starts, _, found = anchors(names, counts, window, rounds)
                starts = starts[np.isin(found, shared)] if len(starts) else starts
                if not len(starts):
                    continue
                ids, hs = _keyed(b, i, j)
                owner = np.searchsorted(counts, starts, "right") - 1
                place = starts - counts[owner]
                repeated, rows = probes(windows_hash(names, window)[starts], owner, place, buckets)
                yield _probe_batch(rows, ids, hs)
                if repeated.any():
                    yield _settled(_back(owner[repeated], place[repeated].astype(np.int32), ids, hs, tasks))

    keys = cut(docs.mapInArrow(send_keys, PROBES), "substring-keys").groupBy("bucket").applyInArrow(_meet(tasks, True), BACK)
    moved = docs.repartition(tasks, "doc_id", "h")
    windows = moved.join(_gathered(keys, np.uint64), ["doc_id", "h"]).mapInArrow(send_windows, PROBES)
    covered = _gathered(windows.groupBy("bucket").applyInArrow(_meet(tasks, False), BACK), np.int32)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                rows = np.arange(len(offs) - 1)
                spaced = np.full(len(data) + len(rows), 32, np.uint8)  # a space after each text
                spaced[np.arange(len(data)) + np.repeat(rows, np.diff(offs))] = data
                offs = offs + np.arange(len(offs))
                starts, ends, counts = words(spaced, offs)
                cover = np.zeros(len(starts) + 1, np.int32)
                for k, got in enumerate(b.column("places")[i:j].to_pylist()):
                    if got:
                        s = np.unique(np.frombuffer(got, np.int32)) + counts[k]
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                ks, ke = starts[~gone], ends[~gone]
                edge = np.zeros(len(spaced) + 1, np.int8)
                edge[ks] += 1
                edge[ke + 1] -= 1  # a kept word and what follows it
                sel = np.cumsum(edge[:-1]) > 0
                spaced[ke] = 32
                out, upto = spaced[sel], np.concatenate([[0], np.cumsum(sel)])[offs]
                removed = np.concatenate([[0], np.cumsum(gone)])[counts]
                kept = [out[s : max(s, e - 1)].tobytes() for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id")[i:j], b.column("h")[i:j], pa.array(np.diff(counts), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "h", "n_words", "n_removed", "kept"])

    out = moved.join(covered, ["doc_id", "h"], "left").mapInArrow(keep, "doc_id long, h long, n_words long, n_removed long, kept string")
    return out.withColumn("h", F.when(F.col("doc_id").isNull(), F.bitwise_not("h")).otherwise(F.col("h")))
