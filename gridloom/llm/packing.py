"""Packing texts into sequences: order-preserving dynamic programming over window cuts.

Tokenising: ids are those of an unchanged tokenizer's encode(text, add_special_tokens=False).  Where the file has the plain
byte-level split, a text splits into words, numbers, signs and white space by character class in numpy; each distinct piece
of a chunk is merged once and its ids are gathered for all places.  Texts with characters outside the class table
(from U+0280 on) or with an added token's content, and all texts under another kind of file, go through the tokenizer
whole; the ids are the same either way (tested).

Packing: documents stand in the order of their partition, as one stream of ids.  A window (sequence) has at most
`size` ids.  Windows may end at a document's end (free), at a sentence's end (SENTENCE), or, where a sentence is
longer than a window, anywhere in it (HARD).  With padding size - length, the least cost up to a cut j is
f(j) = min over i with p(j) - p(i) <= size of (f(i) + p(i)) + size - p(j) + penalty(j): a sliding-window minimum, kept by
a monotone queue in one pass.  The stream is settled as soon as BLOCK ids are held: up to the last cut that the best ways to all
cuts from which a later window may start have in common, so the windows are those of one pass over the whole stream.

Defined results: a null or empty text is its end id alone.  Each id lies in exactly one piece.  Rows with the same
doc_id are documents of their own.  Sequence ids are the partition's number * 2**40 + a count: unique, and the same when a
lost task runs again.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bytes_hash, reps, text_chunks

# Ids of a sequence, the id that ends a document, penalties in ids of padding, held ids from which the stream is settled.
SIZE, END_ID, SENTENCE, HARD, BLOCK = 2048, 1, 8, 64, 1 << 18
#: Distinct pieces that a worker remembers.
CACHE = 1_500_000
SPACES, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# White space below U+0280, as in the Unicode property.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
# Endings that the split pattern takes with an apostrophe.
ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def _class_of(cp: int) -> int:
    kind = unicodedata.category(chr(cp))[0]
    return SPACES if cp in WHITE else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)


CLASSES = np.array([_class_of(cp) for cp in range(0x280)], np.int8)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 is itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of many texts by a tokenizers file with a byte-level split (letters, numbers, others, each with one space before)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()
        kind = json.loads(Path(path).read_text())
        split = kind.get("pre_tokenizer") or {}
        #: Whether pieces() is the file's split.
        self.plain = not any(kind.get(k) for k in ("normalizer", "truncation", "padding")) and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True) and kind["model"].get("type") == "BPE" and not any(kind["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        vocab = self.tok.get_vocab(with_added_tokens=False)
        # merges of one piece: the same ranks in a faster library; the ids are equal (tested)
        bytes_of = byte_alphabet()
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in vocab.items() if all(c in bytes_of for c in token)}
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.added = [t.encode() for t in sorted(added)]
        ranks = {t: i for t, i in ranks.items() if t.decode(errors="replace") not in added}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        ends = np.zeros(max(vocab.values()) + 2, bool)
        for token, i in vocab.items():
            ends[i] = token.endswith((".", "!", "?", "Ċ"))  # Ċ is how such vocabularies write a line feed
        self.sentence_end = ends

    def clear(self) -> None:
        self.keys, self.offs, self.flat = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the pieces that the split pattern gives; data holds no lead byte above 0xC9."""
        n = len(data)
        cls = CLASSES[np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        two = CLASSES[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        cls[lead], cls[lead + 1] = two, two
        first = np.zeros(n + 1, bool)
        first[offs] = True
        start = first[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        # the last character of white space before something else: a space joins it, any other stands alone
        heads = np.flatnonzero(start & ~first[:n] & (cls != SPACES))
        heads = heads[cls[heads - 1] == SPACES]
        joined = data[heads - 1] == 32
        start[heads[joined]] = False
        wide = data[heads - 1] >= 0x80
        start[heads - 1 - wide] = True
        # 's and the like: a lone apostrophe that no space joined, before a letter
        a = np.flatnonzero((data[:-1] == 39) & start[:-1] & (cls[1:] == LETTER) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
        for i in a.tolist():
            for e in ENDINGS:
                k = i + 1 + len(e)
                if data[i + 1 : k].tobytes() == e and not first[i + 1 : k].any():
                    start[i + 1 : k] = False
                    if k < n:
                        start[k] = True
                    break
        return np.flatnonzero(start)

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        ids = [self.merge(t.decode()) for t in texts]
        flat = np.array([i for x in ids for i in x], np.uint32)
        lens = np.concatenate([np.diff(self.offs), np.array([len(x) for x in ids], np.int64)])
        begin = np.concatenate([self.offs[:-1], len(self.flat) + np.cumsum(lens[len(self.keys) :]) - lens[len(self.keys) :]])
        all_keys, all_flat = np.concatenate([self.keys, keys]), np.concatenate([self.flat, flat])
        order = np.argsort(all_keys)
        self.keys, lens = all_keys[order], lens[order]
        self.offs = np.concatenate([[0], np.cumsum(lens)])
        self.flat = all_flat[np.repeat(begin[order], lens) + reps(lens)]

    def fast(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        starts = self.pieces(data, offs)
        ends = np.append(starts[1:], len(data))
        keys, at, back = np.unique(bytes_hash(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self.learn(keys[new], [data[s:e].tobytes() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
            if not np.array_equal(self.keys[np.minimum(place, len(self.keys) - 1)], keys):  # the cache was cleared
                return self.fast(data, offs)
        place = place[back]
        lens = self.offs[place + 1] - self.offs[place]
        ids = self.flat[np.repeat(self.offs[place], lens) + reps(lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, offs)]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        n = len(offs) - 1
        high = np.concatenate([[0], np.cumsum(data > 0xC9)])
        slow = (high[offs[1:]] - high[offs[:-1]]) > 0 if self.plain else np.ones(n, bool)
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(offs, at, "right")) - 1
                slow[k] |= at + len(token) <= offs[k + 1]
                at = raw.find(token, int(offs[k + 1]) if slow[k] else at + 1)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        rows = np.flatnonzero(~slow & (np.diff(offs) > 0))
        if len(rows):
            if len(rows) < n:
                keep = np.repeat(~slow, np.diff(offs))
                part, sub = data[keep], np.concatenate([[0], np.cumsum(np.diff(offs)[rows])])
            else:
                part, sub = data, offs
            for r, ids in zip(rows.tolist(), self.fast(part, sub), strict=True):
                out[r] = ids
        for r in np.flatnonzero(slow).tolist():
            out[r] = np.array(self.tok.encode(data[offs[r] : offs[r + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, size: int, last: bool = True) -> list[int]:
    """Window ends (the last is total) of least padding plus penalties; places are ids from the stream's start.

    Of a stream that goes on (its last place a document's end) only those that any continuation shares.
    """
    penalty = dict.fromkeys(sentence_ends.tolist(), SENTENCE)
    penalty.update(dict.fromkeys(doc_ends.tolist(), 0))
    penalty[total] = 0
    penalty.pop(0, None)
    places = sorted(penalty)
    gaps = np.diff(np.array([0, *places]))
    for k in np.flatnonzero(gaps > size).tolist():
        end = places[k]
        for p in range(end - int(gaps[k]) + size, end, size):
            penalty[p] = HARD
    places = [0, *sorted(penalty)]
    cost, back = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])  # cuts by place, their cost + place increasing
    score = [0] * len(places)
    for j in range(1, len(places)):
        p = places[j]
        while p - places[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = score[i] + size - p + penalty[p]
        s = score[j] = cost[j] + p
        while queue and score[queue[-1]] >= s:
            queue.pop()
        queue.append(j)
    out, j = [], len(places) - 1
    if not last:
        live = {k for k in range(len(places)) if places[k] > total - size}
        while len(live) > 1:
            j = max(live)
            live.remove(j)
            live.add(back[j])
        (j,) = live
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece of a document in a sequence; with_ids adds the ids themselves."""
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def settle(held: list[tuple], enc: Encoder, last: bool) -> tuple[list[list], list[tuple]]:
        """Windows of the held stream of (doc_id, ids, where they start in the document, the document's ids), and what is carried."""
        ends = np.cumsum([len(h[1]) for h in held])
        stream = np.concatenate([h[1] for h in held])
        marks = np.flatnonzero(enc.sentence_end[np.minimum(stream, len(enc.sentence_end) - 1)]) + 1
        windows = cuts(ends, marks, len(stream), size, last)
        done, rows, at, k = windows[-1] if windows else 0, [], 0, 0
        for w in windows:
            first = at
            while at < w:
                begin = int(ends[k]) - len(held[k][1])
                stop = min(w, int(ends[k]))
                rows.append([k, at - begin, stop - at, at, at - first, w])
                at = stop
                k += at == ends[k]
        rest = []
        for h, e in zip(held[k:], ends[k:].tolist(), strict=True):
            skip = max(0, done - (e - len(h[1])))
            rest.append((h[0], h[1][skip:].copy(), h[2] + skip, h[3]))
        return [[held[r[0]][0], held[r[0]][2] + r[1], r[2], zlib.crc32(stream[r[3] : r[3] + r[2]].tobytes()), held[r[0]][3], r[5], r[4], stream[r[3] : r[3] + r[2]]] for r in rows], rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, count, held, n, most = encoder(path), TaskContext.get().partitionId() << 40, 0, [], 0, BLOCK

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, n, count, most
            rows, held = settle(held, enc, last)
            n = sum(len(h[1]) for h in held)
            most = max(BLOCK, 2 * n)
            sequence, before = [], None
            for r in rows:
                count += before is not None and r[5] != before
                before = r[5]
                sequence.append(base + count)
            count += bool(rows)
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], sequence, [r[6] for r in rows]] + [[r[7].astype(np.int32) for r in rows]] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            keys = b.column(0).to_pylist()
            for i, _, data, offs in text_chunks(b):
                for k, ids in enumerate(enc.encode(data, offs)):
                    ids = np.append(ids, np.uint32(end_id))
                    held.append((keys[i + k], ids, 0, len(ids)))
                    n += len(ids)
                    if n >= most:
                        yield flush(False)
        if held:
            yield flush(True)

    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
