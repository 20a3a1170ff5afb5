"""Exact n-gram Jaccard self-join by T-occurrence search (DivideSkip) over inverted lists.

A text's set is its distinct five-word shingles as 64-bit hashes; sets x and y link when |x & y| >= T(|x|, |y|), the least
overlap with 100 * overlap >= 75 * union.  Equal sets are one node: copies never meet each other.

1. Prefixes.  Under one global order (the most frequent shingles of the corpus last, then by hash) two linking sets
   share a shingle among their first |x| - T(|x|, |x|'s least partner) + 1, and from their first common one on both have
   at least T left.  Only prefixes are posted, in blobs by bucket of the shingle; a shingle of more than SPLIT sets is dealt
   over several buckets.  Members that size and place let link with nobody leave a list, and lists of the same members are one.
2. First links.  Each node is searched for in the block of the node with which it shares most lists; the links found
   make components.
3. The rest.  A list whose members are of one component can't change the result any more.  Any other list is given to the
   component that most of its members have, and all members of a component's lists that may still link across components
   make a group, whose sets move once.  In a group, T-occurrence search over the inverted lists of its sets finds all
   links of the members outside of the component; a large group is cut into parts by size that meet pairwise.  Of the
   links only those that join two components leave the task.  So a group of near copies never becomes pairs of rows.

T-occurrence search merges the short lists of a query's shingles with a heap, and probes the longest ones by
binary search for the records that can still reach T (DivideSkip).

Defined results: null, empty and blank texts have no shingles and are their own component; fewer than five words are one
shingle; repeated rows link; rows with the same doc_id and different texts are told apart by the text's hash.  Rows with a null doc_id link like others; a component without any id has a null component_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bytes_hash, components, cut, discard, lists_hash, mix, partitions, reps, text_chunks, trim, windows_hash, words

# Words of a shingle, the threshold in per cent.
N, PERCENT = 5, 75
# Parameters of cost, not of results: the longest list of which all pairs count for first links, other sets of a query's block, the
# most shingles that are put last and in how many sets they must stand, shingles that a task holds to find shared ones, sets of
# a shingle from which its list is dealt over buckets, the longest list whose members are compared by size and place,
# shingles of a bucket of postings, of a part of a group and of a task, entries that are merged with a heap, entries from which a list is probed.
SHORT, BLOCK, LAST, FREQUENT, HELD, SPLIT, WIDE = 8, 256, 1 << 20, 4, 4_000_000, 16_384, 2048
POSTINGS, PART, TASK, HEAP, LONG = 8_000_000, 1_000_000, 2_000_000, 256, 512
#: DivideSkip's weight of the longest list's logarithm.
MU = 0.0085


def overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def least_partner(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return -(-percent * n // 100)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, by row and then by hash, and how many stand before each row."""
    low = LOWER[data]
    starts, ends, counts = words(low, offs)
    names = bytes_hash(low, starts, ends)
    k = np.diff(counts)
    full = np.maximum(k - n + 1, 0)
    rows = np.repeat(np.arange(len(k)), full)
    hashes, owners = [windows_hash(names, n)[counts[rows] + reps(full)]], [rows]
    for few in range(1, n):  # texts of fewer words are one shingle
        rows = np.flatnonzero(k == few)
        if len(rows):
            hashes.append(windows_hash(names[(counts[rows][:, None] + np.arange(few)).ravel()], few)[::few])
            owners.append(rows)
    h, rows = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(len(k) + 1))


def set_names(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; no bit of it tells anything about order or size."""
    return (lists_hash(h, counts) >> np.uint64(1)).astype(np.int64)


# ---------------------------------------------------------------- DivideSkip


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The records of the lists in order, by a heap, and on how many lists each stands."""
    records, counts = [], []
    for record in heapq.merge(*(x.tolist() for x in lists)):
        if records and records[-1] == record:
            counts[-1] += 1
        else:
            records.append(record)
            counts.append(1)
    return np.array(records, np.int64), np.array(counts, np.int64)


class Lists:
    """Inverted lists: the records of each token, in order."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        """tokens: those of one record after another, distinct in a record; sizes: how many each record has."""
        order = np.argsort(tokens, kind="stable")
        self.sizes, self.record = sizes, np.repeat(np.arange(len(sizes)), sizes)[order]
        tokens = tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.tokens, self.edges = tokens[new], np.append(np.flatnonzero(new), len(tokens))

    def divide_skip(self, lists: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Records that stand on at least need[record] (positive) of the lists, which are given by number."""
        least = int(need.min()) if len(need) else 1
        if len(lists) < least:
            return np.zeros(0, np.int64)
        begin, size = self.edges[lists], self.edges[lists + 1] - self.edges[lists]
        by = np.argsort(size, kind="stable")
        begin, size = begin[by], size[by]
        # a record with enough hits stands on a short list, as the long ones are fewer than `least`
        n_long = max(0, min(least - 1, int(least / (MU * log2(max(2, int(size[-1]))) + 1)), int((size > LONG).sum())))
        n_short = len(lists) - n_long
        if size[:n_short].sum() > HEAP:  # many entries: the same merge as a stable sort of all runs
            record, count = np.unique(self.record[np.repeat(begin[:n_short], size[:n_short]) + reps(size[:n_short])], return_counts=True)
        else:
            record, count = merged([self.record[s : s + k] for s, k in zip(begin[:n_short].tolist(), size[:n_short].tolist(), strict=True)])
        for k, (s, m) in enumerate(zip(begin[n_short:].tolist(), size[n_short:].tolist(), strict=True)):
            able = count + (n_long - k) >= need[record]
            record, count = record[able], count[able]
            if not len(record):
                break
            x = self.record[s : s + m]
            count = count + (x[np.minimum(np.searchsorted(x, record), m - 1)] == record)
        return record[count >= need[record]]

    def search(self, query: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Which of the sets link with the query (its shingles, distinct)."""
        if not len(self.tokens):
            return np.zeros(0, np.int64)
        need = overlap(self.sizes, len(query), percent)
        able = (need <= len(query)) & (need <= self.sizes)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if not able.any() or len(at) < need[able].min():
            return np.zeros(0, np.int64)
        # sets of other sizes need more lists than there are
        return self.divide_skip(at, np.where(able, need, len(query) + 1))


# ---------------------------------------------------------------- Spark

SETS = "doc_id long, h long, n long, node long, bucket int, tokens binary, counts binary"


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("h"), F.coalesce(docs[text], F.lit("")).alias("text"))


def _repeated(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Shingles that at least two of the held sets share, with their counts, in blobs by bucket."""
    token, count = np.unique(np.concatenate(held), return_counts=True)
    token, count = token[count > 1], count[count > 1]
    bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    token, count, edges = token[by], count[by].astype(np.uint32), np.searchsorted(bucket[by], np.arange(buckets + 1))
    some = [k for k in range(buckets) if edges[k + 1] > edges[k]]
    blobs = [pa.array([v[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary()) for v in (token, count)]
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(some), pa.int64()) for _ in range(4)), pa.array(some, pa.int32()), *blobs], ["doc_id", "h", "n", "node", "bucket", "tokens", "counts"])


def _sets(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Each row's set size and node (null for empty sets); beside them (bucket not null) shingles that sets of one task share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for b in batches:
            for i, j, data, offs in text_chunks(b):
                h, counts = shingles(data, offs, n)
                size = np.diff(counts)
                names = set_names(h, counts)
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("h")[i:j], pa.array(size, pa.int64()), pa.array(names, pa.int64(), mask=size == 0), pa.nulls(j - i, pa.int32()), none, none], ["doc_id", "h", "n", "node", "bucket", "tokens", "counts"])
                once = np.zeros(j - i, bool)
                once[np.unique(names, return_index=True)[1]] = True
                held.append(h[np.repeat(once, size)])
                many += len(held[-1])
                if many >= HELD:
                    yield _repeated(held, buckets)
                    held, many = [], 0
        if many:
            yield _repeated(held, buckets)

    return docs.mapInArrow(run, SETS)


def _frequent(sets: DataFrame, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that stand in most sets, by the counts that all tasks sent: at least `least`, at most `most` of them, and the counts.

    They only decide which shingles come last in the order and which lists are dealt over buckets; the arrays are bounded, whatever the corpus.
    """

    def run(t: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()])
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        own, back = np.unique(token, return_inverse=True)
        total = np.bincount(back, count, len(own)).astype(np.int64)
        keep = total >= least
        return pa.table([pa.array(own[keep].view(np.int64)), pa.array(total[keep])], ["t", "n"])

    rows = sets.where("bucket is not null").select("bucket", "tokens", "counts").groupBy("bucket").applyInArrow(run, "t long, n long")
    rows = rows.orderBy(F.col("n").desc(), "t").limit(most).toArrow()
    token, count = rows.column("t").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy().astype(np.int64)
    order = np.argsort(token)
    return token[order], count[order]


#: Of a chunk's entries in a bucket, by set: 32 bits of each shingle (sets of shingles that agree in them are one list, which holds
#: all that either would), where a set begins (bits), places (at most 65535: a smaller place allows more), and each set's node and size.
POSTED = "bucket int, tokens binary, begins binary, places binary, nodes binary, sizes binary"


def _token32(token: np.ndarray) -> np.ndarray:
    return (mix(token) >> np.uint64(32)).astype(np.uint32)


def _post(docs: DataFrame, frequent, n: int, percent: int, buckets: int) -> DataFrame:
    """Prefixes of all sets, in blobs by bucket; each set once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = frequent.value
        split = times > SPLIT
        hot, pieces = often[split], -(-times[split] // SPLIT)
        for b in batches:
            for _, _, data, offs in text_chunks(b):
                h, counts = shingles(data, offs, n)
                size = np.diff(counts)
                names = set_names(h, counts)
                rows = np.repeat(np.arange(len(size)), size)
                late = np.zeros(len(h), bool)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                order = np.lexsort((h, late, rows))
                place = reps(size)
                prefix = size - overlap(least_partner(size, percent), size, percent) + 1
                once = np.zeros(len(size), bool)
                once[np.unique(names, return_index=True)[1]] = True
                take = (place < prefix[rows]) & once[rows]
                token, row, place = h[order][take], rows[take], place[take]
                if not len(token):
                    continue
                key = mix(token)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    at, many = at[hot[at] == token], hot[at] == token
                    key[many] = mix(key[many] + mix(names[row[many]].astype(np.uint64)) % pieces[at].astype(np.uint64))
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                bucket, token, row, place = bucket[by], _token32(token[by]), row[by], np.minimum(place[by], 65535).astype(np.uint16)
                begins = _runs(bucket, row)
                edges = np.flatnonzero(_runs(bucket))
                out: list[list] = [[], [], [], [], [], []]
                for s, e in zip(edges.tolist(), np.append(edges[1:], len(bucket)).tolist(), strict=True):
                    own = row[s:e][begins[s:e]]
                    for c, v in zip(out, (int(bucket[s]), token[s:e].tobytes(), np.packbits(begins[s:e]).tobytes(), place[s:e].tobytes(), names[own].tobytes(), size[own].astype(np.uint32).tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "tokens", "begins", "places", "nodes", "sizes"])

    return docs.select("text").mapInArrow(run, POSTED)


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of equal values of sorted columns begins."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in sorted_by])
    return new


def _pairs_of(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of entries within each run of equal, sorted group numbers, in order of i."""
    edges = np.searchsorted(groups, groups, "right")
    later = edges - np.arange(len(groups)) - 1
    i = np.repeat(np.arange(len(groups)), later)
    return i, i + 1 + reps(later)


def _able(na, nb, pa_, pb, percent: int) -> np.ndarray:
    """Whether sizes and places in the prefix still allow the overlap."""
    return np.minimum(na - pa_, nb - pb) >= overlap(na, nb, percent)


#: Pairs x < y with the number of lists that gave them and y's size, or (n null) list x's entry y with its size and place; the
#: place is null in a list that is dealt over buckets.
FOUND = "x long, y long, n int, size int, place int"


def _compatible(size: np.ndarray, place: np.ndarray, percent: int, other: np.ndarray | None = None) -> np.ndarray:
    """Which members of one list sizes and places let link with another one (of another component, if given)."""
    out = np.zeros(len(size), bool)
    for s in range(0, len(size), 256):
        part = slice(s, s + 256)
        able = _able(size[part, None], size[None], place[part, None], place[None], percent)
        if other is None:
            able[np.arange(len(able)), s + np.arange(len(able))] = False
        else:
            able &= other[part, None] != other[None]
        out[part] = able.any(1)
    return out


def _candidates(percent: int, short: int, wide: int, hot):
    """Of one bucket: pairs for the first links, and the entries of all lists that matter; hot: the posted 32 bits of shingles that are dealt over buckets."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        got = {c: np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in (("tokens", np.uint32), ("places", np.uint16), ("nodes", np.int64), ("sizes", np.uint32))}
        bits = zip(t.column("begins").to_pylist(), t.column("tokens").to_pylist(), strict=True)
        begins = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y) // 4) for x, y in bits])
        row = np.cumsum(begins, dtype=np.int64) - 1
        token, place = got["tokens"], got["places"].astype(np.int64)
        # entries of shingles that stand alone are most of all; the others are sorted
        order = np.argsort(token)
        same = token[order][1:] == token[order][:-1]
        twice = np.zeros(len(token), bool)
        twice[1:] = same
        twice[:-1] |= same
        if len(hot.value):
            twice |= np.isin(token[order], hot.value)
        order = order[twice]
        token, place, row = token[order], place[order], row[order]
        node, size = got["nodes"][row], got["sizes"][row].astype(np.int64)
        order = np.lexsort((place, node, token))
        order = order[_runs(token[order], node[order])]
        token, node, size, place = token[order], node[order], size[order], place[order]
        group = np.cumsum(_runs(token)) - 1
        length = np.bincount(group)[group] if len(group) else group
        split = np.isin(token, hot.value)
        few = np.flatnonzero((length > 1) & (length <= short))
        i, j = _pairs_of(group[few])
        i, j = few[i], few[j]
        ok = _able(size[i], size[j], place[i], place[j], percent)
        use = split.copy()
        use[i[ok]] = use[j[ok]] = True
        lefts, rights = [i[ok]], [j[ok]]
        many = np.flatnonzero(length > short)
        for part in np.split(many, np.flatnonzero(np.diff(group[many])) + 1) if len(many) else []:
            if len(part) <= wide and not split[part[0]]:
                part = part[_compatible(size[part], place[part], percent)]
            use[part] = True
            left = part
            while len(left) > 1:  # stars: the first member with all that it may link with, then those that are left
                near = _able(size[left[0]], size[left[1:]], place[left[0]], place[left[1:]], percent)
                lefts.append(np.repeat(left[0], near.sum()))
                rights.append(left[1:][near])
                left = left[1:][~near]
        i, j = np.concatenate(lefts), np.concatenate(rights)
        order = np.lexsort((node[j], node[i]))
        i, j = i[order], j[order]
        first = np.flatnonzero(_runs(node[i], node[j])) if len(i) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(i)))
        pairs = (node[i[first]], node[j[first]], n, size[j[first]])
        # a list's name is made from its members, so that lists of the same members are one list; their least places keep all that any allows
        token, node, size, place, group, split = token[use], node[use], size[use], place[use], group[use], split[use]
        _, group = np.unique(group, return_inverse=True)
        name = np.zeros(group.max() + 1 if len(group) else 0, np.uint64)
        np.add.at(name, group, mix(node.astype(np.uint64)))
        name = np.where(split, mix(token.astype(np.uint64) + np.uint64(1)), name[group]).astype(np.uint64).view(np.int64) if len(group) else np.zeros(0, np.int64)
        order = np.lexsort((place, node, name))
        order = order[_runs(name[order], node[order])] if len(order) else order
        k, m = len(first), len(order)
        ints = lambda a, b, kind, mask=None: pa.concat_arrays([pa.array(a, kind), pa.array(b, kind, mask=mask)])
        return pa.table([ints(pairs[0], name[order], pa.int64()), ints(pairs[1], node[order], pa.int64()), pa.concat_arrays([pa.array(n, pa.int32()), pa.nulls(m, pa.int32())]), ints(pairs[3], size[order], pa.int32()), pa.concat_arrays([pa.nulls(k, pa.int32()), pa.array(place[order], pa.int32(), mask=split[order])])], ["x", "y", "n", "size", "place"])

    return run


def _searched(rows: DataFrame, tasks: int, n: int, percent: int) -> DataFrame:
    """Links (x, y, a, b: their components) of each unit's queries among its indexed sets, of which each joins two components.

    rows: unit (long), side (0 query, 1 indexed, 2 both), node, component, text.
    """

    def run(t: pa.Table) -> pa.Table:
        trim()
        t = t.select(["unit", "side", "node", "component", "text"]).sort_by([("unit", "ascending"), ("node", "ascending")])
        unit, side, node, comp = (t.column(c).to_numpy() for c in ("unit", "side", "node", "component"))
        hashes, sizes = [], []
        for b in t.select(["text"]).to_batches():
            for _, _, data, offs in text_chunks(b):
                h, counts = shingles(data, offs, n)
                hashes.append(h)
                sizes.append(np.diff(counts))
        del t
        tokens, sizes = np.concatenate(hashes), np.concatenate(sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out: list[tuple] = []
        edges = np.append(np.flatnonzero(_runs(unit)), len(unit)).tolist()
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            held = s + np.flatnonzero(side[s:e] > 0)
            index = Lists(tokens[np.repeat(upto[held], sizes[held]) + reps(sizes[held])], sizes[held])
            root: dict[int, int] = {}
            many = dict(zip(*(v.tolist() for v in np.unique(comp[held], return_counts=True)), strict=True))

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            for q in (s + np.flatnonzero(side[s:e] != 1)).tolist():
                if many.get(find(int(comp[q])), 0) == len(held):  # all that it could find is joined with it
                    continue
                found = held[index.search(tokens[upto[q] : upto[q + 1]], percent)]
                for k in found[comp[found] != comp[q]].tolist():
                    a, b = find(int(comp[q])), find(int(comp[k]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        many[min(a, b)] = many.pop(a, 0) + many.pop(b, 0)
                        out.append((node[q], node[k], comp[q], comp[k]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["x", "y", "a", "b"])

    return rows.withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(tasks))).select("task", "unit", "side", "node", "component", "text").groupBy("task").applyInArrow(run, "x long, y long, a long, b long")


def _tasks(spark, shingle_count: int | None, each: int) -> int:
    return max(partitions(spark), -(-(shingle_count or 0) // each))


def first_units(tested: DataFrame, block: int) -> DataFrame:
    """(node, units): the blocks of a query x and up to `block` others that each node of the pairs (x, y) belongs to, with its side."""
    share = tested.groupBy("x").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = tested.join(share, "x").select("x", "y", F.xxhash64("x", F.pmod(F.xxhash64("y"), "parts")).alias("unit"))
    members = dealt.select(F.col("y").alias("node"), "unit", F.lit(1).alias("side")).union(dealt.select("x", "unit", F.lit(0)).distinct())
    return members.groupBy("node").agg(F.collect_list(F.struct("unit", "side")).alias("units"))


def mixed_groups(entries: DataFrame, comps: DataFrame, tested: DataFrame, percent: int, wide: int) -> DataFrame:
    """(label, node, size, component): members of lists that still may link across components, in groups by the component that most members of their list have.

    A list of two such members whose pair the first links have compared is done."""
    spark = entries.sparkSession
    buckets = _tasks(spark, entries.count(), 200_000)
    rows = entries.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def run(t: pa.Table) -> pa.Table:
        l, node, size, place, comp = (t.column(c).to_numpy() for c in ("list", "node", "size", "place", "component"))
        size, place = size.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((place, node, l))
        order = order[_runs(l[order], node[order])]
        l, node, size, place, comp = (v[order] for v in (l, node, size, place, comp))
        edges = np.flatnonzero(_runs(l))
        least, most = np.minimum.reduceat(comp, edges), np.maximum.reduceat(comp, edges)
        use = np.zeros(len(l), bool)
        for s, e in zip(edges[least < most].tolist(), np.append(edges[1:], len(l))[least < most].tolist(), strict=True):
            use[s:e] = _compatible(size[s:e], place[s:e], percent, comp[s:e]) if e - s <= wide else True
        l, node, size, comp = (v[use] for v in (l, node, size, comp))
        order = np.lexsort((comp, l))
        l, node, size, comp = (v[order] for v in (l, node, size, comp))
        x, y = np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)  # both 0: more than two
        if len(l):
            edges = np.flatnonzero(_runs(l))
            two = edges[np.diff(np.append(edges, len(l))) == 2]
            x[two] = x[two + 1] = np.minimum(node[two], node[two + 1])
            y[two] = y[two + 1] = np.maximum(node[two], node[two + 1])
            runs = np.flatnonzero(_runs(l, comp))
            many = np.diff(np.append(runs, len(l)))
            by = np.lexsort((comp[runs], -many, l[runs]))
            by = by[_runs(l[runs][by])]
            label = comp[runs][by][np.cumsum(_runs(l)) - 1]
            order = np.lexsort((y, x, node, label))
            order = order[_runs(label[order], node[order], x[order], y[order])]
            label, node, size, comp, x, y = (v[order] for v in (label, node, size, comp, x, y))
        else:
            label = l
        return pa.table([pa.array(label, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(comp, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["label", "node", "size", "component", "x", "y"])

    done = tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    own = rows.where("place is not null").withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "label long, node long, size int, component long, x long, y long")
    own = own.join(done, ["x", "y"], "left_anti").select("label", "node", "size", "component")
    # lists that were dealt over buckets stay dealt: counted with partial sums
    hot = rows.where("place is null").select("list", "node", "size", "component").distinct()
    label = hot.groupBy("list", "component").agg(F.count("*").alias("n")).groupBy("list").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m"), F.count("*").alias("k")).where("k > 1").select("list", (-F.col("m.c")).alias("label"))
    return own.union(hot.join(label, "list").select("label", "node", "size", "component")).distinct()


def rest_links(groups: DataFrame, texts: DataFrame, n: int, percent: int, part: int, each: int) -> DataFrame:
    """Links between components, as edges (a, b) of components; groups: a written table of mixed_groups()."""
    spark = groups.sparkSession
    inside = F.col("component") == F.col("label")
    parts = groups.groupBy("label").agg(F.ceil(F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)) / part).cast("int").alias("kc"), F.ceil(F.coalesce(F.sum(F.when(~inside, F.col("size"))), F.lit(0)) / part).cast("int").alias("ko"))
    rows = groups.join(parts, "label")
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("kc")).otherwise(F.col("ko"))).cast("int")
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    nothing, zero = F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>"), F.lit(0)
    one = F.array(unit(0, zero, zero, F.when(inside, 1).otherwise(2)))
    of_component = F.when(F.col("ko") > 0, F.transform(upto("ko"), lambda j: unit(1, F.col("own"), j, F.lit(1)))).otherwise(nothing)
    with_component = F.when(F.col("kc") > 0, F.transform(upto("kc"), lambda i: unit(1, i, F.col("own"), F.lit(0)))).otherwise(nothing)
    others = F.transform(upto("ko"), lambda j: unit(2, F.least("own", j), F.greatest("own", j), F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1)))
    rows = rows.withColumn("own", own).withColumn("u", F.explode(F.when((F.col("kc") <= 1) & (F.col("ko") <= 1), one).when(inside, of_component).otherwise(F.concat(with_component, others))))
    rows = cut(rows.select(F.xxhash64("label", "u.kind", "u.i", "u.j").alias("unit"), F.col("u.side").alias("side"), "node", "component", "size"), "jaccard-units")
    tasks = _tasks(spark, rows.agg(F.sum("size")).first()[0], each)
    return _searched(rows.drop("size").join(texts.select("node", "text").hint("merge"), "node"), tasks, n, percent).select("a", "b")


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, h, n_shingles and component_id (the smallest doc_id reachable by links) for every row."""
    return linked(docs, n, percent, text, key).drop("component")


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """join() and `component`, a name of each component that doesn't depend on ids (null for texts without shingles)."""
    spark = docs.sparkSession
    docs = _named(docs, text, key)
    written = cut(_sets(docs, n, partitions(spark)), "jaccard-sets")
    often = _frequent(written, LAST, FREQUENT)
    frequent, hot = spark.sparkContext.broadcast(often), spark.sparkContext.broadcast(_token32(often[0][often[1] > SPLIT]))
    sets = written.where("bucket is null").select("doc_id", "h", "n", "node")
    buckets = _tasks(spark, sets.agg(F.sum("n")).first()[0], POSTINGS)
    found = cut(_post(docs, frequent, n, percent, buckets).groupBy("bucket").applyInArrow(_candidates(percent, SHORT, WIDE, hot), FOUND), "jaccard-candidates")
    entries = found.where("n is null").select(F.col("x").alias("list"), F.col("y").alias("node"), "size", "place")
    pairs = found.where("n is not null").groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    tested = cut(pairs.groupBy("y").agg(F.max(F.struct("n", (-F.col("x")).alias("neg"), "size")).alias("b")).select((-F.col("b.neg")).alias("x"), "y", F.col("b.size").alias("size")), "jaccard-tested")
    # one text of each node that a list names, with the blocks it belongs to; the join's partitions serve to drop repeated rows too, and the plan is the same at all sizes
    at = F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(-1)).alias("k"), "h")).alias("at")
    chosen = sets.where("node is not null").groupBy("node").agg(at).join(entries.select("node").distinct(), "node", "left_semi").join(first_units(tested, BLOCK), "node", "left").select("node", "at.k", "at.h", "units")
    texts = cut(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), "h", "text").join(chosen.hint("merge"), ["k", "h"]).dropDuplicates(["k", "h"]).select("node", "text", "units"), "jaccard-texts")
    units = texts.select("node", "text", F.explode("units").alias("u")).select(F.col("u.unit").alias("unit"), F.col("u.side").alias("side"), "node", F.col("node").alias("component"), "text")
    links = cut(_searched(units, _tasks(spark, tested.agg(F.sum("size")).first()[0], TASK // 2), n, percent).select("a", "b"), "jaccard-links")
    first = cut(components(links, "jaccard-star"), "jaccard-components")
    groups = cut(mixed_groups(entries, first, tested, percent, WIDE), "jaccard-groups")
    more = cut(rest_links(groups, texts, n, percent, PART, TASK), "jaccard-links")
    second = components(more, "jaccard-star").toDF("component", "joined")
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = classes.join(second, "component", "left").select("node", "least", F.coalesce("joined", "component").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    reach = cut(classes.join(least, "component").select("node", "component_id", "component"), "jaccard-reach")
    discard(spark, found, texts, tested, links, first, groups, more)
    return sets.join(reach, "node", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")
