"""Jaccard join, vectors and substrings against brute force."""

import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest

from gridloom.llm import caps, jaccard, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"


def corpus(seed: int, n: int = 160) -> list[tuple]:
    """Copies, near copies in chains, a common passage, odd rows."""
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(45)]
    texts = [[word() for _ in range(r.choice([3, 5, 30, 60, 120]))] for _ in range(n // 4)]
    while len(texts) < n:
        t = list(r.choice(texts))
        k = r.random()
        if k < 0.6:
            for _ in range(r.randint(0, 3)):
                if t:
                    t[r.randrange(len(t))] = word()
        elif k < 0.8:
            at = r.randrange(len(t) + 1)
            t[at:at] = passage
        texts.append(t)
    texts += [["a"] * 100, ["a", "b"] * 50, ["a"] * 35, ["x"] * 34, ["A", "b"], ["a", "B"]]
    rows = [(i, r.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), rows[0], (rows[1][0], "another text with the same id " * 3)]
    return [(i, t, None, None, None, "clash") for i, t in rows]


@pytest.mark.parametrize("short,split,wide,part", [(8, 16_384, 2048, 1_000_000), (2, 6, 1, 300), (4, 12, 20, 60)])
def test_jaccard(spark, monkeypatch, short, split, wide, part):
    for name, value in {"SHORT": short, "SPLIT": split, "WIDE": wide, "PART": part, "BLOCK": 3, "HELD": 2000, "TASK": 5000, "POSTINGS": 2000, "HEAP": 16}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(1)
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    want = Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_dealt_shingles(spark, monkeypatch):
    """Near copies whose prefixes share only shingles that are dealt over many buckets, and texts beside them that don't link."""
    for name, value in {"SPLIT": 6, "POSTINGS": 20}.items():
        monkeypatch.setattr(jaccard, name, value)
    passage = " ".join(f"w{k}" for k in range(64))
    rows = [(k, f"{passage} own{k}") for k in range(40)] + [(40 + k, " ".join(f"x{k}y{j}" for j in range(30)) + " " + passage) for k in range(3)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 if k < 40 else k for k in range(43)}


@pytest.mark.parametrize("heap,long", [(0, 0), (1000, 0), (0, 5), (20, 512)])
def test_divide_skip(monkeypatch, heap, long):
    monkeypatch.setattr(jaccard, "HEAP", heap)
    monkeypatch.setattr(jaccard, "LONG", long)
    r = Random(5)
    for _ in range(200):
        sets = [set(r.sample(range(30), r.randint(1, 30))) for _ in range(12)]
        index = jaccard.Lists(np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets]))
        query, need = r.sample(range(30), r.randint(1, 30)), [r.randint(1, 20) for _ in range(12)]
        at = np.array([int(np.flatnonzero(index.tokens == x)[0]) for x in query if x in index.tokens])
        assert index.divide_skip(at, np.array(need)).tolist() == [k for k in range(12) if len(sets[k] & set(query)) >= need[k]]
        assert index.search(np.array(sorted(query), np.uint64)).tolist() == [k for k in range(12) if 100 * len(sets[k] & set(query)) >= 75 * len(sets[k] | set(query))]


def test_hashes():
    """Equal contents have equal hashes wherever they stand; strings that collide under polynomials modulo 2**64 differ here."""
    from gridloom.llm.common import bytes_hash, lists_hash, windows_hash

    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
        data = np.frombuffer((a + b + a).encode(), np.uint8)
        n = len(a)
        h = bytes_hash(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] == h[2] != h[1]
        names = bytes_hash(data, np.arange(len(data)), np.arange(len(data)) + 1)
        w = windows_hash(names, n)
        assert len(w) == len(data) - n + 1 and w[0] == w[2 * n] != w[n]
    r = Random(2)
    spans = ["".join(r.choice("xy") for _ in range(r.randint(0, 90))) for _ in range(3000)]
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    h = bytes_hash(data, ends - [len(s) for s in spans], ends)
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(spans, h.tolist())))
    values = np.array([5, 6, 7, 5, 6, 6, 5], np.uint64)
    x = lists_hash(values, np.array([0, 2, 3, 5, 7, 7]))
    assert x[0] == x[2] and len(set(x.tolist())) == 4


def test_jaccard_empty(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_substrings(rows, window=35):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    c = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if c[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


def test_substrings(spark):
    rows = corpus(2)
    got = substrings.dedup(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    want = brute_substrings([r[:2] for r in rows])
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(r.n_removed for r in got) > 0
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids(spark):
    """Rows without an id count as other places of a window and as links, and have results of their own."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k * 7919))
    text = lambda a, n=60: " ".join(word(k) for k in range(a, a + n))
    rows = [(5, text(1)), (None, text(1)), (None, text(1)), (None, text(30, 90)), (7, text(1000)), (None, text(2000)), (None, text(2000) + " more"), (None, None), (None, ""), (0, text(3000)), (None, text(4000))]
    df = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in rows], SCHEMA).repartition(3)
    got = substrings.dedup(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_substrings(rows)
    keyed = {(r.doc_id, r.h) for r in df.selectExpr("doc_id", "xxhash64(text) h").collect()}
    assert {(r.doc_id, r.h) for r in got} == keyed
    found = jaccard.linked(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter([(5, 56, 5), (None, 56, 5), (None, 56, 5), (None, 86, None), (7, 56, 7), (None, 56, None), (None, 57, None), (None, 0, None), (None, 0, None), (0, 56, 0), (None, 56, None)])
    assert len({r.component for r in found if r.component is not None}) == 6 and {(r.doc_id, r.h) for r in found} == keyed


def test_symbols_agree():
    """Equal windows have equal anchors and keys, whatever stands round them."""
    r = np.random.default_rng(0)
    for words in (2, 50):
        inside = r.integers(0, words, 35).astype(np.uint64)
        seen = set()
        for _ in range(50):
            a, b = r.integers(0, words, r.integers(0, 30)).astype(np.uint64), r.integers(0, words, r.integers(0, 30)).astype(np.uint64)
            names = np.concatenate([a, inside, b])
            starts, anchor, key = substrings.anchors(names, np.array([0, len(names)]))
            k = int(np.flatnonzero(starts == len(a))[0])
            seen.add((int(anchor[k]) - len(a), int(key[k])))
        assert len(seen) == 1


def test_vectors(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(40):
        v = r.standard_normal(16)
        for _ in range(r.integers(1, 8)):
            rows.append((len(rows), [float(x) for x in v + r.standard_normal(16) * r.choice([0, 0.02, 0.05, 0.08])], int(k % 3)))
    common = [1.0] * 16
    rows += [(len(rows) + k, common, 1) for k in range(60)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, common, None), (n + 4, [None] * 16, 1), (n + 5, [], 1), (n + 6, [1.0, 1.0], 1), rows[0], (rows[1][0], common, 2)]
    got = caps.near(spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label int, node string")).collect()
    good = [(i, np.array(v) / np.linalg.norm(v), lab) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v) else (i, None, lab) for i, v, lab in rows]
    links = defaultdict(set)
    for a, (_, x, l1) in enumerate(good):
        for b, (_, y, l2) in enumerate(good):
            if a != b and x is not None and y is not None and l1 == l2 and len(x) == len(y) and x @ y >= 0.98 - 1e-12:
                links[a].add(b)
    want = Counter()
    for a, (i, *_) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        c = min(good[b][0] for b in seen)
        want[(i, len(links[a]), c, i == c)] += 1
    found = Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got)
    assert sum((found & want).values()) >= 0.97 * len(good)
    assert sum(k[1] * v for k, v in found.items()) >= 0.9 * sum(k[1] * v for k, v in want.items())
    assert found.total() == len(rows)


def test_decode_finds_all_sums_over_the_bound():
    tables = np.random.default_rng(1).standard_normal((3, 6))
    sums = {a * 36 + b * 6 + c: tables[0, a] + tables[1, b] + tables[2, c] for a in range(6) for b in range(6) for c in range(6)}
    order = sorted(sums, key=lambda k: -sums[k])
    for bound in (2.0, 0.5, -9.0):
        assert caps.decode(tables, bound, 0) == [k for k in order if sums[k] >= bound]
    assert caps.decode(tables, 99.0, 15) == order[:15]


@pytest.mark.parametrize("dim", [2, 8, 16, 24, 64, 200])
def test_recall_of_caps(dim):
    """Of random pairs at exactly the cosine, the share that have a filter in common."""
    r = np.random.default_rng(dim)
    x = r.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((300, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    found = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.filters(x), caps.filters(y), strict=True)])
    assert found >= (1 if dim < caps.SHORT else 0.95)


@pytest.mark.parametrize("dim", [16, 24, 64])
def test_links_beyond_the_caps(spark, monkeypatch, dim):
    """Pairs above the cosine that share no cap, beside pairs that do, chains and pairs just below: all links and only those, over many parts."""
    monkeypatch.setattr(caps, "PART", 7)
    monkeypatch.setattr(caps, "WHOLE_PART", 50)
    r = np.random.default_rng(dim)

    def partners(x, cosine):
        y = r.standard_normal(x.shape)
        y -= (x * y).sum(1, keepdims=True) * x
        return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)

    x = r.standard_normal((3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = partners(x, 0.98001)
    apart = np.array([not len(np.intersect1d(a, b)) for a, b in zip(caps.filters(x), caps.filters(y), strict=True)])
    if dim == 16:
        assert apart.any()
    apart[:40] = True
    x, y = x[apart], y[apart]
    v = np.concatenate([x, y, partners(y, 0.99), partners(x, 0.9799)])
    v = np.concatenate([v, v[:30], 3 * v[:30]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    component = np.arange(len(v))
    while True:
        least = np.minimum(component, np.where(link, component[None], len(v)).min(1))
        if (least == component).all():
            break
        component = least
    got = caps.near(spark.createDataFrame([(k, [float(c) for c in x], 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    assert {g.vec_id: (g.n_links, g.component_id, g.kept) for g in got} == {k: (int(link[k].sum()), int(component[k]), bool(component[k] == k)) for k in range(len(v))}


def test_vectors_empty(spark):
    schema = "vec_id long, embedding array<float>, label int, component_id int"
    assert caps.near(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in caps.near(spark.createDataFrame([(1, None, 1, 5), (2, [1.0], None, 5)], schema)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
