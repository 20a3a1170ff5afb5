"""Media, packing, mixing, licenses, pages, classifiers and the pipeline."""

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import cotraining, html_pages, licenses, media, mixing, packing, toxicity
from gridloom.llm.trees import Boosted, calibrated, isotonic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"
ODD = [None, "", " \n", "a", "é" * 700, "x " * 5000, "Über 漢字 €", "it's 12 o'clock\n\n  don't!    you're\u0085"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s" if i % 3 else None, None, -1) for i, t in enumerate(texts)], SCHEMA)


# ---- media


def test_png_round_trip():
    for n in (1, 2, 40):
        payload = np.random.default_rng(n).integers(0, 256, n * media.UNIT).astype(np.uint8).tobytes()
        png = media.encode(payload)
        assert media.decode(png).tobytes() == payload
        for at in (3, 20, len(png) // 2, len(png) - 6):
            broken = bytearray(png)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                media.decode(bytes(broken))


def test_all_filters():
    r = np.random.default_rng(0)
    want, above, lines = r.integers(0, 256, (10, 30)).astype(np.uint8), np.zeros(30, np.int64), []
    for y, row in enumerate(want.astype(np.int64)):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][y % 5]
        lines.append((row - guess) & 255)
        above = row
    assert (media.unfilter(np.arange(10) % 5, np.array(lines).astype(np.uint8)) == want).all()


def test_media_rows(spark):
    rows = media.read_media(media.to_media(frame(spark, [*ODD, "a"]))).orderBy("doc_id").collect()
    for r, t in zip(rows, [*ODD, "a"], strict=True):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.error) == (len(raw), len(full), zlib.crc32(full[-32:]), None)
    assert rows[3][3:] == rows[-1][3:] and re.fullmatch("[0-9a-f]{16}", rows[0].feature)
    bad = spark.createDataFrame([(1, 2, None), (2, 2, bytearray(b"nope"))], "doc_id long, n_bytes long, media binary")
    assert [r.error is None for r in media.read_media(bad).orderBy("doc_id").collect()] == [True, False]


# ---- packing


def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_equals_tokenizer():
    import random

    import pyarrow as pa

    from gridloom.llm.common import texts_of

    from tokenizers import Tokenizer

    enc, r, tok = packing.Encoder(path()), random.Random(1), Tokenizer.from_file(path())
    texts = ["".join(r.choice(" \n\t' \u0085stmdrevl.,!?12é²½ßÀ€漢 XyZ<|>endoftx") for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "|>", "<|endof", "text|>"]
    r.shuffle(texts)
    data, offs = texts_of(pa.array(texts))
    for t, ids in zip(texts, enc.encode(data, offs), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
    enc.plain = False
    assert [x.tolist() for x in enc.encode(data[: offs[50]], offs[:51])] == [tok.encode(t, add_special_tokens=False).ids for t in texts[:50]]


def test_packing(spark):
    import random

    r = random.Random(2)
    texts = [*ODD, *(" ".join("".join(r.choice("abcdefgh") for _ in range(5)) + r.choice(["", "", "."]) for _ in range(r.choice([5, 100, 700, 3000]))) for _ in range(80))]
    df = frame(spark, texts).repartition(2)
    rows = packing.pack(df, path(), with_ids=True).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append(x)
        assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{x.length}I", *x.ids)) and x.length > 0
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda x: x.start)
        assert [v for x in pieces for v in x.ids] == want and all(x.doc_tokens == len(want) for x in pieces)
        assert [x.start for x in pieces] == np.cumsum([0, *(x.length for x in pieces[:-1])]).tolist()
    for pieces in by_seq.values():
        pieces.sort(key=lambda x: x.offset)
        ends = np.cumsum([x.length for x in pieces])
        assert [x.offset for x in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    total = sum(x.length for x in rows)
    assert len(by_seq) <= total / 2048 * 1.06 + 2


@pytest.mark.parametrize("block", [50, 400])
def test_packing_settles_as_one_stream(spark, monkeypatch, block):
    import random

    r = random.Random(8)
    texts = [" ".join(r.choice(["aa", "bb.", "cc"]) for _ in range(r.choice([0, 1, 5, 20, 60, 300]))) for _ in range(150)]
    df = frame(spark, texts).coalesce(1)
    rows = lambda: sorted(map(tuple, packing.pack(df, path(), size=32).collect()), key=str)
    want = rows()
    monkeypatch.setattr(packing, "BLOCK", block)
    assert rows() == want


def test_cuts_are_optimal():
    import random

    r = random.Random(4)
    for _ in range(60):
        size, total = 10, r.randint(12, 60)
        docs = np.array(sorted(r.sample(range(1, total), min(total - 1, r.randint(1, 6)))) + [total])
        marks = np.array(sorted(r.sample(range(1, total), min(total - 1, 12))))
        cost = {p: packing.SENTENCE for p in marks.tolist()} | dict.fromkeys(docs.tolist(), 0)
        got = packing.cuts(docs, marks, total, size)
        at = [0, *sorted(cost)]
        extra = {p: packing.HARD for a, b in zip(at[:-1], at[1:], strict=True) for p in range(a + size, b, size)} if max(np.diff(at)) > size else {}
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a > size:
                extra |= {p: packing.HARD for p in range(a + size, b, size)}
        full = {**{p: c for p, c in extra.items() if p not in cost}, **cost, total: 0}
        best = {0: 0}
        for p in sorted(full):
            best[p] = min((best[q] + size - (p - q) + full[p] for q in best if p - q <= size), default=float("inf"))
        have = sum(size - (b - a) + full[b] for a, b in zip([0, *got[:-1]], got, strict=True))
        assert have == best[total] and got[-1] == total


# ---- mixing


def test_mixing(spark):
    import random

    r = random.Random(0)
    rows = [(i, "w " * r.choice([0, 1, 7, 300]), None, s, None, -1) for i, s in enumerate(r.choices(["a", "b", "c", None, "é", "tiny"], [60, 5, 20, 10, 5, 1], k=400))]
    rows += [(9000, None, None, "a", None, -1), (9001, "", None, "zero", None, -1)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = ({x.doc_id: x for x in mixing.mix(df.repartition(n)).collect()} for n in (1, 7))
    assert {k: (x.target, x.taken) for k, x in a.items()} == {k: (x.target, x.taken) for k, x in b.items()}
    size = defaultdict(int)
    for _, t, _, s, _, _ in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, open_, target = sum(size.values()), set(names), {}
    while True:  # the excess is shared again until no target is above three times its source
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    taken = defaultdict(int)
    for x in a.values():
        taken[x.source] += x.taken
        assert abs(x.target - target[x.source]) < 1e-6 * total and x.taken <= 3 * x.size and x.source_size == size[x.source]
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_apportion_is_sainte_lague(spark):
    import heapq
    import random

    r = random.Random(3)
    for seats in (0, 1, 17, 400):
        w = {k: r.choice([0.0, 1.0, 3.5, 40.0, 41.0]) for k in range(12)}
        df = spark.createDataFrame([(k, v, seats) for k, v in w.items()], "k int, w double, seats long")
        got = {x.k: x.quota for x in mixing.apportion(df, [], "k", "w", "seats").collect()}
        heap, want = [(-v, k) for k, v in w.items() if v], dict.fromkeys(w, 0)
        heapq.heapify(heap)
        for _ in range(seats):
            _, k = heapq.heappop(heap)
            want[k] += 1
            heapq.heappush(heap, (-w[k] / (2 * want[k] + 1), k))
        assert got == want


# ---- licenses


def test_licenses(spark):
    texts = [*ODD, "Under the MIT license. under the mit license under the mit license", "(CC BY-NC 4.0) Apache License, Version 2.0!", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU Lesser General Public License version 3",
             "Licensed under the BSD 3-Clause license", "under themit license", "cc by nc cc by nc", "creative commons attribution sharealike license", "released under the ISC license " * 40]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    n = len(ODD)
    assert [got[n + k].labels for k in (0, 2, 3, 4, 5, 7, 8)] == ["mit", "gpl-3", "lgpl-3", "bsd-3-clause", "", "cc-by-sa", "isc"]


def test_ambiguous_names_alone(spark):
    clean = ["we use python here", "boost your sales", "for the common public good", "php 3 was slow", "x11 forwarding", "IBM public records"]
    named = ["Python Software Foundation License", "Boost Software License 1.0", "Common Public License", "PHP License, version 3.01", "licensed under the X11 license", "IBM Public License"]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, clean + named)).collect()}
    assert [got[i] for i in range(len(clean + named))] == [""] * len(clean) + ["psf-2", "bsl-1", "cpl-1", "php-3", "x11", "ipl-1"]


def shortest(pattern):
    """The shortest matches of a pattern, one for each alternative."""

    def of(items):
        out = [""]
        for op, arg in items:
            if op is parser.LITERAL:
                found = [chr(arg)]
            elif op is parser.IN:
                found = [chr(arg[0][1])] if arg[0][0] is parser.LITERAL else ["7"]
            elif op is parser.SUBPATTERN:
                found = of(arg[3])
            elif op is parser.BRANCH:
                found = [x for b in arg[1] for x in of(b)]
            elif op is parser.MAX_REPEAT:
                found = [x * arg[0] for x in of(arg[2])] if arg[0] else [""]
            else:
                assert op in (parser.ASSERT, parser.ASSERT_NOT)
                found = [""]
            out = list(dict.fromkeys(a + b for a in out for b in found))
        return out

    parser = re._parser
    return of(parser.parse(pattern))


def test_each_rule_alone(spark):
    rules = [(r["prio"], f["label"], re.compile(r["re"], re.A)) for f in licenses.rules() for r in f["rules"]]
    texts = list(dict.fromkeys(t for _, _, e in rules for t in shortest(e.pattern)))
    texts += ["this module is GPL v2 or later", "dual MPL 2.0 and GPL 3", "apache 2 0 applies", "nothing of that sort"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        norm = f" {re.sub('[^a-z0-9]+', ' ', t.lower())} "
        end, labels, prio = -1, set(), 0
        for _, last, p, label in sorted((m.start(), -m.end(), -p, label) for p, label, e in rules for m in e.finditer(norm)):
            if -last > end:
                end, prio = -last, max(prio, -p)
                labels.add(label)
        base = {x for b, x in licenses.BASE.items() if f" {b} " in norm}
        assert got[i].labels == ",".join(sorted(labels | base)) and got[i].score == max(prio / 100, 0.8 if base else 0), t
        assert labels or i == len(texts) - 1, t
    assert [got[len(texts) - k].labels for k in (4, 3, 2)] == ["gpl-2", "gpl-3,mpl-2", "apache-2"]


# ---- pages


@pytest.fixture(scope="module")
def labeller():
    return html_pages.labeller()


def test_blocks():
    page = '<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body><p>A &amp; <b>b</b>\n c<br>d<p>E&#233;<div hidden>no</div><form>f</form><!-- c --><ul><li>g<li>h</ul>tail &lt;x&gt;'
    assert [b.text for b in html_pages.blocks(page)] == ["A & b c d", "Eé", "g", "h", "tail <x>"]
    assert html_pages.blocks("") == [] and [b.text for b in html_pages.blocks("a < b <")] == ["a < b <"]


def test_quotes_open_values_only_after_equals():
    text = lambda page: [b.text for b in html_pages.blocks(page)]
    assert text("<article><p title=it's>Hello world</p><p>second</p></article>") == ["Hello world", "second"]
    assert text("<p>x <a href=foo'bar>link</a> y</p><p>tail</p>") == ["x link y", "tail"]
    assert text("<p 'a>one</p><p \"b>two</p>") == ["one", "two"]
    assert text("<p title = 'a > b' class=\"c > d\">one</p>") == ["one"]
    assert text("<a href=x?a=\"b>one</a>") == ["one"]
    assert text("<p title=\"never closed>one</p>") == []
    assert text("<div title=\"x hidden y\">seen</div><div hidden>no</div><div style='display: none'>no</div><div data-x='1'hidden>no</div>") == ["seen"]


def test_long_attributes_and_deep_pages():
    data = f"data-state='{'x' * 5000}'"
    got = html_pages.blocks(f'<div {data} style="display:none">no</div><div {data} class="advert">yes</div>')
    assert [b.text for b in got] == ["yes"] and got[0].path == ("<div", ".advert")
    for deep in (150, 199, 250, 5000):
        page = "<div>" * deep + "<section class=comments>a<form>f</form><div hidden>no<div>no</div></div><p>b</p></section>c" + "</div>" * deep + "<p>d"
        got = html_pages.blocks(page)
        assert [b.text for b in got] == ["a", "b", "c", "d"]
        assert [(".comments" in b.path, "<div" in b.path) for b in got] == [(True, True), (True, True), (False, True), (False, False)]
    got = html_pages.blocks("<div><b>" * 20_000 + "x" + "</div></i>" * 20_000 + "<form>f</form>y")
    assert [b.text for b in got] == ["x", "y"] and got[1].path == ()
    many = html_pages.blocks("".join(f"<div class=k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>" for k in range(5000)) + "x")[0].path
    assert len(many) == html_pages.STEPS and many[:2] == ("<div", ".kaaa") and many[-1] == f".k{chr(97 + 4999 % 26)}{chr(97 + 4999 // 26 % 26)}{chr(97 + 4999 // 676)}"


def test_pages_of_unseen_layouts(labeller):
    pages = html_pages.training(150, 77)
    found = labeller.label([p for p, _ in pages])
    wrong = sum(int((f != np.array(y, bool)).sum()) for f, (_, y) in zip(found, pages, strict=True))
    assert wrong / sum(len(p) for p, _ in pages) < 0.01


def test_extract(spark, labeller):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title</h1><p>First  part &amp; more text of it.</p><p>Second part, a sentence.</p></article><aside class="sidebar"><p>Read also this.</p></aside><section class="comments"><p>Great post!</p></section><footer>&copy; 2020 us</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<article><p>Open"), (5, "u", "<nav>only</nav>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_pages.extract(df, labeller).collect()}
    want = "Title\n\nFirst part & more text of it.\n\nSecond part, a sentence."
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0) and got[4] == ("Open", 4)


def test_all_words_of_a_block_are_read(labeller):
    start = "one two three four five six seven eight"
    block = lambda t: html_pages.Block(("<body", "<div"), t, 0)
    # texts of equal length and punctuation, so that only words tell them apart
    for a, b in ((f"{start} sponsored", f"{start} something"), (f"{start} " * 400 + "sponsored", f"{start} " * 400 + "something")):
        x, y = (labeller.inputs([block(t)])[0] for t in (a, b))
        assert (x[:, -html_pages.DENSE :] == y[:, -html_pages.DENSE :]).all() and (x != y).any()
    ids, weights, _, _ = html_pages.vectors([block(f"{start} " * 5000)])
    assert len(ids) < 2 * html_pages.WORD_ROWS and abs(weights[-8:].sum() - html_pages.WORD_WEIGHT) < 1e-3


def test_long_pages_are_one_sequence(labeller):
    pages = [p for p, _ in html_pages.training(120, 5)]
    long = [b for p in pages for b in p]
    pages = [long, long[300:900], pages[0]]
    assert len(long) > 3 * html_pages.MOST
    found = labeller.label(pages)
    for p, own in zip(pages, found, strict=True):
        x, mask = labeller.padded([labeller.inputs(p)[0]])
        z = labeller.logits(x, mask)[0][:, 0]
        assert (own == (z > 0))[abs(z) > 1e-3].all()
    for own, z in zip(labeller.sliced(pages, 7), labeller.sliced(pages, 10**6), strict=True):
        assert np.allclose(own, z, atol=1e-3)


# ---- classifiers


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(rounds=60).fit(x[:2000], y[:2000])
    assert ((m.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    knots = isotonic(m.raw(x[2000:]), y[2000:])
    p = calibrated(knots, np.sort(m.raw(x)))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def labelled(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(10, 60))]
        bad = i % 4 == 0
        for _ in range(r.randint(1, 3) if bad else 0):
            w[r.randrange(len(w))] = r.choice(["idiot", "stupid", "zorbly", "zorbint"])
        rows.append((i, " ".join(w), "en", f"s{i % 5}", None, 0))
        labels.append((i, int(not bad), int(bad)))
    rows += [(9000 + k, t, None, None, None, 0) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5000, None, None), (3, 5, 7)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(got) == 908 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    again = docs.repartition(7)
    assert sorted((r.doc_id, r.score) for r in toxicity.score(again, toxicity.fit(again, labels)).collect()) == sorted((r.doc_id, r.score) for r in got)
    none = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_features_of_a_text_alone():
    import random

    import pyarrow as pa

    from gridloom.llm.common import texts_of

    r = random.Random(7)
    texts = ["".join(r.choice("aAbk!!1 .é-") for _ in range(r.choice([0, 1, 2, 3, 40]))) for _ in range(400)]
    keys = np.unique(toxicity.terms(toxicity.LOWER[texts_of(pa.array(texts))[0]], texts_of(pa.array(texts))[1])[3])
    lexicon = toxicity.Lexicon(keys, np.random.default_rng(0).random(len(keys)) * 3)
    for view in (lambda d, o: toxicity.features(d, o, lexicon), cotraining.text_view):
        together = view(*texts_of(pa.array(texts)))
        for k, t in enumerate(texts):
            assert (view(*texts_of(pa.array([t])))[0] == together[k]).all()


def test_quality(spark):
    docs, labels, _ = labelled(spark)
    views = cotraining.views(docs)
    model = cotraining.fit(views, labels)
    got = cotraining.score(views, model).collect()
    assert len(got) == 908 and all(0 <= r.score <= 1 for r in got)
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 50 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.8
    again = cotraining.views(docs.repartition(7))
    assert sorted((r.doc_id, r.score) for r in cotraining.score(again, cotraining.fit(again, labels)).collect()) == sorted((r.doc_id, r.score) for r in got)
    none = cotraining.fit(views, labels.where("doc_id < 0"))
    assert {r.score for r in cotraining.score(views, none).collect()} == {0.5}
    assert cotraining.score(cotraining.views(docs.limit(0)), model).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p
    from gridloom.llm import jaccard, substrings

    docs, labels, _ = labelled(spark)
    docs = docs.drop("size").union(docs.drop("size").limit(3)).selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as int) n_chars")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.schema == docs.schema
        if name == "ngram_jaccard_join":
            roots = {r.component_id for r in jaccard.join(docs).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(roots)
        elif name == "substring_dedup":
            want = {r.doc_id: r.kept.split() for r in substrings.dedup(docs).collect()}
            assert {r.doc_id: (r.text or "").split() for r in after.collect()} == want
        elif name == "source_mixing":
            want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
            have = defaultdict(int)
            for r in after.collect():
                have[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert have == want
        docs = after


def test_pipeline_keeps_rows_without_id(spark, tmp_path):
    import corpus_pipeline as p

    word = lambda k: "".join(chr(97 + int(c)) for c in str(k * 7919))
    text = lambda a, n=60: " ".join(word(k) for k in range(a, a + n))
    rows = [(5, text(1)), (None, text(1)), (None, text(1000, 100)), (None, text(2000)), (None, text(2000)), (7, text(1050, 100)), (None, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert texts(p.toxic_out(spark, docs, str(tmp_path))) == sorted((i or 0, t or "") for i, t in rows)
    one = p.cut(p.one_of_each(spark, docs, ""), "test-one")
    assert texts(one) == sorted([(5, text(1)), (0, text(1000, 100)), (0, text(2000)), (7, text(1050, 100)), (0, ""), (0, ""), (0, "")])
    out = p.cut(p.repeats_out(spark, one, ""), "test-out")
    assert texts(out) == sorted([(5, text(1)), (0, text(1000, 50)), (0, text(2000)), (7, text(1100, 50)), (0, ""), (0, ""), (0, "")])
    taken = p.mixed(spark, out, "").where("doc_id is null").collect()
    want = sum(r.taken for r in mixing.mix(out).collect() if r.doc_id is None)
    assert sum(len(r.text.split()) for r in taken) == want > 0
    assert packing.pack(out, path()).where("doc_id is null").select("start").count() >= 5
